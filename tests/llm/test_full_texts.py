"""Whole texts of long licences, and short ones under copyright lines without a sign or year."""
import os

import pytest

from vecloom.llm import licences

from .cases import documents

FILES = "/usr/share/common-licenses"


def found(spark, rows):
    return {r["doc_id"]: r["licence"] for r in licences.scan(documents(spark, list(enumerate(rows)))).collect()}


@pytest.mark.skipif(not os.path.isdir(FILES), reason="no licence files")
def test_whole_texts_of_long_licences(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0"}
    rows = [open(f"{FILES}/{f}", encoding="utf-8").read() for f in names]
    want = list(names.values())
    rows += [rows[0].replace("[yyyy] [name of copyright owner]", "2020 Jane Doe"), rows[0] + "\nmore"]
    assert found(spark, rows) == dict(enumerate([*want, "Apache-2.0", None]))


def test_copyright_lines_of_a_holder_or_a_place_for_the_year(spark):
    mit, bsd = licences.KNOWN[0][1], next(t for n, t in licences.KNOWN if n == "BSD-3-Clause")
    heads = ["Copyright Jane Doe\n", "Copyright <year> <holder>\n\n", "Copyright [yyyy] Jane Doe\r\n", "Copyright by The Authors\n"]
    rows = [h + t for t in (mit, bsd) for h in heads] + ["Copyright holders must ask first.\n" + mit, mit.replace("COPYRIGHT HOLDERS", "\nCOPYRIGHT HOLDERS")]
    assert found(spark, rows) == dict(enumerate(["MIT"] * 4 + ["BSD-3-Clause"] * 4 + [None, "MIT"]))
