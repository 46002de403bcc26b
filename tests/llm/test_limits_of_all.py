"""Limits of the quality rules come from all labelled documents, however many."""
import random

import numpy as np
import pytest
import zstandard

from vecloom.llm import quality


def text(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


WORDS = [f"{a}{b}{c}" for a in ("ba", "ke", "mur", "sol") for b in ("nd", "l", "rt", "v") for c in ("en", "is", "o", "ark", "el")]


def fitted(texts):
    pack, rows = zstandard.ZstdCompressor(level=quality.LEVEL), []
    for t in texts:
        n, _, _, _, rep = quality.counts(t)
        if not quality.base_failed(n, rep):
            raw = t.encode()
            rows.append((len(raw), *quality.ratios(raw, pack)))
    chunks = [f(c) for n, _, c in rows if n >= 1.5 * quality.CHUNK for f in (min, max)]
    return quality.fit(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array(chunks))


def same(a, b):
    for x, y in zip((a.at, a.least, a.most, a.chunk), (b.at, b.least, b.most, b.chunk)):
        assert x == pytest.approx(y, rel=1e-9)


@pytest.mark.parametrize("n", [90, 640, 20_700])
def test_limits_of_all_labelled_documents(spark, n):
    rng = random.Random(n)
    rows = [(i, text(rng, rng.randint(60, 90) if n > 1000 else rng.choice([70, 400, 2000]))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "few words"), (None, rows[0][1]), (0, rows[1][1])]  # one id twice
    labels = [(i, 1) for i in range(n + 3)] + [(5, 1), (7 * n, 1), (None, 1)] + [(i, 0) for i in range(n, n + 3)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int")
    got, want = quality.limits_of(docs, marks), fitted([t for i, t in rows if i is not None])
    assert (got == quality.WIDE) == (n < quality.ENOUGH)
    same(got, want)
    if n == 640:
        assert got.chunk != quality.WIDE.chunk
        alike = spark.createDataFrame([(i, rows[3][1]) for i in range(150)], "doc_id long, text string")
        same(quality.limits_of(alike, marks), fitted([rows[3][1]] * 150))
