"""Every registered query against its SQL counterpart."""
import datetime
import math
import os

import duckdb
import pytest

from vecloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{data}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, data, duck, name):
    df = catalogue.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = sorted((str([plain(r[c]) for c in cols]) for r in df.collect()))
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = duck.sql(sql)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(str([plain(r[i]) for i in at]) for r in rel.fetchall())


def test_recall_gate(spark, data):
    for name, least in (("ann_ivf_recall", 0.9), ("ann_hnsw_recall", 0.95)):
        assert catalogue.queries()[name](spark, data).first()["recall"] >= least
    assert all(r["same"] for r in catalogue.queries()["ann_hnsw_pinned"](spark, data).collect())
