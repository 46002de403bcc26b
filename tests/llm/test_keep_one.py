"""Near duplicates: one row of each component, whatever its ids."""
from collections import Counter

from vecloom.llm import jaccard_join

from .cases import PROSE, documents

A, B = " ".join(PROSE), " ".join(reversed(PROSE))


def kept(spark, rows):
    return Counter((r["doc_id"], r["text"]) for r in jaccard_join.keep_one(documents(spark, rows, extra=False)).collect())


def test_null_ids_stay_where_nothing_else_does(spark):
    spark_rows = [(i, t, "a") for i, t in [(None, A), (None, None), (None, ""), (1, B), (None, B), (2, None)]]
    docs = spark.createDataFrame(spark_rows, "doc_id long, text string, source string").repartition(3)
    got = Counter((r["doc_id"], r["text"]) for r in jaccard_join.keep_one(docs).collect())
    assert got == Counter([(None, A), (None, None), (None, ""), (1, B), (2, None)])


def test_repeated_ids_leave_one_row_of_each_component(spark):
    assert kept(spark, [(3, A), (3, A), (3, A), (4, A)]) == Counter([(3, A)])
    # id 1 leads its own group B and is a copy of id 0 in A: only its row in B stays
    assert kept(spark, [(0, A), (1, A + " end"), (1, B), (2, B)]) == Counter([(0, A), (1, B)])
    assert kept(spark, [(7, ""), (7, ""), (7, None)]) == Counter([(7, ""), (7, ""), (7, None)])
