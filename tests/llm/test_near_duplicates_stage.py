"""The pipeline's near-duplicate stage: five words, 80 %."""
import corpus_pipeline

from .cases import components, documents, shingles


def test_copies_between_80_and_85_percent_are_duplicates(spark):
    words = [f"w{i}" for i in range(500)]
    rows = [(0, " ".join(words)), (1, " ".join([*words, *[f"x{i}" for i in range(100)]])), (2, " ".join([*words, *[f"y{i}" for i in range(140)]]))]
    want = components({i: shingles(t, 5) for i, t in rows}, 80)
    assert set(want.values()) == {0, 2} and set(components({i: shingles(t) for i, t in rows}).values()) == {0, 1, 2}
    got = corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows, extra=False), "")
    assert {r["doc_id"] for r in got.collect()} == {0, 2}
