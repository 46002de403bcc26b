"""Small cases of single operators."""
import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecloom.functions import rules, vector
from vecloom.operators import admission, ann, compaction, liveness, lww, measure, placement, search, tag_index
from vecloom.sources import cbor, config, synthetic, wal

LOG = "id string, vector array<double>, tags array<string>, ts long, version long, tombstone boolean, segment_id long"


def log(spark, *rows):
    """(id, vector, ts, version, segment) or with None as vector for a tombstone."""
    return spark.createDataFrame([(i, v, [], ts, ver, v is None, seg) for i, v, ts, ver, seg in rows], LOG)


def test_kernels(spark):
    rows = spark.createDataFrame([([1.0, 0.0, 0.0], [0.0, 1.0, 0.0]), ([1.0, 2.0, 2.0], [1.0, 2.0, 2.0]), ([0.0, 0.0, 0.0], [1.0, 0.0, 0.0]), ([], [])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = [tuple(r) for r in rows.select(vector.l2_squared(a, b), vector.dot(a, b), vector.cosine(a, b), vector.norm(a)).collect()]
    assert got == [(2.0, 0.0, 0.0, 1.0), (0.0, 9.0, 1.0, 3.0), (1.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0)]
    with pytest.raises(ValueError):
        vector.score("manhattan", a, b)
    vector.register(spark)
    assert spark.sql("SELECT vec_l2(array(1,0), array(0,1)), vec_cosine(array(0,0), array(1,0)), tags_all(array('x','y'), array('x'))").first()[:] == (2.0, 0.0, True)


def test_exact_search_orders_ties_and_edges(spark):
    rows = spark.createDataFrame([("row-0", [1.0, 0.0]), ("row-1", [0.0, 1.0]), ("row-2", [0.9, 0.1]), ("row-3", [-1.0, 0.0]), ("row-4", [1.0, 0.0]), ("none", [])], "id string, vector array<double>")
    assert [r["id"] for r in search.top_k(rows, [1.0, 0.0], 3, "l2").collect()] == ["row-0", "row-4", "row-2"]
    assert search.top_k(rows, [], 5).count() == 0 and search.top_k(rows, [1.0, 0.0], 0).count() == 0


def test_merge_keeps_best_score(spark):
    hits = spark.createDataFrame([("a", 1.0), ("b", 0.5), ("a", 2.0), ("c", 0.9)], "id string, score double")
    assert [tuple(r) for r in search.merge_top_k(hits, 2).collect()] == [("a", 2.0), ("c", 0.9)]


def test_stale_version_is_rescored(spark):
    rows = log(spark, ("a", [1.0, 0.0], 10, 0, 1), ("a", [-1.0, 0.0], 20, 0, -1))
    assert [tuple(r) for r in search.segmented(rows, [1.0, 0.0], 1, 18).collect()] == [("a", -4.0)]
    gone = log(spark, ("a", [1.0, 0.0], 10, 0, 1), ("a", None, 20, 0, -1))
    assert search.segmented(gone, [1.0, 0.0], 1, 18).count() == 0 and lww.get(gone, "a").count() == 0


def test_equal_versions_prefer_memtable_then_oldest_segment(spark):
    rows = log(spark, ("a", [1.0], 5, 1, 2), ("a", [2.0], 5, 1, 1), ("b", [1.0], 5, 1, 3), ("b", [2.0], 5, 1, -1))
    assert {r["id"]: r["vector"] for r in lww.newest(rows).collect()} == {"a": [2.0], "b": [2.0]}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcd"), st.integers(0, 5), st.integers(0, 3), st.booleans()), min_size=1, max_size=40))
def test_visible_equals_a_fold(spark, writes):
    best = {}
    for i, (key, ts, version, gone) in enumerate(writes):
        if key not in best or (ts, version) > best[key][:2]:
            best[key] = (ts, version, gone, i)
    rows = spark.createDataFrame([(k, None if g else [float(i)], [], ts, v, g, i) for i, (k, ts, v, g) in enumerate(writes)], LOG)
    assert {r["id"]: r["vector"] for r in lww.visible(rows).collect()} == {k: [float(i)] for k, (_, _, g, i) in best.items() if not g}


def test_partial_compaction_keeps_tombstones(spark):
    rows = log(spark, ("k", [1.0], 10, 0, 1), ("k", None, 20, 0, 2), ("other", [3.0], 15, 0, 3))
    part = compaction.compact(rows, [2, 3])
    assert {(r["id"], r["tombstone"]) for r in part.collect()} == {("k", True), ("other", False)}
    assert {r["id"] for r in compaction.compact(rows).collect()} == {"other"}
    assert compaction.needs_compaction(rows).first()[0]


def test_tiers(spark):
    sizes = spark.createDataFrame([(i, n) for i, n in enumerate([0, 1, 3, 4, 15, 16, 64])], "segment_id long, row_count long")
    assert [r[0] for r in sizes.orderBy("segment_id").select(rules.size_tier(F.col("row_count"))).collect()] == [0, 0, 0, 1, 1, 2, 3]
    mixed = spark.createDataFrame([(i, n) for i, n in enumerate([1, 1, 1, 8, 8, 8, 8])], "segment_id long, row_count long")
    assert sorted(r["segment_id"] for r in compaction.pick_tier(mixed).collect()) == [3, 4, 5, 6]
    assert compaction.pick_tier(mixed, 0).count() == 0
    assert compaction.plan_cascade({1: 1, 2: 1, 3: 1, 4: 1}) == [[1, 2, 3, 4]] and compaction.plan_cascade({1: 1}) == []


def test_tags(spark):
    rows = spark.createDataFrame([(0, 0, ["red", "sale", "red"]), (0, 1, ["blue"]), (0, 2, ["red"]), (0, 3, []), (0, 4, None)], "segment_id long, ord long, tags array<string>")
    assert tag_index.matching(rows, ["red"]).count() == 2 and tag_index.matching(rows, ["red", "sale"]).count() == 1
    assert tag_index.matching(rows, ["green"]).count() == 0 and tag_index.matching(rows, []).count() == 5
    assert tag_index.cardinality(tag_index.inverted(rows), ["red", "sale"]).first()["n"] == 1


def test_ring_matches_a_walk(spark):
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(5)], "node string")
    tokens = placement.ring(nodes, vnodes=8)
    keys = spark.createDataFrame([(f"key-{i}",) for i in range(300)], "key string")
    ring = sorted((r["token"], r["node"]) for r in tokens.collect())
    import hashlib

    def walk(key):
        h = int(hashlib.md5(key.encode()).hexdigest()[:15], 16)
        order = [n for t, n in ring if t >= h] + [n for t, n in ring if t < h]
        return list(dict.fromkeys(order))[:3]

    got = {}
    for r in placement.replicas(keys, tokens, 3).orderBy("key", "n").collect():
        got.setdefault(r["key"], []).append(r["node"])
    assert got == {f"key-{i}": walk(f"key-{i}") for i in range(300)}
    assert placement.replicas(keys, tokens, 0).count() == 0 and placement.replicas(keys, tokens.limit(0), 2).count() == 0
    moved = placement.plan_remove(keys, tokens, "n0", 1)
    assert {r["from_node"] for r in moved.collect()} == {"n0"} and moved.filter("durable or to_node = 'n0'").count() == 0


def test_quota_and_rate(spark):
    writes = spark.createDataFrame([("c", 1, "put", "a"), ("c", 2, "put", "b"), ("c", 3, "put", "a"), ("c", 4, "put", "x"), ("c", 5, "delete", "a"), ("c", 6, "put", "x")], "collection string, seq long, op string, id string")
    assert [r["admitted"] for r in admission.quota(writes, 2).orderBy("seq").collect()] == [True, True, True, False, True, False]
    assert [r["admitted"] for r in admission.quota_with_deletes(writes, 2).orderBy("seq").collect()] == [True, True, True, False, True, True]
    asks = spark.createDataFrame([("c", i, t) for i, t in enumerate([0, 1, 2, 10, 11, 12, 30])], "collection string, seq long, ts long")
    assert [r["admitted"] for r in admission.rate(asks, 2, 10).orderBy("seq").collect()] == [True, True, False, True, True, False, True]
    sizes = spark.createDataFrame([("c", 1, 60), ("c", 2, 50), ("c", 3, 101)], "collection string, seq long, bytes long")
    assert [r["admitted"] for r in admission.memory(sizes, 100).orderBy("seq").collect()] == [True, True, False]


def test_phi_grows_with_silence(spark):
    beats = spark.createDataFrame([("n", 100 * i) for i in range(10)] + [("once", 0)] + [("fast", i) for i in range(20)], "endpoint string, now_ms long")
    at = lambda t, **kw: {r["endpoint"]: r for r in liveness.phi(beats, F.lit(t), **kw).collect()}
    assert at(900)["n"]["phi"] < 1 < at(1400)["n"]["phi"] and not at(3400)["n"]["available"]
    # one heartbeat: a mean of a second; fast ones: a mean of 100 ms; a pause does not count
    assert at(3400)["once"]["available"] and not at(20_000)["once"]["available"] and at(2000)["once"]["mean_ms"] == 1000
    assert at(119)["fast"]["phi"] == pytest.approx(math.log10(math.e)) and at(119, pause_ms=500)["fast"]["phi"] == 0


def test_gossip(spark):
    kind = "endpoint string, generation long, version long, status string"
    s = spark.createDataFrame([("a", 1, 5, "Alive"), ("a", 1, 9, "Dead"), ("a", 2, 1, "Alive"), ("b", 1, 3, "Left"), ("b", 1, 7, "Alive"), ("c", 1, 4, "Alive"), ("c", 1, 4, "Left")], kind)
    assert {tuple(r) for r in liveness.merge_gossip(s).collect()} == {("a", 2, 1, "Alive"), ("b", 1, 7, "Alive"), ("c", 1, 4, "Left")}


def test_gossip_round_and_tick(spark):
    """A newer heartbeat is taken whole, Alive after Left and after Dead too; an echo of the same one changes nothing but a leave."""
    kind = "endpoint string, generation long, version long, status string"
    mine = spark.createDataFrame([("me", 1, 5, "Alive"), ("left", 1, 3, "Left"), ("dead", 1, 3, "Dead"), ("echo", 1, 3, "Dead"), ("goes", 1, 3, "Alive"), ("old", 2, 1, "Alive"), ("mine", 1, 1, "Alive")], kind)
    theirs = spark.createDataFrame([("me", 9, 9, "Left"), ("left", 1, 4, "Alive"), ("dead", 1, 4, "Alive"), ("echo", 1, 3, "Alive"), ("goes", 1, 3, "Left"), ("old", 1, 9, "Left"), ("new", 1, 1, "Dead")], kind)
    got = {r[0]: tuple(r[1:]) for r in liveness.gossip_round(mine, theirs, "me").collect()}
    assert got == {"me": (1, 5, "Alive"), "left": (1, 4, "Alive"), "dead": (1, 4, "Alive"), "echo": (1, 3, "Dead"), "goes": (1, 3, "Left"), "old": (2, 1, "Alive"), "mine": (1, 1, "Alive"), "new": (1, 1, "Dead")}
    beats = spark.createDataFrame([("me", 0), ("goes", 0), ("old", 9_500), ("left", 0)], "endpoint string, now_ms long")
    after = {r[0]: r[3] for r in liveness.tick(mine, beats, F.lit(30_000), "me").collect()}
    assert after == {"me": "Alive", "left": "Left", "dead": "Dead", "echo": "Dead", "goes": "Dead", "old": "Dead", "mine": "Alive"}


def test_hash64_parity(spark):
    """Against the published FNV-1a and splitmix64, one byte at a time."""
    def finish(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * factor % (1 << 64)
        return x ^ x >> 31

    def plain(text, seed):
        h = 0xCBF29CE484222325 ^ finish(seed)
        for b in text.encode():
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return finish(h)

    rows = [("", 0), ("a", 0), ("node-1", 7), ("ünïcode 👍", 3), ("x" * 300, 2**40)]
    df = spark.createDataFrame(rows, "t string, seed long")
    assert [r[0] + (1 << 63) for r in df.select(placement.hash64(F.col("t"), F.col("seed"))).collect()] == [plain(*r) for r in rows]
    from vecloom.plans import catalogue

    for r in catalogue.queries()["hash64_parity"](spark, "/root/testdata/sf0.001").collect():
        assert int(r["hash"]) == plain(r["n_name"], r["seed"])
    # a ring by it, walked
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(5)], "node string")
    tokens = sorted((plain(f"n{i}", v), f"n{i}") for i in range(5) for v in range(8))
    keys = [f"key-{i}" for i in range(200)]
    walk = lambda key: list(dict.fromkeys([n for t, n in tokens if t >= plain(key, 0)] + [n for t, n in tokens]))[:2]
    found = {}
    for r in placement.replicas(spark.createDataFrame([(k,) for k in keys], "key string"), placement.ring(nodes, vnodes=8, by=placement.FNV), 2, by=placement.FNV).orderBy("key", "n").collect():
        found.setdefault(r["key"], []).append(r["node"])
    assert found == {k: walk(k) for k in keys}


def test_replicated_rows_survive_a_node(spark):
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(4)], "node string")
    rows = spark.createDataFrame([(f"k{i}", i, "own") for i in range(100)], "key string, value long, token string")
    tokens = placement.ring(nodes, vnodes=8)
    held = placement.write_replicated(rows, tokens, 2)
    assert held.count() == 200 and held.columns == ["node", *rows.columns]
    for gone in ("n0", "n3"):
        got = placement.read_any(held, [f"n{i}" for i in range(4) if f"n{i}" != gone], order=("node",))
        assert sorted((r["key"], r["value"]) for r in got.collect()) == sorted((f"k{i}", i) for i in range(100))


def test_batch_search_passes_over_unfit_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.5, None]), (None, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0, 0.0]), *[(i, [float("nan"), 0.0]) for i in range(10, 14)]], "id long, vector array<double>")
    asked = spark.createDataFrame([(9, [1.0, 0.0]), (8, None), (7, [1.0, 2.0, 3.0])], "query_id long, qvec array<double>")
    for block in (1, 100):
        got = [(r["query_id"], r["rank"], r["id"]) for r in search.batch_top_k(rows, asked, 2, block=block).orderBy("query_id", "rank").collect()]
        assert got == [(9, 1, 1), (9, 2, 6)]
    assert search.batch_top_k(rows, asked.limit(0), 2).count() == 0


def test_pinned_graph_search_is_the_whole_one(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(f"d{i}", i % 2, rng.normal(size=8).tolist()) for i in range(300)], "id string, segment_id long, vector array<double>")
    edges = ann.graph_edges(rows).cache()
    asked = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(5)], "query_id long, qvec array<double>")
    find = lambda **kw: sorted(map(tuple, ann.graph_search(rows, edges, asked, 5, **kw).collect()))
    assert len(find()) == 25 and find() == find(pinned=ann.pin(edges))


def _large_segments(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(f"d{i}", i % 2, rng.normal(size=8).tolist()) for i in range(600)], "id string, segment_id long, vector array<double>")
    asked = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(5)], "query_id long, qvec array<double>")
    return rows, asked, ann.graph_edges(rows, part=100).cache()


def test_graphs_of_a_large_segment_are_bounded(spark):
    rows, asked, edges = _large_segments(spark)
    nodes = edges.filter("layer = 0").groupBy("segment_id", "part").count().collect()
    assert len(nodes) == 6 and sum(r["count"] for r in nodes) == 600 and max(r["count"] for r in nodes) < 150
    got = {(r["query_id"], r["rank"]): r["id"] for r in ann.graph_search(rows, edges, asked, 5, beam=200).collect()}
    truth = {}
    for q, v in asked.collect():
        near = sorted(rows.collect(), key=lambda r: -np.dot(r["vector"], v) / np.linalg.norm(r["vector"]))
        truth |= {(q, n + 1): near[n]["id"] for n in range(5)}
    assert got == truth
    old = ann.graph_edges(rows).drop("part")  # as stored by earlier versions, one graph a segment
    assert len(ann.graph_search(rows, old, asked, 5).collect()) == 25


def test_pinned_search_of_a_large_segment(spark):
    rows, asked, edges = _large_segments(spark)
    assert {part for _, part in ann.pin(edges)} == {0, 1, 2}
    find = lambda **kw: sorted(map(tuple, ann.graph_search(rows, edges, asked, 5, **kw).collect()))
    assert len(find()) == 25 and find() == find(pinned=ann.pin(edges))


def test_invariants_of_a_large_segment(spark):
    """Nodes of one graph are no neighbours of another's, and lists are pruned as one by one."""
    _, _, edges = _large_segments(spark)
    assert [r["n"] for r in ann.check_edges(edges).collect()] == [0, 0, 0]
    strange = edges.withColumn("part", F.when(F.col("ord") == 3, 9).otherwise(F.col("part")))
    assert ann.check_edges(strange).filter("problem = 'absent'").first()["n"] > 0
    m = np.random.default_rng(1).normal(size=(40, 8))
    for metric in ("cosine", "l2"):
        g = ann.Graph(m, metric)
        lists = [list(range(20)), list(range(10, 30))]
        near = lambda i, to: sorted(zip(g.scores(g.m[i], to).tolist(), to), key=lambda x: (-x[0], x[1]))
        assert g._prune([35, 36], lists) == [g._spread(near(i, to), 19) for i, to in zip((35, 36), lists)]


def _peak(spark, monkeypatch, plan, *cell) -> int:
    """Bytes that a task of a batch search of 2,000 queries holds over one batch of 10,000 rows."""
    rng = np.random.default_rng(2)
    tasks = []
    real = type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, f, schema: tasks.append(f) or real(self, f, schema))
    plan(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(2_000, 4)))], "query_id long, qvec array<double>"))
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(rng.normal(size=(10_000, 4)).tolist()), *cell], names=["id", "vector", "cell"][: 2 + len(cell)])
    tracemalloc.start()
    out = list(tasks[-1](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in out) == 20_000
    return peak


def test_batch_search_holds_a_tile_of_scores(spark, monkeypatch):
    rows = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "id long, vector array<double>")
    assert _peak(spark, monkeypatch, lambda asked: search.batch_top_k(rows, asked, 10)) < 80e6


def test_inverted_file_holds_a_tile_of_scores(spark, monkeypatch):
    rows = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], 0)], "id long, vector array<double>, cell long")
    assert _peak(spark, monkeypatch, lambda asked: ann.ivf_search(rows, np.ones((1, 4)), asked, 10), pa.array([0] * 10_000)) < 80e6


def test_knn_table_function(spark):
    from vecloom.functions import vector

    vector.register(spark)
    spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 0, [0.0, 1.0]), ("c", 1, [1.0, 0.0]), ("d", 1, None)], "id string, segment_id long, vector array<double>").createOrReplaceTempView("knn_rows")
    got = spark.sql("SELECT id, rank, score FROM knn(TABLE(knn_rows) PARTITION BY (segment_id), array(1D, 0D), 'cosine', 1)").collect()
    assert sorted(map(tuple, got)) == [("a", 1, 1.0), ("c", 1, 1.0)]


def test_log_survives_and_cuts(spark, tmp_path):
    from vecloom.sources import store, wal

    row = lambda i: {"id": f"r{i}", "vector": [float(i), 0.5], "metadata": b"m", "tags": ["t"], "ts": i, "version": 0, "tombstone": False}
    for policy in wal.SYNC:
        files = store.Files(spark, f"file://{tmp_path}/{policy}")
        log = wal.Log(files, sync=policy, batch=2)
        log.append([row(1)])
        log.append([row(2), {**row(3), "vector": None, "tombstone": True}])
        old = log.cut()
        log.append([row(4)])
        log.sync()
        assert [r["id"] for r in wal.Log(files).rows()] == ["r1", "r2", "r3", "r4"] and next(wal.Log(files).rows()) == row(1)
        log.drop(old)
        assert [r["id"] for r in wal.Log(files).rows()] == ["r4"]
    # a store that cannot append
    log = wal.Log(files, "remote", "batch", 2)
    log.local, log.handle = None, None
    for i in range(5):
        log.append([row(i)])
    assert [r["id"] for r in log.rows()] == ["r0", "r1", "r2", "r3"]
    log.close()
    assert [r["id"] for r in log.rows()][-1] == "r4"


def test_two_writers_conflict(spark, tmp_path):
    from vecloom.sources.store import Conflict, SegmentStore

    one, two = SegmentStore(spark, f"file://{tmp_path}/s"), SegmentStore(spark, f"file://{tmp_path}/s")
    seen = two.manifest()["generation"]
    one.publish([], after=0)
    with pytest.raises(Conflict):
        two.publish([], after=seen)
    assert two.files.claim("manifests/000000000002.claim")
    with pytest.raises(Conflict):
        one.publish([])
    spark.range(1).selectExpr("cast(id as string) id").write.parquet(f"file://{tmp_path}/s/segments/segment_id=9")
    assert one.orphans(3600) == [] and one.orphans() == ["segments/segment_id=9", "manifests/000000000002.claim"][:1] and one.collect_garbage() and one.orphans() == []


def test_embedded():
    from vecloom.embedded import Db

    db = Db(2, "l2", flush_rows=2, compact_at=3)
    for i in range(7):
        db.upsert(f"r{i}", [float(i), 0.0], ["even"] if i % 2 == 0 else [], ts=1)
    db.delete("r0", ts=2)
    db.upsert("r1", [9.0, 0.0], ts=0)
    assert db.get("r0") is None and db.get("r1")["vector"] == [1.0, 0.0]
    assert [i for i, _ in db.search([0.0, 0.0], 2)] == ["r1", "r2"] and [i for i, _ in db.search([0.0, 0.0], 9, ["even"])] == ["r2", "r4", "r6"]
    db.compact()
    assert len(db.segments) == 1 and len(db.segments[0]) == 6 and not db.memtable
    with pytest.raises(ValueError):
        db.upsert("x", [1.0])


def test_agreement(spark):
    kind = "query_id long, rank int, id string, score double"
    truth = spark.createDataFrame([(1, 1, "a", 0.9), (1, 2, "b", 0.8), (1, 3, "c", 0.7)], kind)
    other = spark.createDataFrame([(1, 1, "a", 0.88), (1, 2, "c", 0.7), (1, 3, "d", 0.6)], kind)
    r = measure.agreement(truth, other).first()
    assert (r["overlap"], round(r["recall"], 6), r["jaccard"], r["ranks_equal"], r["mean_shift"], r["max_shift"], round(r["score_mae"], 6)) == (2, 0.666667, 0.5, 1, 0.5, 1, 0.01)
    assert measure.verdict(measure.agreement(truth, truth)).first()["verdict"] == "match"
    assert measure.same_ranking(truth, truth).first()["same"] and not measure.same_ranking(truth, other).first()["same"]


@given(st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**63 - 1) | st.floats(allow_nan=False) | st.text(max_size=8) | st.binary(max_size=8), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=12))
@settings(deadline=None)
def test_cbor_round_trip(value):
    assert cbor.decode(cbor.encode(value)) == value


def test_cbor_bytes():
    assert [cbor.encode(v).hex() for v in (0, 24, True, None, "a", [], {})] == ["00", "1818", "f5", "f6", "6161", "80", "a0"]
    for bad in (b"", b"\x18", b"\x00\x00", b"\x9f\xff", b"\xa1\x01\x02", b"\x61\xff"):
        with pytest.raises(cbor.CborError):
            cbor.decode(bad)


def test_wal_stops_at_damage(spark, tmp_path):
    rows = [wal.encode_row({"id": str(i), "vector": [1.0], "ts": i}) for i in range(4)]
    raw = wal.frames(rows)
    assert list(wal.replay(raw)) == rows and list(wal.replay(raw[:-1])) == rows[:3]
    damaged = bytearray(raw)
    damaged[len(wal.frames(rows[:2])) + 14] ^= 1
    assert list(wal.replay(bytes(damaged))) == rows[:2]
    (tmp_path / "log").write_bytes(bytes(damaged))
    assert wal.read(spark, str(tmp_path / "log")).count() == 2


def test_config(spark, tmp_path):
    assert config.load_toml('http_port = 80\nmetric = "l2"') == {"http_port": 80, "metric": "l2"}
    for bad in ("x = 1", "http_port = 'a'", "http_port ="):
        with pytest.raises(ValueError):
            config.load_toml(bad)
    (tmp_path / "c").write_text("a\t8\tl2\nbad\nb\t4\tdot\tcold\t9\n")
    got = {r["name"]: r for r in config.read_catalogue(spark, str(tmp_path / "c")).collect()}
    assert set(got) == {"a", "b"} and got["a"]["storage_mode"] == "hot" and got["b"]["max_vectors"] == 9


def test_graph_recall():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(16, 24))
    m = centres[rng.integers(0, 16, 500)] + 0.2 * rng.normal(size=(500, 24))
    g = ann.Graph(m, "l2")
    hits = 0
    for q in random.Random(1).sample(range(500), 30):
        truth = np.argsort(np.square(m - m[q]).sum(1), kind="stable")[:10]
        hits += len(set(truth.tolist()) & {i for _, i in g.search(m[q], 10)})
    assert hits / 300 >= 0.95
    assert ann.Graph(np.zeros((0, 4))).search(np.ones(4), 3) == []


def test_synthetic_is_reproducible(spark):
    a, b = ([tuple(r["vector"]) for r in synthetic.clustered(spark.newSession(), 40, 6).orderBy("id").collect()] for _ in range(2))
    assert a == b and abs(sum(x * x for x in a[0]) - 1) < 1e-5
