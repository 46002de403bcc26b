"""The registered queries over the driver's tables, each with its SQL counterpart.

Collections derived from the tables: `vec` (embeddings as rows), `vec_log`
(originals, negated second versions of every fifth and tombstones of every
seventh), `doc_log` (events as versions of users' rows), `oplog` and heartbeats
(events), and a ring of nations with orders as keys.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import engine
from ..functions import rules, vector
from ..operators import admission, ann, compaction, liveness, lww, measure, placement, search, tag_index
from ..session import table
from ..sources import store
from ..streaming import upsert

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = sql
        return f

    return add


# Collections ---------------------------------------------------------------

_VEC = """vec AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vector, label, vec_id AS ts, 0 AS version, vec_id % 4 AS segment_id,
  ['label:' || label, CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END] AS tags FROM embeddings)"""
_LOG = """vl AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS vector, 0 AS version, false AS tombstone FROM embeddings
  UNION ALL SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: -x), 1, false FROM embeddings WHERE vec_id % 5 = 0
  UNION ALL SELECT vec_id, NULL, 2, true FROM embeddings WHERE vec_id % 7 = 0),
vec_log AS (SELECT *, CASE WHEN (id + version) % 4 = 3 THEN -1 ELSE (id + version) % 4 END AS segment_id FROM vl),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS rn FROM vec_log) WHERE rn = 1)"""
_DOC = """doc_log AS (SELECT user_id AS id, epoch_us(ts) AS ts, event_id AS version, event_type = 'error' AS tombstone, event_type, value, props,
  epoch_us(ts) // 86400000000 AS segment_id FROM events),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, version DESC) AS rn FROM doc_log) WHERE rn = 1)"""
_Q = "(SELECT vector FROM vec WHERE id = 0)"
_COS = "list_cosine_similarity({a}, {b})"
_L2 = "(0::DOUBLE - list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"


def vec(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label", F.array(F.concat(F.lit("label:"), F.col("label").cast("string")), F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd")).alias("tags"),
        F.col("vec_id").alias("ts"), F.lit(0).cast("long").alias("version"), F.lit(False).alias("tombstone"), (F.col("vec_id") % 4).alias("segment_id"),
    )


def vec_log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")

    def versions(rows: DataFrame, v, number: int, gone: bool) -> DataFrame:
        segment = (F.col("vec_id") + number) % 4
        return rows.select(F.col("vec_id").alias("id"), v.cast("array<double>").alias("vector"), F.lit(0).cast("long").alias("ts"), F.lit(number).cast("long").alias("version"), F.lit(gone).alias("tombstone"), F.when(segment == 3, lww.MEMTABLE).otherwise(segment).cast("long").alias("segment_id"))

    first = versions(e, F.col("embedding"), 0, False)
    second = versions(e.filter(F.col("vec_id") % 5 == 0), F.transform("embedding", lambda x: -x), 1, False)
    return first.unionByName(second).unionByName(versions(e.filter(F.col("vec_id") % 7 == 0), F.lit(None), 2, True))


def doc_log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(F.col("user_id").alias("id"), us.alias("ts"), F.col("event_id").alias("version"), (F.col("event_type") == "error").alias("tombstone"), "event_type", "value", "props", F.expr("unix_micros(cast(ts as timestamp)) div 86400000000").alias("segment_id"))


def query_vector(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    """The vector of one row, as a search request would bring it."""
    rows = table(spark, d, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").limit(1).collect()
    return list(rows[0][0]) if rows else []


def _long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


def _score(hits: DataFrame) -> DataFrame:
    return hits.select(F.col("id").cast("long"), F.round("score", 6).alias("score"))


# Kernels and search ----------------------------------------------------------


def _knn(metric: str, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _score(search.top_k(vec(spark, d), query_vector(spark, d), 10, metric))

    run.__name__ = f"vec_knn_{metric}"
    query(f"WITH {_VEC} SELECT id, round({sql}, 6) AS score FROM vec ORDER BY {sql} DESC, id LIMIT 10")(run)


_knn("cosine", _COS.format(a="vector", b=_Q))
_knn("dot", f"list_dot_product(vector, {_Q})")
_knn("l2", _L2.format(a="vector", b=_Q))


@query(f"WITH {_VEC} SELECT id, round(sqrt(list_sum(list_transform(vector, lambda x: x * x))), 6) AS norm FROM vec")
def vec_norms(spark, d):
    return vec(spark, d).select("id", F.round(vector.norm(F.col("vector")), 6).alias("norm"))


@query(f"WITH {_VEC} SELECT id, 0.0::DOUBLE AS with_zero, round({_COS.format(a='vector', b='vector')}, 6) AS with_self FROM vec")
def vec_zero_norm_guard(spark, d):
    zero = F.transform("vector", lambda x: x * 0)
    return vec(spark, d).select("id", vector.cosine(F.col("vector"), zero).alias("with_zero"), F.round(vector.cosine(F.col("vector"), F.col("vector")), 6).alias("with_self"))


@query(f"WITH {_VEC} SELECT count(*) AS n, count(*) FILTER (abs(list_sum(list_transform(vector, lambda x: x * x)) - 1) < 1e-5) AS units FROM vec")
def vec_normalized_check(spark, d):
    doubled = vec(spark, d).select(vector.unit(F.transform("vector", lambda x: x * 2)).alias("u"))
    return doubled.agg(F.count("*").alias("n"), F.sum((F.abs(vector.norm(F.col("u")) - 1) < 1e-5).cast("long")).alias("units"))


@query(f"WITH {_VEC} SELECT id, len(vector) * 4::BIGINT AS wire_bytes, true AS same FROM vec")
def vec_wire_codec(spark, d):
    coded = vec(spark, d).select("id", "vector", vector.to_bytes("vector").alias("wire"))
    return coded.select("id", F.octet_length("wire").cast("long").alias("wire_bytes"), (vector.from_bytes("wire") == F.col("vector")).alias("same"))


@query(f"WITH {_VEC} SELECT id, round({_COS.format(a='vector', b=_Q)}, 6) AS score FROM vec WHERE list_contains(tags, 'even') ORDER BY {_COS.format(a='vector', b=_Q)} DESC, id LIMIT 10")
def knn_tag_filter_any(spark, d):
    return _score(search.top_k(vec(spark, d), query_vector(spark, d), 10, tags=["even"]))


@query(f"WITH {_VEC} SELECT id, round({_COS.format(a='vector', b=_Q)}, 6) AS score FROM vec WHERE list_has_all(tags, ['even', 'label:2']) ORDER BY {_COS.format(a='vector', b=_Q)} DESC, id LIMIT 10")
def knn_tag_filter_all(spark, d):
    return _score(search.top_k(vec(spark, d), query_vector(spark, d), 10, tags=["even", "label:2"]))


_BATCH = f"""pairs AS (SELECT q.id AS query_id, v.id, {_COS.format(a='q.vector', b='v.vector')} AS score FROM vec q, vec v WHERE q.id % 100 = 0),
exact AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM pairs)"""


@query(f"WITH {_VEC}, {_BATCH} SELECT query_id, rank, id, round(score, 6) AS score FROM exact WHERE rank <= 10")
def knn_batch(spark, d):
    v = vec(spark, d)
    asked = v.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("qvec"))
    return search.batch_top_k(v, asked, 10).select("query_id", *_long("rank"), "id", F.round("score", 6).alias("score"))


@query(f"WITH {_VEC} SELECT id, round({_COS.format(a='vector', b=_Q)}, 6) AS score FROM vec WHERE segment_id = 3 ORDER BY {_COS.format(a='vector', b=_Q)} DESC, id LIMIT 10")
def memtable_knn(spark, d):
    return _score(search.top_k(vec(spark, d).filter("segment_id = 3"), query_vector(spark, d), 10))


@query(f"WITH {_VEC} SELECT id, round({_COS.format(a='vector', b=_Q)}, 6) AS score FROM vec ORDER BY {_COS.format(a='vector', b=_Q)} DESC, id LIMIT 10")
def merge_topk_shards(spark, d):
    held_twice = vec(spark, d).select("id", "vector", F.explode(F.array((F.col("id") % 5).cast("int"), ((F.col("id") + 1) % 5).cast("int"))).alias("shard"))
    return _score(search.scatter_gather(held_twice, query_vector(spark, d), 10, "shard"))


@query("""WITH cases AS (SELECT * FROM (VALUES (0, 0.5, 64), (10, 1.0, 128), (10, 0.5, 128), (10, 0.05, 128), (10, 0.001, 128), (100, 0.2, 64)) t(k, sigma, ef))
SELECT k::BIGINT AS k, sigma::DOUBLE AS sigma, ef::BIGINT AS ef, (2 * k + 16)::BIGINT AS base_fetch,
  CASE WHEN k = 0 THEN 0 ELSE least(greatest(ceil(k / greatest(sigma::DOUBLE, 0.01)), 2 * k + 16), greatest(ef, 2 * k + 16)) END::BIGINT AS fetch FROM cases""")
def fetch_k_policy(spark, d):
    cases = spark.createDataFrame([(0, 0.5, 64), (10, 1.0, 128), (10, 0.5, 128), (10, 0.05, 128), (10, 0.001, 128), (100, 0.2, 64)], "k long, sigma double, ef long")
    return cases.withColumn("base_fetch", 2 * F.col("k") + 16).withColumn("fetch", rules.adaptive_fetch(F.col("k"), F.col("sigma"), F.col("ef")))


_SEG = f"""{_LOG}, {_VEC},
live AS (SELECT * FROM vec_log WHERE NOT tombstone AND vector IS NOT NULL),
scored AS (SELECT segment_id, id, {_L2.format(a='vector', b=_Q)} AS score FROM live),
cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY score DESC, id) AS rn FROM scored) WHERE rn <= 36),
merged AS (SELECT id, max(score) AS score FROM cut GROUP BY id ORDER BY score DESC, id LIMIT 36),
kept AS (SELECT m.id, n.vector FROM merged m JOIN newest n ON m.id = n.id WHERE NOT n.tombstone ORDER BY m.score DESC, m.id LIMIT 10)"""


@query(f"WITH {_SEG} SELECT id, round({_L2.format(a='vector', b=_Q)}, 6) AS score FROM kept")
def knn_segmented(spark, d):
    log = vec_log(spark, d)
    return _score(search.segmented(log, query_vector(spark, d), 10, rules.base_fetch(10)))


@query(f"WITH {_LOG}, {_VEC} SELECT id, round({_L2.format(a='vector', b=_Q)}, 6) AS score FROM newest WHERE NOT tombstone ORDER BY {_L2.format(a='vector', b=_Q)} DESC, id LIMIT 10")
def knn_exact_after_lww(spark, d):
    return _score(search.top_k(lww.visible(vec_log(spark, d)), query_vector(spark, d), 10, "l2"))


@query(f"WITH {_LOG}, {_VEC} SELECT id, round({_COS.format(a='vector', b=_Q)}, 6) AS score FROM newest WHERE NOT tombstone AND id % 2 = 0 ORDER BY {_COS.format(a='vector', b=_Q)} DESC, id LIMIT 10")
def lww_then_knn(spark, d):
    """Flagship: newest versions, tag filter, top-k."""
    tagged = lww.visible(vec_log(spark, d)).withColumn("tags", F.array(F.when(F.col("id") % 2 == 0, "even").otherwise("odd")))
    return _score(search.top_k(tagged, query_vector(spark, d), 10, tags=["even"]))


# Tags -----------------------------------------------------------------------


@query(f"WITH {_VEC} SELECT segment_id, tag, count(DISTINCT id) AS n FROM (SELECT segment_id, id, unnest(tags) AS tag FROM vec) GROUP BY ALL")
def tag_inverted_index(spark, d):
    return tag_index.inverted(vec(spark, d), "id").groupBy("segment_id", "tag").agg(F.sum("n").alias("n"))


@query(f"WITH {_VEC} SELECT segment_id, id AS ord FROM vec WHERE list_has_all(tags, ['odd', 'label:3'])")
def tag_matching_and(spark, d):
    return tag_index.matching(vec(spark, d), ["odd", "label:3"], "id").select("segment_id", "ord")


@query(f"WITH {_VEC} SELECT segment_id, count(*) AS n FROM vec WHERE list_has_all(tags, ['odd', 'label:3']) GROUP BY ALL")
def tag_bitmap_cardinality(spark, d):
    return tag_index.cardinality(tag_index.inverted(vec(spark, d), "id"), ["odd", "label:3"])


@query(f"WITH {_VEC} SELECT segment_id, unnest(tags) AS tag, id AS ord FROM vec")
def tag_bitmap_round_trip(spark, d):
    return tag_index.ordinals(tag_index.inverted(vec(spark, d), "id"))


@query(f"WITH {_VEC} SELECT round(avg(CASE WHEN list_has_all(tags, ['even', 'label:1']) THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS selectivity FROM vec")
def tag_selectivity(spark, d):
    return tag_index.selectivity(vec(spark, d), ["even", "label:1"]).select(F.round("selectivity", 6).alias("selectivity"))


# Versions and maintenance -------------------------------------------------------


@query(f"WITH {_DOC} SELECT id, ts, version, event_type, value FROM newest WHERE NOT tombstone")
def lww_visible(spark, d):
    return lww.visible(doc_log(spark, d)).select("id", "ts", "version", "event_type", "value")


@query(f"WITH {_DOC} SELECT id, ts, version, event_type FROM newest WHERE NOT tombstone AND id = 7")
def lww_point_get(spark, d):
    return lww.get(doc_log(spark, d), 7).select("id", "ts", "version", "event_type")


@query(f"WITH {_DOC} SELECT segment_id, count(*) AS row_count, count(*) FILTER (NOT tombstone) AS live_count, min(ts) AS min_ts, max(ts) AS max_ts FROM doc_log GROUP BY ALL")
def segment_stats(spark, d):
    return lww.segment_stats(doc_log(spark, d))


@query(f"WITH {_DOC}, n AS (SELECT segment_id, count(*) AS current FROM newest GROUP BY ALL) SELECT segment_id, count(*) AS rows, round(1 - coalesce(any_value(current), 0) / count(*), 6)::DOUBLE AS shadowed FROM doc_log LEFT JOIN n USING (segment_id) GROUP BY ALL")
def shadowed_fraction(spark, d):
    return lww.shadowed(doc_log(spark, d)).select("segment_id", "rows", F.round("shadowed", 6).alias("shadowed"))


_MERGED = "chosen AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS k FROM vec_log WHERE {})"


@query(f"WITH {_LOG}, {_MERGED.format('segment_id IN (1, 2)')} SELECT id, version, tombstone, 1::BIGINT AS segment_id FROM chosen WHERE k = 1")
def compact_partial(spark, d):
    return compaction.compact(vec_log(spark, d), [1, 2]).select("id", "version", "tombstone", "segment_id")


@query(f"WITH {_LOG}, {_MERGED.format('segment_id >= 0')} SELECT id, version, tombstone, 0::BIGINT AS segment_id FROM chosen WHERE k = 1 AND NOT tombstone")
def compact_full(spark, d):
    return compaction.compact(vec_log(spark, d)).select("id", "version", "tombstone", "segment_id")


_TIER = "list_max(list_transform(range(0, 32), lambda t: CASE WHEN n >= power(4, t) THEN t ELSE 0 END))::INT"


@query(f"WITH s AS (SELECT l_suppkey AS segment_id, count(*) AS n FROM lineitem GROUP BY ALL) SELECT segment_id, n, {_TIER} AS tier FROM s")
def size_tier_bucket(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("segment_id")).agg(F.count("*").alias("n"))
    return s.withColumn("tier", rules.size_tier(F.col("n")))


@query(f"""WITH s AS (SELECT l_partkey AS segment_id, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT segment_id, n AS row_count, {_TIER} AS tier FROM s),
f AS (SELECT min(tier) AS tier FROM (SELECT tier FROM t GROUP BY tier HAVING count(*) >= 4)) SELECT segment_id, row_count, t.tier FROM t JOIN f ON t.tier = f.tier""")
def size_tier_pick(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("segment_id")).agg(F.count("*").alias("row_count"))
    return compaction.pick_tier(s)


@query(f"WITH {_LOG}, stored AS (SELECT * FROM vec_log WHERE segment_id >= 0) SELECT segment_id, count(*) AS rows, count(*) FILTER (id NOT IN (SELECT id FROM newest WHERE NOT tombstone)) AS ghosts, round(count(*) FILTER (id NOT IN (SELECT id FROM newest WHERE NOT tombstone)) / count(*), 6)::DOUBLE AS fraction FROM stored GROUP BY ALL")
def ghost_fraction(spark, d):
    return compaction.ghosts(vec_log(spark, d)).select("segment_id", "rows", "ghosts", F.round("fraction", 6).alias("fraction"))


@query(f"WITH {_LOG} SELECT count(*) AS live_rows FROM newest WHERE NOT tombstone")
def live_count(spark, d):
    return lww.live_count(vec_log(spark, d))


@query(f"WITH {_LOG} SELECT count(*) AS live_rows, (count(*) * 64 * 4)::BIGINT AS storage_bytes FROM newest WHERE NOT tombstone")
def storage_bytes(spark, d):
    return lww.storage_bytes(vec_log(spark, d), 64)


@query(f"WITH {_VEC} SELECT id, (strlen(id::VARCHAR) + 4 * len(vector) + list_sum(list_transform(tags, lambda t: strlen(t))))::BIGINT AS bytes FROM vec")
def row_bytes(spark, d):
    return vec(spark, d).select("id", rules.row_bytes(F.col("id").cast("string"), F.col("vector"), F.lit(None).cast("string"), F.col("tags")).alias("bytes"))


@query("""WITH n AS (SELECT vec_id % 4 AS segment_id, vec_id AS id, row_number() OVER (PARTITION BY vec_id % 4 ORDER BY vec_id) - 1 AS ord, lead(vec_id) OVER (PARTITION BY vec_id % 4 ORDER BY vec_id) AS after FROM embeddings)
SELECT segment_id, ord, id FROM n WHERE ord % 16 = 0 OR after IS NULL""")
def sparse_index(spark, d):
    return compaction.sparse_index(vec(spark, d)).select("segment_id", *_long("ord"), "id")


@query("SELECT vec_id AS id, len(embedding) = 64 AS fits FROM embeddings")
def dim_validation(spark, d):
    return vec(spark, d).select("id", vector.valid_dimension(F.col("vector"), F.col("tombstone"), 64).alias("fits"))


@query("SELECT c_custkey, regexp_full_match(c_name, '[A-Za-z0-9_-]{1,128}') AND c_name <> 'CATALOG' AS name_ok, length(c_name) BETWEEN 1 AND 512 AND NOT regexp_matches(c_name, '[/\\\\]') AND c_name NOT IN ('.', '..') AS id_ok FROM customer")
def name_validation(spark, d):
    return table(spark, d, "customer").select("c_custkey", rules.valid_collection_name(F.col("c_name")).alias("name_ok"), rules.valid_document_id(F.col("c_name")).alias("id_ok"))


@query("SELECT page_id, url_encode(url) AS encoded, list_filter(string_split(regexp_extract(url, '^[^?#]*'), '/'), lambda p: p <> '')[1] AS first FROM pages")
def url_strings(spark, d):
    return table(spark, d, "pages").select("page_id", rules.percent_encoded(F.col("url")).alias("encoded"), F.get(rules.path_parts(F.col("url")), F.lit(0)).alias("first"))


# The collection API over a table whose size is fixed ------------------------------------


def _countries(spark, d, **options) -> engine.Collection:
    """A collection of the nations, in a folder of its own."""
    c = engine.Collection(spark, f"{upsert.scratch(spark)}/collection-{uuid.uuid4().hex}", engine.Options(dimension=2, tier_threshold=0, **options))
    return c


def _nations(spark, d) -> list[dict]:
    return [{"id": r["n_name"], "vector": [float(r["n_nationkey"]), float(r["n_regionkey"])], "tags": [f"region:{r['n_regionkey']}"], "ts": 1, "region": r["n_regionkey"]} for r in table(spark, d, "nation").collect()]  # 25 rows


def _given(rows: list[dict]) -> list[dict]:
    return [{k: v for k, v in r.items() if k != "region"} for r in rows]


@query("SELECT n_name AS id, CASE WHEN n_regionkey = 2 THEN 3 ELSE 1 END::BIGINT AS ts FROM nation WHERE n_regionkey <> 1")
def wal_recovery(spark, d):
    """Rows of a segment, newer ones and tombstones of the log alone, as another process finds them."""
    rows, c = _nations(spark, d), _countries(spark, d)
    c.upsert_many(_given(rows))
    c.flush()
    c.upsert_many([r | {"ts": 3} for r in _given([r for r in rows if r["region"] == 2])])
    for r in rows:
        if r["region"] == 1:
            c.delete(r["id"], ts=2)
    again = engine.Collection(spark, c.store.root, c.options)
    return again.list().select("id", "ts")


@query("SELECT n_regionkey::BIGINT + 1 AS segment_id, n_name AS id FROM nation")
def segment_write_scan(spark, d):
    """A segment for each region, written, published and read by its id."""
    rows, c = _nations(spark, d), _countries(spark, d)
    for region in sorted({r["region"] for r in rows}):
        c.upsert_many(_given([r for r in rows if r["region"] == region]))
        c.flush()
    return c.store.read().select("segment_id", "id")


@query("SELECT 'segments/segment_id=2' AS path")
def orphan_sweep(spark, d):
    """What is left of a writer that did not come to publish."""
    rows, c = _nations(spark, d), _countries(spark, d)
    c.upsert_many(_given(rows))
    c.flush()
    c.store.write_segment(c.store.read(), 2)
    return spark.createDataFrame([(x,) for x in c.store.collect_garbage() if x.startswith("segments")], "path string")


@query("SELECT n_name AS id, -(power(n_nationkey - 7, 2) + power(n_regionkey - 2, 2))::DOUBLE AS score FROM nation WHERE n_regionkey <> 3 ORDER BY score DESC, id LIMIT 6")
def search_by_segment_state(spark, d):
    """One segment answers by its graph, one row by row, the memtable hides a region."""
    rows, c = _nations(spark, d), _countries(spark, d)
    c.upsert_many(_given([r for r in rows if r["region"] < 3]))
    c.flush()
    c.build_indexes()
    c.upsert_many(_given([r for r in rows if r["region"] >= 3]))
    c.flush()
    for r in rows:
        if r["region"] == 3:
            c.delete(r["id"], ts=2)
    return c.search([7.0, 2.0], 6, mode="graph")


# Admission and logs ---------------------------------------------------------------


@query("""WITH w AS (SELECT event_id AS seq, user_id AS id, min(event_id) OVER (PARTITION BY user_id) AS first FROM events)
SELECT seq, id, dense_rank() OVER (ORDER BY first) <= 100 AS admitted FROM w""")
def quota_admission(spark, d):
    log = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"))
    return admission.quota(log, 100).select("seq", "id", "admitted")


@query("""WITH RECURSIVE r AS (SELECT event_type, epoch_us(ts) AS ts, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT event_type, event_id, n, ts AS start, 1 AS used, true AS admitted FROM r WHERE n = 1
UNION ALL SELECT r.event_type, r.event_id, r.n, CASE WHEN r.ts - f.start >= 3600000000 THEN r.ts ELSE f.start END,
  CASE WHEN r.ts - f.start >= 3600000000 THEN 1 WHEN f.used < 2 THEN f.used + 1 ELSE f.used END, r.ts - f.start >= 3600000000 OR f.used < 2
FROM f JOIN r ON r.event_type = f.event_type AND r.n = f.n + 1)
SELECT event_type, event_id, admitted FROM f""")
def qps_admission(spark, d):
    log = table(spark, d, "events").select(F.col("event_type").alias("collection"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    keyed = log.withColumn("seq", F.struct("us", "event_id"))
    folded = admission.rate(keyed, 2, 3_600_000_000, at="us", order="seq")
    return folded.select(F.col("collection").alias("event_type"), "seq.event_id", "admitted")


@query("""WITH b AS (SELECT user_id, min(event_id) AS bad FROM events WHERE event_type = 'error' GROUP BY ALL)
SELECT e.user_id, event_id FROM events e LEFT JOIN b ON e.user_id = b.user_id WHERE bad IS NULL OR event_id < bad""")
def wal_valid_prefix(spark, d):
    log = table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"))
    return admission.valid_prefix(log, by="user_id").select("user_id", F.col("seq").alias("event_id"))


@query("SELECT event_id, (props::JSON ->> '$.k') ::BIGINT AS k FROM events")
def metadata_json_extract(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')").alias("k"))


@query("SELECT 'seg-' || o_orderkey AS path FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orphan_files(spark, d):
    name = lambda c: F.concat(F.lit("seg-"), F.col(c).cast("string")).alias("path")
    files = table(spark, d, "orders").select(name("o_orderkey"))
    return store.unreferenced(files, table(spark, d, "lineitem").select(name("l_orderkey")))


# Placement ------------------------------------------------------------------------

_RING = """nodes AS (SELECT n_name AS node FROM nation), keys AS (SELECT o_orderkey AS key, ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 15))::BIGINT AS h FROM orders),
tokens AS (SELECT node, ('0x' || substr(md5(node || '#' || v), 1, 15))::BIGINT AS token FROM nodes, range(0, 16) t(v)),
away AS (SELECT key, node, min(CASE WHEN token >= h THEN token - h ELSE token - h + 1152921504606846976 END) AS away FROM keys, tokens GROUP BY ALL),
held AS (SELECT key, node, row_number() OVER (PARTITION BY key ORDER BY away, node) AS n FROM away)"""


def _keys(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"))


def _ring(spark, d):
    return placement.ring(table(spark, d, "nation"), "n_name", 16)


@query(f"WITH {_RING} SELECT key, node FROM held WHERE n = 1")
def ring_primary(spark, d):
    return placement.replicas(_keys(spark, d), _ring(spark, d), 1).select("key", "node")


@query(f"WITH {_RING} SELECT key, n, node FROM held WHERE n <= 3")
def ring_replicas_rf3(spark, d):
    return placement.replicas(_keys(spark, d), _ring(spark, d), 3).select("key", *_long("n"), "node")


@query(f"WITH {_RING} SELECT node, count(*) AS keys FROM held WHERE n = 1 GROUP BY ALL")
def ring_load(spark, d):
    return placement.load(_keys(spark, d), _ring(spark, d))


_LESS = ", less AS (SELECT key, node, row_number() OVER (PARTITION BY key ORDER BY away, node) AS n FROM away WHERE node <> (SELECT min(n_name) FROM nation)), a AS (SELECT * FROM held WHERE n <= 2), b AS (SELECT * FROM less WHERE n <= 2)"


def _first_node(spark, d) -> str:
    return table(spark, d, "nation").agg(F.min("n_name")).first()[0]


@query(f"WITH {_RING}{_LESS}, stay AS (SELECT key, min(node) FILTER (node <> (SELECT min(n_name) FROM nation)) AS other FROM a GROUP BY ALL) SELECT b.key, coalesce(other, (SELECT min(n_name) FROM nation)) AS from_node, b.node AS to_node, other IS NOT NULL AS durable FROM b JOIN stay ON b.key = stay.key WHERE NOT EXISTS (FROM a WHERE a.key = b.key AND a.node = b.node)")
def rebalance_remove(spark, d):
    return placement.plan_remove(_keys(spark, d), _ring(spark, d), _first_node(spark, d), 2)


@query(f"WITH {_RING}{_LESS}, f AS (SELECT key, min(node) AS from_node FROM b GROUP BY ALL) SELECT a.key, from_node, a.node AS to_node FROM a JOIN f ON a.key = f.key WHERE NOT EXISTS (FROM b WHERE a.key = b.key AND a.node = b.node)")
def rebalance_add(spark, d):
    tokens, node = _ring(spark, d), _first_node(spark, d)
    return placement.plan_add(_keys(spark, d), tokens.filter(F.col("node") != node), tokens.filter(F.col("node") == node), 2)


@query(f"WITH {_RING} SELECT key, count(*) AS copies, count(*) = 3 AS satisfied FROM held WHERE n <= 3 GROUP BY ALL")
def replication_satisfied(spark, d):
    return placement.satisfied(placement.replicas(_keys(spark, d), _ring(spark, d), 3), 3, 25)


@query(f"WITH {_RING} SELECT key FROM held WHERE n <= 3 AND node = (SELECT min(n_name) FROM nation)")
def keys_held_by(spark, d):
    return placement.held_by(placement.replicas(_keys(spark, d), _ring(spark, d), 3), _first_node(spark, d))


@query(f"""WITH {_RING}{_LESS}, f AS (SELECT key, min(node) AS from_node FROM b GROUP BY ALL), p AS (SELECT a.key, a.node FROM a WHERE NOT EXISTS (FROM b WHERE a.key = b.key AND a.node = b.node))
SELECT key, node, 1::BIGINT AS ts FROM b UNION ALL SELECT key, node, 2::BIGINT FROM p""")
def apply_migrations(spark, d):
    tokens, node = _ring(spark, d), _first_node(spark, d)
    old, new = tokens.filter(F.col("node") != node), tokens.filter(F.col("node") == node)
    rows = placement.replicas(_keys(spark, d), old, 2).select("key", "node", F.lit(1).cast("long").alias("ts"))
    return placement.apply(rows, placement.plan_add(_keys(spark, d), old, new, 2))


def _round(of: str, to: str, shift: int, factor: int) -> str:
    return f"{to} AS (SELECT n_name, seed, (xor(x, x >> {shift}) * {factor}::UHUGEINT) & {(1 << 64) - 1}::UHUGEINT AS x FROM {of})"


@query(f"""WITH s AS (SELECT n_name, seed, seed::UHUGEINT AS x FROM nation, range(4) t(seed)),
{_round("s", "a", 30, 0xBF58476D1CE4E5B9)}, {_round("a", "b", 27, 0x94D049BB133111EB)},
h AS (SELECT n_name, seed, list_reduce([xor({0xCBF29CE484222325}::UHUGEINT, xor(x, x >> 31))] || list_transform(string_split(n_name, ''), lambda c: ascii(c)::UHUGEINT), lambda v, y: (xor(v, y) * {0x100000001B3}::UHUGEINT) & {(1 << 64) - 1}::UHUGEINT) AS x FROM b),
{_round("h", "i", 30, 0xBF58476D1CE4E5B9)}, {_round("i", "j", 27, 0x94D049BB133111EB)}
SELECT n_name, seed, xor(x, x >> 31)::VARCHAR AS hash FROM j""")
def hash64_parity(spark, d):
    """Seeded hashes of the nations' names as unsigned decimals."""
    names = table(spark, d, "nation").select("n_name", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("seed"))
    return names.select("n_name", "seed", (placement.hash64(F.col("n_name"), F.col("seed")).cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string").alias("hash"))


@query(f"WITH {_RING} SELECT key, node FROM held WHERE n <= 2")
def replicated_write(spark, d):
    return placement.write_replicated(_keys(spark, d), _ring(spark, d), 2).select("key", "node")


@query(f"WITH {_RING}, up AS (SELECT * FROM held WHERE n <= 2 AND node <> (SELECT min(n_name) FROM nation)) SELECT key, min_by(node, n) AS node FROM up GROUP BY key")
def any_replica_read(spark, d):
    names = [r[0] for r in table(spark, d, "nation").select("n_name").collect()]  # the cluster's nodes
    return placement.read_any(placement.replicas(_keys(spark, d), _ring(spark, d), 2), sorted(names)[1:]).select("key", "node")


@query("SELECT o_orderkey % 7 AS shard, count(*) AS keys FROM orders GROUP BY ALL")
def modulo_sharding(spark, d):
    return _keys(spark, d).groupBy(placement.modulo(F.col("key"), 7).alias("shard")).agg(F.count("*").alias("keys"))


# Liveness -------------------------------------------------------------------------

_BEATS = "beats AS (SELECT user_id AS endpoint, epoch_us(ts) // 1000 AS now_ms FROM events)"


@query(f"""WITH {_BEATS}, t AS (SELECT max(now_ms) AS now FROM beats),
g AS (SELECT endpoint, now_ms, now_ms - lag(now_ms) OVER (PARTITION BY endpoint ORDER BY now_ms) AS i FROM beats),
r AS (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY now_ms DESC) AS n FROM g WHERE i > 0),
m AS (SELECT endpoint, greatest(avg(i), 100) AS mean FROM r WHERE n <= 100 GROUP BY ALL), l AS (SELECT endpoint, max(now_ms) AS last_ms FROM beats GROUP BY ALL),
p AS (SELECT l.endpoint, last_ms, coalesce(mean, 1000) AS mean, (now - last_ms) / coalesce(mean, 1000) * log10(exp(1)) AS phi FROM l LEFT JOIN m ON l.endpoint = m.endpoint, t)
SELECT endpoint, last_ms, round(mean, 4) AS mean_ms, round(phi, 6) AS phi, phi < 8 AS available FROM p""")
def phi_accrual(spark, d):
    beats = table(spark, d, "events").select(F.col("user_id").alias("endpoint"), F.unix_millis(F.col("ts").cast("timestamp")).alias("now_ms"))
    now = beats.agg(F.max("now_ms").alias("n")).scalar()
    return liveness.phi(beats, now).select("endpoint", "last_ms", F.round("mean_ms", 4).alias("mean_ms"), F.round("phi", 6).alias("phi"), "available")


_STATUS = "CASE event_type WHEN 'error' THEN 'Dead' WHEN 'signup' THEN 'Left' ELSE 'Alive' END"


@query(f"""WITH s AS (SELECT user_id AS endpoint, event_id // 1000 AS generation, event_id AS version, {_STATUS} AS status FROM events)
SELECT endpoint, generation, version, status FROM (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY generation DESC, version DESC, (status = 'Left') DESC) AS n FROM s) WHERE n = 1""")
def gossip_merge(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("endpoint"), F.expr("event_id div 1000").alias("generation"), F.col("event_id").alias("version"), F.expr(_STATUS).alias("status"))
    return liveness.merge_gossip(e)


_SEEN = f"""s AS (SELECT user_id AS endpoint, (event_id // 1000)::BIGINT AS generation, event_id AS version, {_STATUS} AS status, event_id % 2 AS side FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY endpoint, side ORDER BY generation DESC, version DESC) AS k FROM s),
mine AS (FROM n WHERE k = 1 AND side = 0), theirs AS (FROM n WHERE k = 1 AND side = 1)"""


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    """What two members know of the users: the even and the odd events."""
    e = table(spark, d, "events").select(F.col("user_id").alias("endpoint"), F.expr("event_id div 1000").alias("generation"), F.col("event_id").alias("version"), F.expr(_STATUS).alias("status"))
    return tuple(liveness.merge_gossip(e.filter(F.col("version") % 2 == side)) for side in (0, 1))


@query(f"""WITH {_SEEN} SELECT coalesce(m.endpoint, t.endpoint) AS endpoint, CASE WHEN take THEN t.generation ELSE m.generation END AS generation, CASE WHEN take THEN t.version ELSE m.version END AS version, CASE WHEN take THEN t.status ELSE m.status END AS status
FROM (SELECT m, t, m.endpoint IS NULL OR (t.endpoint IS NOT NULL AND m.endpoint <> 7 AND (t.generation > m.generation OR (t.generation = m.generation AND t.version > m.version))) AS take FROM mine m FULL JOIN theirs t ON m.endpoint = t.endpoint)""")
def gossip_exchange(spark, d):
    mine, theirs = _sides(spark, d)
    return liveness.gossip_round(mine, theirs, 7)


@query(f"""WITH {_BEATS}, {_SEEN}, t AS (SELECT max(now_ms) AS now FROM beats), g AS (SELECT endpoint, now_ms, now_ms - lag(now_ms) OVER (PARTITION BY endpoint ORDER BY now_ms) AS i FROM beats),
r AS (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY now_ms DESC) AS k FROM g WHERE i > 0), a AS (SELECT endpoint, greatest(avg(i), 100) AS mean FROM r WHERE k <= 100 GROUP BY ALL),
p AS (SELECT b.endpoint, (any_value(now) - max(now_ms)) / coalesce(any_value(mean), 1000) * log10(exp(1)) AS phi FROM beats b LEFT JOIN a ON a.endpoint = b.endpoint, t GROUP BY b.endpoint)
SELECT endpoint, generation, version, CASE WHEN status = 'Alive' AND endpoint <> 7 AND phi >= 1 THEN 'Dead' ELSE status END AS status FROM mine JOIN p USING (endpoint)""")
def gossip_tick(spark, d):
    beats = table(spark, d, "events").select(F.col("user_id").alias("endpoint"), F.unix_millis(F.col("ts").cast("timestamp")).alias("now_ms"))
    return liveness.tick(_sides(spark, d)[0], beats, beats.agg(F.max("now_ms").alias("n")).scalar(), 7, threshold=1.0)


@query("""WITH r AS (SELECT user_id AS id, epoch_us(ts) AS ts, event_id AS version, event_id % 3 AS replica FROM events)
SELECT id, ts, version FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, version DESC) AS n FROM r WHERE replica IN (0, 2)) WHERE n = 1""")
def quorum_read_lww(spark, d):
    log = doc_log(spark, d).select("id", "ts", "version", (F.col("version") % 3).alias("replica"))
    return lww.quorum(log, [0, 2]).select("id", "ts", "version")


# Measurement ------------------------------------------------------------------------


def _buckets() -> str:
    return " UNION ALL ".join(f"SELECT event_type, '{b}' AS le, count(*) FILTER (value <= {b}) AS count, count(*) AS total FROM events GROUP BY ALL" for b in measure.BUCKETS)


@query(_buckets() + " UNION ALL SELECT event_type, '+Inf', count(*), count(*) FROM events GROUP BY ALL")
def hist_cumulative(spark, d):
    return measure.histogram(table(spark, d, "events"), "value", by=["event_type"]).select("event_type", "le", "count", "total")


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS max FROM events GROUP BY ALL")
def latency_percentiles(spark, d):
    got = measure.latency(table(spark, d, "events"), "value", ["event_type"])
    return got.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p99")], "max")


@query("SELECT event_type AS op, count(*) AS total, count(*) FILTER (value >= 50) AS failed FROM events GROUP BY ALL")
def usage_stats(spark, d):
    return measure.usage(table(spark, d, "events").select(F.col("event_type").alias("op"), (F.col("value") < 50).alias("ok")))


_TWO_LISTS = f"""WITH {_VEC}, {_BATCH}, t AS (SELECT * FROM exact WHERE rank <= 10),
p2 AS (SELECT q.id AS query_id, v.id, {_COS.format(a='q.vector[1:32]', b='v.vector[1:32]')} AS score FROM vec q, vec v WHERE q.id % 100 = 0),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p2) WHERE rank <= 10),
j AS (SELECT coalesce(t.query_id, a.query_id) AS query_id, t.rank AS r1, a.rank AS r2, t.score AS s1, a.score AS s2 FROM t FULL JOIN a ON t.query_id = a.query_id AND t.id = a.id),
g AS (SELECT query_id, count(*) FILTER (r1 IS NOT NULL AND r2 IS NOT NULL) AS overlap, count(*) AS either, count(*) FILTER (r1 = r2) AS ranks_equal, coalesce(avg(abs(r1 - r2)), 0) AS mean_shift,
  coalesce(max(abs(r1 - r2)), 0) AS max_shift, coalesce(avg(abs(s1 - s2)), 0) AS score_mae, count(*) FILTER (r1 = 1 AND r2 = 1) > 0 AS same_first FROM j GROUP BY ALL)"""


def _lists(spark, d) -> tuple[DataFrame, DataFrame]:
    """Exact lists, and lists by the first half of the components."""
    v = vec(spark, d)

    def lists(rows):
        return search.batch_top_k(rows, rows.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("qvec")), 10)

    return lists(v), lists(v.withColumn("vector", F.slice("vector", 1, 32)))


@query(_TWO_LISTS + " SELECT query_id, overlap, round(overlap / 10, 6)::DOUBLE AS recall FROM g")
def recall_at_k(spark, d):
    return measure.agreement(*_lists(spark, d)).select("query_id", "overlap", F.round("recall", 6).alias("recall"))


@query(_TWO_LISTS + " SELECT query_id, round(overlap / either, 6)::DOUBLE AS jaccard FROM g")
def jaccard_at_k(spark, d):
    return measure.agreement(*_lists(spark, d)).select("query_id", F.round("jaccard", 6).alias("jaccard"))


@query(_TWO_LISTS + " SELECT query_id, ranks_equal, round(mean_shift, 6)::DOUBLE AS mean_shift, max_shift::BIGINT AS max_shift FROM g")
def rank_disagreement(spark, d):
    return measure.agreement(*_lists(spark, d)).select("query_id", "ranks_equal", F.round("mean_shift", 6).alias("mean_shift"), *_long("max_shift"))


@query(_TWO_LISTS + " SELECT query_id, round(score_mae, 6)::DOUBLE AS score_mae FROM g")
def score_mae(spark, d):
    return measure.agreement(*_lists(spark, d)).select("query_id", F.round("score_mae", 6).alias("score_mae"))


@query(_TWO_LISTS + """, r AS (SELECT count(*) AS queries, avg(overlap / 10) AS mr, min(overlap / 10) AS lo, avg(overlap / either) AS mj, avg(same_first::INT) AS fr FROM g)
SELECT queries, round(mr, 6)::DOUBLE AS mean_recall, round(lo, 6)::DOUBLE AS min_recall, round(mj, 6)::DOUBLE AS mean_jaccard, round(fr, 6)::DOUBLE AS first_rate,
CASE WHEN mr >= 0.99 AND mj >= 0.99 THEN 'match' WHEN mr >= 0.9 THEN 'close' ELSE 'material' END AS verdict FROM r""")
def agreement_rollup(spark, d):
    v = measure.verdict(measure.agreement(*_lists(spark, d)))
    return v.select("queries", *[F.round(c, 6).alias(c) for c in ("mean_recall", "min_recall", "mean_jaccard", "first_rate")], "verdict")


@query(_TWO_LISTS + """, s AS (SELECT t.query_id, t.rank, t.id AS x, a.id AS y FROM t FULL JOIN a ON t.query_id = a.query_id AND t.rank = a.rank)
SELECT query_id, bool_and(x IS NOT DISTINCT FROM y) AS same FROM s GROUP BY ALL""")
def ranking_equality(spark, d):
    return measure.same_ranking(*_lists(spark, d))


@query(f"WITH {_VEC}, {_BATCH} SELECT count(*) AS probes, round(avg((id = query_id)::INT), 6)::DOUBLE AS recall_at_1 FROM exact WHERE rank = 1")
def probe_recall(spark, d):
    exact, _ = _lists(spark, d)
    return exact.filter("rank = 1").agg(F.count("*").alias("probes"), F.round(F.avg((F.col("id") == F.col("query_id")).cast("double")), 6).alias("recall_at_1"))


@query("""WITH p AS (SELECT user_id % 8 AS node, count(*) / (sum(value) + 1) AS rate, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY ALL)
SELECT round(sum(rate), 6) AS total_rate, round(avg(rate), 6) AS mean_rate, round(quantile_cont(rate, 0.5), 6) AS p50_rate, round(quantile_cont(rate, 0.95), 6) AS p95_rate FROM p""")
def cluster_rollup(spark, d):
    per = table(spark, d, "events").groupBy((F.col("user_id") % 8).alias("node")).agg(F.count("*").alias("ops"), (F.sum("value") + 1).alias("seconds"))
    r = measure.roll_up(per)
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


@query("SELECT count(DISTINCT user_id % 8) AS nodes, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT user_id % 8) = 8 AND count(*) FILTER (event_type = 'error') = 0 AS survived FROM events")
def survival_verdict(spark, d):
    per = table(spark, d, "events").groupBy((F.col("user_id") % 8).alias("node")).agg(F.sum((F.col("event_type") == "error").cast("long")).alias("errors"))
    return measure.survival(per, 8)


@query("SELECT o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_keys(spark, d):
    return measure.missing(_keys(spark, d), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key")))


@query("SELECT NOT EXISTS (SELECT DISTINCT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem) AND NOT EXISTS (SELECT DISTINCT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders) AS same")
def set_equality(spark, d):
    return measure.same_set(_keys(spark, d), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key")))


@query("WITH w AS (SELECT n_nationkey, 1 / power(n_nationkey % 17 + 1, 1.3) AS weight FROM nation) SELECT n_nationkey, round(weight, 6) AS weight, round(weight / sum(weight) OVER () * 1000, 6) AS share FROM w")
def zipf_plan(spark, d):
    z = measure.zipf_shares(table(spark, d, "nation").select("n_nationkey"), "n_nationkey", 1000)
    return z.select("n_nationkey", F.round("weight", 6).alias("weight"), F.round("share", 6).alias("share"))


@query("SELECT 'ops_total{op=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def prometheus_text(spark, d):
    counts = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("value"))
    return measure.prometheus(counts.select(F.lit("ops_total").alias("name"), F.format_string('op="%s"', "event_type").alias("labels"), "value"))


# Approximate search and streams (no SQL counterpart, or one over the whole table) ----------------


def _recall(spark: SparkSession, d: str, found: DataFrame, v: DataFrame, asked: DataFrame) -> DataFrame:
    exact = search.batch_top_k(v, asked, 10)
    per = measure.agreement(exact, found)
    return per.agg(F.count("*").alias("queries"), F.round(F.avg("recall"), 6).alias("recall"), F.min("overlap").alias("least_overlap"))


def _asked(v: DataFrame) -> DataFrame:
    return v.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("qvec"))


@query()
def ann_ivf_recall(spark, d):
    """Recall of the inverted file against exact search, for every hundredth row. The table's vectors hardly form clusters, so many cells must be read."""
    v = vec(spark, d)
    c = ann.centroids(v, 16)
    return _recall(spark, d, ann.ivf_search(ann.assign(v, c), c, _asked(v), 10, nprobe=10), v, _asked(v))


def _kept_edges(spark: SparkSession, v: DataFrame) -> DataFrame:
    """The segments' graphs, built once and written, as a search finds them."""
    path = f"{upsert.scratch(spark)}/graphs-{uuid.uuid4().hex}"
    ann.graph_edges(v).write.partitionBy("layer").parquet(path)
    return spark.read.parquet(path)


@query()
def ann_hnsw_recall(spark, d):
    """Recall of the segments' stored graphs against exact search, for every hundredth row."""
    v = vec(spark, d)
    return _recall(spark, d, ann.graph_search(v, _kept_edges(spark, v), _asked(v), 10), v, _asked(v))


@query("SELECT vec_id AS query_id, true AS same FROM embeddings WHERE vec_id % 100 = 0")
def ann_hnsw_pinned(spark, d):
    """The answers with pinned upper layers and with all layers read, and whether they agree."""
    v = vec(spark, d)
    edges = _kept_edges(spark, v)
    whole = ann.graph_search(v, edges, _asked(v), 10)
    pinned = ann.graph_search(v, edges, _asked(v), 10, pinned=ann.pin(edges))
    return measure.same_ranking(whole, pinned)


@query("SELECT 'self_loop' AS problem, 0::BIGINT AS n UNION ALL SELECT 'degree', 0 UNION ALL SELECT 'absent', 0")
def ann_graph_invariants(spark, d):
    return ann.check_edges(_kept_edges(spark, vec(spark, d)))


@query(f"WITH {_DOC} SELECT id, ts, version, tombstone FROM newest")
def stream_lww_upsert(spark, d):
    """The events as a stream, appended to a log batch by batch, then its newest rows."""
    root = f"{upsert.scratch(spark)}/{uuid.uuid4().hex}"
    src = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = src.select(F.col("user_id").alias("id"), us.alias("ts"), F.col("event_id").alias("version"), (F.col("event_type") == "error").alias("tombstone"))
    upsert.into_log(rows, f"{root}/log", f"{root}/checkpoint").awaitTermination()
    return lww.newest(spark.read.parquet(f"{root}/log").drop("batch"), segment=None)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
