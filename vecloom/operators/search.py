"""Exact nearest-neighbour search.

One query: a declarative plan that ends in TakeOrderedAndProject. Many queries:
blocks of bounded size are broadcast and multiplied with the rows where they
lie; each task keeps its k best rows per query, so k * tasks rows per query are shuffled.
Ties go to the smaller id.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, vector
from . import lww

#: Queries that are broadcast at a time.
BLOCK = 8_192
#: Queries and rows that are multiplied at a time: what a task holds besides its lists.
TILE, TILE_ROWS = 256, 2_048


def literal(v: list[float]) -> Column:
    return F.lit([float(x) for x in v]) if v else F.array().cast("array<double>")


def top_k(rows: DataFrame, query: list[float], k: int = 10, metric: str = "cosine", tags: list[str] | None = None, id_col: str = "id") -> DataFrame:
    """id and score of the k live rows of the highest score. An empty query or k = 0 gives none."""
    if not query or k <= 0:
        return rows.select(F.col(id_col), F.lit(0.0).alias("score")).limit(0)
    fit = rows
    if "tombstone" in rows.columns:
        fit = fit.filter(rules.live(F.col("vector"), F.col("tombstone")))
    else:
        fit = fit.filter(F.size("vector") > 0)
    if tags:
        fit = fit.filter(rules.has_all_tags(F.col("tags"), tags))
    return fit.select(id_col, vector.score(metric, F.col("vector"), literal(query)).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def ranked(hits: DataFrame, by: list[str], k: int, id_col: str = "id") -> DataFrame:
    """rank within `by` by (score desc, id), up to k: WindowGroupLimit keeps k rows per task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.col(id_col))
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def merge_top_k(hits: DataFrame, k: int, by: list[str] | None = None, id_col: str = "id") -> DataFrame:
    """Candidate lists, laid in one table, to one: each id once with its highest score, the best k (per `by`)."""
    best = hits.groupBy(*(by or []), id_col).agg(F.max("score").alias("score"))
    return ranked(best, by, k, id_col).drop("rank") if by else best.orderBy(F.desc("score"), id_col).limit(k)


def scatter_gather(rows: DataFrame, query: list[float], k: int, shard: str, metric: str = "cosine", id_col: str = "id") -> DataFrame:
    """Top k of every shard, then of all; an id that several shards hold counts once."""
    scored = rows.select(shard, id_col, vector.score(metric, F.col("vector"), literal(query)).alias("score"))
    return merge_top_k(ranked(scored, [shard], k, id_col).drop("rank"), k, id_col=id_col)


def segmented(log: DataFrame, query: list[float], k: int, fetch: int, metric: str = "l2", tags: list[str] | None = None) -> DataFrame:
    """Search segment by segment as a log-structured store does it.

    The best `fetch` rows of each segment are merged by their own scores, stale
    versions included, and walked in that order; ids whose newest version is a
    tombstone or lacks a tag are passed over, the first k others are kept and
    scored again on their newest vectors. A stale version can thus take a place.
    """
    merged = merge_top_k(segment_hits(log, query, fetch, metric, tags), fetch)
    return reconciled(merged, log, query, k, metric, tags)


def segment_hits(log: DataFrame, query: list[float], fetch: int, metric: str, tags: list[str] | None = None) -> DataFrame:
    """(id, score): the best `fetch` live rows of each segment, versions that are stale included."""
    fit = log.filter(rules.live(F.col("vector"), F.col("tombstone")))
    if tags:
        fit = fit.filter(rules.has_all_tags(F.col("tags"), tags))
    scored = fit.select("segment_id", "id", vector.score(metric, F.col("vector"), literal(query)).alias("score"))
    return ranked(scored, ["segment_id"], fetch).select("id", "score")


def reconciled(merged: DataFrame, log: DataFrame, query: list[float], k: int, metric: str, tags: list[str] | None = None) -> DataFrame:
    """The first k of a short list of hits whose newest version is live and has the tags, scored again on it. Only the log's rows of these ids are looked at, and none is shuffled but those."""
    near = log.join(F.broadcast(merged.select("id", F.col("score").alias("_score"))), "id")  # a short list
    now = lww.newest(near).filter(rules.live(F.col("vector"), F.col("tombstone")))
    if tags:
        now = now.filter(rules.has_all_tags(F.col("tags"), tags))
    kept = now.orderBy(F.desc("_score"), "id").limit(k)
    return kept.select("id", vector.score(metric, F.col("vector"), literal(query)).alias("score")).orderBy(F.desc("score"), "id")


def segment_hits(log: DataFrame, query: list[float], fetch: int, metric: str, tags: list[str] | None = None) -> DataFrame:
    """(id, score): the best `fetch` live rows of each segment, versions that are stale included."""
    fit = log.filter(rules.live(F.col("vector"), F.col("tombstone")))
    if tags:
        fit = fit.filter(rules.has_all_tags(F.col("tags"), tags))
    scored = fit.select("segment_id", "id", vector.score(metric, F.col("vector"), literal(query)).alias("score"))
    return ranked(scored, ["segment_id"], fetch).select("id", "score")


def reconciled(merged: DataFrame, log: DataFrame, query: list[float], k: int, metric: str, tags: list[str] | None = None) -> DataFrame:
    """The first k of a short list of hits whose newest version is live and has the tags, scored again on it. Only the log's rows of these ids are looked at, and none is shuffled but those."""
    near = log.join(F.broadcast(merged.select("id")), "id", "left_semi")
    now = lww.newest(near).filter(rules.live(F.col("vector"), F.col("tombstone")))
    if tags:
        now = now.filter(rules.has_all_tags(F.col("tags"), tags))
    kept = F.broadcast(merged).join(now.select("id", "vector"), "id").orderBy(F.desc("score"), "id").limit(k)  # at most `fetch` rows
    return kept.select("id", vector.score(metric, F.col("vector"), literal(query)).alias("score")).orderBy(F.desc("score"), "id")


def _scores(q: np.ndarray, m: np.ndarray, metric: str) -> np.ndarray:
    s = q @ m.T
    if metric == "dot":
        return s
    if metric == "l2":
        return 2 * s - np.square(q).sum(1)[:, None] - np.square(m).sum(1)[None, :]
    n = np.sqrt(np.square(q).sum(1))[:, None] * np.sqrt(np.square(m).sum(1))[None, :]
    return np.divide(s, n, out=np.zeros_like(s), where=n != 0)


class Best:
    """The k best (score, smaller id) rows of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.floor = k, np.full(queries, -np.inf)
        self.q, self.id, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add_for(self, queries: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        """Scores of some queries (rows) with the rows `ids` (columns); what is no number is passed over."""
        s[np.isnan(s)] = -np.inf
        floor = self.floor[queries, None]
        if s.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(s, -self.k, axis=1)[:, [-self.k]])
        i, j = np.nonzero((s >= floor) & (s > -np.inf))
        self.fresh.append((queries[i], ids[j], s[i, j]))
        self.waiting += len(i)
        if self.waiting > 4 * self.k * len(self.floor):
            self.cut()

    def add_rows(self, who: np.ndarray, q: np.ndarray, ids: np.ndarray, m: np.ndarray, metric: str, own: np.ndarray | None = None) -> None:
        """Scores of the queries `who` (of all, `q`) with rows (`ids`, `m`), a tile at a time; `own`: for each query an id that it must not find."""
        for row in range(0, len(ids), TILE_ROWS):
            some, part = ids[row : row + TILE_ROWS], m[row : row + TILE_ROWS]
            for at in range(0, len(who), TILE):
                mine = who[at : at + TILE]
                s = _scores(q[mine], part, metric)
                if own is not None:
                    s[own[mine, None] == some[None, :]] = -np.inf
                self.add_for(mine, some, s)

    def cut(self) -> None:
        self.q, self.id, self.score = (np.concatenate(c) for c in zip((self.q, self.id, self.score), *self.fresh))
        self.fresh, self.waiting = [], 0
        order = np.lexsort((self.id, -self.score, self.q))
        q = self.q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = order[rank == self.k - 1]
        self.floor[self.q[last]] = self.score[last]
        order = order[rank < self.k]
        self.q, self.id, self.score = self.q[order], self.id[order], self.score[order]


def taken(asked: DataFrame, block: int) -> Iterator[list]:
    """The rows of a table of (id, vector) in blocks of bounded size; one job if they fit in one."""
    first = asked.limit(block + 1).collect()  # bounded
    if len(first) <= block:
        yield first
        return
    blocks = -(-2 * asked.count() // block)
    for b in range(blocks):
        yield asked.filter(F.pmod(F.xxhash64(asked.columns[0]), F.lit(blocks)) == b).collect()


def matrix(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of the rows of (id, vector) that have an id and `width` components, none of them null."""
    column = batch.column(1)
    fit = pc.and_(pc.equal(pc.list_value_length(column), width), batch.column(0).is_valid())
    if column.flatten().null_count:
        holes = pc.list_parent_indices(column).filter(pc.is_null(pc.list_flatten(column)))
        fit = pc.and_(fit, pc.invert(pc.is_in(pa.array(np.arange(batch.num_rows)), holes.cast(pa.int64()))))
    batch = batch.filter(pc.fill_null(fit, False))
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, width)


def batch_top_k(rows: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", exclude_self: bool = False, block: int = BLOCK) -> DataFrame:
    """query_id, rank, id, score for a table of queries (query_id, qvec) over rows (id long, vector).

    Every task keeps the k best of each query of a block, so at most k * tasks
    rows per query are shuffled. Rows without id or vector, with null components
    or of another dimension than the queries take no part; nor do such queries.
    """
    spark = rows.sparkSession
    asked = queries.select(F.col("query_id").cast("long"), F.col("qvec").cast("array<double>")).filter("query_id is not null and qvec is not null and forall(qvec, x -> x is not null)")
    slim, out = rows.select(F.col("id").cast("long").alias("id"), "vector"), None
    for mine in taken(asked, block):
        for width in sorted({len(r[1]) for r in mine} - {0}):
            own = [r for r in mine if len(r[1]) == width]
            sent = spark.sparkContext.broadcast((np.array([r[0] for r in own], np.int64), np.array([r[1] for r in own], np.float64)))

            def run(batches: Iterator[pa.RecordBatch], sent=sent, width=width) -> Iterator[pa.RecordBatch]:
                ids, q = sent.value
                best, who = Best(len(ids), k), np.arange(len(ids))
                for batch in batches:
                    own, m = matrix(batch, width)
                    best.add_rows(who, q, own, m, metric, ids if exclude_self else None)
                best.cut()
                yield pa.RecordBatch.from_arrays([pa.array(ids[best.q]), pa.array(best.id), pa.array(best.score)], names=["query_id", "id", "score"])

            part = slim.mapInArrow(run, "query_id long, id long, score double")
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "query_id long, id long, score double")
    return ranked(out, ["query_id"], k).select("query_id", "rank", "id", "score")
