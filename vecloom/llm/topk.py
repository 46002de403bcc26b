"""Exact top-k search by a three-phase uniform threshold.

The coordinates are split into groups; each group is a list that scores every
candidate by its part of the inner product, so a candidate's score is the sum of
its scores in all lists.

1. Gather: each task takes the best k of each list, completes their scores, and
   gives its k best. The k-th best of all that was gathered is a safe cutoff: the
   true k-th best is no lower.
2. Collect: with the cutoffs broadcast, a candidate whose score reaches the
   cutoff has a score of at least cutoff / lists in one list; only such entries
   are taken up.
3. Resolve: their missing scores are added, what stays below the cutoff goes,
   and each task keeps the k best, ties to the smaller id; a last ranking per
   query is exact.

Queries are handled in blocks of bounded size, each against all rows, which stay
where they are: no candidate is shuffled. Scores are integers, computed by
matrix products in floats wherever these are exact.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stored

K, SCALE, LISTS = 10, 1024, 2
#: Queries in a block, which is broadcast, and queries and candidates that are multiplied at a time.
BLOCK, TILE, ROWS = 16_384, 256, 8_192
_LONG = (-(1 << 63), (1 << 63) - 1)


def quantise(ids: pa.Array, vectors: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and floor(scale * x) of the vectors that are neither null nor hold null or non-finite components."""
    out_ids, out = [], []
    values = vectors.flatten()
    flat, bad = values.to_numpy(zero_copy_only=False).astype(np.float64), values.is_null().to_numpy(zero_copy_only=False)
    ends = np.cumsum([0 if n is None else n for n in pc.list_value_length(vectors).to_pylist()])
    start = 0
    for i, end in enumerate(ends.tolist()):
        part = flat[start:end]
        if vectors[i].is_valid and ids[i].is_valid and np.isfinite(part).all() and not bad[start:end].any():
            out_ids.append(ids[i].as_py())
            out.append(np.floor(part * scale))
        start = end
    return np.array(out_ids, np.int64), out


def matrix(rows: list[np.ndarray], width: int) -> np.ndarray:
    """Rows as a matrix of `width` columns: shorter vectors are filled with zeros, longer ones cut where the others have nothing."""
    if rows and all(len(r) == width for r in rows):
        return np.stack(rows)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : min(width, len(r))] = r[:width]
    return out


def norm(m: np.ndarray) -> float:
    return float(np.sqrt(np.square(m).sum(1).max(initial=0.0)))


def number_type(bound: float):
    """The number type in which sums of products of at most this absolute value are exact."""
    return np.float32 if bound < 1 << 23 else np.float64 if bound < 1 << 52 else object


def convert(m: np.ndarray, kind) -> np.ndarray:
    return m.astype(kind) if kind is not object else np.array([[int(v) for v in r] for r in m], object).reshape(m.shape)


class Tiles:
    """The products of a block of queries with batches of candidates, list by list."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, lists: int):
        self.ids, self.queries, self.norm = ids, queries, norm(queries)
        self.cuts = np.linspace(0, queries.shape[1], lists + 1).astype(int)

    def __call__(self, ids: np.ndarray, rows: list[np.ndarray]) -> Iterator[tuple[slice, np.ndarray, list[np.ndarray]]]:
        """(queries, candidates' ids, the scores in each list) of each tile."""
        for r in range(0, len(ids), ROWS):
            m = matrix(rows[r : r + ROWS], self.queries.shape[1])
            kind = number_type(self.norm * norm(m))
            m = convert(m, kind)
            for q in range(0, len(self.ids), TILE):
                at = slice(q, min(q + TILE, len(self.ids)))
                part = convert(self.queries[at], kind)
                yield at, ids[r : r + ROWS], [part[:, a:b] @ m[:, a:b].T for a, b in zip(self.cuts, self.cuts[1:])]


def gather(tiles: Tiles, k: int, batches: Iterator[tuple[np.ndarray, list[np.ndarray]]]) -> list[list[int]]:
    """Phase 1: for each query at most k scores of distinct rows, high ones."""
    best: list[list[int]] = [[] for _ in tiles.ids]
    for ids, rows in batches:
        for at, cand, parts in tiles(ids, rows):
            whole = sum(parts[1:], parts[0])
            picks = [np.argpartition(-p, min(k, p.shape[1] - 1), axis=1)[:, :k] if p.dtype != object else np.argsort(-p, axis=1, kind="stable")[:, :k] for p in parts]
            for i in range(whole.shape[0]):
                own = np.unique(np.concatenate([p[i] for p in picks]))
                own = own[cand[own] != tiles.ids[at.start + i]]
                got = best[at.start + i] + [min(max(int(v), _LONG[0]), _LONG[1]) for v in whole[i, own]]
                got.sort(reverse=True)
                best[at.start + i] = got[:k]
    return best


def collect(tiles: Tiles, k: int, cutoffs: list[int | None], batches: Iterator[tuple[np.ndarray, list[np.ndarray]]]) -> Iterator[tuple[int, int, int]]:
    """Phases 2 and 3: (query, row, score) of the best k rows of a task among those that reach the cutoff."""
    best: dict[int, list[tuple[int, int]]] = {}
    for ids, rows in batches:
        for at, cand, parts in tiles(ids, rows):
            low = np.array([-np.inf if c is None else c / len(parts) for c in cutoffs[at]])
            low = np.where(np.isfinite(low), np.nextafter(low, -np.inf), low)[:, None]  # never above the quotient
            enough = parts[0] >= low
            for p in parts[1:]:
                enough |= p >= low
            where, col = np.nonzero(enough.astype(bool))
            score = sum(p[where, col] for p in parts)
            floor = np.array([-np.inf if c is None else c for c in cutoffs[at]], object if parts[0].dtype == object else np.float64)[where]
            real = (score >= floor) & (cand[col] != tiles.ids[at][where])
            where, col, score = where[real.astype(bool)], col[real.astype(bool)], score[real.astype(bool)]
            begins = np.searchsorted(where, np.arange(at.stop - at.start + 1))
            for i in np.unique(where).tolist():
                a, b = begins[i], begins[i + 1]
                got = best.get(at.start + i, []) + [(-min(max(int(s), _LONG[0]), _LONG[1]), int(c)) for s, c in zip(score[a:b].tolist(), cand[col[a:b]].tolist())]
                got.sort()
                best[at.start + i] = got[:k]
    for i, got in best.items():
        for s, c in got:
            yield int(tiles.ids[i]), c, -s


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, scale: int = SCALE, lists: int = LISTS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of the highest integer inner product with each query, ties to the smaller id.

    Every row but those with the query's own id is a candidate; rows that repeat
    an id are candidates each. A query id that occurs with several vectors is
    asked once, with the least. Vectors that are null or hold null or non-finite
    components take no part, nor do rows without id; a missing component counts
    as 0. Scores beyond a long count as its bound. With fewer than k
    candidates all are returned; no queries or rows give an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    asked = vectors.filter(is_query).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    sound = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    asked = stored(asked.filter(sound & F.col("id").isNotNull()).groupBy("id").agg(F.min("v").alias("v")), "queries")
    n = asked.count()
    schema = "query_id long, vec_id long, score long"
    out = spark.createDataFrame([], schema)
    for b in range(-(-n // block)):
        mine = asked.filter(F.pmod(F.xxhash64("id"), F.lit(-(-n // block))) == b).collect()
        if not mine:
            continue
        width = max(len(r["v"]) for r in mine)
        queries = matrix([np.floor(np.array(r["v"], np.float64) * scale) for r in mine], max(width, lists))
        sent = spark.sparkContext.broadcast((np.array([r["id"] for r in mine], np.int64), queries))

        def scores(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            tiles = Tiles(*sent.value, lists)
            best = gather(tiles, k, (quantise(x.column(0), x.column(1), scale) for x in batches))
            pairs = [(i, s) for i, own in enumerate(best) for s in own]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([str(p[1]) for p in pairs], pa.string())], names=["q", "s"])

        order = Window.partitionBy("q").orderBy(F.desc("s"))
        gathered = rows.mapInArrow(scores, "q long, s string").select("q", F.col("s").cast("decimal(38,0)").alias("s"))
        kth = gathered.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).filter(F.col("r") == k)
        cutoffs: list[int | None] = [None] * len(mine)
        for r in kth.select("q", "s").collect():  # one row for each query of the block
            cutoffs[r["q"]] = int(r["s"])
        cut = spark.sparkContext.broadcast(cutoffs)

        def entries(batches: Iterator[pa.RecordBatch], sent=sent, cut=cut) -> Iterator[pa.RecordBatch]:
            tiles = Tiles(*sent.value, lists)
            found = list(collect(tiles, k, cut.value, (quantise(x.column(0), x.column(1), scale) for x in batches)))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

        out = out.unionByName(rows.mapInArrow(entries, schema)) if b else rows.mapInArrow(entries, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
