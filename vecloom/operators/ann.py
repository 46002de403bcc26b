"""Approximate search: inverted file (cells around centroids) and navigable small-world graphs per segment.

IVF is the form for large tables: rows are laid out by cell, and a query reads
`nprobe` cells. Graphs are built by a Python operator, inserted in id order with
seeded levels, so a rebuild gives the same graph. A segment of more than PART
rows is dealt by the hash of the id over several graphs of about equal size, so
neither a task's memory nor its time grows with the segment; a search asks all.
"""
from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import PROFILES
from . import search

#: Vectors from which centroids are learned, at most; every row is then assigned.
SAMPLE = 100_000
MAX_LAYERS = 16
#: Rows of a graph, about; a larger segment has several.
PART = 16_384
#: Scores that a build holds at a time.
SCORES = 1 << 21


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _prepared(m: np.ndarray, metric: str) -> np.ndarray:
    return _unit(m) if metric == "cosine" else m


def centroids(rows: DataFrame, cells: int, metric: str = "cosine", rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Cell centres by k-means on a sample of at most SAMPLE rows, the ones of the least id hash."""
    sample = rows.filter(F.size("vector") > 0).select("vector").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(SAMPLE).collect()
    if not sample:
        return np.zeros((0, 0))
    m = _prepared(np.array([r[0] for r in sample], np.float64), metric)
    rng = np.random.default_rng(seed)
    c = m[rng.choice(len(m), min(cells, len(m)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(m @ c.T - np.square(c).sum(1) / 2, axis=1)
        sums, n = np.zeros_like(c), np.bincount(own, minlength=len(c))
        np.add.at(sums, own, m)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def assign(rows: DataFrame, centres: np.ndarray, metric: str = "cosine") -> DataFrame:
    """(id, vector, cell) of every row with a vector; write it partitioned by cell so that a probe prunes the scan."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)  # cells * dimension numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for b in batches:
            if b.num_rows:
                m = _prepared(b.column(1).flatten().to_numpy().astype(np.float64).reshape(b.num_rows, -1), metric)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.argmax(m @ c.T - np.square(c).sum(1) / 2, axis=1), pa.int64())], names=["id", "vector", "cell"])

    return rows.filter(F.size("vector") > 0).select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector")).mapInArrow(run, "id long, vector array<float>, cell long")


def ivf_search(indexed: DataFrame, centres: np.ndarray, queries: DataFrame, k: int = 10, nprobe: int = 8, metric: str = "cosine") -> DataFrame:
    """query_id, rank, id, score: the best k of the nprobe cells whose centres are nearest to each query. Queries are joined to rows by cell, in blocks of bounded size."""
    asked = queries.select(F.col("query_id").cast("long"), F.col("qvec").cast("array<double>")).filter(F.size("qvec") == centres.shape[1])
    out = None
    for mine in search.taken(asked, search.BLOCK):
        q = np.array([r[1] for r in mine], np.float64).reshape(len(mine), centres.shape[1])
        near = np.argsort(-(_prepared(q, metric) @ centres.T - np.square(centres).sum(1) / 2), axis=1, kind="stable")[:, :nprobe] if len(q) else np.empty((0, 0), np.int64)
        by_cell: dict[int, list[int]] = {}
        for i, cells in enumerate(near.tolist()):
            for c in cells:
                by_cell.setdefault(c, []).append(i)
        sent = indexed.sparkSession.sparkContext.broadcast((np.array([r[0] for r in mine], np.int64), q, by_cell))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, qs, wanted = sent.value
            best = search.Best(len(ids), k)
            for batch in batches:
                cells = batch.column(2).to_numpy()
                for c in np.unique(cells).tolist():
                    who = np.array(wanted.get(c, []), np.int64)
                    own, m = search.matrix(batch.filter(pa.array(cells == c)), qs.shape[1])
                    if len(who) and len(own):
                        best.add_rows(who, qs, own, m, metric)
            best.cut()
            yield pa.RecordBatch.from_arrays([pa.array(ids[best.q]), pa.array(best.id), pa.array(best.score)], names=["query_id", "id", "score"])

        part = indexed.filter(F.col("cell").isin(sorted(by_cell))).select("id", "vector", "cell").mapInArrow(run, "query_id long, id long, score double")
        out = part if out is None else out.unionByName(part)
    return search.ranked(out, ["query_id"], k).select("query_id", "rank", "id", "score")


class Graph:
    """A layered navigable small-world graph over a segment's vectors."""

    def __init__(self, m: np.ndarray, metric: str = "cosine", profile: str = "balanced", seed: int = 7):
        self.m, self.metric = _prepared(m.astype(np.float64), metric), metric
        self.degree, self.build_beam, self.beam = PROFILES[profile]
        self.layers: list[dict[int, list[int]]] = []
        self.entry = -1
        levels = np.minimum(np.floor(-np.log(1 - np.random.default_rng(seed).random(len(m))) / log(self.degree)).astype(int), MAX_LAYERS - 1).tolist()
        if metric == "l2":  # by differences, which are exact for near rows
            for i, level in enumerate(levels):
                self._insert(i, level, self._to(self.m[i]))
            return
        at = 0
        while at < len(levels):  # a block's scores with all rows before its end, by one multiplication
            end = min(len(levels), at + max(1, min(256, SCORES // len(levels))))
            for i, row in enumerate(self.m[at:end] @ self.m[:end].T, at):
                self._insert(i, levels[i], self._among(memoryview(row)))
            at = end

    @classmethod
    def load(cls, m: np.ndarray, layers: list[dict[int, list[int]]], metric: str = "cosine", profile: str = "balanced") -> Graph:
        """A graph that was built before, over the same vectors in the same order."""
        g = cls(m[:0], metric, profile)
        g.m, g.layers, g.entry = _prepared(m.astype(np.float64), metric), layers, min(layers[-1]) if layers else -1
        return g

    def scores(self, q: np.ndarray, to: list[int]) -> np.ndarray:
        return self._with(self.m.take(to, 0), q)

    def _with(self, v: np.ndarray, q: np.ndarray) -> np.ndarray:
        return -np.square(v - q).sum(1) if self.metric == "l2" else v @ q

    def _to(self, q: np.ndarray) -> Callable[[list[int]], list[float]]:
        return lambda to: self.scores(q, to).tolist()

    @staticmethod
    def _among(row: memoryview) -> Callable[[list[int]], list[float]]:
        return lambda to: [row[j] for j in to]

    def _beam(self, scores: Callable[[list[int]], list[float]], start: list[int], width: int, layer: int) -> list[tuple[float, int]]:
        links, push, pop, pushpop = self.layers[layer], heapq.heappush, heapq.heappop, heapq.heappushpop
        seen = set(start)
        found = [(s, -i) for s, i in zip(scores(start), start)]
        open_ = [(-s, -i) for s, i in found]
        heapq.heapify(found)
        heapq.heapify(open_)
        while open_:
            s, i = pop(open_)
            full, least = len(found) >= width, found[0][0]
            if full and -s < least:
                break
            fresh = [j for j in links[i] if j not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for t, j in zip(scores(fresh), fresh):
                if not full:
                    push(found, (t, -j))
                    push(open_, (-t, j))
                    full, least = len(found) >= width, found[0][0]
                elif t > least:
                    pushpop(found, (t, -j))
                    push(open_, (-t, j))
                    least = found[0][0]
        return sorted(((s, -i) for s, i in found), key=lambda x: (-x[0], x[1]))

    def _spread(self, near: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours that lie closer to the new node than to those already taken; the rest fill up."""
        ids = [i for _, i in near]
        v, s = self.m.take(ids, 0), np.array([x for x, _ in near])
        free, kept, at = np.ones(len(ids), bool), [0], 1
        closest = self._with(v, v[0])
        while at < len(ids) and len(kept) < most:
            closer = closest[at:] < s[at:]
            n = int(closer.argmax())
            if not closer[n]:
                break
            kept.append(at + n)
            closest = np.maximum(closest, self._with(v, v[at + n]))
            at += n + 1
        free[kept] = False
        return [ids[n] for n in kept + np.flatnonzero(free)[: most - len(kept)].tolist()]

    def _prune(self, nodes: list[int], lists: list[list[int]]) -> list[list[int]]:
        """`_spread` of the neighbours of several nodes, one too many each, side by side."""
        to = np.array(lists)
        own, v = self.m.take(nodes, 0), self.m.take(to, 0)
        s = -np.square(v - own[:, None]).sum(2) if self.metric == "l2" else (v @ own[:, :, None])[:, :, 0]
        to = np.take_along_axis(to, order := np.lexsort((to, -s)), 1)
        s, v = np.take_along_axis(s, order, 1), self.m.take(to, 0)
        if self.metric == "l2":  # seen from the node, so that common parts do not cancel
            v = v - own[:, None]
            n = np.square(v).sum(2)
            pairs = 2 * (v @ v.transpose(0, 2, 1)) - n[:, :, None] - n[:, None, :]
        else:
            pairs = v @ v.transpose(0, 2, 1)
        closest, kept = np.full(to.shape, -np.inf), np.empty(to.shape, bool)
        for c in range(to.shape[1]):
            kept[:, c] = new = closest[:, c] < s[:, c]
            np.maximum(closest, pairs[:, c], out=closest, where=new[:, None])
        return np.take_along_axis(to, np.argsort(~kept, axis=1, kind="stable"), 1)[:, :-1].tolist()

    def _insert(self, node: int, level: int, scores: Callable[[list[int]], list[float]]) -> None:
        top = len(self.layers) - 1
        while len(self.layers) <= level:
            self.layers.append({})
        for layer in range(level + 1):
            self.layers[layer][node] = []
        if self.entry < 0:
            self.entry = node
            return
        at = [self.entry]
        for layer in range(top, level, -1):
            at = [self._beam(scores, at, 1, layer)[0][1]]
        for layer in range(min(level, top), -1, -1):
            links = self.layers[layer]
            near = self._beam(scores, at, self.build_beam, layer)
            most = self.degree * (2 if layer == 0 else 1)
            links[node] = self._spread(near, self.degree)
            full = []
            for other in links[node]:
                links[other].append(node)
                if len(links[other]) > most:
                    full.append(other)
            if full:
                links.update(zip(full, self._prune(full, [links[i] for i in full])))
            at = [i for _, i in near]
        if level > top:
            self.entry = node

    def search(self, q: np.ndarray, k: int, beam: int | None = None) -> list[tuple[float, int]]:
        if self.entry < 0 or k <= 0:
            return []
        scores = self._to(_prepared(np.asarray(q, np.float64)[None], self.metric)[0])
        at = [self.entry]
        for layer in range(len(self.layers) - 1, 0, -1):
            at = [self._beam(scores, at, 1, layer)[0][1]]
        return self._beam(scores, at, max(beam or self.beam, k), 0)[:k]


def _segments(rows: DataFrame) -> DataFrame:
    return rows.filter(F.size("vector") > 0).select(F.col("segment_id").cast("long").alias("segment_id"), "id", "vector")


def _vectors(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """A graph's rows in id order, and their vectors."""
    t = t.sort_by("id").combine_chunks()
    v = t["vector"].combine_chunks()
    if pc.count_distinct(pc.list_value_length(v)).as_py() > 1:
        raise ValueError("vectors of different lengths in a segment")
    return t, v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(t), -1)


def _dealt(rows: DataFrame, parts: DataFrame, *more: str) -> DataFrame:
    """Rows with their graph's number within the segment; `parts` (segment_id, parts) has one row for each segment."""
    return rows.join(F.broadcast(parts.withColumnRenamed("segment_id", "_of")), F.col("segment_id").eqNullSafe(F.col("_of"))).select("segment_id", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), "id", "vector", *more)


def graph_edges(rows: DataFrame, metric: str = "cosine", profile: str = "balanced", part: int = PART) -> DataFrame:
    """(segment_id, part, layer, ord, neighbours): the graphs of each segment's live rows, as a table to be kept. A segment has one graph for each `part` rows begun; a node is its row's place in its graph's order of ids."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # one graph's rows
        if not held:
            return
        t, m = _vectors(pa.Table.from_batches(held))
        g = Graph(m, metric, profile)
        out = [(t["segment_id"][0].as_py(), t["part"][0].as_py(), layer, i, links) for layer, nodes in enumerate(g.layers) for i, links in nodes.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32())))], names=["segment_id", "part", "layer", "ord", "neighbours"])

    live = _segments(rows)
    counts = live.groupBy("segment_id").agg(F.ceil(F.count("*") / part).alias("parts")).collect()  # one row for each segment
    firsts = np.cumsum([0] + [r[1] for r in counts]).tolist()  # each graph has a task of its own, by number
    parts = rows.sparkSession.createDataFrame([(*r, n) for r, n in zip(counts, firsts)], "segment_id long, parts long, first long")
    dealt = _dealt(live, parts, "first").repartitionById(max(1, firsts[-1]), (F.col("first") + F.col("part")).cast("int"))
    return dealt.drop("first").mapInArrow(build, "segment_id long, part long, layer int, ord int, neighbours array<int>")


def _parted(edges: DataFrame) -> DataFrame:
    """Edges with their graph's number; graphs that were stored without one are their segment's only one."""
    return edges.withColumn("part", F.coalesce("part", F.lit(0)) if "part" in edges.columns else F.lit(0)).withColumn("part", F.col("part").cast("long"))


#: Rows of upper layers that may be pinned in every worker.
MAX_PINNED = 2_000_000


def pin(edges: DataFrame) -> dict[tuple[int, int], dict[int, dict[int, list[int]]]]:
    """(segment, part): layer: node: neighbours of the layers above the lowest, about one node in the degree; refused above MAX_PINNED rows. A search with it reads layer 0 alone."""
    rows = _parted(edges).filter("layer > 0").select("segment_id", "part", "layer", "ord", "neighbours").limit(MAX_PINNED + 1).collect()
    if len(rows) > MAX_PINNED:
        raise ValueError(f"more than {MAX_PINNED} nodes to pin")
    out: dict[tuple[int, int], dict[int, dict[int, list[int]]]] = {}
    for r in rows:
        out.setdefault((r[0], r[1]), {}).setdefault(r[2], {})[r[3]] = r[4]
    return out


def graph_search(rows: DataFrame, edges: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", profile: str = "balanced", beam: int | None = None, pinned: dict | None = None) -> DataFrame:
    """query_id, rank, id, score: each segment's stored graphs answer every query of a block, and the answers are merged.

    `rows` are the segments' live rows that `edges` was built from. Segments
    without a graph answer nothing. With `pinned` upper layers only the edges of
    layer 0 are read.
    """
    spark = rows.sparkSession
    above = spark.sparkContext.broadcast(pinned) if pinned is not None else None
    kind = rows.schema["id"].dataType.simpleString()

    def answer(sent):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            hits = []
            if len(left) and len(right):
                t, m = _vectors(left)
                layers: dict[int, dict[int, list[int]]] = {n: dict(nodes) for n, nodes in above.value.get((t["segment_id"][0].as_py(), t["part"][0].as_py()), {}).items()} if above else {}
                for n, i, links in zip(*(right[c].to_pylist() for c in ("layer", "ord", "neighbours"))):
                    layers.setdefault(n, {})[i] = links
                g = Graph.load(m, [layers[n] for n in sorted(layers)], metric, profile)
                ids = t["id"].to_pylist()
                hits = [(n, ids[i], s) for n, q in sent.value if len(q) == m.shape[1] for s, i in g.search(np.array(q), k, beam)]
            return pa.table([pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], left.schema.field("id").type), pa.array([h[2] for h in hits], pa.float64())], names=["query_id", "id", "score"])

        return run

    asked = queries.select(F.col("query_id").cast("long"), F.col("qvec").cast("array<double>")).filter("query_id is not null and size(qvec) > 0")
    kept = _parted(edges.filter("layer = 0") if above else edges).select(F.col("segment_id").cast("long").alias("segment_id"), "part", "layer", "ord", "neighbours")
    dealt = _dealt(_segments(rows), kept.groupBy("segment_id").agg((F.max("part") + 1).alias("parts")))
    out = None
    for mine in search.taken(asked, search.BLOCK):
        sent = spark.sparkContext.broadcast([(r[0], r[1]) for r in mine])
        part = dealt.groupBy("segment_id", "part").cogroup(kept.groupBy("segment_id", "part")).applyInArrow(answer(sent), f"query_id long, id {kind}, score double")
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return search.ranked(best, ["query_id"], k).select("query_id", "rank", "id", "score")


def check_edges(edges: DataFrame, profile: str = "balanced") -> DataFrame:
    """(problem, n) of a table of edges: self-loops, nodes of too high a degree, neighbours that are not on the layer."""
    degree = PROFILES[profile][0]
    limit = F.when(F.col("layer") == 0, 2 * degree).otherwise(degree)
    edges = _parted(edges)
    pairs = edges.select("segment_id", "part", "layer", "ord", F.explode("neighbours").alias("to"))
    absent = pairs.join(edges.select("segment_id", "part", "layer", F.col("ord").alias("to")), ["segment_id", "part", "layer", "to"], "left_anti")

    def n(df: DataFrame, problem: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(problem).alias("problem"), "n")

    return n(pairs.filter(F.col("ord") == F.col("to")), "self_loop").unionByName(n(edges.filter(F.size("neighbours") > limit), "degree")).unionByName(n(absent, "absent"))
