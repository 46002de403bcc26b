"""N-gram Jaccard join.

Documents are sets of 64-bit hashes of their word shingles; equal sets are one
class from the start. Two sets of Jaccard similarity >= t share a shingle among
the |S| - ceil(t|S|) + 1 first of each, in any order that is fixed for all; the
order used puts shingles that many documents hold last, so passages that are
common to unrelated documents bring no candidates together.

1. Texts are coded in chunks; the number of holders of each shingle goes there
   and back (see chunks).
2. Each chunk emits the prefix shingles that others hold too, at most one row per
   shingle (its other holders are tied to the one named by an edge at once), so a
   hot shingle has as many rows as there are chunks. Holders of one shingle are
   tied to its first holder.
3. Connected components of these ties are blocks: every link lies within one.
4. In each block, or each pair of parts of a large one, T-occurrence search by
   DivideSkip finds the links: the longest inverted lists are put aside, the
   others are heap-merged, and what occurs in enough of them is looked up in the
   long ones by binary search. A set is not compared with those that are already
   linked to it, directly or not, so a group of near copies costs about its size
   and never all its pairs.
5. Components of the links, then the smallest id in each.

Nothing here is collected to the driver or broadcast.
"""
from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import merge
from itertools import groupby
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import SENT, Texts, bits_for, coded, finish, returned, rows_of, sent, sums_of
from .common import aside, drop, need_integer, ship, stored, trim

WIDTH, PERCENT = 4, 85
#: Bytes of text in a chunk.
CHUNK = 4 << 20
#: Shingles in a part of a block: two parts are searched at a time.
PART = 2_000_000
#: Above so many entries the short lists are merged by sorting instead of a heap.
HEAP = 4_096
#: Weight of the list length in DivideSkip's choice of long lists.
MU = 0.02
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def shingle_sets(h: np.ndarray, n: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, from its words' hashes; the whole sequence where it has fewer words; empty without words."""
    ends = np.cumsum(n)
    with np.errstate(over="ignore"):
        total = max(0, len(h) - width + 1)
        mixed = np.zeros(total, np.uint64)
        for k in range(width):
            mixed += h[k : k + total] * _MIX[k % 4] + np.uint64(k // 4)
        mixed = finish(mixed)
        out = []
        for end, count in zip(ends.tolist(), n.tolist()):
            if count >= width:
                out.append(np.unique(mixed[end - count : end - width + 1]))
            elif count:
                out.append(finish((h[end - count : end] * _MIX[np.arange(count) % 4]).sum(keepdims=True, dtype=np.uint64) + np.uint64(count)))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def class_of(s: np.ndarray) -> int:
    """A set's class: a signed 64-bit digest of it."""
    v = xxhash.xxh3_64_intdigest(s.tobytes())
    return v - (1 << 64) if v >> 63 else v


class Sets(Texts):
    """A chunk's shingle sets, their classes, and each class once."""

    def __init__(self, row: dict, width: int):
        super().__init__(row)
        self.sets = shingle_sets(self.words[self.tokens] if len(self.words) else self.words, self.n, width)
        self.classes = [class_of(s) for s in self.sets]
        self.once = {c: s for c, s in zip(self.classes, self.sets) if len(s)}
        self.sizes = [len(s) for s in self.sets]
        del self.words, self.tokens, self.sets

    def held(self) -> tuple[np.ndarray, np.ndarray]:
        """The chunk's shingles, sorted, and the classes that hold each."""
        return np.unique(np.concatenate(list(self.once.values())), return_counts=True) if self.once else (np.empty(0, np.uint64), np.empty(0, np.int64))


def send(chunks: DataFrame, bits: int, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            keys, times = Sets(row, width).held()
            yield from sent(row["chunk"], 0, keys, [times], bits)

    return chunks.mapInArrow(run, SENT)


def prefix(s: np.ndarray, holders: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set in the common order, by holders and then by hash, without those that nobody else holds."""
    keep = len(s) - -(-percent * len(s) // 100) + 1
    first = np.argsort(holders, kind="stable")[:keep]
    return s[first[holders[first] > 1]]


def prefixes(chunks: DataFrame, back: DataFrame, width: int, percent: int) -> DataFrame:
    """k = 0: (shingle, class) of a prefix shingle; 1: (class, class) that one prefix shingle ties within the chunk; 2: (id, class, size, chunk) of a document."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        c = Sets(row, width)
        keys, _ = c.held()
        holders = sums_of(right.to_pylist(), 0, 0)
        parts = [prefix(s, holders[np.searchsorted(keys, s)], percent) for s in c.once.values()]
        token = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        cls = np.repeat(np.fromiter(c.once, np.int64, len(c.once)), [len(p) for p in parts])
        order = np.lexsort((cls, token))
        token, cls = token[order].view(np.int64), cls[order]
        first, hub = _stars(token, cls)
        pairs = np.unique(np.stack([cls[~first], hub[~first]], 1), axis=0)
        kinds = np.repeat([0, 1, 2], [int(first.sum()), len(pairs), len(c.ids)])
        a = pa.chunked_array([pa.array(token[first]), pa.array(pairs[:, 0]), pa.array(c.ids, pa.int64())])
        b = np.r_[cls[first], pairs[:, 1], np.array(c.classes, np.int64)]
        n = np.r_[np.zeros(len(kinds) - len(c.ids), np.int64), np.array(c.sizes, np.int64)]
        trim()
        return pa.table([pa.array(kinds, pa.int64()), a, pa.array(b, pa.int64()), pa.array(n, pa.int64()), pa.array(np.full(len(kinds), row["chunk"], np.int64))], names=["k", "a", "b", "n", "chunk"])

    return chunks.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(run, "k long, a long, b long, n long, chunk long")


def _stars(token: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by token: where each token's rows begin, and for each row the first class of its token."""
    first = np.r_[True, token[1:] != token[:-1]] if len(token) else np.empty(0, bool)
    return first, cls[np.maximum.accumulate(np.where(first, np.arange(len(token)), 0))] if len(token) else cls


def ties(rows: DataFrame) -> DataFrame:
    """(a, b): pairs of classes that tie the holders of each prefix shingle together; distinct. `rows`: (k, a, b) of `prefixes`."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # token and first class of the rows before
        for batch in batches:
            kind, a, b = (c.to_numpy() for c in batch.columns)
            done = kind == 1
            token, cls = a[~done], b[~done]
            if last and len(token):
                token, cls = np.r_[last[0], token], np.r_[last[1], cls]
            _, hub = _stars(token, cls)
            if len(token):
                last = token[-1], hub[-1]
            other = hub != cls
            pairs = np.unique(np.stack([np.r_[a[done], cls[other]], np.r_[b[done], hub[other]]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return rows.repartition("a").sortWithinPartitions("k", "a", "b").mapInArrow(gather, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root, old) of every node of the edges (a, b); root: the least node reachable. Labels go to neighbours and then jump to their label's label, until none changes; each round is written out."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        moved = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("old"), F.least("root", "near").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("root").alias("far"))
        new = stored(moved.join(jump, "via").select("node", F.least("via", "far").alias("root"), "old"), "labels")
        drop(labels)
        labels = new
        if new.filter(F.col("root") != F.col("old")).isEmpty():
            drop(both)
            return new


class Search:
    """T-occurrence search among the sets of one cell, with a union-find over them."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT, sides: np.ndarray | None = None):
        self.percent, self.n, self.sides = percent, np.array([len(s) for s in sets]), sides
        self.comp, self.smallest = np.arange(len(sets)), int(self.n.min())
        self.members = {i: [i] for i in range(len(sets))}
        _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), self.n)
        self.weight = np.bincount(owner, times[token] / self.n[owner], len(sets))
        self._index(token.astype(np.int64), owner)

    def _index(self, token: np.ndarray, owner: np.ndarray) -> None:
        """Inverted lists of the shingles that sets of more than one component hold; no others can count for two sets to be linked."""
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        if len(token):
            starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            comp = self.comp[owner]
            mixed = np.minimum.reduceat(comp, starts) != np.maximum.reduceat(comp, starts)
            keep = np.repeat(mixed, np.diff(np.r_[starts, len(token)]))
            token, owner = token[keep], owner[keep]
        _, self.token = np.unique(token, return_inverse=True)
        self.owner, self.starts = owner, np.searchsorted(self.token, np.arange(self.token.max(initial=-1) + 2))
        by = np.argsort(owner, kind="stable")
        self.held, self.at = self.token[by], np.searchsorted(owner[by], np.arange(len(self.n) + 1))
        self.indexed_for = len(self.members)

    def matches(self, x: int) -> list[int]:
        """Sets outside x's component that are similar enough to x, by DivideSkip."""
        size, p = int(self.n[x]), self.percent
        smallest = max(-(-p * size // 100), self.smallest)  # of the sets that can be similar
        need = -(-p * (size + smallest) // (100 + p))
        held = self.held[self.at[x] : self.at[x + 1]]
        if len(held) < need:
            return []
        lengths = self.starts[held + 1] - self.starts[held]
        held = held[np.argsort(lengths, kind="stable")]
        aside = min(need - 1, int(need / (MU * log2(max(2, int(lengths.max()))) + 1)))
        lists = [self.owner[self.starts[t] : self.starts[t + 1]] for t in held.tolist()]
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        if sum(map(len, short)) > HEAP:
            return self._merged_by_sorting(x, need, short, long)
        out = []
        for y, g in groupby(merge(*[s.tolist() for s in short])):
            common = sum(1 for _ in g)
            if common < need - len(long) or self.comp[y] == self.comp[x] or (self.sides is not None and self.sides[y] == self.sides[x]):
                continue
            wanted = -(-p * (size + int(self.n[y])) // (100 + p))
            for left, s in zip(range(len(long), 0, -1), long):
                if common + left < wanted:
                    break
                k = bisect_left(s, y)
                common += k < len(s) and s[k] == y
            if common >= wanted:
                out.append(y)
        return out

    def _merged_by_sorting(self, x: int, need: int, short: list[np.ndarray], long: list[np.ndarray]) -> list[int]:
        """The same for many entries: one sort merges the short lists, and all candidates probe a long list at once."""
        y, common = np.unique(np.concatenate(short), return_counts=True)
        keep = (common >= need - len(long)) & (self.comp[y] != self.comp[x])
        if self.sides is not None:
            keep &= self.sides[y] != self.sides[x]
        y, common = y[keep], common[keep]
        wanted = -(-self.percent * (self.n[x] + self.n[y]) // (100 + self.percent))
        for left, s in zip(range(len(long), 0, -1), long):
            if left % 8 == 0 or left == len(long):
                alive = common + left >= wanted
                y, common, wanted = y[alive], common[alive], wanted[alive]
                if not len(y):
                    return []
            common += s[np.minimum(np.searchsorted(s, y), len(s) - 1)] == y
        return y[common >= wanted].tolist()

    def union(self, x: int, y: int) -> None:
        a, b = self.comp[x], self.comp[y]
        if a == b:
            return
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        self.comp[self.members[b]] = a
        self.members[a] += self.members.pop(b)
        if self.largest == b or len(self.members[a]) > len(self.members[self.largest]):
            self.largest = a

    def run(self) -> np.ndarray:
        """The component of each set. Every pair of sets in different components has been compared: one of them is outside the largest component and was looked up. The sets with the most common shingles come first, since what they link drops out of the lists."""
        self.largest, waiting = next(iter(self.members), 0), np.argsort(-self.weight, kind="stable").tolist()
        while waiting:
            put_off = []
            for x in waiting:
                if self.comp[x] == self.largest and len(self.members[self.largest]) > 1:
                    put_off.append(x)
                    continue
                for y in self.matches(x):
                    self.union(x, y)
                if 2 * len(self.members) <= self.indexed_for and self.indexed_for > 16:
                    self._index(self.token, self.owner)
            waiting = put_off if any(self.comp[x] != self.largest for x in put_off) else []  # the largest can have changed meanwhile
        return self.comp


def link_cells(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): in each cell (block, i, j) each set that is linked to others, and the first of them. With i = j all pairs of the cell count, else those between the parts."""

    def cell(ids: list[int], sides: list[int], sets: list[bytes], i: int, j: int) -> tuple[list[int], list[int]]:
        once = {c: (side, np.frombuffer(s, np.uint64)) for c, side, s in zip(ids, sides, sets)}
        names = list(once)
        if len(names) < 2:
            return [], []
        found = Search([s for _, s in once.values()], percent, None if i == j else np.array([side for side, _ in once.values()])).run()
        return [names[x] for x in range(len(names)) if found[x] != x], [names[found[x]] for x in range(len(names)) if found[x] != x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sides, sets = None, [], [], []
        out_a, out_b = [], []

        def close():
            if key is not None:
                a, b = cell(ids, sides, sets, key[1], key[2])
                out_a.extend(a)
                out_b.extend(b)

        for batch in batches:
            block, i, j, side, cls = (batch.column(k).to_pylist() for k in range(5))
            data = batch.column(5)
            for r, now in enumerate(zip(block, i, j)):
                if now != key:
                    close()
                    key, ids, sides, sets = now, [], [], []
                ids.append(cls[r])
                sides.append(side[r])
                sets.append(data[r].as_py())
            if len(out_a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])
                out_a, out_b = [], []
        close()
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return rows.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "cls").mapInArrow(run, "a long, b long")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per input row: its id, n_shingles and component_id, the smallest id that links lead to.

    Documents link when 100 * common >= percent * all shingles of the two. Null
    texts and texts without words have no shingles, are linked with nothing and
    are their own component. Rows that repeat an id each get a row; a null id
    counts only if its component has no other. An empty table gives an empty
    result. Ids must be integers.
    """
    need_integer(docs, id_col)
    ship(docs.sparkSession)
    chunks = stored(coded(docs, id_col, text_col, CHUNK), "chunks")
    entries = chunks.agg(F.coalesce(F.sum(F.octet_length("tokens")), F.lit(0))).first()[0]  # about two bytes for each token
    back = stored(returned(send(chunks, bits_for(int(entries) // 2), width)), "holders")
    seen = stored(prefixes(chunks, back, width, percent), "prefixes")
    drop(back)
    rows = seen.filter("k = 2").select(F.col("a").alias("id"), F.col("b").alias("cls"), "n", "chunk")
    blocks = components(ties(seen.filter("k < 2").select("k", "a", "b")))
    scratch = [chunks, blocks]

    held = rows.filter("n > 0").groupBy("cls").agg(F.min("chunk").alias("chunk"), F.first("n").alias("n"))
    held = held.join(blocks, F.col("cls") == F.col("node")).select("chunk", "cls", "n", F.col("root").alias("block"))
    parts = held.groupBy("block").agg(F.ceil(F.sum("n") / F.lit(PART / 2)).cast("int").alias("parts"))
    parts = stored(parts.select("block", F.when(F.col("parts") <= 4, 1).otherwise(F.col("parts")).alias("parts")), "parts")  # as tables of their own on both sides, a hot block is split by the join
    held = stored(held.join(parts, "block").select("chunk", "cls", "block", "parts"), "held")
    scratch += [parts, held]

    def sets_of(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted = right.select(["cls", "block", "parts"])
        once = Sets(left.to_pylist()[0], width).once if len(wanted) else {}
        return wanted.append_column("tokens", pa.array([once[c].tobytes() for c in wanted["cls"].to_pylist()], pa.binary()))

    found = chunks.join(held.select("chunk").distinct(), "chunk", "left_semi").groupBy("chunk").cogroup(held.groupBy("chunk")).applyInArrow(sets_of, "cls long, block long, parts int, tokens binary")
    found = found.withColumn("side", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    cells = found.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select("block", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "cls", "tokens")
    links = stored(link_cells(cells, percent), "links")
    whole = held.filter("parts > 1").isEmpty()
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root")) if whole else components(links).select("node", "root")
    drop(*scratch)

    tagged = rows.join(roots, F.col("cls") == F.col("node"), "left").select("id", "n", F.coalesce("root", "cls").alias("root"))
    real = tagged.filter("n > 0")
    least = stored(real.groupBy("root").agg(F.min("id").alias("component_id")), "least")
    linked = real.join(least, "root").select("id", "n", "component_id")
    return linked.unionByName(tagged.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row of each component: that of the smallest id, a null id last, and of rows that repeat this id one. Rows without words all stay.

    Rows are told apart by a key of their own, written out with them so that it
    is the same in every pass. Ids may be of any type that has an order; columns
    pass through whatever their names; an empty table gives an empty result.
    """
    docs, back = aside(docs, "_row")
    id_col, text_col = ({old: new for new, old in back.items()}.get(c, c) for c in (id_col, text_col))
    keyed = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "keyed")
    found = join(keyed.select("_row", F.col(text_col).alias("text")), "_row", "text", **kw)
    rows = found.join(keyed.select("_row", F.col(id_col).alias("_id")), "_row")
    first = F.min(F.struct(F.col("_id").isNull(), "_id", "_row"))
    best = rows.filter("n_shingles > 0").groupBy("component_id").agg(first.alias("first")).select("first._row")
    return keyed.join(best.union(rows.filter("n_shingles = 0").select("_row")), "_row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns]).withColumnsRenamed(back)
