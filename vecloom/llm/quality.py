"""Quality rules by compression bands.

zstandard ratios (bytes over compressed bytes) of the whole text and of its
fixed chunks must lie in a band that depends on the length: repetitive text
compresses too well, random text too little. The limits are fitted on labelled
documents, or given. Counts of words, symbols and repeats accompany the verdict.

A Python operator, since zstandard is no Spark function: mapInArrow, one
document at a time, no shuffle. To fit limits, all labelled documents are measured
and what was measured is sorted; the driver gets sums and a few ranks of it.
"""
from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, ship, stored, trim

#: zstandard level, and bytes of a chunk. A last chunk of under half of it is joined to the one before.
LEVEL, CHUNK = 3, 4096
#: Share of a text's chunks outside their band that rejects it.
CHUNK_SHARE = 0.5
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: Good documents on each side that a fitted limit gives up, in thousandths; room beyond the limit, as a ratio's share; documents of a length that a limit needs, and lengths that have one.
GIVEN_UP, ROOM, ENOUGH, GROUPS = 2, 0.02, 100, 24
EDGES = GIVEN_UP / 1000, 1 - GIVEN_UP / 1000
_SYMBOLS, _WHITE = b"#*$%&|<>", "\x20\t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Limits:
    """A band of ratios at some lengths in bytes, in powers of two; between them it is interpolated, past the ends it goes on as between the last two, and up only past the last."""

    at: tuple[float, ...]
    least: tuple[float, ...]
    most: tuple[float, ...]
    chunk: tuple[float, float]

    def band(self, length: int) -> tuple[float, float]:
        x, out = np.log2(max(length, 1)), []
        for side in (self.least, self.most):
            y = float(np.interp(x, self.at, side))
            if len(self.at) > 1 and x > self.at[-1]:
                y += max(0.0, (side[-1] - side[-2]) / (self.at[-1] - self.at[-2])) * (x - self.at[-1]) * (side is self.most)
            elif len(self.at) > 1 and x < self.at[0]:
                y -= max(0.0, (side[1] - side[0]) / (self.at[1] - self.at[0])) * (self.at[0] - x) * (side is self.least)
            out.append(y)
        return out[0], out[1]


#: Limits for texts without labels: wide ones. Short texts hardly compress, long ones share more.
WIDE = Limits((6.0, 8.0, 10.0, 12.0, 14.0, 16.0), (0.0, 1.15, 1.4, 1.5, 1.55, 1.6), (3.5, 4.0, 4.5, 5.5, 7.0, 8.0), (1.4, 5.5))


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of `width` words that occur twice or more, each word once."""
    n = len(words)
    if n < width:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    key = ids[: n - width + 1].copy()
    for k in range(1, width):  # ranks after each step keep the key below n * n
        key = key * len(seen) + ids[k : n - width + 1 + k]
        if k < width - 1:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
    _, where, times = np.unique(key, return_inverse=True, return_counts=True)
    hit = times[where] > 1
    mark = np.zeros(n, bool)
    for k in range(width):
        mark[k : n - width + 1 + k] |= hit
    return int(mark.sum())


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """COUNTS of a text; all 0 for null."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), len(text) - sum(map(text.count, _WHITE)), len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words)


def ratios(raw: bytes, pack: zstandard.ZstdCompressor) -> tuple[float, list[float]]:
    """Ratio of the whole and of each chunk."""
    if not raw:
        return 0.0, []
    whole = len(raw) / len(pack.compress(raw))
    if len(raw) < 1.5 * CHUNK:
        return whole, [whole]
    ends = list(range(CHUNK, len(raw) - CHUNK // 2, CHUNK)) + [len(raw)]
    return whole, [(b - a) / len(pack.compress(raw[a:b])) for a, b in zip([0, *ends], ends)]


def in_bands(raw: bytes, whole: float, chunks: list[float], limits: Limits = WIDE) -> bool:
    """Whether a text keeps to its bands. An empty text doesn't."""
    if not raw:
        return False
    low, high = limits.band(len(raw))
    if not low <= whole <= high:
        return False
    if len(raw) < 1.5 * CHUNK:
        return True
    out = sum(not limits.chunk[0] <= r <= limits.chunk[1] for r in chunks)
    return out < CHUNK_SHARE * len(chunks)


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > REPEAT_PERCENT * n_words


def judge_text(text: str | None, pack: zstandard.ZstdCompressor, limits: Limits = WIDE) -> tuple:
    n, chars, symbols, dup, rep = counts(text)
    raw = (text or "").encode()
    whole, chunks = ratios(raw, pack)
    failed = base_failed(n, rep)
    return n, chars, symbols, dup, rep, failed, whole, min(chunks, default=0.0), max(chunks, default=0.0), not failed and in_bands(raw, whole, chunks, limits)


def fit(lengths: np.ndarray, wholes: np.ndarray, chunks: np.ndarray) -> Limits:
    """The limits that leave all but GIVEN_UP thousandths of good texts inside, with ROOM. `chunks`: ratios of the good texts' chunks.

    Ratios grow with the logarithm of the length. The good texts are put in
    groups by length; a line through each is taken off, what is left gives the
    group's quantiles, and these hold at its middle, and at the ends of the
    shortest and the longest group. Fewer than ENOUGH good texts give WIDE.
    """
    if len(lengths) < ENOUGH:
        return WIDE
    x = np.log2(np.maximum(lengths, 1).astype(np.float64))
    groups = []
    for part in np.array_split(np.lexsort((wholes, x)), max(1, min(GROUPS, len(x) // ENOUGH))):
        own, y = x[part], wholes[part]
        slope, start = np.polyfit(own, y, 1) if np.ptp(own) > 0 else (0.0, y.mean())
        groups.append((own.min(), np.median(own), own.max(), slope, start, *np.quantile(y - (slope * own + start), EDGES)))
    return _limits(groups, np.quantile(chunks, EDGES) if len(chunks) >= ENOUGH else None)


def _limits(groups: list[tuple], chunk: tuple[float, float] | None) -> Limits:
    """Limits from each group's least, middle and greatest logarithm of a length, its line and the EDGES of what is left, and the EDGES of all chunks."""
    points: dict[float, tuple[float, float]] = {}
    for i, (shortest, middle, longest, slope, start, low, high) in enumerate(groups):
        for place in [shortest] * (i == 0) + [middle] + [longest] * (i == len(groups) - 1):
            points.setdefault(float(place), (float((slope * place + start + low) * (1 - ROOM)), float((slope * place + start + high) * (1 + ROOM))))
    at = sorted(points)
    both = WIDE.chunk if chunk is None else (float(chunk[0] * (1 - ROOM)), float(chunk[1] * (1 + ROOM)))
    return Limits(tuple(at), tuple(points[p][0] for p in at), tuple(points[p][1] for p in at), both)


def _ordered(rows: DataFrame, *by: str) -> tuple[DataFrame, Callable[[int], int]]:
    """The rows with `_at`, which grows in the order of `by`, and the `_at` of the row of a rank from 0. No task has all rows; of each partition its size comes to the driver."""
    out = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    sizes = sorted(tuple(r) for r in out.groupBy(F.shiftright("_at", 33).alias("part")).count().collect())
    first = np.cumsum([0, *(n for _, n in sizes)]).tolist()

    def at(rank: int) -> int:
        k = bisect_right(first, rank) - 1
        return (sizes[k][0] << 33) + rank - first[k]

    return out, at


def _edges(begin: int, n: int) -> list[tuple[int, int, float]]:
    """For the EDGES of n sorted values from a rank on: the two ranks between which each lies, and how far."""
    places = [(q * (n - 1), int(q * (n - 1))) for q in EDGES]
    return [(begin + k, begin + min(k + 1, n - 1), p - k) for p, k in places]


def limits_of(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", good: str = "quality = 1") -> Limits:
    """What `fit` gives for all good labelled documents; labels without a document count for nothing, and of a text's chunks the least and the greatest.

    Every document is measured where it lies, so that no text moves; a row of a
    few numbers meets its label. Groups and quantiles are ranks of two sorts.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        pack = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            taken, rows = [], []
            for i, t in enumerate(batch.column(1)):
                text = t.as_py()
                n, _, _, _, rep = counts(text)
                if not base_failed(n, rep):
                    raw = text.encode()
                    whole, chunks = ratios(raw, pack)
                    taken.append(i)
                    rows.append((float(np.log2(len(raw))), whole, min(chunks), max(chunks), len(raw) >= 1.5 * CHUNK))
            cells = [pa.array([r[i] for r in rows], k) for i, k in enumerate((*[pa.float64()] * 4, pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(taken, pa.int64())), *cells], names=["_key", "x", "whole", "least", "most", "chunked"])

    chosen = labels.filter(good).select(F.col(id_col).alias("_key"))
    texts = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("text")).filter("_key is not null")
    measured = texts.mapInArrow(run, f"_key {docs.schema[id_col].dataType.simpleString()}, x double, whole double, least double, most double, chunked boolean")
    found = stored(measured.join(chosen, "_key", "left_semi"), "measured")
    total = found.count()
    if total < ENOUGH:
        drop(found)
        return WIDE

    parts = max(1, min(GROUPS, total // ENOUGH))
    sizes = [total // parts + (i < total % parts) for i in range(parts)]
    begins = np.cumsum([0, *sizes]).tolist()
    rows, at = _ordered(found, "x", "whole", "_key")
    drop(found)
    grouped = rows.withColumn("g", sum(((F.col("_at") >= at(b)).cast("int") for b in begins[1:-1]), F.lit(0)))
    lines = {}
    for g, slope, x, y, shortest, longest, chunked in grouped.groupBy("g").agg(F.regr_slope("whole", "x"), F.avg("x"), F.avg("whole"), F.min("x"), F.max("x"), F.count_if("chunked")).collect():
        slope = slope if longest > shortest else 0.0
        lines[g] = slope, y - slope * x, shortest, longest, chunked
    middle = [(at(b + (n - 1) // 2), at(b + n // 2)) for b, n in zip(begins, sizes)]
    places = {r["_at"]: r["x"] for r in rows.filter(F.col("_at").isin(sorted({p for pair in middle for p in pair}))).select("_at", "x").collect()}

    of = [F.element_at(F.array(*[F.lit(float(lines[g][k])) for g in range(parts)]), F.col("g") + 1) for k in (0, 1)]
    left = grouped.select("g", (F.col("whole") - (of[0] * F.col("x") + of[1])).alias("v"), "_key")
    n_chunks = 2 * sum(c for *_, c in lines.values())
    of_chunks = rows.filter("chunked").select(F.lit(-1).alias("g"), F.explode(F.array("least", "most")).alias("v"), "_key")
    values, at = _ordered(left.union(of_chunks), "g", "v", "_key")
    drop(rows)
    spots = [_edges(n_chunks + b, n) for b, n in zip(begins, sizes)] + ([_edges(0, n_chunks)] if n_chunks >= ENOUGH else [])
    wanted = sorted({at(rank) for two in spots for low, high, _ in two for rank in (low, high)})
    value = {r["_at"]: r["v"] for r in values.filter(F.col("_at").isin(wanted)).select("_at", "v").collect()}
    drop(values)
    edges = [[value[at(low)] + (value[at(high)] - value[at(low)]) * share for low, high, share in two] for two in spots]
    groups = [(lines[g][2], (places[middle[g][0]] + places[middle[g][1]]) / 2, lines[g][3], *lines[g][:2], *edges[g]) for g in range(parts)]
    return _limits(groups, edges[parts] if n_chunks >= ENOUGH else None)


ADDED = pa.schema(
    [(c, pa.int64()) for c in COUNTS] + [("base_failed", pa.bool_()), ("ratio", pa.float64()), ("least_chunk", pa.float64()), ("most_chunk", pa.float64()), ("kept", pa.bool_())]
)
_DDL = ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, ratio double, least_chunk double, most_chunk double, kept boolean"


def limits_in(docs: DataFrame, folder: str, **kw) -> Limits:
    """Limits fitted on the table of labels in a folder, WIDE where it has none."""
    spark = docs.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/labels.parquet")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return WIDE
    return limits_of(docs, spark.read.parquet(f"{folder}/labels.parquet"), **kw)


def judge(docs: DataFrame, text_col: str = "text", limits: Limits = WIDE) -> DataFrame:
    """Every row with COUNTS, base_failed, ratio, least_chunk, most_chunk and kept.

    Null and empty texts have no words and fail; very long ones are judged whole.
    Rows keep their number, repeated ones get a row each; an empty table gives an
    empty result. Columns of the added names are replaced, others pass through.
    """
    ship(docs.sparkSession)
    docs = docs.drop(*ADDED.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        pack = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            rows = [judge_text(t.as_py(), pack, limits) for t in texts]
            cols = [pa.array(c, f.type) for c, f in zip(zip(*rows), ADDED)] if rows else [pa.array([], f.type) for f in ADDED]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *ADDED.names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, {_DDL}")


def keep(docs: DataFrame, text_col: str = "text", limits: Limits = WIDE) -> DataFrame:
    """The documents that pass, with their own columns."""
    return judge(docs, text_col, limits).filter("kept").select(*[f"`{c}`" for c in docs.columns])
