"""Texts coded in chunks, and counts that go there and back.

A chunk is one row: some documents, their words' hashes and their tokens as
indices of these. It is written once, so that later passes meet the same chunks.
To count keys over the whole corpus, each chunk sends its own distinct keys with
its counts, sorted, in blobs by range of the key; a range sums the counts of all
chunks and returns to each the sums of what it sent, in the order in which it
sent them. However frequent a key is, it is one entry per chunk, and a chunk gets
back only what it asked for: nothing is broadcast and no key is hot.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trim

#: Bytes of text in a chunk, and entries that meet in a range.
CHUNK, RANGE = 8 << 20, 1_500_000


def finish(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(a).tobytes())


def unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, byte plane by byte plane: those of the high bytes hardly take space."""
    return pack(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)


def unpack_keys(b: bytes) -> np.ndarray:
    planes = unpack(b, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches, one at a time: a batch may hold many chunks. Freed memory goes back after each."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
            trim()


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased, and the number of words of each text. A null text has none."""
    low = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.ascii_split_whitespace(low)
    words, doc = lists.flatten(), np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    real = pc.not_equal(pc.binary_length(words), 0)
    coded = pc.dictionary_encode(words.filter(real))
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return table[coded.indices.to_numpy()] if len(table) else np.empty(0, np.uint64), np.bincount(doc[real.to_numpy(zero_copy_only=False)], minlength=len(texts))


def coded(docs: DataFrame, id_col: str, text_col: str, size: int | None = None) -> DataFrame:
    """(chunk, ids, lens, words, tokens): words are hashes, frequent ones first; tokens are indices of these."""
    most = CHUNK if size is None else size

    def row(seq: int, ids: list, lens: list[np.ndarray], hashes: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.concatenate(hashes), np.concatenate(lens)
        words, token = np.unique(h, return_inverse=True)
        order = np.argsort(-np.bincount(token, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words))
        key = (TaskContext.get().partitionId() << 31) + seq
        cells = [[key], [ids], [pack(n.astype(np.uint32))], [words[order].tobytes()], [pack(rank[token])]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()))], names=["chunk", "ids", "lens", "words", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        seq, ids, lens, hashes, held = 0, [], [], [], 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
            start = 0
            while start < batch.num_rows:  # as many documents as fill the chunk, one at least
                stop = start + int(np.searchsorted(np.cumsum(sizes[start:]), most - held)) + 1
                part = batch.take(pa.array(np.arange(start, min(stop, batch.num_rows))))  # a copy: string kernels may mistake the offsets of slices
                h, n = word_hashes(part.column(1))
                ids += part.column(0).to_pylist()
                lens.append(n)
                hashes.append(h)
                held += int(sizes[start:stop].sum())
                if held >= most:
                    yield row(seq, ids, lens, hashes)
                    trim()
                    seq, ids, lens, hashes, held = seq + 1, [], [], [], 0
                start = stop
        if ids:
            yield row(seq, ids, lens, hashes)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "chunk long, ids array<bigint>, lens binary, words binary, tokens binary")


class Texts:
    """The documents of a chunk."""

    def __init__(self, row: dict):
        self.ids, self.n = row["ids"], unpack(row["lens"], np.uint32).astype(np.int64)
        self.words, self.tokens = np.frombuffer(row["words"], np.uint64), unpack(row["tokens"], np.uint32)


def bits_for(entries: int) -> int:
    """Leading bits of a key that make its range."""
    return max(0, int(entries / RANGE)).bit_length()


def sent(chunk: int, kind: int, keys: np.ndarray, counts: list[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """A chunk's sorted distinct keys and their counts as blobs (kind, range, chunk, keys, counts), one for each range that has any."""
    part = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    begins = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(keys) else np.empty(0, np.int64)
    cells: list[list] = [[], [], [], [], []]
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(keys)]):
        for cell, v in zip(cells, (kind, int(part[a]), chunk, pack_keys(keys[a:b]), [pack(c[a:b].astype(np.uint32)) for c in counts])):
            cell.append(v)
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cells, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary())))], names=["kind", "range", "chunk", "keys", "counts"])


SENT = "kind int, range long, chunk long, keys binary, counts array<binary>"


def returned(blobs: DataFrame) -> DataFrame:
    """(chunk, kind, range, sums, distinct): for each blob the sums over all chunks in its order; distinct is the number of the range's keys whose first sum is not 0."""

    def run(table: pa.Table) -> pa.Table:
        keys = [unpack_keys(k.as_py()) for k in table["keys"]]
        counts = table["counts"].to_pylist()
        ends = np.cumsum([len(k) for k in keys])[:-1]
        _, where = np.unique(np.concatenate(keys), return_inverse=True)
        sums = [np.bincount(where, np.concatenate([unpack(c[i], np.uint32) for c in counts])).astype(np.uint64) for i in range(len(counts[0]))]
        back = list(zip(*[[pack(p) for p in np.split(s[where], ends)] for s in sums]))
        n = int((sums[0] > 0).sum())
        trim()
        return pa.table([table["chunk"], table["kind"], table["range"], pa.array([list(b) for b in back], pa.list_(pa.binary())), pa.array([n] * len(keys), pa.int64())], names=["chunk", "kind", "range", "sums", "distinct"])

    return blobs.groupBy("kind", "range").applyInArrow(run, "chunk long, kind int, range long, sums array<binary>, distinct long")


def sums_of(back: list[dict], kind: int, which: int) -> np.ndarray:
    """A chunk's sums of one kind, in the order of its sorted keys."""
    mine = sorted((r for r in back if r["kind"] == kind), key=lambda r: r["range"])
    return np.concatenate([unpack(r["sums"][which], np.uint64) for r in mine]).astype(np.int64) if mine else np.empty(0, np.int64)
