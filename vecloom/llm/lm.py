"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of orders 2, 1 and 0 (uniform) are mixed with
weights that depend on how often the context was seen, in buckets of powers of
two. The weights are learned by expectation-maximisation on the counts of
documents that were deleted from the estimates; the final estimates use all
training documents.

Texts are coded in chunks and counts go there and back (see chunks): with the
counts of its own words and pairs of words over the whole corpus, each chunk
gives a histogram of its deleted tokens' three estimates, EM runs on the sum of
these, whose size is bounded by the grid, and each chunk scores its documents.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import SENT, Texts, bits_for, coded, finish, returned, rows_of, sent, sums_of, unpack
from .common import drop, free_shuffles, need_integer, ship, stored

#: Documents whose crc32(id) % FOLDS is HELD_OUT are not learned from; those where it is DELETED give the held-out counts of EM.
FOLDS, HELD_OUT, DELETED = 7, 2, 3
#: Bytes of text in a chunk: larger ones send fewer pairs, smaller ones need less memory.
CHUNK = 10 << 20
#: Cells per factor of two of the grid of estimates, and rounds of EM.
GRID, ROUNDS = 4, 40
#: Hashes that stand for the end and the start of a text.
END, START = np.uint64(1), np.uint64(2)
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def fold(doc_id) -> int:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % FOLDS


class Chunk(Texts):
    """A chunk's tokens with the end of each text (word 0), their predecessors, and its distinct pairs."""

    def __init__(self, row: dict):
        super().__init__(row)
        self.words, tokens = np.r_[END, self.words], self.tokens + 1
        self.folds = np.array([fold(i) for i in self.ids], np.uint8)
        at = np.cumsum(self.n + 1) - 1
        self.token = np.zeros(len(tokens) + len(self.n), np.int32)
        real = np.ones(len(self.token), bool)
        real[at] = False
        self.token[real] = tokens  # fewer than 2^31 words in a chunk
        self.doc = np.repeat(np.arange(len(self.n), dtype=np.int32), self.n + 1)
        self.before = np.r_[np.int32(0), self.token[:-1]]
        self.before[np.r_[0, at[:-1] + 1]] = len(self.words)  # the start of a text
        pair, self.pair = np.unique(self.before.astype(np.int64) * len(self.words) + self.token, return_inverse=True)
        self.pair = self.pair.astype(np.int32)
        names = np.r_[self.words, START]
        with np.errstate(over="ignore"):
            hashed = finish(names[pair // len(self.words)] * _K[0] + names[pair % len(self.words)] * _K[1])
        self.pair_order = np.argsort(hashed)
        self.pair_hash = hashed[self.pair_order]
        self.word_order = np.argsort(self.words)
        self.word_hash = self.words[self.word_order]
        self.trained = (self.folds != HELD_OUT)[self.doc]
        self.deleted = (self.folds == DELETED)[self.doc]

    def counts(self, index: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All training counts and the deleted part, in the order in which they are sent."""
        return tuple(np.bincount(index[m], minlength=len(order))[order].astype(np.uint32) for m in (self.trained, self.deleted))


def send(chunks: DataFrame, bits: int) -> DataFrame:
    """Blobs of kind 0 for words, 1 for pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            c = Chunk(row)
            for kind, keys, index, order in ((0, c.word_hash, c.token, c.word_order), (1, c.pair_hash, c.pair, c.pair_order)):
                yield from sent(row["chunk"], kind, keys, list(c.counts(index, order)), bits)

    return chunks.mapInArrow(run, SENT)


class Counted(Chunk):
    """A chunk with the counts of its words and pairs over all chunks."""

    def __init__(self, row: dict, back: list[dict]):
        super().__init__(row)
        for kind, name, order in ((0, "word", self.word_order), (1, "pair", self.pair_order)):
            for which, what in enumerate(("every", "gone")):
                got = np.empty(len(order), np.int64)
                got[order] = sums_of(back, kind, which)
                setattr(self, f"{name}_{what}", got)

    def estimates(self, n: int, texts: int, fitted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: the context's count, and the estimates of order 2 and 1. `fitted`: without the deleted documents."""
        word = self.word_every - self.word_gone * fitted
        pair = (self.pair_every - self.pair_gone * fitted)[self.pair]
        context = np.r_[word, texts][self.before]
        return context, pair / np.maximum(context, 1), word[self.token] / max(n, 1)


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context that was never seen, else 1 + floor(log2(count))."""
    return np.where(context > 0, np.frexp(np.maximum(context, 1).astype(np.float64))[1], 0)


def _cell(p: np.ndarray, uniform: float) -> np.ndarray:
    """A cell of the grid: the estimate's ratio to the uniform one, rounded on a logarithmic scale, so that EM goes over a table of bounded size; 0 stands for an estimate of 0. Scores use the estimates themselves."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.round(np.log2(np.where(p > 0, p, 1) / uniform) * GRID) + 10_000, 0).astype(np.int64)


def learn(cells: list[tuple[int, int, int, int]], rounds: int = ROUNDS) -> dict[int, tuple[float, float, float]]:
    """Weights (order 2, 1, 0) of each bucket by EM. cells: (bucket, cell of order 2, cell of order 1, tokens)."""
    out = {}
    for b in sorted({c[0] for c in cells}):
        own = np.array([c[1:] for c in cells if c[0] == b], np.float64)
        p = np.stack([*[np.where(own[:, i] > 0, 2.0 ** ((own[:, i] - 10_000) / GRID), 0.0) for i in (0, 1)], np.ones(len(own))], 1)
        w, times = np.full(3, 1 / 3), own[:, 2]
        for _ in range(rounds):
            share = p * w
            share /= share.sum(1, keepdims=True)
            w = (share * times[:, None]).sum(0) / times.sum()
        w = np.maximum(w, 1e-6)  # the uniform part never vanishes
        out[b] = tuple((w / w.sum()).tolist())
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score, score_per_token.

    Texts are lower-cased (A-Z) words and one end, which is a token too; null and
    empty texts are one end. base_score adds one to unigram counts; score is the
    interpolated model's log10 probability. Repeated rows count as often as they
    occur, and very long texts count whole; an empty table gives an empty result. Without training documents all estimates but the uniform one are 0.
    An unseen bucket takes the weights of the nearest seen one below, else above,
    else equal ones. Ids must be integers; null ids are folded as the empty text.
    """
    need_integer(docs, id_col)
    spark = docs.sparkSession
    ship(spark)
    chunks = stored(coded(docs, id_col, text_col, CHUNK), "chunks")
    def folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                f, lens = np.array([fold(i) for i in r["ids"]]), unpack(r["lens"], np.uint32).astype(np.int64) + 1
                yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in (lens.sum(), lens[f != HELD_OUT].sum(), lens[f == DELETED].sum(), (f != HELD_OUT).sum(), (f == DELETED).sum())], names=["all", "n", "dn", "t", "dt"])

    sums = chunks.select("ids", "lens").mapInArrow(folds, "all long, n long, dn long, t long, dt long")
    size = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums.columns]).first()
    n, all_texts = int(size["n"]), int(size["t"])
    fit_n, fit_texts = n - int(size["dn"]), all_texts - int(size["dt"])
    back = stored(returned(send(chunks, bits_for(int(size["all"])))), "counts")
    known = back.filter("kind = 0").groupBy("range").agg(F.first("distinct").alias("d")).agg(F.coalesce(F.sum("d"), F.lit(0)).alias("v")).first()
    v = int(known["v"])
    uniform = 1.0 / (v + 1)

    def together(run, schema: str) -> DataFrame:
        return chunks.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(lambda a, b: run(Counted(a.to_pylist()[0], b.to_pylist())), schema)

    def histogram(c: Counted) -> pa.Table:
        context, two, one = c.estimates(fit_n, fit_texts, True)
        d = c.deleted
        cells, times = np.unique(np.stack([bucket(context[d]), _cell(two[d], uniform), _cell(one[d], uniform)], 1), axis=0, return_counts=True) if d.any() else (np.empty((0, 3), np.int64), np.empty(0, np.int64))
        return pa.table([*[pa.array(cells[:, i].astype(np.int64)) for i in range(3)], pa.array(times.astype(np.int64))], names=["b", "two", "one", "times"])

    seen = stored(together(histogram, "b long, two long, one long, times long").groupBy("b", "two", "one").agg(F.sum("times").alias("times")), "estimates")
    weights = learn([tuple(r) for r in seen.collect()])  # at most buckets x cells x cells rows
    table = np.array([weights.get(max((b for b in weights if b <= k), default=min(weights, default=-1)), (1 / 3, 1 / 3, 1 / 3)) for k in range(66)])

    def result(c: Counted) -> pa.Table:
        context, two, one = c.estimates(n, all_texts, False)
        w = table[bucket(context)]
        held, docs_n = c.word_every[c.token], len(c.n)
        sums = [np.bincount(c.doc, x, docs_n) for x in (held > 0, np.log10((held + 1) / (n + 1 * (v + 1))), np.log10(w[:, 0] * two + w[:, 1] * one + w[:, 2] * uniform))]
        return pa.table(
            [pa.array(c.ids, pa.int64()), pa.array(c.folds == HELD_OUT), pa.array(c.n + 1), pa.array(sums[0].astype(np.int64)), pa.array(np.full(docs_n, n, np.int64)), pa.array(sums[1]), pa.array(sums[2])],
            names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    del seen
    free_shuffles(spark)
    out = together(result, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col).withColumn("score_per_token", F.col("score") / F.col("n_tokens"))
