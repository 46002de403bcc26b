"""Consistent-hash placement of keys on nodes.

A key's replicas are the first distinct nodes clockwise from its hash: the nodes
in the order of their nearest token. A ring is cluster metadata of checked size,
keys are data: the holders of each arc of the ring are worked out once, and keys
find their arc by one as-of step within hash ranges, without pairing keys with
tokens. When a ring changes, only keys on arcs whose holders changed are joined.
"""
from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VNODES = 64
#: Keys and tokens are aligned in so many ranges of the hash.
RANGES = 1_024
#: Tokens a ring may have.
MAX_TOKENS = 2_000_000


def hash60(c: Column) -> Column:
    """A 60-bit md5 prefix, a non-negative long."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 15), 16, 10).cast("long")


def _spread(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def fnv64(texts: pa.Array, seeds: np.ndarray) -> np.ndarray:
    """FNV-1a over the bytes of each text from a seeded start, finished by splitmix64; all texts side by side, place by place."""
    texts = texts.cast(pa.large_binary())
    data, ends = np.frombuffer(texts.buffers()[2] or b"", np.uint8), np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    with np.errstate(over="ignore"):
        h = np.uint64(0xCBF29CE484222325) ^ _spread(seeds.astype(np.uint64))
        order = np.argsort(-np.diff(ends), kind="stable")
        starts, lengths = ends[:-1][order], np.diff(ends)[order]
        out = h[order]
        for j in range(int(lengths.max(initial=0))):
            m = int(np.searchsorted(-lengths, -j))
            out[:m] = (out[:m] ^ data[starts[:m] + j]) * np.uint64(0x100000001B3)
        h[order] = _spread(out)
    return h


@F.pandas_udf(T.LongType())
def _hash64(text: pd.Series, seed: pd.Series) -> pd.Series:
    found = fnv64(pa.array(text.fillna(""), pa.string()), seed.to_numpy(np.int64))
    return pd.Series((found ^ np.uint64(1 << 63)).view(np.int64))


def hash64(c: Column, seed: Column | int = 0) -> Column:
    """Seeded FNV-1a with the finaliser of splitmix64, less 2^63, so that the order of longs is that of the unsigned hashes. Null is hashed as the empty text."""
    return _hash64(c.cast("string"), F.lit(seed).cast("long") if isinstance(seed, int) else seed.cast("long"))


@dataclass(frozen=True)
class Hash:
    """How keys and virtual nodes are hashed: longs from `low` on, the next power of two being `bits` away."""

    key: Callable[[Column], Column]
    token: Callable[[Column, Column], Column]
    low: int
    bits: int

    def range_of(self, h: Column) -> Column:
        return F.shiftright(h, self.bits - 10) - (self.low >> (self.bits - 10))


MD5 = Hash(hash60, lambda node, v: hash60(F.concat_ws("#", node, v.cast("string"))), 0, 60)
FNV = Hash(hash64, hash64, -(1 << 63), 64)


def ring(nodes: DataFrame, node: str = "node", vnodes: int = VNODES, by: Hash = MD5) -> DataFrame:
    """(token, node): each node once, with `vnodes` tokens; a node that is listed twice has no more."""
    spread = nodes.select(F.col(node).alias("node")).distinct().select("node", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("v"))
    return spread.select(by.token(F.col("node"), F.col("v")).alias("token"), "node")


def _holders(rows: list[tuple[int, str]], rf: int) -> tuple[list[int], list[list[str]]]:
    """The distinct tokens of a ring, and the first rf distinct nodes clockwise from each."""
    rows = sorted(rows)
    nodes, at, out = len({n for _, n in rows}), [], []
    for i, (token, _) in enumerate(rows):
        if i and rows[i - 1][0] == token:
            continue
        held: list[str] = []
        for j in range(len(rows)):
            node = rows[(i + j) % len(rows)][1]
            if node not in held:
                held.append(node)
            if len(held) == min(rf, nodes):
                break
        at.append(token)
        out.append(held)
    return at, out


def _tokens(tokens: DataFrame) -> list[tuple[int, str]]:
    """The ring, read to the driver; more than MAX_TOKENS tokens are refused."""
    rows = [(r["token"], r["node"]) for r in tokens.select("token", "node").limit(MAX_TOKENS + 1).collect()]
    if len(rows) > MAX_TOKENS:
        raise ValueError(f"a ring may have {MAX_TOKENS} tokens")
    return rows


def _spans(spark, arcs: Iterator[tuple], columns: str, by: Hash) -> DataFrame:
    """Arcs (before, token, ...) as a table, once for each range r that they touch."""
    spans = spark.createDataFrame(list(arcs), f"before long, token long, {columns}")
    return spans.withColumn("r", F.explode(F.sequence(by.range_of(F.greatest(F.col("before"), F.lit(by.low))), by.range_of(F.col("token")))))


def _bounds(at: list[int], by: Hash) -> Iterator[tuple[int, int, int]]:
    """(before, token, index): hashes in (before, token] belong to a token; past the last one the ring begins again. `before` of the first lies below all hashes, as null does not."""
    last = by.low + (1 << by.bits) - 1
    for i, token in enumerate(at):
        yield (at[i - 1] if i else None), token, i
    if at and at[-1] < last:
        yield at[-1], last, 0


def _met(keys: DataFrame, spans: DataFrame, key: str, by: Hash) -> DataFrame:
    """Keys with the arc that they lie in, if it is among the spans."""
    hashed = keys.select(F.col(key).alias("key"), by.key(F.col(key)).alias("h")).withColumn("r", by.range_of(F.col("h")))
    return hashed.join(spans, (hashed.r == spans.r) & (F.col("before").isNull() | (F.col("h") > F.col("before"))) & (F.col("h") <= F.col("token"))).drop("r", "h", "before", "token")


def replicas(keys: DataFrame, tokens: DataFrame, rf: int, key: str = "key", by: Hash = MD5) -> DataFrame:
    """(key, n, node): at most min(rf, nodes) replicas of each key, n = 1 the primary.

    Keys and arcs meet within ranges of the hash; a key lies in one arc.
    """
    if rf <= 0:
        return keys.select(F.col(key).alias("key"), F.lit(0).alias("n"), F.lit("").alias("node")).limit(0)
    at, held = _holders(_tokens(tokens), rf)
    spans = _spans(keys.sparkSession, ((a, b, held[i]) for a, b, i in _bounds(at, by)), "holders array<string>", by)
    return _met(keys, spans, key, by).select("key", F.posexplode("holders").alias("p", "node")).select("key", (F.col("p") + 1).alias("n"), "node")


def _differences(old: list[tuple[int, str]], new: list[tuple[int, str]], rf: int, by: Hash) -> Iterator[tuple[int | None, int, list[str], list[str]]]:
    """(before, token, holders in the old ring, in the new one) of the arcs on which these are not the same sets."""
    (a, held_a), (b, held_b) = _holders(old, rf), _holders(new, rf)
    of = lambda at, held, token: held[bisect_left(at, token) % len(at)] if at else []
    for before, token, _ in _bounds(sorted({*a, *b}), by):
        x, y = of(a, held_a, token), of(b, held_b, token)
        if set(x) != set(y):
            yield before, token, x, y


def load(keys: DataFrame, tokens: DataFrame, key: str = "key") -> DataFrame:
    """Keys whose primary a node is, for nodes that have any."""
    return replicas(keys, tokens, 1, key).groupBy("node").agg(F.count("*").alias("keys"))


def plan_add(keys: DataFrame, tokens: DataFrame, more: DataFrame, rf: int, key: str = "key", by: Hash = MD5) -> DataFrame:
    """(key, from_node, to_node) to copy when the tokens `more` join: for keys that a new node now holds, from the first previous holder by name. `keys` has each key once; those on unchanged arcs are not touched."""
    old = _tokens(tokens)
    arcs = ((a, b, min(x), [n for n in y if n not in x]) for a, b, x, y in _differences(old, old + _tokens(more), rf, by) if x)
    found = _met(keys, _spans(keys.sparkSession, arcs, "from_node string, gained array<string>", by), key, by)
    return found.select("key", "from_node", F.explode("gained").alias("to_node"))


def plan_remove(keys: DataFrame, tokens: DataFrame, node: str, rf: int, key: str = "key", by: Hash = MD5) -> DataFrame:
    """(key, from_node, to_node, durable) to copy when a node leaves: from a holder that stays, the first by name, else from the leaving one; durable tells whether one stays. `keys` has each key once."""
    old = _tokens(tokens)
    arcs = ((a, b, min({*x} - {node}, default=node), len({*x} - {node}) > 0, [n for n in y if n not in x]) for a, b, x, y in _differences(old, [t for t in old if t[1] != node], rf, by))
    found = _met(keys, _spans(keys.sparkSession, arcs, "from_node string, durable boolean, gained array<string>", by), key, by)
    return found.select("key", "from_node", F.explode("gained").alias("to_node"), "durable")


def write_replicated(rows: DataFrame, tokens: DataFrame, rf: int, key: str = "key", by: Hash = MD5) -> DataFrame:
    """(node, columns of rows): each row once for every node that holds its key. Write it partitioned by node. Without nodes nothing can be written: an empty result. Names that begin with an underscore are reserved."""
    at, held = _holders(_tokens(tokens), max(rf, 0)) if rf > 0 else ([], [])
    spans = _spans(rows.sparkSession, ((a, b, held[i]) for a, b, i in _bounds(at, by)), "_holders array<string>", by)
    names = [F.col(f"`{c}`") for c in rows.columns]
    hashed = rows.withColumn("_h", by.key(F.col(key))).withColumn("_r", by.range_of(F.col("_h")))
    spans = spans.select(F.col("r").alias("_range"), F.col("before").alias("_before"), F.col("token").alias("_token"), "_holders")
    met = hashed.join(spans, (F.col("_r") == F.col("_range")) & (F.col("_before").isNull() | (F.col("_h") > F.col("_before"))) & (F.col("_h") <= F.col("_token")))
    return met.select(F.explode("_holders").alias("node"), *names)


def read_any(held: DataFrame, up: list[str], key: str = "key", order: tuple[str, ...] = ("n",)) -> DataFrame:
    """One row per key from the first of its replicas whose node is up; keys without one are missing. `held`: rows with key, node and what `order` names."""
    return held.filter(F.col("node").isin(up)).groupBy(key).agg(F.min_by(F.struct(*[c for c in held.columns if c != key]), F.struct(*order)).alias("_row")).select(key, "_row.*")


def satisfied(held: DataFrame, rf: int, nodes: int) -> DataFrame:
    """Per key: copies, and whether they are min(rf, nodes)."""
    return held.groupBy("key").agg(F.countDistinct("node").alias("copies")).withColumn("satisfied", F.col("copies") >= min(rf, nodes))


def held_by(held: DataFrame, node: str) -> DataFrame:
    return held.filter(F.col("node") == node).select("key").distinct()


def apply(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows (key, node, ts, ...) with the copies of a plan, whose timestamps are one later."""
    copies = rows.join(plan.select("key", F.col("from_node").alias("node"), "to_node"), ["key", "node"])
    copies = copies.withColumn("node", F.col("to_node")).withColumn("ts", F.col("ts") + 1)
    return rows.unionByName(copies.select(*rows.columns))


def modulo(number: Column, shards: int) -> Column:
    return F.pmod(number, F.lit(shards))
