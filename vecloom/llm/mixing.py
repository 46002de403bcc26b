"""Mixing sources to target weights.

Words are summed per source, a target is derived for each source, and every
document is emitted floor(rate) times plus once more if a hash-seeded Bernoulli
draw with probability rate - floor(rate) succeeds, where rate = target / size of
the source. A document's draw depends only on its id, its text's length in words
and the seed, so reruns agree whatever the partitioning.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, n_words, unit_hash

WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2.0, "mix-1"
#: Source tables of at most so many rows are broadcast; larger ones are joined by a salted shuffle.
BROADCAST_SOURCES, SALTS = 20_000, 32


#: Columns that a plan adds, and those that come and go.
OWN = ("_size", "_mix", "_copies", "_copy", "_source", "_salt", "_salt_")


def targets(sized: DataFrame, source: str = "source", size: str = "size", weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source: source, source_size, target, rate.

    Sources in code point order, null last, take `weights` in turn and share
    `share` times all words; a target stops at `cap` times its source's size and
    the excess is reshared by weight among the others until none is above. That
    is water filling: ordered by cap/weight, a prefix of the sources is full, so
    one pass of running sums over the (small) table of sources finds the level.
    A source without words gets target and rate 0.
    """
    per = sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)).withColumn("cap", F.lit(cap) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    upto, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("all", F.lit(share) * F.sum("source_size").over(whole))
    per = per.withColumn("level", (F.col("all") - (F.sum("cap").over(upto) - F.col("cap"))) / F.sum("w").over(after))
    per = per.withColumn("full", F.col("cap") <= F.col("w") * F.col("level"))
    level = (F.col("all") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0.0))) / F.nullif(F.sum(F.when(~F.col("full"), F.col("w"))).over(whole), F.lit(0.0))
    per = per.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * level))
    return per.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))


def with_rates(docs: DataFrame, per: DataFrame, id_col: str, source: str) -> DataFrame:
    """Adds the source's columns to each row. A source may hold a third of all rows: a checked, small table is broadcast, a larger one salted."""
    per = per.select(F.col("source").alias("_source"), F.struct("source_size", "target", "rate").alias("_mix"))
    same = F.col(source).eqNullSafe(F.col("_source"))
    if per.count() <= BROADCAST_SOURCES:
        return docs.join(F.broadcast(per), same).drop("_source")
    salted = per.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    docs = docs.withColumn("_salt_", F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int"))
    return docs.join(salted, same & (F.col("_salt_") == F.col("_salt"))).drop("_source", "_salt", "_salt_")


def copies(rate: Column, *key: Column, seed: str = SEED) -> Column:
    """floor(rate) plus a Bernoulli draw with the fraction as its probability."""
    return (F.floor(rate) + F.when(unit_hash(F.lit(seed), *key) < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **kw) -> DataFrame:
    """Every input row with its columns, `_size` (words), `_mix` (source_size, target, rate) and `_copies`.

    Null texts have size 0; null sources are a source of their own, the last;
    rows that repeat are drawn alike, as they have the same key. An empty table
    gives an empty result. Very long texts are counted whole. Extra columns pass
    through; those with the names of added columns are replaced.
    """
    sized = docs.drop(*OWN).withColumn("_size", n_words(F.col(text_col)))
    per = targets(sized, source_col, "_size", **kw)
    return with_rates(sized, per, id_col, source_col).withColumn("_copies", copies(F.col("_mix.rate"), F.col(id_col), F.col("_size"), seed=seed))


def mix(docs: DataFrame, **kw) -> DataFrame:
    """The mixed corpus: each document as often as its plan says, with the columns of `docs`."""
    kept, back = aside(docs, *OWN)
    planned = plan(kept, **kw).filter(F.col("_copies") > 0)
    out = planned.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return out.select(*[F.col(f"`{c}`") for c in kept.columns]).withColumnsRenamed(back)
