"""Heartbeats: suspicion by accrual, and merging of gossip states."""
from __future__ import annotations

from math import e, log10

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Intervals that count, phi from which a node is suspected, least mean, mean before the first interval, and silence that does not count.
WINDOW, THRESHOLD, FLOOR_MS, FIRST_MS, PAUSE_MS = 100, 8.0, 100.0, 1000.0, 0


def intervals(beats: DataFrame, endpoint: str = "endpoint", at: str = "now_ms") -> DataFrame:
    """(endpoint, at, interval): the positive times between a node's heartbeats."""
    gap = F.col(at) - F.lag(at).over(Window.partitionBy(endpoint).orderBy(at))
    return beats.select(F.col(endpoint).alias("endpoint"), F.col(at).alias("at"), gap.alias("interval")).filter(F.col("interval") > 0)


def phi(beats: DataFrame, now_ms: Column, endpoint: str = "endpoint", at: str = "now_ms", window: int = WINDOW, threshold: float = THRESHOLD, floor_ms: float = FLOOR_MS, first_ms: float = FIRST_MS, pause_ms: float = PAUSE_MS) -> DataFrame:
    """(endpoint, last_ms, mean_ms, phi, available): silence, less the pause, over the mean of the last `window` intervals, times log10 e.

    The mean is `floor_ms` at least, and `first_ms` after a single heartbeat. A
    node that never sent one is not in the result: nobody suspects it.
    """
    gaps = intervals(beats, endpoint, at)
    newest = gaps.withColumn("n", F.row_number().over(Window.partitionBy("endpoint").orderBy(F.desc("at")))).filter(F.col("n") <= window)
    mean = newest.groupBy("endpoint").agg(F.greatest(F.avg("interval"), F.lit(floor_ms)).alias("mean"))
    last = beats.groupBy(F.col(endpoint).alias("endpoint")).agg(F.max(at).alias("last_ms"))
    found = last.join(mean, "endpoint", "left").withColumn("mean_ms", F.coalesce("mean", F.lit(float(first_ms))))
    value = F.greatest(now_ms - F.col("last_ms") - F.lit(pause_ms), F.lit(0)) / F.col("mean_ms") * log10(e)
    return found.select("endpoint", "last_ms", "mean_ms", value.alias("phi"), (value < threshold).alias("available"))


def merge_gossip(states: DataFrame, endpoint: str = "endpoint") -> DataFrame:
    """One state per endpoint: the newest heartbeat (generation, version) is taken whole; of equal ones a node's word that it left counts, then its own belief that it lives."""
    rank = F.struct("generation", "version", F.when(F.col("status") == "Left", 2).when(F.col("status") == "Alive", 1).otherwise(0))
    return states.groupBy(endpoint).agg(F.max_by(F.struct("generation", "version", "status"), rank).alias("s")).select(endpoint, "s.*")


def gossip_round(local: DataFrame, remote: DataFrame, me: str) -> DataFrame:
    """A member's states (endpoint, generation, version, status) after it hears another's.

    Its own record is its own affair and an unknown endpoint is taken over. Of
    others a newer heartbeat is taken whole, which clears a conviction; at an
    equal heartbeat only a leave is, so an echo of Alive does not.
    """
    other = remote.select("endpoint", *[F.col(c).alias(f"r_{c}") for c in ("generation", "version", "status")])
    newer = (F.col("r_generation") > F.col("generation")) | ((F.col("r_generation") == F.col("generation")) & (F.col("r_version") > F.col("version")))
    left = (F.col("r_generation") == F.col("generation")) & (F.col("r_version") == F.col("version")) & (F.col("r_status") == "Left")
    take = F.col("generation").isNull() | ((F.col("endpoint") != me) & F.coalesce(newer | left, F.lit(False)))
    return local.join(other, "endpoint", "full").select("endpoint", *[F.when(take, F.col(f"r_{c}")).otherwise(F.col(c)).alias(c) for c in ("generation", "version", "status")])


def tick(local: DataFrame, beats: DataFrame, now_ms: Column, me: str, **kw) -> DataFrame:
    """The states after a look at the clock: others that are Alive and suspected become Dead, for this member only; heartbeats stay."""
    suspected = phi(beats, now_ms, **kw).filter(~F.col("available")).select("endpoint", F.lit(True).alias("_gone"))
    gone = F.coalesce("_gone", F.lit(False)) & (F.col("endpoint") != me) & (F.col("status") == "Alive")
    return local.join(suspected, "endpoint", "left").select("endpoint", "generation", "version", F.when(gone, F.lit("Dead")).otherwise(F.col("status")).alias("status"))
