"""Last-write-wins tables: a log of versioned rows and its visible state.

A log has id, vector, metadata, tags, ts, version, tombstone, segment_id. The
newest (ts, version) of an id wins; of equal ones the row of the memtable
(segment -1), then of the oldest segment.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEMTABLE = -1


def version_key(ts: str = "ts", version: str = "version", segment: str | None = "segment_id") -> Column:
    """Orders versions; with a segment the order is total among the rows of different segments."""
    keys = [F.coalesce(F.col(ts), F.lit(0)), F.coalesce(F.col(version), F.lit(0))]
    if segment:
        keys.append(-F.col(segment))
    return F.struct(*keys)


def newest(log: DataFrame, key: str = "id", segment: str | None = "segment_id") -> DataFrame:
    """One row per key, the newest version, tombstones included. Versions are combined before the shuffle, so a hot key costs one row per task."""
    segment = segment if segment and segment in log.columns else None
    rest = [c for c in log.columns if c != key]
    best = log.groupBy(key).agg(F.max_by(F.struct(*rest), version_key(segment=segment)).alias("_row"))
    return best.select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in log.columns])


def visible(log: DataFrame, key: str = "id") -> DataFrame:
    """The newest rows that are no tombstones."""
    return newest(log, key).filter(~F.coalesce("tombstone", F.lit(False)))


def get(log: DataFrame, row_id, key: str = "id") -> DataFrame:
    """At most one row: the visible version of an id. The filter reaches the scan."""
    return visible(log.filter(F.col(key) == F.lit(row_id)), key)


def deletion(ids: DataFrame, log: DataFrame, ts: Column) -> DataFrame:
    """Tombstones for ids, in the shape of a log: version 0, no vector, no tags."""
    given = {"tombstone": F.lit(True), "ts": ts, "version": F.lit(0), "segment_id": F.lit(MEMTABLE)}
    return ids.select(*[F.col("id") if f.name == "id" else given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in log.schema])


def live_count(log: DataFrame) -> DataFrame:
    return visible(log).agg(F.count("*").alias("live_rows"))


def storage_bytes(log: DataFrame, dimension: int) -> DataFrame:
    """Estimated bytes of the live vectors."""
    return live_count(log).select("live_rows", (F.col("live_rows") * dimension * 4).alias("storage_bytes"))


def segment_stats(log: DataFrame) -> DataFrame:
    """Rows, live rows and timestamps of each segment."""
    return log.groupBy("segment_id").agg(
        F.count("*").alias("row_count"), F.sum(F.when(F.col("tombstone"), 0).otherwise(1)).alias("live_count"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts")
    )


def shadowed(log: DataFrame) -> DataFrame:
    """For each segment the share of its rows that newer versions elsewhere hide."""
    seen = newest(log).groupBy("segment_id").agg(F.count("*").alias("current"))
    rows = log.groupBy("segment_id").agg(F.count("*").alias("rows"))
    return rows.join(seen, "segment_id", "left").select("segment_id", "rows", (1 - F.coalesce("current", F.lit(0)) / F.col("rows")).alias("shadowed"))


def quorum(log: DataFrame, replicas: list[str], key: str = "id") -> DataFrame:
    """The newest row of each key among those replicas that answered; a majority of all replicas must be named by the caller."""
    return newest(log.filter(F.col("replica").isin(replicas)), key, segment=None)
