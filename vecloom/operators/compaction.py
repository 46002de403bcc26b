"""Segment maintenance: merging, tiers, ghosts."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from . import lww


def compact(log: DataFrame, segments: list[int] | None = None, drop_tombstones: bool | None = None, into: int | None = None) -> DataFrame:
    """The newest row of each id over the chosen segments (default: all but the memtable), as one segment, by default the oldest of them.

    Tombstones go only if no segment is left out, since an older version may lie
    in one that is; the memtable does not count, as its rows are never older. A
    caller with a manifest says so, and names the new segment; else the log is
    asked, of which only segment_id is read for that.
    """
    stored = log.filter(F.col("segment_id") != lww.MEMTABLE)
    chosen = stored if segments is None else stored.filter(F.col("segment_id").isin(segments))
    if drop_tombstones is None and segments is not None:
        others = stored.filter(~F.col("segment_id").isin(segments)).agg((F.count("*") > 0).alias("x")).select("x").scalar()
    else:
        others = F.lit(segments is not None and not drop_tombstones)
    number = chosen.agg(F.min("segment_id").alias("least")).select("least").scalar() if into is None else F.lit(into).cast("long")
    return lww.newest(chosen).filter(~F.coalesce("tombstone", F.lit(False)) | others).withColumn("segment_id", number)


def needs_compaction(log: DataFrame) -> DataFrame:
    """Whether a full compaction has anything to do: two segments or more, or any tombstone in one."""
    s = log.filter(F.col("segment_id") != lww.MEMTABLE)
    return s.agg(((F.countDistinct("segment_id") >= 2) | F.coalesce(F.max(F.col("tombstone").cast("int")), F.lit(0)).cast("boolean")).alias("needed"))


def pick_tier(segments: DataFrame, threshold: int = 4, ratio: int = 4) -> DataFrame:
    """All members (segment_id, row_count, tier) of the lowest tier with at least `threshold` segments; none for a threshold of 0 or where no tier has so many."""
    tiered = segments.withColumn("tier", rules.size_tier(F.col("row_count"), ratio))
    if threshold < 1:
        return tiered.limit(0)
    full = tiered.groupBy("tier").agg(F.count("*").alias("n")).filter(F.col("n") >= threshold).agg(F.min("tier").alias("tier"))
    return tiered.join(F.broadcast(full), "tier", "left_semi")  # one row


def plan_cascade(sizes: dict[int, int], threshold: int = 4, ratio: int = 4, rounds: int = 64, most: int | None = None) -> list[list[int]]:
    """Merges (lists of segment ids; each result takes the least id and the sum of the sizes) until no tier is full; then all, if more than `most` segments are left."""
    left, plan = dict(sizes), []
    for _ in range(rounds):
        tiers: dict[int, list[int]] = {}
        for s, n in left.items():
            tier = 0
            while n >= ratio ** (tier + 1) and tier < 62:
                tier += 1
            tiers.setdefault(tier, []).append(s)
        full = [t for t, members in tiers.items() if len(members) >= threshold > 0]
        if not full:
            break
        merged = sorted(tiers[min(full)])
        plan.append(merged)
        left[merged[0]] = sum(left.pop(s) for s in merged)
    if most is not None and len(left) > max(most, 1):
        plan.append(sorted(left))
    return plan


def ghosts(log: DataFrame) -> DataFrame:
    """(segment_id, rows, ghosts, fraction): rows of a segment whose id is visible nowhere."""
    alive = lww.visible(log).select("id")
    rows = log.filter(F.col("segment_id") != lww.MEMTABLE)
    dead = rows.join(alive, "id", "left_anti").groupBy("segment_id").agg(F.count("*").alias("ghosts"))
    return rows.groupBy("segment_id").agg(F.count("*").alias("rows")).join(dead, "segment_id", "left").select("segment_id", "rows", F.coalesce("ghosts", F.lit(0)).alias("ghosts"), (F.coalesce("ghosts", F.lit(0)) / F.col("rows")).alias("fraction"))


def sparse_index(rows: DataFrame, stride: int = 16) -> DataFrame:
    """(segment_id, ord, id): every `stride`-th id of a segment in id order, and its last."""
    w = Window.partitionBy("segment_id").orderBy("id")
    numbered = rows.select("segment_id", "id", (F.row_number().over(w) - 1).alias("ord"), F.lead("id").over(w).alias("after"))
    return numbered.filter((F.col("ord") % stride == 0) | F.col("after").isNull()).select("segment_id", "ord", "id")
