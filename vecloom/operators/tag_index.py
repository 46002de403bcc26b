"""Inverted tag index over (segment_id, ord, tags)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules

#: Rows in a bitmap bucket, fixed by Spark's bitmap functions.
BUCKET = 32_768


def postings(rows: DataFrame, ordinal: str = "ord", segment: str = "segment_id") -> DataFrame:
    """(segment, tag, ord): a row for each distinct tag of each row."""
    return rows.select(segment, F.col(ordinal).alias("ord"), F.explode(rules.normal_tags(F.col("tags"))).alias("tag"))


def inverted(rows: DataFrame, ordinal: str = "ord", segment: str = "segment_id") -> DataFrame:
    """(segment, tag, bucket, bitmap, n): bitmaps of ordinals, in buckets, so a tag on every row stays in bounded rows."""
    pos = F.col("ord") + 1  # Spark's positions begin at 1
    return postings(rows, ordinal, segment).groupBy(segment, "tag", F.bitmap_bucket_number(pos).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(pos)).alias("bitmap"), F.count("*").alias("n"))


def ordinals(index: DataFrame, segment: str = "segment_id") -> DataFrame:
    """(segment, tag, ord): the bitmaps of `inverted` spelt out again, byte by byte and only where one has bits."""
    pairs = F.transform(F.regexp_extract_all(F.hex("bitmap"), F.lit(".."), F.lit(0)), lambda two, at: F.struct(at.alias("at"), F.conv(two, 16, 10).cast("int").alias("bits")))
    some = F.filter(pairs, lambda p: p["bits"] != 0)
    bits = F.flatten(F.transform(some, lambda p: F.transform(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda b: p["bits"].bitwiseAND(F.call_function("shiftleft", F.lit(1), b)) != 0), lambda b: p["at"] * 8 + b)))
    return index.select(segment, "tag", "bucket", F.explode(bits).alias("bit")).select(segment, "tag", ((F.col("bucket") - 1) * BUCKET + F.col("bit")).cast("long").alias("ord"))


def matching(rows: DataFrame, wanted: list[str], ordinal: str = "ord", segment: str = "segment_id") -> DataFrame:
    """(segment, ord) of rows with all wanted tags, by division of the postings; every row if none is wanted."""
    if not wanted:
        return rows.select(segment, F.col(ordinal).alias("ord"))
    wanted = list(dict.fromkeys(wanted))
    hits = postings(rows, ordinal, segment).filter(F.col("tag").isin(wanted))
    return hits.groupBy(segment, "ord").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted)).drop("n")


def cardinality(index: DataFrame, wanted: list[str], segment: str = "segment_id") -> DataFrame:
    """(segment, n): rows that have all wanted tags, from the bitmaps of `inverted`."""
    wanted = list(dict.fromkeys(wanted))
    per = index.filter(F.col("tag").isin(wanted)).groupBy(segment, "bucket").agg(F.count("*").alias("tags"), F.bitmap_count(F.bitmap_and_agg("bitmap")).alias("n"))
    return per.filter(F.col("tags") == len(wanted)).groupBy(segment).agg(F.sum("n").alias("n"))


def selectivity(log: DataFrame, wanted: list[str]) -> DataFrame:
    """The share of rows that fit: all rows of segments, only live ones of the memtable; 1 without filter or rows."""
    if not wanted:
        return log.sparkSession.range(1).select(F.lit(1.0).alias("selectivity"))
    counted = log.filter((F.col("segment_id") >= 0) | rules.live(F.col("vector"), F.col("tombstone")))
    return counted.agg(F.coalesce(F.avg(rules.has_all_tags(F.col("tags"), wanted).cast("double")), F.lit(1.0)).alias("selectivity"))
