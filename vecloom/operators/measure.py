"""Measurements over operation logs and over pairs of result lists (query_id, rank, id, score)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Upper bounds in milliseconds; +Inf follows.
BUCKETS = (1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0, 10000.0)


def histogram(log: DataFrame, value: str, buckets=BUCKETS, by: list[str] | None = None) -> DataFrame:
    """(by, le, count, total, sum): cumulative counts, by one scan with one conditional sum per bucket."""
    by = by or []
    agg = log.groupBy(*by).agg(*[F.sum((F.col(value) <= b).cast("long")).alias(f"b{i}") for i, b in enumerate(buckets)], F.count(value).alias("total"), F.sum(value).alias("sum"))
    pairs = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.coalesce(F.col(f"b{i}"), F.lit(0)).alias("count")) for i, b in enumerate(buckets)], F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("count")))
    return agg.select(*by, F.explode(pairs).alias("p"), "total", "sum").select(*by, "p.le", "p.count", "total", "sum")


def latency(log: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """count, mean, p50, p95, p99 and max; percentiles interpolate linearly."""
    return log.groupBy(*(by or [])).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), *[F.percentile(value, p / 100).alias(f"p{p}") for p in (50, 95, 99)], F.max(value).alias("max"))


def usage(oplog: DataFrame, op: str = "op") -> DataFrame:
    """Operations of each kind, all and failed."""
    return oplog.groupBy(op).agg(F.count("*").alias("total"), F.sum((~F.col("ok")).cast("long")).alias("failed"))


def agreement(truth: DataFrame, approx: DataFrame) -> DataFrame:
    """One row per query of either list: overlap, recall, jaccard, ranks_equal, mean_shift, max_shift, score_mae, same_first.

    Recall is 1 for an empty truth, jaccard 1 for two empty lists, shifts and
    score error 0 without common ids.
    """
    a = truth.select("query_id", "id", F.col("rank").alias("r1"), F.col("score").alias("s1"))
    b = approx.select("query_id", "id", F.col("rank").alias("r2"), F.col("score").alias("s2"))
    both = a.join(b, ["query_id", "id"], "full")
    common = F.col("r1").isNotNull() & F.col("r2").isNotNull()
    shift = F.when(common, F.abs(F.col("r1") - F.col("r2")))
    n = lambda c: F.sum(c.cast("long"))
    per = both.groupBy("query_id").agg(
        n(common).alias("overlap"), F.count("r1").alias("n1"), F.count("r2").alias("n2"), F.count("*").alias("either"), n(common & (F.col("r1") == F.col("r2"))).alias("ranks_equal"),
        F.coalesce(F.avg(shift), F.lit(0.0)).alias("mean_shift"), F.coalesce(F.max(shift), F.lit(0)).alias("max_shift"),
        F.coalesce(F.avg(F.when(common, F.abs(F.col("s1") - F.col("s2")))), F.lit(0.0)).alias("score_mae"), n(common & (F.col("r1") == 1) & (F.col("r2") == 1)).alias("same_first"),
    )
    return per.select(
        "query_id", "overlap", F.when(F.col("n1") == 0, 1.0).otherwise(F.col("overlap") / F.greatest("n1", F.lit(1))).alias("recall"),
        F.when(F.col("either") == 0, 1.0).otherwise(F.col("overlap") / F.greatest("either", F.lit(1))).alias("jaccard"), "ranks_equal", "mean_shift", "max_shift", "score_mae", (F.col("same_first") > 0).alias("same_first"),
    )


def verdict(agreed: DataFrame) -> DataFrame:
    """One row over all queries: mean, least and greatest recall, mean jaccard, rates, and match, close or material."""
    row = agreed.agg(
        F.count("*").alias("queries"), F.avg("recall").alias("mean_recall"), F.min("recall").alias("min_recall"), F.max("recall").alias("max_recall"), F.avg("jaccard").alias("mean_jaccard"),
        F.avg(F.col("same_first").cast("double")).alias("first_rate"), F.avg((F.col("jaccard") == 1).cast("double")).alias("perfect_rate"),
    )
    return row.withColumn("verdict", F.when((F.col("mean_recall") >= 0.99) & (F.col("mean_jaccard") >= 0.99), "match").when(F.col("mean_recall") >= 0.90, "close").otherwise("material"))


def same_ranking(truth: DataFrame, approx: DataFrame) -> DataFrame:
    """(query_id, same): whether both lists have the same ids at the same ranks."""
    both = truth.select("query_id", "rank", F.col("id").alias("a")).join(approx.select("query_id", "rank", F.col("id").alias("b")), ["query_id", "rank"], "full")
    return both.groupBy("query_id").agg(F.min(F.col("a").eqNullSafe(F.col("b"))).alias("same"))


def missing(expected: DataFrame, found: DataFrame, key: str = "key") -> DataFrame:
    return expected.select(key).distinct().join(found.select(key).distinct(), key, "left_anti")


def survival(reports: DataFrame, expected: int) -> DataFrame:
    """Whether all nodes reported and none had errors."""
    return reports.agg(F.countDistinct("node").alias("nodes"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors")).withColumn("survived", (F.col("nodes") == expected) & (F.col("errors") == 0))


def roll_up(reports: DataFrame) -> DataFrame:
    """Operations per second of all nodes together, and the mean and percentiles over nodes."""
    per = reports.groupBy("node").agg((F.sum("ops") / F.sum("seconds")).alias("rate"))
    return per.agg(F.sum("rate").alias("total_rate"), F.avg("rate").alias("mean_rate"), F.percentile("rate", 0.5).alias("p50_rate"), F.percentile("rate", 0.95).alias("p95_rate"))


def same_set(one: DataFrame, other: DataFrame) -> DataFrame:
    """(same): whether two tables have the same distinct rows."""
    sides = one.withColumn("_side", F.lit(1)).unionByName(other.withColumn("_side", F.lit(2)))
    per = sides.groupBy(*one.columns).agg(F.countDistinct("_side").alias("_n"))
    return per.agg(F.coalesce(F.min("_n") == 2, F.lit(True)).alias("same"))


def zipf_shares(items: DataFrame, number: str, total: int, period: int = 17, power: float = 1.3) -> DataFrame:
    """Adds weight 1 / (number % period + 1)^power and each item's share of `total`."""
    weighed = items.withColumn("weight", 1 / F.pow(F.col(number) % period + F.lit(1.0), F.lit(power)))
    return weighed.withColumn("share", F.col("weight") / weighed.agg(F.sum("weight")).scalar() * total)


def prometheus(metrics: DataFrame) -> DataFrame:
    """Text lines of (name, labels, value): name{labels} value, in order."""
    labels = F.when(F.coalesce("labels", F.lit("")) == "", "").otherwise(F.concat(F.lit("{"), F.col("labels"), F.lit("}")))
    return metrics.select(F.concat(F.col("name"), labels, F.lit(" "), F.col("value").cast("string")).alias("line"))
