"""The registered query of each operator over the driver's tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, jaccard_join, licences, lm, mixing, oracles, quality, secret_scan, sharding, topk, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return jaccard_join.join(_table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, encoded and decoded again."""
    both = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), round_trip=True)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, digest of the canonical form, licence of the whole text, notices of whole lines."""
    return licences.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "digest", "licence", "notices")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every URL."""
    return url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score of the ten best rows for each query."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.search(vectors, F.col("vec_id") % 100 == 0)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, slot, shard of every document."""
    return sharding.place(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "slot", "shard")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    return lm.score(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    planned = mixing.plan(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return planned.select("doc_id", F.col("_size").alias("size"), "_mix.source_size", "_mix.target", (F.col("_copies") * F.col("_size")).alias("taken"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every whole text."""
    found = secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str):
        return F.size(F.filter("_base", lambda s: s["kind"] == secret_scan.KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in secret_scan.KINDS[:3]], F.sha2(secret_scan.listed(F.col("_base")).cast("binary"), 256).alias("base_sha256"), secret_scan.listed(F.col("_spans")).alias("spans"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts, base_failed and kept of every whole text, by limits fitted on the labelled documents."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, limits=quality.limits_in(docs, sf_dir)).select("doc_id", *quality.COUNTS, "base_failed", "kept")


def queries() -> dict:
    return {f.__name__: f for f in (op1_jaccard_join, op2_byte_bpe, op3_license_scan, op4_url_filter, op5_topk, op6_sharding, op7_lm_score, op8_mix, op9_secret_scan, op10_quality)}


def oracle_sql() -> dict[str, str]:
    return oracles.sql()
