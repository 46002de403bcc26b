"""A corpus pipeline of five stages, each one operator of vecloom.llm.

Quality rules reject documents, near duplicates keep one document of each group,
secrets are masked in the texts, sources are mixed to their targets, and the
result is tokenised. Each stage's result is written and read again as the next
one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm import bpe, jaccard_join, mixing, quality, secret_scan
from vecloom.llm.common import drop, stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; their bands are fitted on the labelled documents."""
    return quality.keep(docs, limits=quality.limits_in(docs, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that links of 80 % of their 5-word shingles lead together the one of the smallest id stays."""
    return jaccard_join.keep_one(docs, width=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text becomes [secret]; n_chars follows the text."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate asks for."""
    return mixing.mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and a check of the round trip; a document that was mixed in twice is there twice."""
    both = bpe.encode(docs, round_trip=True)
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
    ("tokens", tokenise),
]

#: SQL has neither zstandard nor byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's documents. What the stages before it wrote goes as soon as the next one has read it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        after = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop(before)
        docs = before = after
    return docs
