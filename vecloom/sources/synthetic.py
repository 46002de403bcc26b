"""Corpora made by rule: every row depends on its number and the seed alone."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def clustered(spark: SparkSession, rows: int, dimension: int, clusters: int = 32, spread: float = 0.15, unit: bool = True, seed: int = 42) -> DataFrame:
    """(id, vector, cluster): points around random centres."""
    centres = np.random.default_rng(seed).normal(size=(clusters, dimension))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            noise = np.stack([np.random.default_rng([seed, int(i)]).normal(size=dimension) for i in ids]) if len(ids) else np.zeros((0, dimension))
            m = centres[ids % clusters] + spread * noise
            if unit:
                m /= np.linalg.norm(m, axis=1, keepdims=True)
            offsets = pa.array(np.arange(0, m.size + 1, dimension, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(m.ravel().astype(np.float32))), pa.array(ids % clusters)], names=["id", "vector", "cluster"])

    return spark.range(rows).mapInArrow(run, "id long, vector array<float>, cluster long")


def gaussian(spark: SparkSession, rows: int, dimension: int, seed: int = 42) -> DataFrame:
    """(id, vector): random unit vectors."""
    return clustered(spark, rows, dimension, 1, 1e6, True, seed).drop("cluster")
