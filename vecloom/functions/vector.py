"""Vector kernels as column expressions: doubles throughout, higher is better for every score."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS = ("l2", "dot", "cosine")


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(as_double(v), lambda x: x * x)))


def cosine_with_norms(a: Column, norm_a: Column, b: Column, norm_b: Column) -> Column:
    """Cosine from stored norms; 0 if either is 0."""
    return F.when(norm_a * norm_b == 0, F.lit(0.0)).otherwise(dot(a, b) / (norm_a * norm_b))


def cosine(a: Column, b: Column) -> Column:
    return cosine_with_norms(a, norm(a), b, norm(b))


def score(metric: str, a: Column, b: Column) -> Column:
    """The uniform score: minus squared distance, inner product or cosine."""
    if metric == "l2":
        return -l2_squared(a, b)
    if metric == "dot":
        return dot(a, b)
    if metric == "cosine":
        return cosine(a, b)
    raise ValueError(f"unknown metric {metric!r}")


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, as_double(v)).otherwise(F.transform(as_double(v), lambda x: x / n))


def valid_dimension(v: Column, tombstone: Column, dimension: int) -> Column:
    """Whether a row may be written: tombstones always, others with exactly `dimension` components; 0 switches the check off."""
    return F.lit(True) if dimension == 0 else F.coalesce(tombstone, F.lit(False)) | (F.coalesce(F.size(v), F.lit(-1)) == dimension)


@F.arrow_udf(T.BinaryType())
def _floats_to_bytes(v: pa.Array) -> pa.Array:
    data = np.ascontiguousarray(v.flatten().to_numpy(zero_copy_only=False), "<f4")
    ends = 4 * np.cumsum(pc.fill_null(pc.list_value_length(v), 0).to_numpy(), dtype=np.int64)
    out = pa.Array.from_buffers(pa.large_binary(), len(v), [None, pa.py_buffer(np.r_[0, ends]), pa.py_buffer(data)])
    return pc.if_else(v.is_valid(), out, None).cast(pa.binary())


def to_bytes(v: Column | str) -> Column:
    """Little-endian float32 wire form, whole batches at a time; null stays null."""
    return _floats_to_bytes((F.col(v) if isinstance(v, str) else v).cast("array<float>"))


@F.arrow_udf(T.ArrayType(T.FloatType()))
def from_bytes(b: pa.Array) -> pa.Array:
    """The vector of a wire form; null where the length is no multiple of four."""
    fit = pc.fill_null(pc.equal(pc.bit_wise_and(pc.binary_length(b), 3), 0), False)
    whole = pc.if_else(fit, b, None).cast(pa.large_binary())
    ends = np.cumsum(pc.fill_null(pc.binary_length(whole), 0).to_numpy(), dtype=np.int64) // 4
    raw = b"".join(whole.drop_null().to_pylist())
    out = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(np.frombuffer(raw, "<f4"), pa.float32()))
    return pc.if_else(fit, out, None)


@F.udtf(returnType=T.StructType([T.StructField("id", T.StringType()), T.StructField("rank", T.IntegerType()), T.StructField("score", T.DoubleType())]))
class KnnRows:
    """Table function knn(query, metric, k) over TABLE(rows) of (id, vector): the best k rows of the partition that it is given."""

    def eval(self, row: Row, query: list, metric: str, k: int):
        if not hasattr(self, "best"):
            self.best, self.q = [], np.array(query, np.float64)
            self.metric, self.k = metric, k
        if row["vector"] is None or row["id"] is None or len(row["vector"]) != len(self.q):
            return
        v = np.array(row["vector"], np.float64)
        if self.metric == "l2":
            score = -float(np.square(v - self.q).sum())
        else:
            n = float(np.linalg.norm(v) * np.linalg.norm(self.q)) if self.metric == "cosine" else 1.0
            score = float(v @ self.q) / n if n else 0.0
        if not np.isnan(score):
            self.best.append((-score, str(row["id"])))
        if len(self.best) > 4 * self.k + 64:
            self.best = sorted(self.best)[: self.k]

    def terminate(self):
        for rank, (score, row_id) in enumerate(sorted(getattr(self, "best", []))[: getattr(self, "k", 0)]):
            yield row_id, rank + 1, -score


def register(spark: SparkSession) -> None:
    """SQL functions vec_l2, vec_dot, vec_cosine, vec_norm and tags_all, which Catalyst inlines, and the table function knn.

    SELECT * FROM knn(TABLE(rows) PARTITION BY (segment_id), array(1D, 0D), 'cosine', 10)
    gives the best rows of each segment; without PARTITION BY (WITH SINGLE
    PARTITION) all rows go through one task, so give a partitioning on large tables.
    """
    spark.udtf.register("knn", KnnRows)
    ab = "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>"
    total = "aggregate({}, 0D, (s, x) -> s + x)"
    for name, args, body in (
        ("vec_l2", ab, total.format("zip_with(a, b, (x, y) -> (x - y) * (x - y))")),
        ("vec_dot", ab, total.format("zip_with(a, b, (x, y) -> x * y)")),
        ("vec_norm", "a ARRAY<DOUBLE>", f"sqrt({total.format('transform(a, x -> x * x)')})"),
        ("tags_all", "tags ARRAY<STRING>, wanted ARRAY<STRING>", "size(array_except(wanted, tags)) = 0"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURN {body}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION vec_cosine({ab}) RETURN CASE WHEN vec_norm(a) * vec_norm(b) = 0 THEN 0D ELSE vec_dot(a, b) / (vec_norm(a) * vec_norm(b)) END")
