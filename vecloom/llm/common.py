"""What the operators of this subpackage share: words, scratch tables, shipping."""
from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import tempfile
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Maximal runs of anything but ASCII white space (space, \t \n \v \f \r).
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_scratch: dict[str, SparkSession] = {}
_tables: list = []


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, _UPPER, _LOWER)


def n_words(text: Column) -> Column:
    """Number of words in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(*parts: Column) -> Column:
    """A reproducible double in [0, 1) from the text forms of `parts`, null as the empty string."""
    key = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def table_literal(row: DataFrame, digits: int = 4) -> Column:
    """A fixed-size model, one row of one array<double>, as a constant array.

    Subqueries may not stand inside higher-order functions, so the row comes to
    the driver; its length depends on the model's alphabet, never on the data.
    """
    values = ",".join(f"{v:.{digits}f}" for v in row.first()[0])
    return F.split(F.lit(values), ",").cast("array<double>")


def need_integer(df: DataFrame, col: str) -> None:
    """Refuses a column of ids that are not integers."""
    kind = df.schema[col].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{col} must hold integers, not {kind.simpleString()}")


def aside(df: DataFrame, *reserved: str) -> tuple[DataFrame, dict[str, str]]:
    """The table with columns that bear an operator's own names (in any case) renamed, and the way back: new name to old."""
    own, back = {r.lower() for r in reserved}, {}
    for c in df.columns:
        if c.lower() in own:
            name = f"{c}_kept"
            while name.lower() in {x.lower() for x in [*df.columns, *back]}:
                name += "_"
            back[name] = c
    return df.withColumnsRenamed({old: new for new, old in back.items()}), back


def ship(spark: SparkSession) -> None:
    """Puts this package on the path of local Python workers; a cluster job ships it with --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


@lru_cache(1)
def _malloc_trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def table(build):
    """Caches large tables that a worker builds once and keeps from task to task, until a task of another operator calls `trim`."""
    _tables.append(cached := lru_cache(2)(build))
    return cached


def trim() -> None:
    """Lets go of the tables of other operators and returns freed memory of this worker to the system; workers and allocators keep it otherwise, next to the other workers of the executor."""
    for cached in _tables:
        cached.cache_clear()
    pa.default_memory_pool().release_unused()
    if f := _malloc_trim():
        f(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a fresh local one where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="vecloom-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished queries now; it does so when the driver's references to them are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """Writes a table to the shared folder and reads it back: a cut lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    free_shuffles(spark)
    df.write.option("compression", codec).parquet(path)
    free_shuffles(spark)
    out = spark.read.schema(df.schema).parquet(path)
    _scratch[path], out.written_to = spark, path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes written tables that no later step reads. What a result still needs goes when the process ends."""
    for t in tables:
        _remove(t.written_to)


def _remove(path: str) -> None:
    spark = _scratch.pop(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def drop_scratch() -> None:
    """Removes the written tables, as far as the session still lives."""
    while _scratch:
        try:
            _remove(next(iter(_scratch)))
        except Exception:  # the session ended before this process
            return
