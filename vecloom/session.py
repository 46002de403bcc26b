"""Session construction and the settings the engine relies on."""
from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings used when this library starts its own session (tests, bench). A
#: session handed in by a cluster keeps its own values.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cpus: int | str = "*", memory: str = "8g", partitions: int = 8, **extra: str) -> SparkSession:
    """A local session with DEFAULTS, for tests and benchmarks."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.environ.get("PYTHONPATH", "")
    if root not in path.split(os.pathsep):
        os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [root, path]))
    conf = DEFAULTS | {"spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(partitions), "spark.driver.host": "127.0.0.1"} | extra
    return SparkSession.builder.master(f"local[{cpus}]").appName("vecloom").config(map=conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
