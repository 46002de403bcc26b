"""Streams of versioned rows.

Late rows are accepted at any time and lose to newer versions, so no watermark
is needed for a table; state may be bounded by one where that is wanted.
"""
from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import lww


def scratch(spark: SparkSession) -> str:
    """The folder shared by all executors: spark.checkpoint.dir, or a local one where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="vecloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def into_log(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends a stream to a row log: within a batch the newest row of each id is kept. A batch that is repeated after a failure overwrites its own folder, so rows count once."""

    def write(batch: DataFrame, number: int) -> None:
        lww.newest(batch, segment=None).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class Newest(StatefulProcessor):
    """Keeps the newest (ts, version) of each id and emits a row whenever it changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("newest", "ts long, version long, tombstone boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else None
        best, changed = held, False
        for pdf in rows:
            for ts, version, gone in zip(pdf["ts"], pdf["version"], pdf["tombstone"]):
                now = (int(ts), int(version), bool(gone))
                if best is None or now[:2] > tuple(best[:2]):
                    best, changed = now, True
        if changed:
            self.state.update(tuple(best))
            yield pd.DataFrame({"id": [key[0]], "ts": [best[0]], "version": [best[1]], "tombstone": [best[2]]})

    def close(self) -> None:
        pass


def visible_changes(stream: DataFrame) -> DataFrame:
    """Changes of the visible table, row by row, from (id, ts, version, tombstone)."""
    kind = dict(stream.dtypes)["id"]
    return stream.groupBy("id").transformWithStateInPandas(statefulProcessor=Newest(), outputStructType=f"id {kind}, ts long, version long, tombstone boolean", outputMode="Update", timeMode="None")


class Window(StatefulProcessor):
    """Admission per collection: `most` requests in a window that begins with the first request at least `width` after its start."""

    def __init__(self, most: int, width: int):
        self.most, self.width = most, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "start long, used long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        start, used = self.state.get() if self.state.exists() else (None, 0)
        for pdf in rows:
            ok = []
            pdf = pdf.sort_values("ts", kind="stable")
            for ts in pdf["ts"]:
                if start is None or ts - start >= self.width:
                    start, used = int(ts), 0
                ok.append(used < self.most)
                used += used < self.most
            yield pd.DataFrame({"collection": key[0], "ts": pdf["ts"].to_numpy(), "admitted": ok})
        if start is not None:
            self.state.update((start, int(used)))

    def close(self) -> None:
        pass


def admitted(stream: DataFrame, most: int, width: int) -> DataFrame:
    """(collection, ts, admitted) for a stream of requests (collection, ts); `operators.admission.rate` is the batch form."""
    kind = dict(stream.dtypes)["collection"]
    return stream.groupBy("collection").transformWithStateInPandas(statefulProcessor=Window(most, width), outputStructType=f"collection {kind}, ts long, admitted boolean", outputMode="Update", timeMode="None")


def silences(beats: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions of heartbeats (endpoint, at) that end after a silence of `gap`."""
    return beats.withWatermark("at", late).groupBy("endpoint", F.session_window("at", gap)).agg(F.count("*").alias("beats")).select("endpoint", "session_window.start", "session_window.end", "beats")
