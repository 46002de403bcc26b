"""Admission of writes and searches.

Decisions that depend on earlier decisions are folds in order: one collection's
log goes through one task, as it goes through one writer in a store. Collections
run in parallel, and a fold streams over its sorted rows in bounded memory
(the quota's live ids aside).
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quota(log: DataFrame, most: int, key: str = "id", order: str = "seq", collection: str | None = None) -> DataFrame:
    """Adds admitted: whether a write's id is among the first `most` distinct ids of its collection. For logs without deletions.

    The first appearance of each id is ranked; an id that is not among the first
    `most` never becomes one later, so no fold is needed.
    """
    by = [collection] if collection else []
    first = log.groupBy(*by, key).agg(F.min(order).alias("_first"))
    ranked = first.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_first"))).filter(F.col("_n") <= most)
    allowed = ranked.select(*by, key, F.lit(True).alias("_in"))
    return log.join(allowed, [*by, key], "left").withColumn("admitted", F.coalesce("_in", F.lit(False))).drop("_in")


def _fold(log: DataFrame, collection: str, order: str, columns: list[str], start, step) -> DataFrame:
    """(collection, order, admitted) from `step(state, *columns) -> bool` over each collection's rows in order; the state is kept from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for batch in batches:
            rows = [c.to_pylist() for c in batch.columns]
            out = []
            for i in range(batch.num_rows):
                if rows[0][i] != now:
                    now, state = rows[0][i], start()
                out.append(step(state, *[r[i] for r in rows[2:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], names=[collection, order, "admitted"])

    kinds = dict(log.dtypes)
    sorted_log = log.select(collection, order, *columns).repartition(collection).sortWithinPartitions(collection, order)
    return sorted_log.mapInArrow(run, f"`{collection}` {kinds[collection]}, `{order}` {kinds[order]}, admitted boolean")


def quota_with_deletes(log: DataFrame, most: int, collection: str = "collection", order: str = "seq") -> DataFrame:
    """As `quota`, for logs of (op, id) with op 'delete' among them: a deletion frees a place."""

    def step(ids: set, op: str, row_id) -> bool:
        if op == "delete":
            ids.discard(row_id)
            return True
        if row_id not in ids and len(ids) >= most:
            return False
        ids.add(row_id)
        return True

    return _fold(log, collection, order, ["op", "id"], set, step)


def rate(log: DataFrame, most: int, width: int, at: str = "ts", collection: str = "collection", order: str = "seq") -> DataFrame:
    """Admits `most` requests in a window of `width`, which begins anew with the first request that comes `width` or more after the window's start."""

    def step(state: list, now: int) -> bool:
        if state[0] is None or now - state[0] >= width:
            state[:] = [now, 0]
        if state[1] >= most:
            return False
        state[1] += 1
        return True

    return _fold(log, collection, order, [at], lambda: [None, 0], step)


def memory(log: DataFrame, budget: int, collection: str = "collection", order: str = "seq", size: str = "bytes") -> DataFrame:
    """Admits rows that fit the budget on their own; a full memtable is flushed first, which empties it."""

    def step(state: list, n: int) -> bool:
        if n > budget:
            return False
        state[0] = n if state[0] + n > budget else state[0] + n
        return True

    return _fold(log, collection, order, [size], lambda: [0], step)


def valid_prefix(log: DataFrame, ok: str = "ok", order: str = "seq", by: str | None = None) -> DataFrame:
    """The rows before the first invalid one of each log, found by one aggregation instead of a running window."""
    if by:
        bad = log.filter(~F.col(ok)).groupBy(by).agg(F.min(order).alias("_bad"))
        return log.join(bad, by, "left").filter(F.col("_bad").isNull() | (F.col(order) < F.col("_bad"))).drop("_bad")
    bad = log.filter(~F.col(ok)).agg(F.min(order).alias("b")).scalar()
    return log.filter(bad.isNull() | (F.col(order) < bad))
