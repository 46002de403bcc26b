"""Sharding by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a prime-sized table, from two
hashes of its name; shards take turns, each claiming the first slot of its
permutation that is still free, until the table is full. Every shard then holds
floor or ceil of slots / shards, and removing a shard moves few other slots. The
table depends on the shards' names alone, has a fixed number of slots, and is
broadcast: a row's place costs one hash and one lookup.
"""
from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside

SLOTS = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _hash(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


@lru_cache(16)
def fill(shards: tuple[str, ...], slots: int = SLOTS) -> tuple[int, ...]:
    """The shard's index for each slot. Shards are taken in name order; an empty list gives an empty table."""
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    if len(shards) > slots or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and no more than the slots")
    order = sorted(range(len(shards)), key=lambda i: shards[i])
    at = {i: _hash(shards[i], "offset") % slots for i in order}
    step = {i: _hash(shards[i], "skip") % (slots - 1) + 1 for i in order}
    owner, free = [-1] * slots, slots
    while free and order:
        for i in order:
            if not free:
                break
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            owner[at[i]] = i
            free -= 1
    return tuple(owner) if order else ()


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key's text form; null is placed as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % F.lit(slots)


def lookup(spark, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(_slot, shard): the filled table, of a fixed number of rows."""
    if not shards:
        return spark.createDataFrame([], "_slot long, shard string")
    owners = F.split(F.lit(",".join(map(str, fill(tuple(shards), slots)))), ",").cast("array<int>")
    names = F.split(F.lit("\x01".join(shards)), "\x01")
    return spark.range(slots, numPartitions=1).select(F.col("id").alias("_slot"), F.element_at(names, F.element_at(owners, (F.col("id") + 1).cast("int")) + 1).alias("shard"))


def place(df: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Every row with `slot` and `shard`, by a broadcast join with the fixed-size table.

    Rows with equal keys go to one shard; a null key is placed as the empty text.
    With no shards, shard is null; an empty table gives an empty result. Columns
    named slot or shard are replaced, unless the key is one, which is refused;
    others pass through whatever their names.
    """
    if key.lower() in ("slot", "shard"):
        raise ValueError("the key may not be named slot or shard")
    df, back = aside(df.drop("slot", "shard"), "_slot")
    df = df.withColumn("slot", slot_of(F.col({old: new for new, old in back.items()}.get(key, key)), slots))
    return df.join(F.broadcast(lookup(df.sparkSession, tuple(shards), slots)), F.col("slot") == F.col("_slot"), "left").drop("_slot").withColumnsRenamed(back)
