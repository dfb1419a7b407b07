"""Sharding by a permutation-filled lookup table, in DataFrame operations only.

Every shard has its own preference order over the slots of a table of prime size: a permutation from two hashes of its
name, (offset + j * skip) mod size. The shards take turns and each claims the next free slot it prefers, until the table is
full, so shares differ by one slot at most; when shards come or go most slots keep their shard. A key is placed by one hash
and one look into the table, which is broadcast: its size is the number of slots, whatever the data.

Nulls: null key columns count as the empty text in the hash, so rows without any key share one documented shard. Keys are
hashed, not ranked: ties and repeated rows go where their key goes. Other columns are kept; a column of the same name as the
result column is replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime of about a hundred slots per shard keeps shares within one percent.
SLOTS = 6469
SHARDS = tuple(f"shard-{i:02d}" for i in range(64))


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def filled(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The shard (its place in ``shards``) of every slot."""
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("shards must be distinct names, at most one per slot, and the number of slots prime")
    offsets, skips = [_hash(f"{s}/offset") % slots for s in shards], [_hash(f"{s}/skip") % (slots - 1) + 1 for s in shards]
    table, turns, left = [-1] * slots, [0] * len(shards), slots
    while True:
        for i in range(len(shards)):
            while table[at := (offsets[i] + turns[i] * skips[i]) % slots] >= 0:
                turns[i] += 1
            table[at] = i
            left -= 1
            if not left:
                return table


def slot_of(*keys: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: its hash modulo the table's size."""
    text = F.concat_ws("\u001f", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % slots).cast("int")


def assign(frame: DataFrame, *keys: str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, out_col: str = "shard") -> DataFrame:
    """The frame with the shard name of each row's key."""
    spark, table = frame.sparkSession, filled(shards, slots)
    named = F.get(F.lit(list(shards)), F.get(F.split(F.lit(",".join(map(str, table))), ","), F.col("id").cast("int")).cast("int"))
    lookup = spark.range(slots).select(F.col("id").cast("int").alias("__slot"), named.alias("__shard"))
    placed = frame.withColumn("__of", slot_of(*[F.col(k) for k in keys], slots=slots))
    return placed.join(F.broadcast(lookup), F.col("__of") == F.col("__slot")).withColumn(out_col, F.col("__shard")).drop("__of", "__slot", "__shard")


def sizes(frame: DataFrame, shards: tuple[str, ...] = SHARDS, shard_col: str = "shard") -> DataFrame:
    """(shard, rows) for every shard, also the empty ones."""
    every = frame.sparkSession.range(1).select(F.explode(F.lit(list(shards))).alias(shard_col))
    return every.join(frame.groupBy(shard_col).agg(F.count(F.lit(1)).alias("rows")), shard_col, "left").na.fill(0, ["rows"])
