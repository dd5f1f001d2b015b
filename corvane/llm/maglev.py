"""Sharding by a permutation-filled lookup table: every shard prefers the slots of a prime-sized table in an order of its own,
and the shards take turns claiming their next free slot until the table is full. A key's slot is its hash modulo the size.

Shards get within one slot of equally many slots (for equal weights), and a shard that comes or goes moves few other keys. The
table has SLOTS rows whatever the data, so it is broadcast, and placing a document is one hash and one lookup.

Cases: rows without a key share the key ""; equal keys share a shard; empty table: empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537
SHARDS = 256


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{k:05d}" for k in range(n)]


def _hash(what: str, name: str) -> int:
    return int.from_bytes(hashlib.md5(f"{what}:{name}".encode()).digest()[:8], "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill(names: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> list[int]:
    """Index of the shard in each slot. A shard of weight w claims w slots a turn."""
    if not names or len(set(names)) != len(names) or len(names) > slots or not is_prime(slots):
        raise ValueError("shards must be distinct, at least one and at most the slots, whose number must be prime")
    weights = weights or [1] * len(names)
    if len(weights) != len(names) or min(weights) < 1:
        raise ValueError("each shard needs a weight of at least 1")
    at = [_hash("offset", n) % slots for n in names]
    step = [_hash("skip", n) % (slots - 1) + 1 for n in names]
    table, left = [-1] * slots, slots
    while left:
        for k, w in enumerate(weights):
            for _ in range(min(w, left)):
                while table[at[k]] >= 0:
                    at[k] = (at[k] + step[k]) % slots
                table[at[k]] = k
                left -= 1
            if not left:
                break
    return table


def slot(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long"), F.lit(slots).cast("long"))


def lookup(spark: SparkSession, names: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> DataFrame:
    return spark.createDataFrame([(s, k, names[k]) for s, k in enumerate(fill(names, slots, weights))], "t_slot long, shard int, shard_name string")


def place(df: DataFrame, key: str, names: list[str] | None = None, slots: int = SLOTS, weights: list[int] | None = None) -> DataFrame:
    """key, slot, shard, shard_name for every row of df; a key of one of the last three names comes back as key_<name>."""
    table = lookup(df.sparkSession, names or shard_names(), slots, weights)
    own = f"key_{key}" if key.lower() in ("slot", "shard", "shard_name") else key
    found = F.col(f"`{key}`")
    rows = df.select(found.alias("k_value"), slot(found, slots).alias("k_slot"))
    rows = rows.join(F.broadcast(table), F.col("k_slot") == F.col("t_slot"))
    return rows.select(F.col("k_value").alias(own), F.col("k_slot").alias("slot"), "shard", "shard_name")
