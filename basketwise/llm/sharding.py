"""Placement of rows on shards through a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def text_hash(text: str) -> int:
    """First 60 bits of the MD5 of a text; the same value in any SQL engine."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int) -> list[int]:
    """Shard number of every slot.

    Every shard prefers slots in its own order, offset + k * skip modulo the prime ``slots``. Shards take turns;
    each turn claims the first preferred slot that is still free, until no slot is. Shares differ by at
    most one slot, and losing a shard moves few slots between the others. The order of ``shards`` does not
    matter: turns follow the sorted names. Names must be distinct and ``slots`` a prime over their number.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct, and there must be one at least")
    if not _is_prime(slots) or slots < len(shards):
        raise ValueError("slots must be a prime not smaller than the number of shards")
    turn = sorted(range(len(shards)), key=lambda i: shards[i])
    spot = [text_hash(s + ":offset") % slots for s in shards]
    skip = [text_hash(s + ":skip") % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    table = [-1] * slots
    left = slots
    while left:
        for i in turn:
            while table[spot[i]] >= 0:
                spot[i] = (spot[i] + skip[i]) % slots
            table[spot[i]] = i
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, slots: int) -> Column:
    """Slot of a key: :func:`text_hash` of its text modulo ``slots``; null keys use the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint") % slots


def place(df: DataFrame, key: Column, shards: list[str], slots: int = 2053, out: str = "shard",
          slot_out: str = "slot") -> DataFrame:
    """``df`` with the slot and the shard name of every row.

    A row needs one hash and one probe of the broadcast table (``slots`` rows, a fixed number): no shuffle,
    whatever the key. Rows with equal keys go together, so use a key that no few values dominate
    (a document id, not its source) to keep shards even. Null keys all go to the slot of the empty
    text. Existing columns named like the outputs are replaced; an empty table stays empty.
    """
    table = lookup_table(shards, slots)
    names = df.sparkSession.range(1).select(F.posexplode(F.lit([shards[i] for i in table])).alias("__slot", out))
    rows = df.drop(slot_out, out).withColumn(slot_out, slot_of(key, slots))
    return rows.join(F.broadcast(names), F.col(slot_out) == F.col("__slot")).drop("__slot")


def write_shards(df: DataFrame, key: Column, shards: list[str], path: str, slots: int = 2053,
                 files_per_shard: int = 1) -> None:
    """Write rows in one folder per shard, each dealt over ``files_per_shard`` tasks by a hash of the row key."""
    placed = place(df, key, shards, slots).withColumn("file", F.pmod(F.xxhash64(key), F.lit(files_per_shard)))
    (placed.repartition(len(shards) * files_per_shard, "shard", "file").drop("file", "slot")
     .write.partitionBy("shard").parquet(path))
