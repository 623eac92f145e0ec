"""Placement of rows on shards by a permutation-filled lookup table.

Each shard has its own preference order over the slots of a prime-sized table; shards take turns and claim their next
free slot until the table is full. A row's key is hashed to a slot, so placement costs one lookup, loads differ by at
most one slot, and few keys move when a shard is added or taken away.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The production table: 16 shards over a prime number of slots, 125 a shard.
SHARDS, SLOTS = 16, 2003
#: The largest table; at 4 bytes and a key a row it stays far below what may be broadcast.
MOST_SLOTS = 1_000_003


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(shard: str, slots: int) -> tuple[int, int]:
    """(offset, skip) of a shard's order: its j-th choice is (offset + j * skip) mod slots."""
    digest = hashlib.md5(shard.encode()).hexdigest()
    return int(digest[:8], 16) % slots, int(digest[8:16], 16) % (slots - 1) + 1


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard number of every slot. Its size is a parameter, never the data's."""
    if not is_prime(slots) or slots > MOST_SLOTS or not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError("slots must be prime and bounded; shards distinct, and at most as many")
    orders, table, left, turn = [preference(s, slots) for s in shards], [-1] * slots, slots, [0] * len(shards)
    while left:
        for i, (offset, skip) in enumerate(orders):
            while table[at := (offset + turn[i] * skip) % slots] >= 0:
                turn[i] += 1
            table[at], left = i, left - 1
            if not left:
                break
    return table


def lookup(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """The table as rows (slot, shard)."""
    filled = ",".join(map(str, fill(shards, slots)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(filled), ",")).alias("slot", "_s")).select("slot", F.col("_s").cast("int").alias("shard"))


def slot_of(key, slots: int = SLOTS):
    """Slot of a key: the first 32 bits of its MD5, modulo the prime. A null key hashes as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % slots


def place(df: DataFrame, key: str = "doc_id", shards: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """The rows with the columns slot and shard (such columns of the input are replaced).

    Null keys take one slot, repeated keys the same slot. With a unique key no shard gets a hot group, whatever the
    source or text. An empty table gives an empty result. The lookup is broadcast: it has ``slots`` rows, at most MOST_SLOTS.
    """
    shards = shards or [f"shard-{i:05d}" for i in range(SHARDS)]
    keyed = df.drop(*({"slot", "shard"} - {key})).withColumn("_slot", slot_of(F.col(key), slots).cast("int"))
    table = lookup(df.sparkSession, shards, slots).withColumnsRenamed({"slot": "_at", "shard": "_shard"})
    out = keyed.join(F.broadcast(table), F.col("_slot") == F.col("_at"))
    return out.drop("_at").withColumnsRenamed({"_slot": "slot", "_shard": "shard"})


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: list[str] | None = None, slots: int = SLOTS) -> None:
    """Write one folder a shard; rows are dealt by slot first, so a shard's files come from many tasks of like size."""
    place(df, key, shards, slots).repartition("slot").write.partitionBy("shard").parquet(path)
