"""Sharding by a permutation-filled lookup table.

Each shard walks the slots of a prime-sized table in an order of its own and the shards
take turns claiming the next free slot of theirs. A key's hash names a slot, the slot names
the shard. The table has a fixed size, so it is broadcast and placement costs one lookup.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Prime size of the table. It bounds the broadcast: one row of two integers per slot.
TABLE_SIZE = 65537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard index of each slot. Depends on the shards' names, not on their order of arrival."""
    if not _is_prime(size):
        raise ValueError(f"the table size {size} is not prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards need distinct names, at least one and at most one per slot")
    walks = []
    for name in shards:
        digest = hashlib.md5(name.encode()).digest()
        start = int.from_bytes(digest[:8], "big") % size
        step = int.from_bytes(digest[8:], "big") % (size - 1) + 1 if size > 2 else 1
        walks.append([start, step])
    turns = sorted(range(len(shards)), key=lambda i: shards[i])
    table, free = [-1] * size, size
    while free:
        for i in turns:
            at, step = walks[i]
            while table[at] >= 0:
                at = (at + step) % size
            table[at] = i
            walks[i][0] = (at + step) % size
            free -= 1
            if not free:
                break
    return table


def place(df: DataFrame, shards: list[str], key_col: str = "doc_id", size: int = TABLE_SIZE) -> DataFrame:
    """Adds ``slot`` (long) and ``shard`` (string) to each row; needs no shuffle.

    A null key is hashed as the empty string, so all null keys share a shard. Repeated keys
    get the same shard. An existing column named slot or shard is replaced. An empty table
    stays empty.
    """
    spark = df.sparkSession
    table = lookup_table(shards, size)
    t_slot, t_shard = fresh(df, "t_slot", "t_shard")
    rows = spark.createDataFrame([(i, shards[s]) for i, s in enumerate(table)], f"{t_slot} long, {t_shard} string")
    key = F.coalesce(F.col(key_col).cast("string"), F.lit(""))
    slot = F.pmod(F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long"), F.lit(size))
    return (
        df.withColumn("slot", slot)
        .join(F.broadcast(rows), F.col("slot") == F.col(t_slot))
        .withColumn("shard", F.col(t_shard))
        .drop(t_slot, t_shard)
    )


def write_shards(df: DataFrame, path: str, shards: list[str], key_col: str = "doc_id", files: int = 1) -> None:
    """Writes one Parquet folder per shard, each in up to ``files`` files.

    The salt, a hash of the whole row, splits a shard over several tasks, so that a hot key's
    neighbours do not wait for it. A null key is placed like any other; repeated rows go to the same
    file. An empty table writes no folder. Rows are written whole, however long.
    """
    (salt,) = fresh(df, "salt")
    (
        place(df, shards, key_col)
        .withColumn(salt, F.pmod(F.xxhash64(*df.columns), F.lit(files)))
        .repartition("shard", salt)
        .drop(salt)
        .write.partitionBy("shard")
        .parquet(path)
    )
