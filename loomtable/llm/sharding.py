"""Placement of rows on shards by a permutation-filled lookup table.

Every shard orders the slots of a table of prime size by a permutation of its own (an offset and a skip from its
name). The shards take turns: each claims the first free slot in its order, until none is free. A key's hash, modulo
the size, is a slot, and the slot's owner is the shard. Shares differ by one slot at most, and after a shard joins or
leaves, few keys move among the others.

The table depends on the shards alone (its size is the bound of what is broadcast). Placement is one hash and one
broadcast look-up in the row's own task: no shuffle, so a hot key or source costs nothing here.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime over a hundred times the usual number of shards: shares differ by under a hundredth.
TABLE_SIZE = 65_537


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The owner (index into ``shards``) of each slot. ``size`` is a prime and no less than the number of shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need names, each used once")
    if size < max(3, len(shards)) or any(size % d == 0 for d in range(2, int(size ** 0.5) + 1)):
        raise ValueError("the size of the table must be a prime, at least 3 and the number of shards")
    walks = []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        at = int.from_bytes(digest[:8], "big") % size
        walks.append([at, int.from_bytes(digest[8:16], "big") % (size - 1) + 1])
    owner = [-1] * size
    free = size
    while free:
        for shard, walk in enumerate(walks):
            while owner[walk[0]] >= 0:
                walk[0] = (walk[0] + walk[1]) % size
            owner[walk[0]] = shard
            free -= 1
            if not free:
                break
    return owner


def table_frame(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """The lookup table as rows (slot, shard index), from one literal."""
    owners = F.split(F.lit(",".join(map(str, lookup_table(shards, size)))), ",")
    return spark.range(0, 1, 1, 1).select(F.posexplode(owners).alias("slot", "owner")).select(
        "slot", F.col("owner").cast("int").alias("shard"))


def place(df: DataFrame, keys: list[str], shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """Columns ``row`` (the whole row as a struct), ``slot`` and ``shard``.

    Rows with equal keys meet in one shard; to spread a hot key, add a column that differs within it. Null keys are
    values like any other and all land together; an empty table stays empty; extra columns stay inside ``row``, so
    none can clash; repeated rows are placed alike.
    """
    slot = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(size)).cast("int")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), slot.alias("slot"))
    return rows.join(F.broadcast(table_frame(df.sparkSession, shards, size)), "slot").select("row", "slot", "shard")


def write_shards(df: DataFrame, keys: list[str], shards: list[str], path: str, files: int = 8) -> None:
    """The rows as Parquet, one folder per shard. Each shard's rows are dealt over ``files`` tasks by a hash of the
    whole row, so no task gets a whole shard."""
    placed = place(df, keys, shards)
    part = F.pmod(F.xxhash64("row"), F.lit(files))
    placed.repartition(F.col("shard"), part).select("row.*", F.col("shard").alias("_shard")).write.partitionBy(
        "_shard").parquet(path)
