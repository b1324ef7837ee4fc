"""Placement by a permutation-filled lookup table.

Each shard prefers the slots of a prime-sized table in an order of its own, and the
shards take turns claiming the first free slot they prefer.  So slots are shared out
evenly, and when shards come or go few slots change hands.  Placing a row is one hash
and one look into the table, whose size is fixed, and which is therefore broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import index_of, without

#: Slots, a prime far above the number of shards.
SLOTS = 65537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
#: A key with more than this share of the rows is dealt out over SPREAD slots.
HOT_SHARE, SPREAD = 1 / 64, 64


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8, key=salt.encode()).digest(), "little")


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> np.ndarray:
    """Of each slot the index of its shard.  Shards' names must differ; their order in ``shards`` doesn't matter but for the indices."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need names of their own")
    if not _is_prime(slots) or slots <= len(shards):
        raise ValueError("the number of slots must be a prime above the number of shards")
    turns = sorted(range(len(shards)), key=lambda i: shards[i])
    at = {i: _number(shards[i], "offset") % slots for i in turns}
    skip = {i: _number(shards[i], "skip") % (slots - 1) + 1 for i in turns}
    table = np.full(slots, -1, dtype=np.int32)
    free = slots
    while free:
        for i in turns:
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                break
    return table


def place(docs: DataFrame, key_column: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS, spread_by: str | None = None) -> DataFrame:
    """``docs`` with ``slot`` (int) and ``shard`` (the shard's name).

    Rows of one key go to one shard.  With ``spread_by`` a key that holds more than
    HOT_SHARE of the rows goes to as many as SPREAD slots, by that column's hash.
    Null keys are a key of their own.  All rows and columns stay, but ones named
    like the new ones, in capitals or not, are replaced.
    """
    spark = docs.sparkSession
    docs = without(docs, "slot", "shard")
    # whatever the columns are called: by position
    names, plain = docs.columns, docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    key = F.col(f"_{index_of(docs, key_column)}")
    hashed = F.xxhash64(key.isNull(), key)
    if spread_by:
        by = F.col(f"_{index_of(docs, spread_by)}")
        counts = plain.select(key.alias("hot"), F.lit(1).alias("found")).groupBy("hot", "found").agg(F.count("*").alias("n"))
        # fewer than 1 / HOT_SHARE keys
        hot = counts.where(F.col("n") > HOT_SHARE * docs.count()).select("hot", "found")
        plain = plain.join(F.broadcast(hot), key.eqNullSafe(F.col("hot")), "left")
        salt = F.when(F.col("found").isNotNull(), F.pmod(F.xxhash64(by), F.lit(SPREAD))).otherwise(F.lit(0).cast("long"))
        hashed = F.when(salt == 0, hashed).otherwise(F.xxhash64(hashed, salt))
    plain = plain.withColumn("slot", F.pmod(hashed, F.lit(slots)).cast("int"))
    table = lookup_table(shards, slots)
    rows = spark.createDataFrame([(k, shards[i]) for k, i in enumerate(table.tolist())], "slot int, shard string")
    return plain.join(F.broadcast(rows), "slot").select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names)], "slot", "shard")


def write_shards(placed: DataFrame, path: str) -> None:
    """Writes placed rows as Parquet, a folder for each shard; each task writes its own files, so no shard has to fit into one."""
    placed.write.partitionBy("shard").parquet(path)
