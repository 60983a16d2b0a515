"""Sharding by a permutation-filled lookup table.

Each shard has a preference order over the slots of a table of prime size: start and stride from hashes of its name.
Shards take turns and claim the next free slot they prefer, until the table is full, so that all hold nearly as many slots and
a change of the shard list moves few of them. The table has ``table_size`` rows, whatever the data, so it is broadcast.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

TABLE_SIZE = 65537
SHARDS = 64


def _number(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def lookup_table(names: list[str], table_size: int = TABLE_SIZE) -> np.ndarray:
    """Shard number of each slot."""
    if not 0 < len(names) <= table_size or table_size < 2 or any(table_size % d == 0 for d in range(2, int(table_size**0.5) + 1)):
        raise ValueError("table_size must be a prime that is not below the number of shards")
    at = [_number(f"start:{x}") % table_size for x in names]
    stride = [_number(f"stride:{x}") % (table_size - 1) + 1 for x in names]
    table, free = np.full(table_size, -1, dtype=np.int32), table_size
    while True:
        for shard in range(len(names)):
            while table[at[shard]] >= 0:
                at[shard] = (at[shard] + stride[shard]) % table_size
            table[at[shard]] = shard
            free -= 1
            if not free:
                return table


def shard_names(n: int) -> list[str]:
    return [f"shard-{k:05d}" for k in range(n)]


def place(docs: DataFrame, key: str = "doc_id", content: str = "text", names: list[str] | None = None, table_size: int = TABLE_SIZE, spread: bool = False) -> DataFrame:
    """``docs`` with slot and shard (columns of those names are replaced).

    slot = hash of the key, modulo the table, so that a row's place depends on the row alone and stays when the table grows. Rows
    with a null key are placed by key and ``content``. With ``spread``, all rows are: for tables in which one key may hold
    more rows than a shard should. Repeated rows go to the same shard; texts of any length are hashed whole; an empty table stays empty.
    """
    names = names or shard_names(SHARDS)
    spark: SparkSession = docs.sparkSession
    docs = docs.drop("slot", "shard")
    by_both = F.xxhash64(F.col(key), F.col(content))
    number = by_both if spread else F.when(F.col(key).isNull(), by_both).otherwise(F.xxhash64(F.col(key)))
    slotted = docs.withColumn("slot", F.pmod(number, F.lit(table_size)).cast("int"))
    table = spark.createDataFrame(list(enumerate(lookup_table(names, table_size).tolist())), "slot int, shard int")
    return slotted.join(F.broadcast(table), "slot").select(*docs.columns, "slot", "shard")
