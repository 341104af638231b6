"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a table of prime size, by an offset and a skip hashed
from its name. Shards take turns (as many as their weights) and claim the next free slot of their
permutation until all slots are taken. A row goes to the shard of the slot that its key's hash names: one
lookup, in a table whose size is fixed, so it is broadcast. When a shard goes or comes, few slots change hands.

Keys may be several columns; a hot key can be spread over `copies` slots by a second hash of the columns `spread`.
Defined results: null keys hash like any value (all null keys go to one shard); repeated rows go to one shard; texts
of any length are never looked at unless they are keys; an empty table gives no rows. Extra columns may have any name:
the ones that are kept must not have a name that the result gives to slot or shard (names can be chosen), which raises.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prime, and at least a hundred times the number of shards.
SLOTS = 65_537


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{salt}:{name}".encode(), digest_size=8).digest(), "little")


def filled(shards: dict[str, int], slots: int = SLOTS) -> np.ndarray:
    """The shard (its place in name order) of each slot; shards maps names to weights of 1 or more."""
    names = sorted(shards)
    if not names or len(names) * 100 > slots or min(shards.values()) < 1:
        raise ValueError("there have to be shards, weights of 1 or more, and a hundred slots a shard")
    offset = [_hash(n, "offset") % slots for n in names]
    skip = [_hash(n, "skip") % (slots - 1) + 1 for n in names]
    taken = np.full(slots, -1, np.int32)
    left = slots
    while True:
        for k, name in enumerate(names):
            for _ in range(shards[name]):
                while taken[offset[k]] >= 0:
                    offset[k] = (offset[k] + skip[k]) % slots
                taken[offset[k]] = k
                left -= 1
                if not left:
                    return taken


def lookup(spark: SparkSession, shards: dict[str, int], slots: int = SLOTS) -> DataFrame:
    """slot, shard: the filled table, of a fixed number of rows."""
    names = sorted(shards)
    taken = filled(shards, slots)
    return spark.createDataFrame([(k, names[s]) for k, s in enumerate(taken.tolist())], "slot int, shard string")


def slot_of(keys: list[str], spread: list[str] | None = None, copies: int = 1, slots: int = SLOTS) -> Column:
    """The slot of a row: of its keys, and of which of `copies` the other columns pick."""
    if spread and copies > 1:
        return F.pmod(F.xxhash64(*keys, F.pmod(F.xxhash64(*spread), F.lit(copies))), F.lit(slots)).cast("int")
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def assign(df: DataFrame, shards: dict[str, int], keys: list[str], keep: list[str], spread: list[str] | None = None, copies: int = 1, names: tuple[str, str] = ("slot", "shard")) -> DataFrame:
    """The columns `keep` of every row, its slot and its shard, which `names` names."""
    clash = {n.lower() for n in names} & {c.lower() for c in keep}
    if clash:
        raise ValueError(f"kept columns have names of the result: {', '.join(sorted(clash))}")
    # What is kept goes along in one struct, so that no name of df can meet a name of the table.
    placed = df.select(F.struct(*(F.col(c).alias(f"c{k}") for k, c in enumerate(keep))).alias("row"), slot_of(keys, spread, copies).alias("slot"))
    found = placed.join(F.broadcast(lookup(df.sparkSession, shards)), "slot")
    return found.select(*(F.col(f"row.c{k}").alias(c) for k, c in enumerate(keep)), F.col("slot").alias(names[0]), F.col("shard").alias(names[1]))


def write(df: DataFrame, shards: dict[str, int], keys: list[str], path: str, folder: str = "shard") -> None:
    """All columns of df in a folder for each shard, named `folder`=...; no column of df may have that name."""
    slot = next(n for n in (f"slot{k}" for k in range(len(df.columns) + 1)) if n not in (c.lower() for c in df.columns) and n != folder)
    assign(df, shards, keys, df.columns, names=(slot, folder)).drop(slot).write.partitionBy(folder).parquet(path)
