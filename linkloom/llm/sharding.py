"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered by content, not by where they lie, and a keyed permutation of 0..n-1 deals them out: what it makes of
a row's number is shard + slot * shards. So shard and slot of any row, and the row in any slot, are computed from
(n, shards, seed) alone, the shuffle is the same on any cluster, and no two shards differ by more than one row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.textops import mix
from linkloom.operators.ranking import ranked

ROUNDS = 8
#: Odd multipliers of the round function, below 2**31; halves of up to 27 bits never leave 63 bits.
M1, M2 = 0x45D9F3B5, 0x2C1B3C6D


def keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    """One 31-bit key for each round."""
    return [int(k) for k in mix(np.arange(1, rounds + 1, dtype=np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(33)]


def half_bits(n: int) -> int:
    """Bits of a half: the smallest even domain that holds 0..n-1."""
    bits = max(1, (max(n, 2) - 1).bit_length())
    if bits > 54:
        raise ValueError("at most 2**54 rows")
    return -(-bits // 2)


def _round(r: np.ndarray, key: int, h: int) -> np.ndarray:
    first = ((r ^ np.int64(key)) * np.int64(M1) & np.int64((1 << 40) - 1)) >> np.int64(11)
    return (first * np.int64(M2) >> np.int64(17)) & np.int64((1 << h) - 1)


def _once(x: np.ndarray, ks: list[int], h: int, back: bool) -> np.ndarray:
    left, right = x >> np.int64(h), x & np.int64((1 << h) - 1)
    for k in reversed(ks) if back else ks:
        left, right = (right ^ _round(left, k, h), left) if back else (right, left ^ _round(right, k, h))
    return left << np.int64(h) | right


def permute(x: np.ndarray, n: int, seed: int = 0, back: bool = False) -> np.ndarray:
    """The permutation of 0..n-1 (back: its inverse). What falls outside is sent on until it is inside (cycle walking)."""
    h, ks = half_bits(n), keys(seed)
    y = _once(np.asarray(x, np.int64), ks, h, back)
    out = np.flatnonzero(y >= n)
    while len(out):
        y[out] = _once(y[out], ks, h, back)
        out = out[y[out] >= n]
    return y


def row_of(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int = 0) -> np.ndarray:
    """The row number that lies in a slot of a shard."""
    return permute(np.asarray(slot, np.int64) * shards + shard, n, seed, back=True)


def place(row: Column, n: int, seed: int = 0) -> Column:
    """What the permutation makes of a row number from 0."""
    return F.pandas_udf(lambda x: pd.Series(permute(x.to_numpy(), n, seed)), "long")(row)


def assign(docs: DataFrame, shards: int = 16, seed: int = 0, order: list[str] | None = None) -> DataFrame:
    """Adds shard (int, from 0) and slot (long, gapless from 0 in each shard); columns of these names are replaced.

    Rows are numbered in the order of the columns `order` (all but binary ones and maps, if not given), nulls first; rows
    equal in all of them are interchangeable, so give columns that tell rows apart. The order is found over range
    partitions, so no key is too frequent. Every row, repeated ones included, has a slot of its own; an empty table gives
    no rows. Give narrow rows (ids) and join the texts where they are needed: every row moves once.
    """
    docs = docs.drop("shard", "slot")
    order = order or [f.name for f in docs.schema.fields if f.dataType.typeName() not in ("binary", "map", "variant")]
    numbered = ranked(docs, [], order, "__row")
    n = docs.count()
    at = numbered.withColumn("__at", place(F.col("__row") - 1, n, seed))
    return at.withColumn("shard", (F.col("__at") % shards).cast("int")).withColumn("slot", F.floor(F.col("__at") / shards).cast("long")).drop("__row", "__at")


def write(docs: DataFrame, path: str, shards: int = 16, seed: int = 0, order: list[str] | None = None, rows: int = 100_000) -> None:
    """Writes the shards as Parquet folders `shard=k`, files of `rows` consecutive slots, in slot order.

    A shard of any size is written by as many tasks as it has files.
    """
    laid = assign(docs, shards, seed, order).withColumn("__file", F.floor(F.col("slot") / rows))
    laid.repartition("shard", "__file").sortWithinPartitions("shard", "slot").drop("__file").write.partitionBy("shard").parquet(path)
