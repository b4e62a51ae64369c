"""Fingerprint columns: shingles, similarity hashes, bands and bit distances."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.links import md5_long

#: Shingles of one row that are hashed at a time.
STEP = 1 << 14


def shingles(tokens: Column, k: int) -> Column:
    """All runs of k tokens; a shorter list is one shingle, an empty one none."""
    # Single elements are read in place; a slice would copy the whole list for every run.
    many = F.transform(F.sequence(F.lit(0), F.size(tokens) - k), lambda i: F.concat_ws(" ", *[F.get(tokens, i + j) for j in range(k)]))
    return F.when(F.size(tokens) == 0, F.array().cast("array<string>")).when(F.size(tokens) < k, F.array(F.array_join(tokens, " "))).otherwise(many)


def simhash(df: DataFrame, key: str, items: str, into: str) -> DataFrame:
    """(key, into): strict majority of each bit over the items' 64-bit digests; null under four items, no row without items.

    Keys are unique. Votes are added up two bits to a number, 32 sums in generated code, and first inside each task: what
    is moved is one row of sums for each key, however many items it has.
    """
    votes = df.select(key, F.explode(items).alias("i")).select(key, md5_long(F.col("i")).alias("h"))
    both = F.lit(0x100000001).cast("long")
    summed = votes.groupBy(key).agg(F.count("*").alias("n"), *[F.sum(F.shiftrightunsigned("h", b).bitwiseAND(both)).alias(f"b{b}") for b in range(32)])
    value = F.lit(0).cast("long")
    for b in range(64):
        ones = F.shiftrightunsigned(f"b{b - 32}", 32) if b > 31 else F.col(f"b{b}").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
        value = value.bitwiseOR(F.when(ones * 2 > F.col("n"), F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return summed.select(key, F.when(F.col("n") >= 4, value).alias(into))


def _similarity(text: bytes | None, k: int) -> int | None:
    tokens = text.split(b" ") if text else []
    n = len(tokens) - k + 1
    if n < 4:
        return None
    ones = np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        part = tokens[at : at + STEP + k - 1]
        digests = b"".join([md5(b" ".join(x)).digest() for x in zip(*[part[i:] for i in range(k)])])
        ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 16)[:, :8], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def _similarities(texts: pa.Array, k: int) -> pa.Array:
    return pa.array([_similarity(t.as_py(), k) for t in texts.cast(pa.binary())], pa.int64())


def similarity(tokens: Column, k: int) -> Column:
    """The simhash of the runs of k tokens, given as one text with a blank between two: what simhash makes of shingles.

    A row is hashed where it is, so nothing moves and no row of sums is kept for a key. Null for null and under four runs.
    """

    def hashed(texts: pa.Array) -> pa.Array:
        return _similarities(texts, k)

    return F.arrow_udf(hashed, "bigint")(tokens)


def printed(rows: DataFrame, *others: str) -> DataFrame:
    """`others` and tags, words (counts), dom_hash, dom, txt of rows with the arrays tags and words: one pass, nothing moved."""
    text = lambda c, least: F.when(F.size(c) >= least, F.array_join(c, " ")).alias(f"{c}_text")
    flat = rows.select(*others, F.size("tags").alias("tags"), F.size("words").alias("words"), exact(F.col("tags")).alias("dom_hash"), text("tags", 8), text("words", 12))
    return flat.select(*others, "tags", "words", "dom_hash", similarity(F.col("tags_text"), 4).alias("dom"), similarity(F.col("words_text"), 3).alias("txt"))


def bands(h: Column, kind: int) -> Column:
    """Four coded 16-bit pieces of a hash; none for null."""
    pieces = F.array(*[F.lit((kind * 4 + i) * 65536) + F.shiftrightunsigned(h, 16 * i).bitwiseAND(F.lit(65535).cast("long")).cast("int") for i in range(4)])
    return F.when(h.isNull(), F.array().cast("array<int>")).otherwise(pieces)


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def exact(tokens: Column, least: int = 8) -> Column:
    """16 hex digits that equal lists of `least` or more tokens share."""
    return F.when(F.size(tokens) >= least, F.substring(F.md5(F.array_join(tokens, " ").cast("binary")), 1, 16))
