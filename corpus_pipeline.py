"""A training corpus from `documents`: language, near copies, repeated passages, mixing, packing.

Each stage works on all that the one before kept, as Parquet. All but the last return the columns of documents. Every
stage gives no rows for an empty table, takes nulls in any column, and carries columns that it does not know along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import langid, mixing, packing, simhash, suffixes
from linkloom.session import cut, folder, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without a letter (null and empty texts among them) or below the bound go.

    Repeated rows stay or go together. Without labels nothing can be learnt and every text is rejected.
    """
    marked = langid.identify(docs, langid.fit(docs), into="__language")
    return marked.where(~F.col("__language.rejected")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest id, null last, and of equal ids the first as written."""
    # Rows are numbered and written before they are fingerprinted, so that every later read sees the same numbers.
    rows = cut(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    groups = simhash.near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text"))
    named = groups.select(F.col("doc_id").alias("__row"), F.col("component_id").alias("__group")).join(rows.select("__row", "doc_id"), "__row")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__row").alias("row"))
    first = named.groupBy("__group").agg(F.min(order).alias("first")).select(F.col("first.row").alias("__row"))
    return rows.join(first, "__row", "left_semi").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the bytes of passages that occur more than once in what is left; a null text stays null."""
    left = suffixes.stripped(docs)
    changed = {"n_chars": F.length("text").cast("long").alias("n_chars")}
    return left.select(*[changed.get(c, F.col(c)) for c in docs.columns])


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; null and empty texts have no size and are repeated at the rate of size 0.

    A null source is a source of its own. Repeated rows count each. Ties are settled by hash.
    """
    return mixing.repeat(mixing.mix(docs), docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids, each a sequence of power-of-two length from one document; null and empty texts: one piece of one id.

    Repeated rows (copies that the mix took) are packed each.
    """
    return packing.pack(docs)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", target_weights),
    ("packing", sequences),
]

#: SQL cannot express learnt languages or 64-bit XXH64 fingerprints; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between two of them the rows are written to the shared folder and read again."""
    docs, where = table(spark, sf_dir, "documents"), f"{folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{where}/{k}")
            docs = spark.read.parquet(f"{where}/{k}")
    return docs
