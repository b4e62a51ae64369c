"""Parts of a large Parquet dataset in its own order, by the row counts in the files' footers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """file, rows, before: every file that has rows, in the order of their names, with the rows before it.

    Counting reads no column, so only footers. One row a file; the sum over them is one window of that size.
    """
    whole = spark.read.option("pathGlobFilter", pattern).parquet(path)
    counts = whole.select(F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.count("*").alias("rows"))
    return counts.withColumn("before", F.coalesce(F.sum("rows").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def read_rows(spark: SparkSession, path: str, columns: list[str], skip: int = 0, limit: int | None = None, pattern: str = "*.parquet") -> DataFrame:
    """`columns` of the rows after the first `skip`, `limit` of them at most, in dataset order (files by name, rows as written).

    Files wholly before or after are not opened. The others are read as usual, with columns and filters pushed down; only in
    the first and the last of them are rows left out, by their place in the file. `place` is the row's number in the
    dataset, from 0. A missing column is an error that names it.
    """
    end = None if limit is None else skip + limit
    wanted = files(spark, path, pattern).where(F.col("before") + F.col("rows") > skip)
    chosen = (wanted if end is None else wanted.where(F.col("before") < end)).orderBy("before").collect()
    schema = spark.read.option("pathGlobFilter", pattern).parquet(path).schema
    for name in columns:
        if name not in schema.names:
            raise ValueError(f"the dataset has no column {name}")
    if not chosen:
        return spark.createDataFrame([], schema).select(*columns, F.lit(0).cast("long").alias("place"))
    rows = spark.read.schema(schema).parquet(*[r.file for r in chosen])
    # As many rows as files are read: a broadcast of file names, checked by their number.
    starts = spark.createDataFrame([(r.file, r.before) for r in chosen], "__file string, __before long")
    starts = F.broadcast(starts) if len(chosen) <= 10_000 else starts
    placed = rows.select(*columns, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at")).join(starts, "__file").withColumn("place", F.col("__before") + F.col("__at"))
    placed = placed.where(F.col("place") >= skip) if chosen[0].before < skip else placed
    placed = placed.where(F.col("place") < end) if end is not None and chosen[-1].before + chosen[-1].rows > end else placed
    return placed.select(*columns, "place")
