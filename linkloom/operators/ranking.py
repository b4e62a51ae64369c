"""Ranks inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.session import cut


def ranked(df: DataFrame, group: list[str], order: list[str], into: str = "n") -> DataFrame:
    """Adds the place of each row in its group, from 1; null is a group like any other.

    Rows are range-partitioned by (group, order), ranked inside each partition, and shifted by the counts of the
    partitions before: a group that holds a third of all rows spreads over a third of the partitions.
    """
    laid = cut(df.repartitionByRange(*group, *order).withColumn("__p", F.spark_partition_id()), "laid")
    counts = laid.groupBy(*group, "__p").agg(F.count("*").alias("__c"))
    before = counts.select(*group, "__p", F.coalesce(F.sum("__c").over(W.partitionBy(*group).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = laid.withColumn("__r", F.row_number().over(W.partitionBy(*group, "__p").orderBy(*order)))
    shift = before.select(F.col("__p").alias("__q"), "__before", *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)])
    same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)]
    return own.join(shift, [F.col("__p") == F.col("__q"), *same]).withColumn(into, F.col("__before") + F.col("__r")).select(*df.columns, into)


def running(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Adds, for each (into: column), the column's sum over all rows before this one in the given order; 0 for the first.

    As with ranks, rows are range-partitioned and partitions are shifted by the totals of those before. Nulls add nothing.
    """
    laid = cut(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "laid")
    zero = F.lit(0)
    totals = laid.groupBy("__p").agg(*[F.coalesce(F.sum(c), zero).alias(f"__t_{k}") for k, c in sums.items()])
    # One row a partition.
    back = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select("__p", *[F.coalesce(F.sum(f"__t_{k}").over(back), zero).alias(f"__b_{k}") for k in sums])
    inside = W.partitionBy("__p").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = laid.select("*", *[F.coalesce(F.sum(c).over(inside), zero).alias(f"__o_{k}") for k, c in sums.items()]).join(before, "__p")
    return own.select(*df.columns, *[(F.col(f"__b_{k}") + F.col(f"__o_{k}")).alias(k) for k in sums])
