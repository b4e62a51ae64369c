"""Session settings, table access and the shared folder in which lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build(cpus: int = 8, partitions: int = 8, app: str = "linkloom") -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", os.environ.get("LINKLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode one of our own where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = getattr(spark, "_linkloom_dir", None) or tempfile.mkdtemp(prefix="spark-linkloom-", dir="/tmp")
        spark._linkloom_dir = where
    return where.rstrip("/")


def folder(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables, see clean."""
    return f"{shared_dir(spark)}/linkloom-{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application; DataFrames that read them can't be used any more."""
    jvm, where = spark.sparkContext._jvm, folder(spark)
    path = jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _kept.pop(where, None)


#: By folder: tables written once in this application, with what they were made from.
_kept: dict[str, list[tuple]] = {}


def file_state(df: DataFrame) -> tuple:
    """Number, bytes, latest change and a digest of the files under the folders that df reads; all zero where it reads none.

    The files are listed by Spark and added up there: no path but those of the folders reaches the driver's Python.
    """
    leaves, roots = df._jdf.queryExecution().analyzed().collectLeaves().iterator(), []
    while leaves.hasNext():
        leaf = leaves.next()
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            paths = leaf.relation().location().rootPaths().iterator()
            while paths.hasNext():
                roots.append(paths.next().toString())
    if not roots:
        return (0, 0, None, None)
    files = df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(sorted(set(roots))).select("path", "length", "modificationTime")
    return tuple(files.agg(F.count("*"), F.sum("length"), F.max("modificationTime"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first())


def kept(spark: SparkSession, name: str, inputs: list[DataFrame], make: Callable[[], DataFrame]) -> DataFrame:
    """The table that `make` derives from the inputs: written at its first use, then read.

    It is made anew for inputs of another plan (a filter, a limit, other rows in memory) and once a file that they read has
    changed. `name` stands for what `make` does with the inputs, parameters included.
    """
    mine, state = _kept.setdefault(folder(spark), []), [file_state(x) for x in inputs]
    for known, plans, then, found in mine:
        if known == name and then == state and len(plans) == len(inputs) and all(a.sameSemantics(b) for a, b in zip(plans, inputs)):
            return found
    mine.append((name, list(inputs), state, cut(make(), name)))
    return mine[-1][-1]


def forget(spark: SparkSession) -> None:
    """What was kept is made anew at its next use; its files stay until clean."""
    _kept.pop(folder(spark), None)


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as the cluster runs at once, where its files make fewer: for costly work on rows of a few large files."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back: later steps then survive lost executors without recomputing it."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
