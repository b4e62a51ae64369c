"""Tables that change in one step, parts of datasets by footers, and logs of runs."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from linkloom.sources.dataset import files, read_rows
from linkloom.sources.snapshots import Conflict, Table, run_logged


@pytest.fixture
def small(spark, tmp_path):
    t = Table(spark, f"{tmp_path}/t")
    t.create(spark.createDataFrame([(i, f"v{i}", "x") for i in range(40)] + [(None, "n", "x")], "k int, v string, name string"), ["k"], 8)
    return t


def rows(t, number=None):
    return {r.k: r.v for r in t.read(number).collect()}


def test_upsert_rewrites_touched_parts_only(spark, small):
    before = small.version()
    new = spark.createDataFrame([("x", "a", 3, 1), ("x", "b", 3, 2), ("x", "c", 99, 1), ("x", "m", None, 1)], "name string, v string, k int, n int")
    after = small.upsert(new, order=["n"])
    assert rows(small) == {i: f"v{i}" for i in range(40)} | {3: "b", 99: "c", None: "m"} and small.read().count() == 42
    same = [k for k in before.parts if before.parts[k] == after.parts.get(k)]
    assert len(same) >= 5 and rows(small, 0)[3] == "v3" and rows(small, 0)[None] == "n"


def test_insert_absent_rewrites_nothing(spark, small):
    before = small.version()
    small.insert_absent(spark.createDataFrame([(1, "no", "x"), (50, "yes", "x"), (50, "yes", "x"), (None, "no", "x")], "k int, v string, name string"))
    assert rows(small) == {i: f"v{i}" for i in range(40)} | {50: "yes", None: "n"} and small.read().count() == 42
    assert all(set(some) <= set(small.version().parts[k]) for k, some in before.parts.items())


def test_readers_see_old_or_new(spark, small):
    old = small.read()
    small.replace(old.withColumn("v", F.lit("new")))
    assert {r.v for r in old.collect()} == {f"v{i}" for i in range(40)} | {"n"}
    assert {r.v for r in small.read().collect()} == {"new"}
    # A manifest that is not complete is no version, and no one else can take its place.
    (stream := small._fs.create(small._at("versions/000000000002.json"), False)).write(bytearray(b'{"number": 2'))
    stream.close()
    assert small.version().number == 1 and {r.v for r in small.read().collect()} == {"new"}
    with pytest.raises(Conflict):
        small.replace(old)


def test_of_two_writers_one_fails(spark, small):
    base = small.version()
    small.replace(small.read().withColumn("v", F.lit("first")), base=base)
    with pytest.raises(Conflict):
        small.replace(small.read().withColumn("v", F.lit("second")), base=base)
    assert {r.v for r in small.read().collect()} == {"first"}


def test_change_and_vacuum(spark, small):
    before = small.version()
    after = small.change(F.col("k") == 7, lambda d: d.withColumn("v", F.when(F.col("k") == 7, None).otherwise(F.col("v"))))
    assert rows(small)[7] is None and small.read().count() == 41 and sum(before.parts[k] != after.parts[k] for k in before.parts) == 1
    assert small.change(F.col("k") == 1000, lambda d: d).number == after.number
    small.replace(small.read())
    assert small.vacuum(keep=1) >= 1 and small.read().count() == 41


def test_replayed_batches_change_nothing(spark, small):
    batch = spark.createDataFrame([(1, "b0", "x")], "k int, v string, name string")
    one = small.upsert(batch, batch=("feed", 0))
    assert small.upsert(batch.withColumn("v", F.lit("again")), batch=("feed", 0)).number == one.number and rows(small)[1] == "b0"
    assert small.upsert(batch.withColumn("v", F.lit("next")), batch=("feed", 1)).number == one.number + 1


def test_empty_tables(spark, tmp_path):
    t = Table(spark, f"{tmp_path}/e")
    none = spark.createDataFrame([], "k int, v string")
    t.create(none, ["k"])
    assert t.read().count() == 0
    t.upsert(none)
    t.insert_absent(spark.createDataFrame([(1, "a")], "k int, v string"))
    assert rows(t) == {1: "a"}


def test_runs_are_logged_also_when_they_fail(spark, tmp_path):
    log = Table(spark, f"{tmp_path}/runs")
    data = spark.range(30)
    assert run_logged(log, "good", data, lambda d: d.where("id < 10").count(), failed=F.col("id") % 7 == 0) == 10
    with pytest.raises(ZeroDivisionError):
        run_logged(log, "bad", data, lambda d: 1 // 0)
    got = {r.job: r for r in log.read().collect()}
    assert (got["good"].ok, got["good"].fetched, got["good"].added, got["good"].failed) == (True, 30, 10, 5)
    assert (got["bad"].ok, got["bad"].fetched) == (False, None) and got["bad"].note.startswith("ZeroDivisionError")
    assert all(isinstance(r.finished_at, datetime.datetime) and r.started_at <= r.finished_at for r in got.values())


def test_rows_in_dataset_order(spark, tmp_path):
    at = 0
    for k, n in enumerate([5, 0, 7, 4, 9]):
        spark.range(at, at + n).select("id", F.lit("x").alias("place")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/all/f{k}")
        at += n
    import glob
    import os
    import shutil

    os.makedirs(f"{tmp_path}/d")
    for k in range(5):
        (one,) = glob.glob(f"{tmp_path}/all/f{k}/part*.parquet")
        shutil.copy(one, f"{tmp_path}/d/train-{k}.parquet")
    shutil.copy(one, f"{tmp_path}/d/test-0.parquet")
    part = read_rows(spark, f"{tmp_path}/d", ["id"], skip=6, limit=7, pattern="train-*.parquet")
    assert sorted((r.id, r.place) for r in part.collect()) == [(i, i) for i in range(6, 13)]
    assert sorted(f.rsplit("/", 1)[1] for f in part.inputFiles()) == ["train-2.parquet", "train-3.parquet"]
    assert sorted(r.id for r in read_rows(spark, f"{tmp_path}/d", ["id"], skip=16, pattern="train-*.parquet").collect()) == list(range(16, 25))
    assert read_rows(spark, f"{tmp_path}/d", ["id"], skip=99).count() == 0 and files(spark, f"{tmp_path}/d", "train-*.parquet").count() == 4
    with pytest.raises(ValueError, match="no column x"):
        read_rows(spark, f"{tmp_path}/d", ["x"])
