"""Kept tables, ranks and hold-outs on odd input."""

from __future__ import annotations

import pytest

from linkloom import session
from linkloom.operators.ranking import ranked
from linkloom.operators.tables import hold_out


def test_kept_tables_belong_to_their_input(spark, tmp_path):
    count = lambda df: session.kept(spark, "t", [df], lambda: df.select("a")).count()
    small, large = (spark.createDataFrame([(i,) for i in range(n)], "a int") for n in (3, 5))
    assert (count(small), count(large), count(small)) == (3, 5, 3)
    path = f"{tmp_path}/t"
    spark.range(20).selectExpr("id as a").coalesce(1).write.parquet(path)
    read = lambda: spark.read.parquet(path)
    assert (count(read()), count(read().limit(7)), count(read().where("a < 4"))) == (20, 7, 4)
    before = session.kept(spark, "t", [read()], lambda: read()).inputFiles()
    assert session.kept(spark, "t", [read()], lambda: pytest.fail("made again")).inputFiles() == before
    spark.range(9).selectExpr("id as a").coalesce(1).write.mode("overwrite").parquet(path)
    assert count(read()) == 9
    session.forget(spark)
    assert count(read()) == 9


def test_ranks_in_a_null_group(spark):
    rows = spark.createDataFrame([(None, 3), (None, 1), ("a", 2), ("a", 1), (None, 2)], "g string, o int")
    assert sorted(((r.g or "", r.o, r.n) for r in ranked(rows, ["g"], ["o"]).collect())) == [("", 1, 1), ("", 2, 2), ("", 3, 3), ("a", 1, 1), ("a", 2, 2)]


def test_hold_out_with_null_days_and_ties(spark):
    rows = [(i, None if i < 3 else "2024-01-0%d" % (1 + i % 3)) for i in range(40)]
    got = {r.id: r.held_back for r in hold_out(spark.createDataFrame(rows, "id int, day string"), "id", "day", 0.85).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]))
    assert got == {i: k >= int(40 * 0.85) for k, (i, _) in enumerate(order)}
    assert hold_out(spark.createDataFrame([], "id int, day string"), "id", "day", 0.85).count() == 0


def test_few_files_are_spread(spark, tmp_path):
    spark.range(50).coalesce(1).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    assert session.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and session.spread(df).count() == 50
