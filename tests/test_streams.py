"""Streams that stop, start again and run twice."""

from __future__ import annotations

import datetime
import shutil

from pyspark.sql import functions as F

from linkloom.functions import links as L
from linkloom.sources.snapshots import Table
from linkloom.streaming import jobs

T0 = datetime.datetime(2024, 1, 1)


def land(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_a_feed_goes_on_where_it_stopped_and_never_twice(spark, tmp_path):
    src, state = f"{tmp_path}/in", f"{tmp_path}/state"
    ledger = Table(spark, f"{tmp_path}/ledger")
    ledger.create(spark.createDataFrame([], "url_hash long, url string"), ["url_hash"], 4)
    rows = lambda b: jobs.feed(b).select(L.md5_long(F.col("url")).alias("url_hash"), "url")

    def run(checkpoint):
        stream = jobs.landed(spark, src, "ts timestamp, line string", "*.parquet")
        jobs.into_table(stream, ledger, "feed", rows, checkpoint, mode="insert_absent").awaitTermination()
        return sorted(r.url for r in ledger.read().collect())

    land(spark, src, [(T0, "hxxp://a.com/x"), (T0, "http://a.com/x"), (T0, "# no"), (T0, "http://b.com/")], "ts timestamp, line string")
    first = run(state)
    assert len(first) == 2 and run(state) == first
    land(spark, src, [(T0, "http://a.com/x"), (T0, "http://c.com/")], "ts timestamp, line string")
    second = run(state)
    assert len(second) == 3 and set(first) < set(second)
    # A lost checkpoint reads all files again as batch 0: its number is in the table already, so nothing changes.
    version = ledger.version().number
    shutil.rmtree(state)
    assert run(state) == second and ledger.version().number == version


def test_a_batch_that_failed_half_way_is_brought_once(spark, tmp_path):
    target = Table(spark, f"{tmp_path}/t")
    target.create(spark.createDataFrame([], "k long, v string"), ["k"], 4)
    src, state = f"{tmp_path}/in", f"{tmp_path}/state"
    land(spark, src, [(1, "a"), (2, "b")], "k long, v string")
    fail = {"now": True}

    def rows(batch):
        if fail["now"]:
            raise RuntimeError("lost")
        return batch

    def run():
        jobs.into_table(jobs.landed(spark, src, "k long, v string", "*.parquet"), target, "s", rows, state).awaitTermination()

    try:
        run()
        raise AssertionError("the batch should fail")
    except Exception as error:  # noqa: BLE001
        assert "lost" in str(error)
    assert target.read().count() == 0
    fail["now"] = False
    run()
    assert {(r.k, r.v) for r in target.read().collect()} == {(1, "a"), (2, "b")}


def test_latest_states_by_updates(spark, tmp_path):
    src, state = f"{tmp_path}/in", f"{tmp_path}/state"
    target = Table(spark, f"{tmp_path}/t")
    target.create(spark.createDataFrame([], "k long, state string"), ["k"], 2)

    def run():
        stream = jobs.latest(jobs.landed(spark, src, "k long, n long, state string", "*.parquet"), "k", "state", ["n"])
        jobs.into_table(stream, target, "s", lambda b: b, state, output="update").awaitTermination()
        return {r.k: r.state for r in target.read().collect()}

    land(spark, src, [(1, 1, "begun"), (2, 1, "begun"), (1, 3, "done")], "k long, n long, state string")
    assert run() == {1: "done", 2: "begun"}
    land(spark, src, [(1, 2, "late"), (2, 2, "failed"), (3, 1, "begun")], "k long, n long, state string")
    assert run() == {1: "done", 2: "failed", 3: "begun"}


def plain_quota(calls, limit, seconds):
    held, out = {}, {}
    for id_, caller, ts in sorted(calls, key=lambda c: (c[2], c[0])):
        mine = held.setdefault(caller, [])
        mine[:] = [x for x in mine if x > ts - datetime.timedelta(seconds=seconds)]
        out[id_] = len(mine) < limit
        if out[id_]:
            mine.append(ts)
    return out


def test_quota_of_a_loud_caller_in_batch_and_stream(spark, tmp_path):
    import random

    draw = random.Random(4)
    calls, at = [], T0
    for i in range(400):
        at += datetime.timedelta(seconds=draw.choice([1, 30, 600, 4000]))
        calls.append((i, 1 if i % 4 else draw.randrange(2, 5), at))
    want = plain_quota(calls, 3, 3600)
    schema = "id long, caller long, ts timestamp"
    batch = jobs.quota(spark.createDataFrame(calls, schema).repartition(5))
    assert {r.id: r.allowed for r in batch.collect()} == want
    spread = jobs.bursts(spark.createDataFrame(calls, schema).select("id", "caller", (F.unix_micros("ts") / 1e6).alias("at")), 3600)
    assert spread.where("caller = 1").select("burst").distinct().count() > 20
    # Two batches: the second meets the state that the first has left.
    src, state, out = f"{tmp_path}/in", f"{tmp_path}/state", f"{tmp_path}/out"
    got = {}
    for part in (calls[:200], calls[200:]):
        land(spark, src, part, schema)
        stream = jobs.quota_stream(jobs.landed(spark, src, schema, "*.parquet"))
        with jobs.rocks(spark):
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    got = {r.id: r.allowed for r in spark.read.parquet(out).collect()}
    assert got == want


def test_feedback_stream_joins_a_table(spark, tmp_path):
    src = f"{tmp_path}/in"
    land(spark, src, [(1, "bug", " mail a.b@c.de " + "x" * 600), (2, "spam", "no"), (3, "praise", None)], "scan_id long, kind string, note string")
    scans = spark.createDataFrame([(1, "safe")], "scan_id long, verdict string")
    got = {r.scan_id: r for r in jobs.run_once(jobs.feedback(jobs.landed(spark, src, "scan_id long, kind string, note string", "*.parquet"), scans, ("bug", "praise"))).collect()}
    assert set(got) == {1, 3} and got[1].note.startswith("mail [email removed] x") and len(got[1].note) == 500 and got[1].verdict == "safe" and got[3].verdict is None


def test_a_table_of_one_file_or_a_folder_of_files_lands_whole(spark, tmp_path):
    land(spark, f"{tmp_path}/in/rows.parquet", [(1,), (2,)], "k long")
    land(spark, f"{tmp_path}/in/rows.parquet", [(3,)], "k long")
    land(spark, f"{tmp_path}/in/other.parquet", [(9,)], "k long")
    part = next((tmp_path / "in" / "other.parquet").glob("part-*.parquet"))
    shutil.copy(part, tmp_path / "in" / "rows-2.parquet")
    got = jobs.run_once(jobs.landed(spark, f"{tmp_path}/in", "k long", "rows*.parquet"))
    assert sorted(r.k for r in got.collect()) == [1, 2, 3, 9]
