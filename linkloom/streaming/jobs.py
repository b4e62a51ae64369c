"""Streams: each job maps a streaming DataFrame to another; batch frames go through the same code where that is allowed."""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.functions import links as L
from linkloom.operators.ranking import ranked, running
from linkloom.session import folder
from linkloom.sources.snapshots import Table


def landed(spark: SparkSession, folder: str, schema, pattern: str) -> DataFrame:
    """New Parquet files of a folder, as they land; a folder whose name is of the pattern is a table, and its files are read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{folder.rstrip('/')}/{pattern}")


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that has landed, through the stream to Parquet, read back. Offsets and state are kept in the shared folder."""
    spark, at = stream.sparkSession, f"{folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession):
    """While a query with several states (see quota_stream) starts and runs, its state is kept in RocksDB, whatever the session's setting is."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def feed(lines: DataFrame, at: str = "ts", late: str = "1 day") -> DataFrame:
    """Cleaned links of a feed stream (ts, line), each once within the watermark; refused ones and later rows drop out."""
    ok = lines.select(at, L.clean(F.col("line")).alias("url")).where(L.reject_reason(F.col("url")).isNull())
    keyed = ok.withColumn("url_hash", L.md5_long(F.col("url")))
    return keyed.withWatermark(at, late).dropDuplicatesWithinWatermark(["url_hash"]) if lines.isStreaming else keyed.groupBy("url_hash", "url").agg(F.min(at).alias(at))


def trends(scans: DataFrame, late: str = "1 day") -> DataFrame:
    """day, verdict, n: counts in tumbling days of a stream of (ts, verdict); a day is final once the watermark has passed."""
    w = scans.withWatermark("ts", late) if scans.isStreaming else scans
    return w.groupBy(F.window("ts", "1 day"), "verdict").agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "verdict", "n")


def bursts(calls: DataFrame, seconds: int) -> DataFrame:
    """Adds burst to rows (id, caller, at): a number that changes where a caller makes no call for `seconds` or longer.

    Calls are ranked and counted over range partitions, so a caller of any number of calls spreads.
    """
    placed = ranked(calls, ["caller"], ["at", "id"], "__n")
    earlier = placed.select(F.col("caller").alias("__caller"), (F.col("__n") + 1).alias("__m"), F.col("at").alias("__at"))
    met = placed.join(earlier, F.col("caller").eqNullSafe(F.col("__caller")) & (F.col("__n") == F.col("__m")), "left")
    # The first call of a caller begins a burst too.
    begun = met.withColumn("__new", F.when(F.col("__at").isNull() | (F.col("at") - F.col("__at") >= seconds), 1).otherwise(0)).select(*calls.columns, "__new")
    return running(begun, ["caller", "at", "id"], {"__before": "__new"}).withColumn("burst", (F.col("__before") + F.col("__new")).cast("long")).drop("__before", "__new")


QUOTA = "id long, caller long, allowed boolean, wait_s double"


def _allowed(ts: float, held: deque, limit: int, seconds: int) -> tuple[bool, float]:
    """Whether a call is allowed, and else how long to wait; held: the allowed times of the last `seconds`."""
    while held and held[0] <= ts - seconds:
        held.popleft()
    if len(held) >= limit:
        return False, float(held[0] + seconds - ts)
    held.append(float(ts))
    return True, 0.0


def quota(calls: DataFrame, limit: int = 3, seconds: int = 3600) -> DataFrame:
    """Adds allowed and wait_s to calls (caller, ts, id): at most `limit` allowed calls of a caller in any hour.

    Denied calls don't count, so the rule runs in order of time; ties by id. What came before a pause of an hour no longer
    counts, so calls are dealt by caller and burst, and a task holds the last `limit` times of one of them.
    """
    def run(batches):
        who, held = None, deque()
        for pdf in batches:
            told = []
            for burst, ts in zip(pdf["burst"], pdf["at"]):
                if burst != who:
                    who, held = burst, deque()
                told.append(_allowed(ts, held, limit, seconds))
            yield pd.DataFrame({"id": pdf["id"], "caller": pdf["caller"], "allowed": [a for a, _ in told], "wait_s": [w for _, w in told]})

    rows = bursts(calls.select("id", "caller", (F.unix_micros("ts") / 1e6).alias("at")), seconds)
    return rows.repartition("burst").sortWithinPartitions("burst", "at", "id").mapInPandas(run, QUOTA)


def quota_stream(calls: DataFrame, limit: int = 3, seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """The same rule on a stream (caller, ts, id): allowed times are a list state of each caller, and event-time timers empty it.

    Calls of one batch are taken in order of time, batches as they come; rows later than the watermark drop out. Needs the
    RocksDB state store (see rocks).
    """
    from pyspark.sql.streaming import StatefulProcessor

    class Quota(StatefulProcessor):
        def init(self, handle):
            self.handle, self.times = handle, handle.getListState("times", "at double")

        def handleInputRows(self, key, rows, timerValues):
            held = deque(r[0] for r in self.times.get()) if self.times.exists() else deque()
            pdf = pd.concat(list(rows)).sort_values(["at", "id"])
            told = [_allowed(ts, held, limit, seconds) for ts in pdf["at"]]
            if held:
                self.times.put([(x,) for x in held])
                self.handle.registerTimer(int((held[-1] + seconds) * 1000))
            yield pd.DataFrame({"id": pdf["id"], "caller": pdf["caller"], "allowed": [a for a, _ in told], "wait_s": [w for _, w in told]})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            now = expiredTimerInfo.getExpiryTimeInMs() / 1000
            held = [r[0] for r in self.times.get() if r[0] > now - seconds] if self.times.exists() else []
            if held:
                self.times.put([(x,) for x in held])
            else:
                self.times.clear()
            return iter(())

        def close(self):
            pass

    timed = calls.withWatermark("ts", late).select("id", "caller", "ts", (F.unix_micros("ts") / 1e6).alias("at"))
    return timed.groupBy("caller").transformWithStateInPandas(Quota(), QUOTA, "Append", "EventTime")


def into_table(stream: DataFrame, target: Table, name: str, rows: Callable[[DataFrame], DataFrame], checkpoint: str, mode: str = "upsert", output: str = "append", order: list[str] | None = None):
    """Starts a query that brings each batch of a stream into a table, in one step and once.

    rows: what is made of a batch; mode: upsert (by `order` among equal keys) or insert_absent. The batch's number is part of the
    version that holds its rows: a batch that runs again after a failure, or after its checkpoint was lost, changes nothing.
    """
    def bring(batch: DataFrame, number: int) -> None:
        if mode == "upsert":
            target.upsert(rows(batch), order=order, batch=(name, number))
        else:
            target.insert_absent(rows(batch), batch=(name, number))

    return stream.writeStream.foreachBatch(bring).option("checkpointLocation", checkpoint).outputMode(output).trigger(availableNow=True).start()


def latest(log: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """The last state of each key in an event log, batch or stream (update mode)."""
    return log.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias(state))


def feedback(notes: DataFrame, scans: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Notes with e-mails removed, 500 characters at most, of known kinds, with the verdict of their scan (a static table)."""
    safe = F.substring(F.regexp_replace(F.trim("note"), L.EMAIL, "[email removed]"), 1, 500)
    return notes.where(F.col("kind").isin(*kinds)).withColumn("note", safe).join(scans, "scan_id", "left")


def latest_rows(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Whole last rows of each key."""
    w = W.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
