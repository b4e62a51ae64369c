"""Tables on a shared folder that change in one step.

A table is dealt into parts by a hash of its key. A version is a manifest: for each part the folders that hold it. Writers
put new folders beside the old ones, rewrite the touched parts only, and then make the next manifest; readers follow the latest
complete one, so they see all of a change or nothing of it. The manifest of a version can be made once: of two writers
that start from one version the second fails and can try again. Folders are never changed, so readers of an older version go on.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PART = "__part"


class Conflict(RuntimeError):
    """Another writer has made the next version."""


@dataclass
class Version:
    """number; parts: folders by part; streams: the last batch of each stream that is in it."""

    number: int
    schema: str
    keys: list[str]
    n_parts: int
    parts: dict[int, list[str]] = field(default_factory=dict)
    streams: dict[str, int] = field(default_factory=dict)


class Table:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._at("versions").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- versions

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._at("versions")):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in self._fs.listStatus(self._at("versions")) if s.getPath().getName().endswith(".json"))

    def _manifest(self, number: int) -> Version | None:
        """The version of that number, None while its manifest is not complete."""
        stream = self._fs.open(self._at(f"versions/{number:012d}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        if not text.endswith("\n"):
            return None
        found = json.loads(text)
        return Version(**found | {"parts": {int(k): v for k, v in found["parts"].items()}})

    def version(self, number: int | None = None) -> Version:
        """The latest complete version, or that of a number."""
        for n in [number] if number is not None else reversed(self._numbers()):
            if found := self._manifest(n):
                return found
        raise FileNotFoundError(f"no table at {self.path}")

    def exists(self) -> bool:
        return any(self._manifest(n) for n in self._numbers())

    def _commit(self, base: Version | None, new: Version) -> Version:
        """Make new the version after base, or fail if there is one already (or one that a writer has begun)."""
        new.number = base.number + 1 if base else 0
        if any(n >= new.number for n in self._numbers()):
            raise Conflict(f"{self.path} has a version {new.number}")
        try:
            out = self._fs.create(self._at(f"versions/{new.number:012d}.json"), False)
        except Exception as error:  # noqa: BLE001
            if "already exists" in str(error) or "AlreadyExists" in str(error):
                raise Conflict(f"{self.path} has a version {new.number}") from None
            raise
        try:
            out.write(bytearray((json.dumps(new.__dict__) + "\n").encode()))
        finally:
            out.close()
        return new

    # --- reading and writing

    def _read(self, v: Version, parts: list[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/{f}" for k, some in sorted(v.parts.items()) if parts is None or k in parts for f in some]
        schema = StructType.fromJson(json.loads(v.schema))
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, number: int | None = None) -> DataFrame:
        return self._read(self.version(number))

    def _write(self, rows: DataFrame, v: Version) -> dict[int, list[str]]:
        """The rows in new folders by part. A part is one folder of any number of files."""
        folder = f"data/{uuid.uuid4().hex}"
        part = F.pmod(F.xxhash64(*v.keys), F.lit(v.n_parts)).cast("int")
        rows.withColumn(PART, part).write.option("compression", "zstd").partitionBy(PART).parquet(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(folder))]
        return {int(n.split("=")[1]): [f"{folder}/{n}"] for n in names if n.startswith(f"{PART}=")}

    def _touched(self, rows: DataFrame, v: Version) -> list[int]:
        """Parts that rows fall into: as many numbers as the table has parts."""
        return [r[0] for r in rows.select(F.pmod(F.xxhash64(*v.keys), F.lit(v.n_parts)).cast("int").alias("p")).distinct().collect()]

    def create(self, rows: DataFrame, keys: list[str], parts: int = 16) -> Version:
        v = Version(0, rows.schema.json(), keys, parts)
        v.parts = self._write(rows, v)
        return self._commit(None, v)

    def _next(self, base: Version, parts: dict[int, list[str]], batch: tuple[str, int] | None) -> Version:
        streams = base.streams | ({batch[0]: batch[1]} if batch else {})
        return self._commit(base, Version(0, base.schema, base.keys, base.n_parts, parts, streams))

    def _seen(self, base: Version, batch: tuple[str, int] | None) -> bool:
        return bool(batch) and base.streams.get(batch[0], -1) >= batch[1]

    def upsert(self, rows: DataFrame, order: list[str] | None = None, batch: tuple[str, int] | None = None) -> Version:
        """Rows in, in place of those of equal keys; of equal keys among them the last by `order`. Only their parts are rewritten."""
        base = self.version()
        if self._seen(base, batch):
            return base
        new = rows
        if order:
            w = W.partitionBy(*base.keys).orderBy(*[F.desc(c) for c in order])
            new = rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
        old_names = StructType.fromJson(json.loads(base.schema)).names
        new = new.select(*old_names)
        touched = self._touched(new, base)
        same = self._null_safe(base.keys)
        kept = self._read(base, touched)
        kept = kept.alias("o").join(new.select(*base.keys).distinct().alias("n"), same, "left_anti")
        parts = base.parts | {k: [] for k in touched} | self._write(kept.unionByName(new), base)
        return self._next(base, parts, batch)

    def insert_absent(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> Version:
        """Rows whose keys are not there, one a key. No file is rewritten."""
        base = self.version()
        if self._seen(base, batch):
            return base
        new = rows.select(*StructType.fromJson(json.loads(base.schema)).names).dropDuplicates(base.keys)
        absent = new.alias("o").join(self._read(base, self._touched(new, base)).select(*base.keys).alias("n"), self._null_safe(base.keys), "left_anti")
        added = self._write(absent, base)
        return self._next(base, {k: base.parts.get(k, []) + added.get(k, []) for k in {*base.parts, *added}}, batch)

    def replace(self, rows: DataFrame, batch: tuple[str, int] | None = None, base: Version | None = None) -> Version:
        """All rows anew. base: the version that rows were made from, if it is not the latest: then it is a conflict."""
        base = base or self.version()
        if self._seen(base, batch):
            return base
        return self._next(base, self._write(rows.select(*StructType.fromJson(json.loads(base.schema)).names), base), batch)

    def change(self, where, change: Callable[[DataFrame], DataFrame], batch: tuple[str, int] | None = None) -> Version:
        """Rewrite the parts that hold a row under the condition by what `change` makes of their rows. Keys stay as they are."""
        base = self.version()
        if self._seen(base, batch):
            return base
        touched = self._touched(self._read(base).where(where), base)
        if not touched:
            return base
        changed = change(self._read(base, touched)).select(*StructType.fromJson(json.loads(base.schema)).names)
        return self._next(base, base.parts | {k: [] for k in touched} | self._write(changed, base), batch)

    def _null_safe(self, keys: list[str]):
        out = F.lit(True)
        for k in keys:
            out = out & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
        return out

    def vacuum(self, keep: int = 2) -> int:
        """Remove the folders that the last `keep` versions don't name, and older manifests; how many folders went.

        Not while a writer is at work: its folders are not yet named.
        """
        numbers = [n for n in self._numbers() if self._manifest(n)]
        named = {f.split("/")[1] for n in numbers[-keep:] for some in self._manifest(n).parts.values() for f in some}
        gone = [s.getPath() for s in self._fs.listStatus(self._at("data")) if s.getPath().getName() not in named]
        for path in gone:
            self._fs.delete(path, True)
        for n in numbers[:-keep]:
            self._fs.delete(self._at(f"versions/{n:012d}.json"), False)
        return len(gone)


#: The log of runs: one row a run, whether it ended well or not.
RUNS = "run string, job string, started_at timestamp, finished_at timestamp, ok boolean, fetched long, added long, failed long, note string"


def run_logged(log: Table, job: str, rows: DataFrame, work: Callable[[DataFrame], object], failed=None, clock: Callable[[], object] | None = None):
    """What `work` returns for rows, with a row in the log of runs.

    fetched and failed (rows under the condition `failed`) are observed while the job itself reads the rows: no second
    pass. `added` is what work returns if that is a number. A job that fails is logged with its error and the error goes on.
    """
    from datetime import datetime, timezone

    from pyspark.sql import Observation

    now = clock or (lambda: datetime.now(timezone.utc))
    seen = Observation(f"run-{uuid.uuid4().hex}")
    observed = rows.observe(seen, F.count(F.lit(1)).alias("fetched"), F.count_if(failed if failed is not None else F.lit(False)).alias("failed"))
    started, ok, note, out = now(), False, None, None
    try:
        out = work(observed)
        ok = True
        return out
    except Exception as error:
        note = f"{type(error).__name__}: {error}"[:300]
        raise
    finally:
        # An observation of a job that never ran would wait for it.
        counts = seen.get if ok else {"fetched": None, "failed": None}
        row = (uuid.uuid4().hex, job, started, now(), ok, counts["fetched"], out if isinstance(out, int) else None, counts["failed"], note)
        one = log.spark.createDataFrame([row], RUNS)
        for _ in range(20):
            try:
                log.insert_absent(one) if log.exists() else log.create(one, ["run"], 1)
                break
            except Conflict:
                continue
