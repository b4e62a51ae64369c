"""Hard negatives by coordinate pruning over buckets of rows of like length.

Rows are laid out by length, longest first, and cut into buckets of bounded size. Each bucket holds its rows' directions
as one sorted list for every coordinate. An anchor comes with the least score that is still of use to it; a bucket whose
longest row can't reach that is skipped. In a bucket, the least useful angle allows each of the anchor's largest
coordinates (its focus) only a range of values; the ranges are cut out of the sorted lists and intersected, and the rows
left are scored exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.operators.ranking import ranked
from linkloom.session import cut

LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Rounding of directions and angles is far below this.
SLACK = 1e-7


def length(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


class Bucket:
    """Rows of like length: their vectors, and for each coordinate the rows sorted by its share of their length."""

    def __init__(self, parts: list[pa.RecordBatch]):
        self.id, self.row, self.label, self.norm = (np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts]) for c in ("id", "row", "label", "norm"))
        width = max(int(np.diff(p.column("vector").offsets.to_numpy()).max(initial=0)) for p in parts)
        self.vectors = np.concatenate([_matrix(p.column("vector"), width) for p in parts])
        self.most = float(np.abs(self.vectors).max(initial=0))
        self.unit = self.vectors / np.where(self.norm > 0, self.norm, 1)[:, None]
        self.order = np.argsort(self.unit, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.unit, self.order, axis=0)

    def feasible(self, q: np.ndarray, norm: float, floor: int, focus: int) -> np.ndarray:
        """Rows whose focus coordinates allow a score of at least `floor`."""
        everything = np.arange(len(self.id))
        if floor <= LEAST:
            return everything
        reach = norm * (self.norm.max() if floor > 0 else self.norm.min())
        if reach <= 0:
            return everything if floor <= 0 else everything[:0]
        cosine = floor / reach
        if cosine > 1 + SLACK:
            return everything[:0]
        if cosine <= -1 or not q.any():
            return everything
        angle = np.arccos(min(1.0, cosine))
        own = np.argsort(-np.abs(q), kind="stable")[:focus]
        mine = np.arccos(np.clip(q[own] / norm, -1, 1))
        low = np.cos(np.minimum(np.pi, mine + angle)) - SLACK
        high = np.cos(np.maximum(0, mine - angle)) + SLACK
        begin = [int(np.searchsorted(self.sorted[:, f], a, "left")) for f, a in zip(own, low)]
        end = [int(np.searchsorted(self.sorted[:, f], b, "right")) for f, b in zip(own, high)]
        few = int(np.argmin(np.subtract(end, begin)))
        found = self.order[begin[few] : end[few], own[few]]
        for k, f in enumerate(own):
            if k != few and end[k] - begin[k] < len(self.id):
                value = self.unit[found, f]
                found = found[(value >= low[k]) & (value <= high[k])]
        return found

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact inner products as longs; one beyond a long is the nearest long."""
        if self.most * float(np.abs(q).max(initial=0)) * max(1, len(q)) < 1 << 53:
            whole = 2 * len(rows) > len(self.id)
            return (self.vectors @ q)[rows].astype(np.int64) if whole else (self.vectors[rows] @ q).astype(np.int64)
        own = [int(x) for x in q]
        return np.array([min(MOST, max(LEAST, sum(int(x) * y for x, y in zip(v, own)))) for v in self.vectors[rows]], np.int64)

    def best(self, anchor: dict, q: np.ndarray, same: bool, take: int, focus: int):
        """(range, rows, scores): the first `take` rows of each of the anchor's ranges of scores."""
        q = np.pad(q, (0, max(0, self.vectors.shape[1] - len(q))))[: self.vectors.shape[1]]
        rows = self.feasible(q, anchor["norm"], min(anchor["floors"]), focus)
        rows = rows[(self.label[rows] == anchor["label"]) == same]
        rows = rows[self.row[rows] != anchor["row"]]
        score = self.scores(rows, q)
        for k, (low, high) in enumerate(zip(anchor["floors"], anchor["ceilings"])):
            inside = np.flatnonzero((score >= low) & (score <= high))
            if len(inside) > take:
                inside = inside[score[inside] >= np.partition(score[inside], -take)[-take]]
            inside = inside[np.lexsort((self.id[rows[inside]], -score[inside]))][:take]
            if len(inside):
                yield k, rows[inside], score[inside]


def search(buckets: DataFrame, anchors: DataFrame, same: bool, take: int, focus: int) -> DataFrame:
    """(anchor, range, id, score): for each anchor and range of scores, the first `take` rows of each bucket it is sent to.

    buckets: bucket, row, id, label, vector, norm. anchors: bucket, row, label, vector, norm, floors, ceilings. A task holds
    one bucket; anchors stream past it.
    """
    none = F.lit(None)
    held = buckets.select("bucket", F.lit(0).alias("kind"), "row", "id", "label", "vector", "norm", none.cast("array<bigint>").alias("floors"), none.cast("array<bigint>").alias("ceilings"))
    sent = anchors.select("bucket", F.lit(1).alias("kind"), "row", none.cast("long").alias("id"), "label", "vector", "norm", "floors", "ceilings")
    schema = pa.schema([("anchor", pa.int64()), ("range", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        now, parts, bucket = None, [], None
        for batch in batches:
            key, kind = batch.column("bucket").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero((key[1:] != key[:-1]) | (kind[1:] != kind[:-1])) + 1 if len(key) else np.zeros(0, int)
            for i, j in zip(np.r_[0, edges], np.r_[edges, len(key)]):
                some = batch.slice(int(i), int(j - i))
                if not len(some):
                    continue
                if key[i] != now:
                    now, parts, bucket = key[i], [], None
                if kind[i] == 0:
                    parts.append(some)
                    continue
                bucket = bucket or Bucket(parts)
                facts = some.select(["row", "label", "norm", "floors", "ceilings"]).to_pylist()
                out = []
                for anchor, v in zip(facts, some.column("vector")):
                    for k, rows, score in bucket.best(anchor, np.array(v.as_py(), np.float64), same, take, focus):
                        out.append((np.full(len(rows), anchor["row"]), np.full(len(rows), k, np.int32), bucket.id[rows], score))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], schema=schema)

    both = held.unionByName(sent).repartition("bucket").sortWithinPartitions("bucket", "kind")
    return both.mapInArrow(run, "anchor long, range int, id long, score long")


def _first(found: DataFrame, by: list[str], take: int) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= take)


def mine(rows: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, bucket: int = 4096, focus: int = 6) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows marked as anchors.

    rows: id, label, vector (array<double> of whole numbers), anchor (boolean); other columns are ignored. A row's score is
    its inner product with the anchor (missing coordinates count as 0; beyond a long: the nearest long); higher ones first,
    ties by smaller id. An anchor's positives are the first other rows of its label; each positive's negatives are the first
    rows of other labels whose score is `low` to `high` percent of the positive's. Exact for any vectors.
    Rows with a null id, label, vector or coordinate, or one that is not finite, take no part. Rows that repeat an id are rows of their own, and each
    anchor among them is mined. Empty table: no rows. Copies of one vector, however many, only meet in their buckets.
    """
    clean = F.col("id").isNotNull() & F.col("label").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"), F.coalesce(F.col("anchor"), F.lit(False)).alias("anchor"))
    rows = rows.where(clean).withColumn("norm", length(F.col("vector")))
    # Steps of a tenth of the length: within a step rows lie by label, so that an anchor's own label is in few buckets.
    step = F.when(F.col("norm") > 0, -F.floor(F.log("norm") / F.log(F.lit(1.1)))).otherwise(F.lit(MOST))
    laid = ranked(rows.withColumn("step", step).withColumn("row", F.monotonically_increasing_id()), [], ["step", "label", "id", "row"], "n")
    laid = cut(laid.select("row", "id", "label", "vector", "norm", "anchor", ((F.col("n") - 1) / bucket).cast("long").alias("bucket")), "buckets")
    buckets = laid.drop("anchor")
    about = laid.groupBy("bucket").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.max("norm").alias("longest"))
    count = about.agg(F.max("bucket")).first()[0] or 0
    anchors = laid.where("anchor").drop("anchor")

    def everywhere(some: DataFrame) -> DataFrame:
        """Anchors (own: their bucket) with the facts of every bucket whose longest row can reach their least floor."""
        sent = some.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count).cast("long")))).join(about, "bucket")
        return sent.where((F.array_min("floors") <= 0) | (F.col("norm") * F.col("longest") * (1 + SLACK) >= F.array_min("floors")))

    open_range = anchors.withColumn("floors", F.array(F.lit(LEAST))).withColumn("ceilings", F.array(F.lit(MOST)))
    own = cut(search(buckets, open_range, True, positives, focus), "own")
    # As many rows as wanted in an anchor's own bucket tell the score that others must reach.
    floor = own.groupBy(F.col("anchor").alias("row")).agg(F.when(F.count("*") >= positives, F.min("score")).otherwise(F.lit(LEAST)).alias("floor"))
    further = open_range.withColumnRenamed("bucket", "own").join(floor, "row", "left").withColumn("floors", F.array(F.coalesce("floor", F.lit(LEAST)))).drop("floor")
    further = everywhere(further).where("bucket <> own and label between l0 and l1")
    liked = cut(_first(own.unionByName(search(buckets, further, True, positives, focus)), ["anchor"], positives), "positives")

    # A negative share of a negative score is no range: the lower bound would be above the upper.
    score = F.col("score").cast("decimal(20,0)")
    ranges = liked.where("score >= 0").select("anchor", "place", F.floor((score * low + 99) / 100).cast("long").alias("low"), F.floor(score * high / 100).cast("long").alias("high"))
    wanted = ranges.where("low <= high").groupBy(F.col("anchor").alias("row")).agg(F.array_sort(F.collect_list(F.struct("place", "low", "high"))).alias("x"))
    asking = anchors.drop("bucket").join(wanted, "row").withColumn("floors", F.col("x.low")).withColumn("ceilings", F.col("x.high"))
    apart = everywhere(asking).where("l0 <> label or l1 <> label")
    met = search(buckets, apart, False, negatives, focus)
    places = wanted.select(F.col("row").alias("anchor"), F.posexplode("x.place").alias("range", "place"))
    chosen = _first(met, ["anchor", "range"], negatives).withColumnRenamed("place", "rank")
    named = liked.select("anchor", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = chosen.join(places, ["anchor", "range"]).join(named, ["anchor", "place"]).join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
