"""Boosted trees grown leaf by leaf from gradient histograms that Spark adds up.

Values become bins once; a row is then one byte a feature. In each pass a task walks its rows through the tree so far and
adds up gradient, curvature and count for each (node, feature, bin); the sums of all tasks are added behind a shuffle by
(node, feature). Only sums reach the driver: leaves times features times bins, however many rows there are. There the
leaf of most gain is split next. A pass looks ahead: it splits every leaf that may come next, and only the smaller of two
children is read, its sibling being the parent less it, so a tree of 31 leaves takes about as many passes as it has levels.

Gradients are rounded to multiples of 2**-24 and added as whole numbers: the trees do not depend on how rows are dealt out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.session import cut

UNIT = float(1 << 24)
NODES = "tree int, node int, f int, t double, l int, r int, v double, gain double, n long"


@dataclass(frozen=True)
class Settings:
    """rate, leaves, trees, patience: as in any such learner. rows, features: the share of each that a tree sees."""

    rate: float = 0.06
    leaves: int = 31
    trees: int = 300
    patience: int = 30
    least: int = 40
    curvature: float = 1e-3
    ridge: float = 1.0
    rows: float = 0.8
    features: float = 0.8
    bins: int = 255
    seed: int = 7
    #: Margins are written anew after so many trees.
    written: int = 20


@dataclass
class Tree:
    """Node lists in the order of a walk from the root, left first: f (-1: a leaf), b (last bin that goes left), l, r, v; gain and n for splits."""

    f: list[int] = field(default_factory=list)
    b: list[int] = field(default_factory=list)
    l: list[int] = field(default_factory=list)  # noqa: E741
    r: list[int] = field(default_factory=list)
    v: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    n: list[int] = field(default_factory=list)


@dataclass
class Boosted:
    """trees and the upper bound of each bin of each feature; losses: of the held-back rows before each tree, and after the last."""

    trees: list[Tree]
    bounds: list[np.ndarray]
    losses: list[float]

    def nodes(self, spark: SparkSession) -> DataFrame:
        """Node rows (tree, node, f, t, l, r, v, gain, n); a value of at most t goes left."""
        rows = []
        for k, t in enumerate(self.trees):
            for i, f in enumerate(t.f):
                rows.append((k, i, f, float(self.bounds[f][t.b[i]]) if f >= 0 else 0.0, t.l[i], t.r[i], round(float(t.v[i]), 6), float(t.gain[i]), int(t.n[i])))
        return spark.createDataFrame(rows, NODES)


def gain_shares(nodes: DataFrame, names: list[str], top: int = 15) -> DataFrame:
    """feature, share: the features with most of the gain of all splits; ties by name."""
    named = F.element_at(F.array(*map(F.lit, names)), F.col("f") + 1).alias("feature")
    each = nodes.where("f >= 0").groupBy(named).agg(F.sum("gain").alias("gain"))
    # One row a feature.
    share = F.try_divide(F.col("gain"), F.sum("gain").over(W.partitionBy(F.lit(1))))
    return each.select("feature", share.alias("share")).orderBy(F.desc("share"), "feature").limit(top)


def bin_bounds(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """For each feature the values that end a bin: the least value and percentiles, without the largest value."""
    at = [k / bins for k in range(1, bins)]
    cols = [F.col("features")[i] for i in range(width)]
    one = rows.agg(*[F.struct(F.min(c).alias("low"), F.max(c).alias("high"), F.percentile_approx(c, at, 10_000).alias("p")).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    found = []
    for i in range(width):
        low, high, p = one[i]
        found.append(np.array(sorted({x for x in [low, *(p or [])] if x is not None and x < high}), float))
    return found


def binned(rows: DataFrame, bounds: list[np.ndarray], key: str) -> DataFrame:
    """row (a hash of the key), y, weight, held, bins (one byte a feature), margin (0)."""

    def run(batches):
        for b in batches:
            x = np.array(b.column("features").to_pylist(), float).reshape(b.num_rows, len(bounds))
            out = np.stack([np.searchsorted(at, x[:, i], "left") for i, at in enumerate(bounds)], axis=1).astype(np.uint8) if bounds else np.zeros((b.num_rows, 0), np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("y"), b.column("weight"), b.column("held"), pa.array([r.tobytes() for r in out], pa.binary())], ["row", "y", "weight", "held", "bins"])

    given = rows.select(F.xxhash64(key).alias("row"), F.col("y").cast("int").alias("y"), F.col("weight").cast("double").alias("weight"), F.coalesce(F.col("held_back"), F.lit(False)).alias("held"), "features")
    return given.mapInArrow(run, "row long, y int, weight double, held boolean, bins binary").withColumn("margin", F.lit(0.0))


def walk(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """The node at which each row ends."""
    f, b, left, right = (np.array(x) for x in (tree.f, tree.b, tree.l, tree.r))
    at, every = np.zeros(len(bins), int), np.arange(len(bins))
    while (open_ := every[f[at] >= 0]).size:
        now = at[open_]
        at[open_] = np.where(bins[open_, f[now]] <= b[now], left[now], right[now])
    return at


def in_bag(row: np.ndarray, tree: int, share: float, seed: int) -> np.ndarray:
    """Which rows a tree sees, by a hash of row, tree and seed."""
    x = row.view(np.uint64) ^ np.uint64((tree * 0x9E3779B97F4A7C15 + seed * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF)
    for shift, times in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return (x >> np.uint64(11)).astype(float) < share * float(1 << 53)


def _pass(state: DataFrame, done: list[Tree], part: Tree, wanted: list[int], number: int, width: int, bias: float, s: Settings) -> tuple[dict[int, np.ndarray], float]:
    """({node: sums[3, feature, bin]}, loss of the held-back rows under the trees done)."""
    size = s.bins + 1

    def add_up(batches):
        held = {}
        loss, weights = 0, 0
        for batch in batches:
            y, w, out = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "weight", "held"))
            bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, width)
            margin = batch.column("margin").to_numpy() + bias
            for tree in done:
                margin = margin + np.array(tree.v)[walk(tree, bins)]
            p = 1 / (1 + np.exp(-margin))
            sure = np.log1p(np.exp(-np.abs(margin))) + np.where((margin > 0) == (y == 1), 0, np.abs(margin))
            loss += int(np.rint(w[out] * sure[out] * UNIT).sum())
            weights += int(np.rint(w[out] * UNIT).sum())
            some = ~out & in_bag(batch.column("row").to_numpy(), number, s.rows, s.seed)
            g, h = np.rint(w * (p - y) * UNIT), np.rint(w * p * (1 - p) * UNIT)
            at = walk(part, bins)
            for node in wanted:
                mine = np.flatnonzero(some & (at == node))
                flat = (bins[mine].astype(np.int64) + np.arange(width) * size).ravel()
                sums = held.setdefault(node, np.zeros((3, width * size), np.int64))
                for k, v in enumerate((g, h, np.ones(len(y)))):
                    sums[k] += np.bincount(flat, np.repeat(v[mine], width), width * size).astype(np.int64)
        for node, sums in held.items():
            cells = np.ascontiguousarray(sums.reshape(3, width, size).transpose(1, 0, 2))
            yield pa.RecordBatch.from_arrays([pa.array([node] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array([c.tobytes() for c in cells], pa.binary())], ["node", "f", "sums"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([-1], pa.int32()), pa.array([np.array([loss, weights], np.int64).tobytes()], pa.binary())], ["node", "f", "sums"])

    def together(batches):
        now, total = None, None
        for batch in batches:
            for node, f, sums in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (node, f):
                    if now is not None:
                        yield one(now, total)
                    now, total = (node, f), np.zeros(len(sums) // 8, np.int64)
                total = total + np.frombuffer(sums, np.int64)
        if now is not None:
            yield one(now, total)

    def one(key, total):
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["node", "f", "sums"])

    schema = "node int, f int, sums binary"
    added = state.mapInArrow(add_up, schema).repartition("node", "f").sortWithinPartitions("node", "f").mapInArrow(together, schema).collect()
    sums = {node: np.zeros((3, width, size), np.int64) for node in wanted}
    loss = math.nan
    for r in added:
        cells = np.frombuffer(r.sums, np.int64)
        if r.node < 0:
            loss = cells[0] / cells[1] if cells[1] else math.nan
        else:
            sums[r.node][:, r.f] = cells.reshape(3, size)
    return sums, loss


def best_split(sums: np.ndarray, open_: np.ndarray, s: Settings) -> tuple[float, int, int] | None:
    """(gain, feature, last bin that goes left) of most gain; of equal ones the first feature, then the lowest bin."""
    g, h, n = sums.astype(float)
    g, h = g / UNIT, h / UNIT
    total, curve, count = g[0].sum(), h[0].sum(), n[0].sum()
    left = [np.cumsum(x, axis=1)[:, :-1] for x in (g, h, n)]
    right = [total - left[0], curve - left[1], count - left[2]]
    gain = left[0] ** 2 / (left[1] + s.ridge) + right[0] ** 2 / (right[1] + s.ridge) - total**2 / (curve + s.ridge)
    allowed = (left[2] >= s.least) & (right[2] >= s.least) & (left[1] >= s.curvature) & (right[1] >= s.curvature) & open_[:, None]
    gain = np.where(allowed, gain, -np.inf)
    at = int(np.argmax(gain)) if gain.size else 0
    if not gain.size or not gain.flat[at] > 1e-9:
        return None
    f, b = divmod(at, gain.shape[1])
    return float(gain[f, b]), f, b


class _Leaf:
    def __init__(self, sums: np.ndarray, open_: np.ndarray, s: Settings):
        self.sums, self.split = sums, best_split(sums, open_, s)
        self.total, self.curve, self.count = sums[0, 0].sum() / UNIT, sums[1, 0].sum() / UNIT, int(sums[2, 0].sum())
        self.children: tuple[_Leaf, _Leaf] | None = None
        self.chosen = False


def _laid(root: _Leaf, s: Settings, only_chosen: bool) -> tuple[Tree, list[_Leaf]]:
    """The tree below root (chosen splits only, or those looked ahead at too) and the leaf objects by node."""
    tree, leaves = Tree(), []

    def put(leaf: _Leaf) -> int:
        at = len(leaves)
        leaves.append(leaf)
        for column, value in ((tree.f, -1), (tree.b, 0), (tree.l, -1), (tree.r, -1), (tree.v, float(-s.rate * leaf.total / (leaf.curve + s.ridge))), (tree.gain, 0.0), (tree.n, leaf.count)):
            column.append(value)
        if leaf.children and (leaf.chosen or not only_chosen):
            tree.gain[at], tree.f[at], tree.b[at] = leaf.split
            tree.l[at] = put(leaf.children[0])
            tree.r[at] = put(leaf.children[1])
        return at

    put(root)
    return tree, leaves


def grow(state: DataFrame, done: list[Tree], number: int, width: int, bias: float, s: Settings) -> tuple[Tree | None, float]:
    """The next tree (None if no split gains), and the held-back rows' loss before it."""
    rng = np.random.default_rng([s.seed, number])
    open_ = np.zeros(width, bool)
    open_[rng.permutation(width)[: max(1, round(s.features * width))]] = True
    sums, loss = _pass(state, done, Tree([-1], [0], [-1], [-1], [0.0], [0.0], [0]), [0], number, width, bias, s)
    root = _Leaf(sums[0], open_, s)
    if not root.split:
        return None, loss
    frontier = [root]
    while True:
        # Splits already looked at are taken in order of gain; ties go to the leaf found first.
        while sum(x.chosen for x in _laid(root, s, True)[1]) < s.leaves - 1:
            top = max((x for x in frontier if x.split), key=lambda x: x.split[0], default=None)
            if top is None or not top.children:
                break
            top.chosen = True
            frontier.remove(top)
            frontier += top.children
        chosen = sum(x.chosen for x in _laid(root, s, True)[1])
        ahead = sorted((x for x in frontier if x.split and not x.children), key=lambda x: -x.split[0])[: s.leaves - 1 - chosen]
        if not ahead:
            return _laid(root, s, True)[0], loss
        # Splits are tried with empty children, so that rows fall into them; of each pair the smaller is read.
        small = {}
        for leaf in ahead:
            _, f, b = leaf.split
            n = leaf.sums[2, f]
            small[id(leaf)] = 0 if n[: b + 1].sum() * 2 <= n.sum() else 1
            none = np.zeros_like(leaf.sums)
            leaf.children = (_Leaf(none, open_, s), _Leaf(none, open_, s))
        tree, leaves = _laid(root, s, False)
        place = {id(x): i for i, x in enumerate(leaves)}
        wanted = {id(leaf): place[id(leaf.children[small[id(leaf)]])] for leaf in ahead}
        sums, _ = _pass(state, done, tree, sorted(wanted.values()), number, width, bias, s)
        for leaf in ahead:
            read = sums[wanted[id(leaf)]]
            two = (read, leaf.sums - read) if small[id(leaf)] == 0 else (leaf.sums - read, read)
            leaf.children = (_Leaf(two[0], open_, s), _Leaf(two[1], open_, s))


def fit(rows: DataFrame, key: str = "id", settings: Settings | None = None, bounds: list[np.ndarray] | None = None) -> Boosted:
    """Boosted trees for y (0 or 1) from features (an array of equal length in every row), weight and held_back.

    Each tree sees a share of the rows (by a hash of the key) and of the features. Training stops once the weighted log loss of the
    held-back rows has not fallen for `patience` trees, and keeps the trees up to its least; without held-back rows it runs to
    `trees`. The first tree carries the log odds of the training rows. Null features count as 0; rows with a null y or weight
    take no part. No rows, or none of one kind: no trees. Same rows, same trees, however they are dealt out.
    """
    s = settings or Settings()
    rows = cut(rows.where("y is not null and weight is not null and features is not null").select(key, F.transform("features", lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias("features"), "y", "weight", "held_back"), "training")
    start = rows.where("not coalesce(held_back, false)").agg(F.sum(F.col("weight") * F.col("y")).alias("a"), F.sum(F.col("weight") * (1 - F.col("y"))).alias("b"), F.max(F.size("features")).alias("width")).first()
    if not start.a or not start.b:
        return Boosted([], [], [])
    width, bias = start.width, math.log(start.a / start.b)
    bounds = bounds or bin_bounds(rows.where("not coalesce(held_back, false)"), width, s.bins)
    state = cut(binned(rows, bounds, key), "binned")
    trees: list[Tree] = []
    fresh: list[Tree] = []
    losses: list[float] = []
    while len(trees) < s.trees:
        tree, loss = grow(state, fresh, len(trees), width, bias, s)
        losses.append(loss)
        best = min(range(len(losses)), key=lambda i: (math.isnan(losses[i]), losses[i]))
        if tree is None or len(losses) - 1 - best >= s.patience:
            break
        trees.append(tree)
        fresh.append(tree)
        if len(fresh) == s.written:
            state, fresh = cut(moved(state, fresh, width), "binned"), []
    else:
        losses.append(_pass(state, fresh, Tree([-1], [0], [-1], [-1], [0.0], [0.0], [0]), [], len(trees), width, bias, s)[1])
    if not all(map(math.isnan, losses)):
        trees = trees[: max(1, min(range(len(losses)), key=lambda i: (math.isnan(losses[i]), losses[i])))]
    if trees:
        trees[0].v = [v + bias for v in trees[0].v]
    return Boosted(trees, bounds, losses)


def moved(state: DataFrame, trees: list[Tree], width: int) -> DataFrame:
    """The rows with the margins that the trees add."""

    def run(batches):
        for batch in batches:
            bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, width)
            margin = batch.column("margin").to_numpy()
            for tree in trees:
                margin = margin + np.array(tree.v)[walk(tree, bins)]
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(margin))

    return state.mapInArrow(run, state.schema)
