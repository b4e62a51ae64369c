"""Boosted trees against a plain learner that reads all rows for every split."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from linkloom.operators import boosting as B
from linkloom.operators import model

ROWS = "id long, features array<float>, y int, weight double, held_back boolean, name string"


def drawn(n, seed, width=5):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        x = [float(draw.randrange(k + 2)) for k in range(width - 1)] + [round(draw.random(), 2)]
        y = int((x[0] + 2 * x[4] > 1.2) != (x[2] > 1 and draw.random() < 0.7))
        rows.append((i, x, y if draw.random() < 0.9 else 1 - y, 1.0 + (i % 3), i % 6 == 0, "n"))
    return rows


def plain(rows, s, n_trees, width=5):
    """(f, threshold, n left) of each tree's splits in the order in which they are made, and every row's margin."""
    fit = [r for r in rows if not r[4]]
    x = np.array([[np.float32(v) for v in r[1]] for r in rows], float)
    y, w, held = np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    margin = np.full(len(rows), math.log(sum(r[3] for r in fit if r[2]) / sum(r[3] for r in fit if not r[2])))
    out = []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        leaves, made = [np.arange(len(rows))], []

        def best(at):
            at = at[~held[at]]
            score = lambda i: g[i].sum() ** 2 / (h[i].sum() + s.ridge)
            found = []
            for f in range(width):
                for t in sorted(set(x[~held, f]))[:-1]:
                    a, b = at[x[at, f] <= t], at[x[at, f] > t]
                    if min(len(a), len(b)) >= s.least:
                        found.append((score(a) + score(b) - score(at), f, t))
            return max(found, key=lambda z: (round(z[0], 7), -z[1], -z[2]), default=None)

        while len(leaves) < s.leaves:
            options = [(best(leaf), k) for k, leaf in enumerate(leaves)]
            options = [(z, k) for z, k in options if z and z[0] > 1e-9]
            if not options:
                break
            (gain, f, t), k = max(options, key=lambda o: o[0][0])
            leaf = leaves.pop(k)
            leaves += [leaf[x[leaf, f] <= t], leaf[x[leaf, f] > t]]
            made.append((f, t))
        for leaf in leaves:
            i = leaf[~held[leaf]]
            margin[leaf] -= s.rate * g[i].sum() / (h[i].sum() + s.ridge)
        out.append(sorted(made))
    return out, margin


@pytest.mark.parametrize("seed", [1, 2])
def test_trees_are_those_of_a_plain_learner(spark, seed):
    rows = drawn(400, seed)
    s = B.Settings(rate=0.3, leaves=6, trees=3, least=15, rows=1.0, features=1.0, bins=200, written=2)
    table = spark.createDataFrame(rows, ROWS)
    found = B.fit(table.repartition(5), settings=B.Settings(**{**s.__dict__, "patience": 99}))
    n = len(found.trees)
    made, _ = plain(rows, s, n)
    nodes = found.nodes(spark)
    got = [sorted((r.f, r.t) for r in nodes.where(f"tree = {k} and f >= 0").collect()) for k in range(n)]
    assert n >= 1 and [[(f, pytest.approx(t)) for f, t in g] for g in got] == made
    _, margin = plain(rows, s, n)
    raw = {r.id: r.raw for r in model.score(table, nodes).collect()}
    assert all(abs(raw[i] - m) < 1e-4 for i, m in enumerate(margin))
    # The losses are those of the held-back rows.
    held = [r for r in rows if r[4]]
    loss = sum(r[3] * math.log(1 + math.exp(-margin[r[0]] if r[2] else margin[r[0]])) for r in held) / sum(r[3] for r in held)
    assert abs(found.losses[n] - loss) < 1e-5


def test_same_trees_however_rows_are_dealt(spark):
    table = spark.createDataFrame(drawn(600, 3), ROWS)
    s = B.Settings(rate=0.2, leaves=8, trees=4, least=10, written=2)
    one, two = (B.fit(t, settings=s).trees for t in (table.coalesce(1), table.repartition(7)))
    assert one and one == two


def test_training_stops_when_held_back_rows_gain_no_more(spark):
    draw = random.Random(0)
    noise = [(i, [draw.random(), draw.random()], draw.randrange(2), 1.0, i % 3 == 0, "n") for i in range(300)]
    found = B.fit(spark.createDataFrame(noise, ROWS), settings=B.Settings(rate=0.5, leaves=8, trees=40, least=5, patience=3))
    best = min(range(len(found.losses)), key=found.losses.__getitem__)
    assert len(found.losses) == best + 4 and len(found.trees) == max(1, best)


def test_odd_rows(spark):
    none = spark.createDataFrame([], ROWS)
    assert B.fit(none).trees == []
    one_kind = spark.createDataFrame([(i, [1.0], 1, 1.0, False, "n") for i in range(9)], ROWS)
    assert B.fit(one_kind).trees == []
    rows = [(i, [None if i % 2 else 3.0, 1.0], i % 2, 1.0, None, "n") for i in range(200)] + [(500, [1.0, 1.0], None, 1.0, False, "n"), (501, None, 1, 1.0, False, "n")]
    found = B.fit(spark.createDataFrame(rows, ROWS), settings=B.Settings(trees=2, features=1.0))
    assert len(found.trees) == 2 and found.trees[0].f[0] == 0 and found.bounds[0].tolist() == [0.0]
    shares = B.gain_shares(found.nodes(spark), ["a", "b"]).collect()
    assert [(r.feature, r.share) for r in shares] == [("a", 1.0)]
