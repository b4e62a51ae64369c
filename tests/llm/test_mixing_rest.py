"""Tilted rates against a plain solver; what rounding leaves over is settled by all cells that fit, not by a few."""

import math
import random

import pytest

from linkloom.llm import mixing


def test_short_documents_make_up_for_one_very_long_one(spark):
    sizes = [20_000, *range(101, 401)]
    target = 1.5 * sum(sizes)
    cells = spark.createDataFrame([("0s", z, 1) for z in sizes], "source string, size long, n long")
    rates = spark.createDataFrame([("0s", sum(sizes), target, 0.0)], "source string, source_size long, target double, m double")
    plan = mixing.plan_copies(cells, rates).collect()
    assert len(plan) == len(sizes) and all(0 <= r.total <= 2 for r in plan)
    assert abs(sum(r.total * r.size for r in plan) - target) <= min(sizes)


def plain_multiplier(sizes, target, most=2.0):
    """Bisection of sum(size * min(most, exp(m * size))) = target."""
    low, high = -50.0, 50.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(z * min(most, math.exp(min(50.0, mid * z))) for z in sizes) < target else (low, mid)
    return low


def test_rates_are_tilted_by_size(spark):
    r = random.Random(8)
    sources = {f"0{k}": [r.randint(1, 60) ** r.choice((1, 2)) for _ in range(80)] + [9000] * (k % 2) for k in range(6)}
    shares = dict(zip(sources, (0.05, 0.4, 0.9, 1.2, 1.9, 1.999)))
    goal = [(s, sum(z), shares[s] * sum(z)) for s, z in sources.items()] + [("0full", 30, 60.0), ("0none", 0, 0.0), ("0zero", 12, 0.0)]
    cells = [(s, z, zs.count(z)) for s, zs in sources.items() for z in set(zs)] + [("0full", 10, 3), ("0none", 0, 4), ("0zero", 12, 1)]
    solved = mixing.balance(spark.createDataFrame(cells, "source string, size long, n long"), spark.createDataFrame(goal, "source string, source_size long, target double")).collect()
    got = {x.source: x.m for x in solved}
    assert set(got) == {g[0] for g in goal} and got["0full"] is None and got["0zero"] == got["0none"] == 0
    for s, zs in sources.items():
        want = plain_multiplier(zs, shares[s] * sum(zs))
        assert got[s] == pytest.approx(want, rel=1e-6, abs=1e-12)
        assert sum(z * min(2.0, math.exp(got[s] * z)) for z in zs) == pytest.approx(shares[s] * sum(zs), rel=1e-6)
