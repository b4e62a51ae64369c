"""The decision list against a learner in plain Python that looks at every row for every threshold."""

import math
import random
import zlib

import pytest

from linkloom.llm import quality


def plain_rules(rows, steps=40, max_rules=8, max_tests=3, sure=0.95, least=5):
    rows = [r for r in rows if r["bad"] is not None]
    bounds = {}
    for f in quality.FEATURES:
        found = set()
        for some in (rows, [r for r in rows if r["bad"]]):
            v = sorted(r[f] for r in some)
            found |= {v[max(math.ceil(i / steps * len(v)), 1) - 1] for i in range(1, steps) if v}
        bounds[f] = sorted(found)
    meets = lambda r, rule: all((r[f] > b) == above for f, above, b in rule)
    prunes = lambda r: zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
    rules = []
    while len(rules) < max_rules:
        left = [r for r in rows if not any(meets(r, x) for x in rules)]
        rule = []
        while len(rule) < max_tests:
            grow = [r for r in left if not prunes(r) and meets(r, rule)]
            p = sum(r["bad"] for r in grow)
            if p in (0, len(grow)):
                break
            best = (1e-9, None)
            for f in quality.FEATURES:
                for b in bounds[f]:
                    for above in (False, True):
                        hit = [r["bad"] for r in grow if (r[f] > b) == above]
                        if any(hit) and (gain := sum(hit) * (math.log2(sum(hit) / len(hit)) - math.log2(p / len(grow)))) > best[0]:
                            best = (gain, (f, above, b))
            if best[1] is None:
                break
            rule.append(best[1])
        choices = []
        for k in range(1, len(rule) + 1):
            hit = [(r["bad"], prunes(r)) for r in left if meets(r, rule[:k])]
            bad = {x: sum(b for b, q in hit if q is x) for x in (True, False)}
            good = {x: sum(not b for b, q in hit if q is x) for x in (True, False)}
            if sum(bad.values()) >= least and all(bad[x] >= sure * (bad[x] + good[x]) for x in bad):
                choices.append(((bad[True] + 1 - good[True]) / (bad[True] + good[True] + 2), -k))
        if not choices:
            break
        rules.append(rule[: -max(choices)[1]])
    return rules


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_equal_those_of_a_plain_learner(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(500):
        row = {"doc_id": i, **{f: float(r.randrange(12)) for f in quality.FEATURES}}
        a, b, c = (row[f] for f in quality.FEATURES[:3])
        row["bad"] = None if i % 50 == 0 else (a > 8 and b <= 5) or c > 10 or r.random() < 0.01
        rows.append(row)
    kind = "doc_id long, " + ", ".join(f"{f} double" for f in quality.FEATURES) + ", bad boolean"
    table = spark.createDataFrame([tuple(x.values()) for x in rows], kind)
    rules = quality.learn(table, sure=0.85)
    learnt = [[(t.feature, t.above, t.bound) for t in rule] for rule in rules]
    assert learnt and learnt == plain_rules(rows, sure=0.85)
    kept, which = quality.verdict(rules)
    for x in table.select("*", kept.alias("kept"), which.alias("rule")).collect():
        first = next((i for i, rule in enumerate(learnt, 1) if all((x[f] > b) == above for f, above, b in rule)), 0)
        assert (x.kept, x["rule"]) == (first == 0, first)
