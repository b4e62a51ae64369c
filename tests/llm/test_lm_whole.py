"""The language model's filters hold every gram, whatever the input: no bound, no floor."""

import math
import random
import re
import zlib
from collections import Counter

import pytest

from linkloom.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize(("block", "row", "bits"), [(2000, 1 << 16, (12, 10)), (1 << 24, 500, (14, 11))])
def test_scores_follow_all_pairs(spark, block, row, bits, monkeypatch):
    r = random.Random(3)
    kinds = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(r.choice(kinds) for _ in range(r.randint(1, 80)))) for i in range(600)]
    rows += [(700 + i, "a b c d") for i in range(40)] + [(900, None), (None, "a b"), (901, ""), (900, "a b")]
    monkeypatch.setattr(lm, "TEXT_BLOCK", block)
    monkeypatch.setattr(lm, "TEXT_ROW", row)
    monkeypatch.setattr(lm, "planned", lambda _: lm.Slices(*bits))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lm.score(docs).collect()
    tokens = [WORD.findall(t or "") + [None] for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows]
    pairs = lambda t: list(zip(["^", *t[:-1]], t))
    words = Counter(x for t, h in zip(tokens, held) if not h for x in t)
    both = Counter(x for t, h in zip(tokens, held) if not h for x in pairs(t))
    N, V, starts = sum(words.values()), len(words), sum(not h for h in held)
    value = lambda c: lm.VALUES[lm.level(c)]
    singles = sum(c == 1 for c in both.values())
    at_level = {}
    for c in words.values():
        at_level.setdefault(int(lm.level(c)), []).append(c)
    pull = lm.pull([(sum(x) / len(x), sum(x)) for x in at_level.values()], singles, N)

    def plain(t):
        out = 0.0
        for a, b in pairs(t):
            own, context = value(words[b]), starts if a == "^" else value(words[a])
            out += math.log10((min(value(both[a, b]), own, context) + pull * (own + 0.5) / (N + 0.5 * (V + 1))) / (context + pull))
        return out

    expect = sorted((str(d), len(t), h, sum(words[x] > 0 for x in t), plain(t)) for (d, _), t, h in zip(rows, tokens, held))
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {N}
    got = sorted((str(r.doc_id), r.n_tokens, r.held_out, r.n_known, r.score) for r in got)
    assert [x[:4] for x in got] == [x[:4] for x in expect]
    # A filter may read a gram too high, never too low; that moves few texts, and those by little.
    off = [abs(a[4] - b[4]) / a[1] for a, b in zip(got, expect)]
    assert sum(off) / len(off) < 0.02


def test_slices_grow_with_the_input():
    assert lm.planned(0) == lm.planned(1 << 40) == lm.Slices(12, 10)
    for n in (10**13, 10**14):
        dealt = lm.planned(n)
        assert n / dealt.pairs <= 2 * lm.PER_SLICE and dealt.pairs <= 1 << 24


def test_a_second_table_is_scored_from_the_saved_filters(spark, tmp_path):
    r = random.Random(8)
    kinds = [f"w{i}" for i in range(800)]
    text = lambda: " ".join(r.choice(kinds[: r.choice([20, 800])]) for _ in range(r.randint(1, 60)))
    first = spark.createDataFrame([(i, text()) for i in range(500)], "doc_id long, text string").repartition(3)
    own = lm.score(first, folds=5)
    made = lm.fit(first, f"{tmp_path}/model")
    loaded = lm.Fitted.load(spark, f"{tmp_path}/model")
    assert loaded == made
    # The table it was learnt from: the same scores as in the pass in which it was learnt.
    want = {x.doc_id: (x.n_tokens, pytest.approx(x.score)) for x in own.collect()}
    for limit in (1 << 30, 0):
        assert {x.doc_id: (x.n_tokens, x.score) for x in loaded.score(first, broadcast=limit).collect()} == want
    # Another table, unknown words, null and empty texts, repeated rows among it.
    rows = [(i, text()) for i in range(60)] + [(70, "never seen words"), (71, None), (72, ""), (70, "never seen words"), (None, "w1 w2")]
    second = spark.createDataFrame([(*x, "x") for x in rows], "doc_id long, text string, score string").repartition(4)
    by_task, by_slice = (sorted((str(x.doc_id), x.n_tokens, x.n_known, round(x.score, 9)) for x in loaded.score(second, broadcast=limit).collect()) for limit in (1 << 30, 0))
    assert by_task == by_slice and len(by_task) == len(rows)
    plain = {x[0]: x for x in by_task}
    assert plain["71"] == plain["72"][:0] + ("71", *plain["72"][1:]) and plain["70"][2] <= 2 and plain["72"][1] == 1
    assert loaded.score(second.limit(0)).count() == 0
