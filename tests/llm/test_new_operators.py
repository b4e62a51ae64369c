"""Hard negatives, sharding and spelling variants against plain Python."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import negatives, sharding, spelling

VECTORS = "id long, label int, vector array<double>, anchor boolean, source string"


def plain_negatives(rows, positives=5, negatives_=3, low=50, high=95):
    out = []
    for i, (a, la, va, anchor) in enumerate(rows):
        if not anchor:
            continue
        scored = [(-sum(x * y for x, y in zip(map(int, va), map(int, v))), b, lb) for k, (b, lb, v, _) in enumerate(rows) if k != i]
        scored = sorted((max(-(1 << 63) + 1, min((1 << 63) - 1, s)), b, lb) for s, b, lb in scored)
        for s, p, _ in [x for x in scored if x[2] == la][:positives]:
            found = [(t, b) for t, b, lb in scored if lb != la and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(a, p, k + 1, b, -s, -t) for k, (t, b) in enumerate(found[:negatives_])]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_negatives_are_those_of_all_pairs(spark, seed):
    draw = random.Random(seed)
    rows = []
    centres = [[draw.gauss(0, 60) for _ in range(12)] for _ in range(4)]
    for i in range(240):
        centre, spread = draw.choice(centres), draw.choice([1, 8, 40])
        scale = draw.choice([1, 1, 0.2, 5]) if seed % 2 else 1
        vector = [float(round(scale * (x + draw.gauss(0, spread)))) for x in centre]
        rows.append((i if seed < 3 else i // 2, draw.randrange(3), vector if i % 17 else list(centres[0]), i % 5 == 0))
    rows = [(a, b, [float(round(x)) for x in v], d) for a, b, v, d in rows]
    table = spark.createDataFrame([(*r, "x") for r in rows], VECTORS)
    got = negatives.mine(table, bucket=30, focus=3)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows)


def test_negatives_odd_rows(spark):
    whole = [float(x) for x in (3, 4, 0)]
    rows = [(None, 1, whole, True), (1, None, whole, True), (2, 1, None, True), (3, 1, [1.0, None, 2.0], True), (4, 1, [float("nan"), 1.0, 1.0], True), (5, 1, [float("inf"), 1.0, 1.0], True)]
    taking = [(10, 1, whole, True), (11, 1, whole, None), (11, 1, whole, False), (12, 2, [3.0, 3.0], False), (13, 2, [2.0, 2.0, 9.0], False), (14, 2, [], False), (15, 2, [0.0, 0.0, 0.0], True), (16, 2, [0.0, 0.0, 0.0], False)]
    got = negatives.mine(spark.createDataFrame([(*r, "x") for r in rows + taking], VECTORS))
    filled = [(a, b, v + [0.0] * (3 - len(v)), bool(d)) for a, b, v, d in taking]
    assert sorted(map(tuple, got.collect())) == plain_negatives(filled)
    assert negatives.mine(spark.createDataFrame([], VECTORS)).count() == 0


def test_negatives_beyond_a_long(spark):
    huge = [(1, 1, [1e30, 5.0], True), (2, 1, [1e30, 1.0], False), (3, 2, [3e9, 0.0], False), (4, 2, [-1e30, 0.0], False)]
    got = negatives.mine(spark.createDataFrame([(*r, "x") for r in huge], VECTORS)).collect()
    assert got == []  # the positive's score is the largest long, and so is the negative's
    large = [(1, 1, [4e8, 5.0], True), (2, 1, [4e8, 1.0], False), (3, 2, [3e8 + 1, 0.0], False), (4, 2, [-4e8, 0.0], False)]
    got = negatives.mine(spark.createDataFrame([(*r, "x") for r in large], VECTORS)).collect()
    assert list(map(tuple, got)) == plain_negatives(large) and got[0].negative_score == 400_000_000 * 300_000_001


def test_coordinate_ranges_prune():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(4000, 8))
    vectors = np.round(256 * vectors / np.sqrt((vectors**2).sum(axis=1))[:, None])
    norm = np.sqrt((vectors**2).sum(axis=1))
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array(range(4000)), pa.array([1] * 4000), pa.array(norm), pa.array(vectors.tolist())], ["id", "row", "label", "norm", "vector"])
    bucket = negatives.Bucket([batch])
    left = 0
    for i in range(50):
        floor = int(np.sort(bucket.vectors @ vectors[i])[-5])
        found = bucket.feasible(vectors[i], float(norm[i]), floor, 4)
        left += len(found)
        assert set(np.flatnonzero(bucket.vectors @ vectors[i] >= floor)) <= set(found)
    assert left < 50 * 4000 / 2, left


def test_permutation_and_its_inverse():
    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        y = sharding.permute(np.arange(n), n, 3)
        assert sorted(y) == list(range(n))
        assert (sharding.permute(y, n, 3, back=True) == np.arange(n)).all()
    y = sharding.permute(np.arange(100_000), 100_000, 0)
    assert abs(np.corrcoef(np.arange(100_000), y)[0, 1]) < 0.02 and abs(np.corrcoef(y[1:], y[:-1])[0, 1]) < 0.02
    big = np.array([0, 1, 2**53, 2**54 - 1])
    assert (sharding.permute(sharding.permute(big, 2**54), 2**54, back=True) == big).all()


def test_shards_are_even_and_the_same_wherever_rows_lie(spark):
    rows = [(i % 90 or None, "t" * (i % 7), "s", 5) for i in range(203)] + [(7, "same", None, 5)] * 60
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int")
    one = sharding.assign(docs.repartition(1), 5, order=["doc_id", "text"])
    two = sharding.assign(docs.repartition(7, "text"), 5, order=["doc_id", "text"])
    assert one.columns == ["doc_id", "text", "source", "shard", "slot"]
    key = lambda r: (r.shard, r.slot)
    assert [(r.doc_id, r.text) for r in sorted(one.collect(), key=key)] == [(r.doc_id, r.text) for r in sorted(two.collect(), key=key)]
    slots = {}
    for r in one.collect():
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(x) for x in slots.values()]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    # Shard and slot tell the row number, and so the row.
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for r in one.collect()[:50]:
        back = order[int(sharding.row_of(np.array([r.shard]), np.array([r.slot]), len(rows), 5)[0])]
        assert (back[0], back[1]) == (r.doc_id, r.text)
    assert sharding.assign(docs.limit(0), 5).count() == 0


def test_written_shards_keep_slot_order(spark, tmp_path):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    sharding.write(docs, f"{tmp_path}/s", shards=4, rows=100)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.count() == 1000 and back.select("shard", "slot").distinct().count() == 1000
    assert back.select(F.input_file_name()).distinct().count() >= 4


def one_edit(a: str, b: str) -> bool:
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) - len(b) == 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_forms(vocab: dict[str, int], ratio: int = 10):
    near = {w: [v for v in vocab if one_edit(w, v)] for w in vocab}
    form = {}
    for w, n in vocab.items():
        best = min(near[w], key=lambda v: (-vocab[v], v), default=None)
        form[w] = best if best is not None and vocab[best] >= ratio * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), -1 if form[w] is None else vocab[form[w]]) for w, n in vocab.items())


def listed(found):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in found.collect())


@pytest.mark.parametrize("size", [2, 4, None])
def test_forms_are_those_of_all_pairs(spark, size):
    draw = random.Random(5)
    vocab: dict[str, int] = {}
    for _ in range(150):
        w = "".join(draw.choice("abcÀéñ") for _ in range(draw.randrange(3, 9)))
        vocab[w] = draw.choice([1, 2, 15, 200, 4000])
        for _ in range(draw.randrange(3)):
            i = draw.randrange(len(w))
            vocab[draw.choice([w[:i] + w[i + 1 :], w[:i] + "é" + w[i:], w[:i] + "b" + w[i + 1 :]])] = draw.choice([1, 2, 15, 200])
    vocab |= {"aaaaaaa": 10, "aaaaaaaa": 100, "aaaaaaaaa": 1000, "aaaaaaaaaa": 10000}
    table = spark.createDataFrame([(w, n, "x") for w, n in vocab.items()], "word string, n long, name string")
    assert listed(spelling.forms(table, size=size)) == plain_forms(vocab)


def test_words_longer_than_a_digest(spark):
    long = "ab" * 20_000
    words = [long, long + "a", "c" + long[1:], "x" * 64, "x" * 65, "x" * 66, "y" * 64, "x" * 63 + "y"]
    vocab = {w: 10**i for i, w in enumerate(words)}
    assert listed(spelling.forms(spark.createDataFrame(list(vocab.items()), "word string, n long"))) == plain_forms(vocab)


def test_forms_odd_rows(spark):
    table = spark.createDataFrame([(None, 5), ("wordone", 1), ("wordone", 2), ("", 50), ("a", 1)], "word string, n long")
    assert listed(spelling.forms(table)) == plain_forms({"wordone": 3, "": 50, "a": 1})
    assert spelling.forms(table.limit(0)).count() == 0


def test_runs_of_letters(spark):
    docs = spark.createDataFrame([(1, "Überall ÜBERALL überall x÷y×zabcd Straßen-bahnen"), (2, None), (3, ""), (None, "longword LONGWORD")], "doc_id long, text string")
    found = [(r.doc_id, r.run) for r in spelling.runs(docs).collect()]
    assert sorted(found, key=str) == sorted([(1, "Überall"), (1, "Überall"), (1, "überall"), (1, "x÷y×zabcd"), (1, "straßen"), (None, "longword"), (None, "longword")], key=str)
    assert {(r.word, r.n) for r in spelling.vocabulary(spelling.runs(docs).withColumnRenamed("run", "word")).collect()} == {("Überall", 2), ("longword", 2)}


def test_query_deletes_by_checksum(spark, tmp_path):
    import __spark_entry__ as e

    draw = random.Random(1)
    texts = [" ".join(draw.choice(["Paragraph", "wonderful", "Überschrift", "straightforward", "seventh", "tiny"]) for _ in range(60)) for _ in range(80)]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    counts: dict[str, int] = {}
    low = {c: c + 32 for c in range(65, 91)}
    for i, t in enumerate(texts):
        for run in t.translate(low).split():
            h = zlib.crc32(f"{i}:{run}".encode())
            k = h % len(run)
            run = run if h % 31 else run[:k] + run[k + 1 :]
            if len(run) >= 7:
                counts[run] = counts.get(run, 0) + 1
    assert listed(e.queries()["op13_spelling"](spark, str(tmp_path))) == plain_forms({w: n for w, n in counts.items() if n >= 2})
