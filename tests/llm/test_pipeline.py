"""The pipeline's stages, each held against plain Python on its own input."""

import random

import pytest

import corpus_pipeline
from linkloom.llm import langid, simhash


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(6)
    bits = {"en": "the tion ing er ed th", "fr": "é eau ou è que ment"}
    make = lambda lang, n: " ".join("".join(r.choice(bits[lang].split()) for _ in range(r.randint(1, 4))) for _ in range(n))
    passage = make("en", 70)
    rows = []
    for i in range(80):
        lang = "en" if i % 3 else "fr"
        text = make(lang, r.randint(40, 120)) + (" " + passage if i % 10 == 0 else "")
        rows.append((i, text, lang, f"s{i % 4}", len(text)))
    rows += [(100 + i, rows[i][1], "en", "s0", 1) for i in range(5)] + [(200, None, None, None, None), (201, "12 34 !!", "en", "s1", 8)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path), rows, passage


def test_stages(spark, folder):
    path, rows, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    model = langid.fit(docs)
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, path)
        after = out.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        if name == "language ID":
            assert {r.doc_id for r in after} == {r.doc_id for r in before if not model.predict(r.text)[2]}
            assert not {200, 201} & {r.doc_id for r in after}
        elif name == "SimHash near-dedup":
            prints = {r.doc_id: simhash.fingerprint(r.text) for r in before}
            left = {r.doc_id for r in after}
            assert len(after) == len(left) and not left & set(range(100, 105))
            for a in left:
                assert not any((prints[a] ^ prints[b]).bit_count() <= 4 for b in left if b < a)
        elif name == "suffix-array dedup":
            assert len(after) == len(before)
            assert not any(passage[20:-20] in r.text for r in after) and all(r.n_chars == len(r.text) for r in after)
            same = {r.doc_id: r.text for r in before}
            assert all(r.text == same[r.doc_id] for r in after if passage not in same[r.doc_id])
        elif name == "mixing sources to target weights":
            times = {r.doc_id: 0 for r in before}
            for r in after:
                times[r.doc_id] += 1
            assert max(times.values()) <= 2
        else:
            ids = {}
            for p in after:
                ids[p.doc_id] = ids.get(p.doc_id, 0) + p.length
                assert p.length == 1 << p.bucket and p.offset == 0
            assert len({p.sequence_id for p in after}) == len(after) and set(ids) == {r.doc_id for r in before}
        kept.append(len(after))
        docs = spark.createDataFrame(after, out.schema)
    assert corpus_pipeline.run(spark, path).count() == kept[-1]


def test_empty_table(spark, folder, tmp_path):
    path, *_ = folder
    spark.read.parquet(f"{path}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_row_of_each_group_of_near_copies(spark):
    """Repeated rows, an id on two texts and copies without an id: each group keeps one row, each text stays once."""
    one, two, three, four = (" ".join(f"{w}{i}" for i in range(60)) for w in ("alpha", "bird", "cedar", "dune"))
    rows = [(1, one), (1, one), (2, one), (None, one), (3, two), (3, three), (None, three), (None, four), (None, four)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_copies(spark, docs, "").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, one), (3, two), (3, three), (None, four)]))
