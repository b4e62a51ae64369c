import hashlib
import random
from collections import Counter

from linkloom.llm import suffixes


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = len(bytes(gone).replace(b"\0", b" ").split())
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def cases():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60) for _ in range(3)]
    texts = [None, "", "short", "a" * 199, "a" * 200, "a" * 201, "a" * 700, "b" * 200, "b" * 200 + "c", "xyz" * 120, "q" + "xyz" * 120, "xyz" * 66 + "xy"]
    texts += ["a" * 200 + prose(40), "z" * 216, "z" * 200]
    texts += [prose(r.randint(0, 30)) + r.choice(shared) + prose(r.randint(0, 30)) for _ in range(30)]
    texts += [prose(20) + shared[0][i : i + 200] + prose(3) for i in range(0, 40, 7)]
    whole = prose(150)
    texts += [whole, whole, whole[:-1], whole[1:], whole.replace(" ", "  ", 1), prose(30) + shared[1] + prose(4) + shared[1]]
    return texts


def check(spark, texts, **how):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, key int")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.report(docs, **how).collect()}
    assert got == dict(enumerate(brute(texts, 200)))


def test_against_brute_force(spark):
    check(spark, cases())


def test_crowded_anchors_are_compared_by_string(spark):
    check(spark, cases(), most=3)


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    r = random.Random(8)
    body = "".join(r.choice("abcdef") for _ in range(9000))
    monkeypatch.setattr(suffixes, "PIECE", 1000)
    check(spark, [body, body[500:2500] + "!", "?" + body[4000:4300], "k" * 3000, body[:100] + "k" * 300])


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.report(empty).collect() == []
    twice = spark.createDataFrame([(1, "x" * 50 + "y" * 300), (1, "x" * 50 + "y" * 300), (None, None)], "doc_id long, text string")
    assert sorted((r.n_bytes, r.n_removed) for r in suffixes.report(twice).collect()) == [(0, 0), (350, 350), (350, 350)]


def test_sql_twin(spark, tmp_path):
    import duckdb

    from linkloom.llm import queries

    docs = spark.createDataFrame(list(enumerate(cases())), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.QUERIES["op6_suffixes"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(queries.ORACLES["op6_suffixes"]).fetchall())


def test_rows_with_their_texts_stripped(spark):
    from linkloom.llm import suffixes

    shared = "".join(chr(97 + i * i % 23) for i in range(260))
    rows = [(1, "head " + shared, "a", 5), (2, shared + " tail", None, None), (3, None, "a", 1), (None, "", "b", 0), (4, "x" * 50, "c", 2), (4, "x" * 50, "c", 2), (5, "é" * 150, "d", 3), (6, "é" * 150, "d", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, kept long").repartition(3)
    got = sorted(((r.doc_id, r.text, r.row, r.kept) for r in suffixes.stripped(docs).collect()), key=str)
    texts = {r.key: r.kept for r in suffixes.strip_repeats(docs).collect()}
    keys = docs.select("*", suffixes.text_key().alias("key")).collect()
    assert got == sorted(((r.doc_id, None if r.text is None else texts[r.key], r.row, r.kept) for r in keys), key=str)
    assert {g[0]: g[1] for g in got}[1].startswith("head") and len({g[0]: g[1] for g in got}[2]) < 30
    assert suffixes.stripped(docs.limit(0)).count() == 0
