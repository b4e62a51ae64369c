"""What a task holds and moves does not grow with the table: prints in place, tokens by portions."""

import pyarrow as pa
from pyspark.sql import functions as F

from linkloom.functions import prints as P
from linkloom.functions import tokens as T
from linkloom.operators import pages as O
from linkloom.operators import similar as S
from linkloom.operators import similar
from linkloom.plans import page_queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_similarity_of_a_text_is_the_simhash_of_its_shingles(spark):
    words = [["a"] * n for n in range(8)] + [[f"w{i * i % 977}ä" for i in range(n)] for n in (12, 500, 2 * P.STEP + 5)]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)] + [(99, None)], "k int, w array<string>")
    for k in (3, 4):
        want = {r.k: r.h for r in P.simhash(rows.where(F.size("w") > 0).select("k", P.shingles(F.col("w"), k).alias("s")), "k", "s", "h").collect()}
        got = {r.k: r.h for r in rows.select("k", P.similarity(F.array_join("w", " "), k).alias("h")).collect()}
        assert got == {i: want.get(i) for i in got} and sum(h is not None for h in got.values()) == 8 - (k + 3) + 3


def test_prints_of_pages_move_and_group_nothing(spark):
    p = spark.range(3).select(F.col("id").alias("page_id"), F.array(F.lit("a")).alias("tags"), F.array(F.lit("b")).alias("words"))
    assert not any(x in plan(P.printed(p, "page_id")) for x in ("Exchange", "Aggregate", "Join", "Generate"))


def test_tokens_are_held_by_portions():
    page = "<p>" + "word " * 50_000
    small = ["<b>x</b>", None, "", "<i>y"]
    batch = pa.array(small + [page] * 12 + small)
    parts = list(T._tokens(iter([batch, pa.array([], pa.string())])))
    assert len(parts) > 2 and sum(len(x) for x in parts) == len(batch)
    assert max(sum(len(t["text"] or "") for row in x for t in (row.as_py() or [])) for x in parts) <= T.PORTION
    one = [row for p in batch for row in T._walked(pa.array([p], pa.string())).to_pylist()]
    assert [row for x in parts for row in x.to_pylist()] == one


def test_terms_walk_a_page_once(spark):
    assert plan(O.terms(page_queries.read(spark, SF))).count("ArrowEvalPython") == 1


def test_the_library_is_never_sent_through_the_driver(spark):
    lib = spark.range(9).selectExpr("id", "'d' as dom_hash", "cast(null as long) as dom", "id as txt", "cast(null as long) as look", "1 as icon", "20 as tags")
    pairs = spark.range(1).selectExpr("id as a", "id + 1 as b")
    assert plan(similar.compared(pairs, lib, spark.range(1).selectExpr("7 as icon"))).count("SortMergeJoin") == 2


def test_pairs_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(S, "TASK_PAIRS", 500, raising=False)
    monkeypatch.setattr(S, "STRETCH", 16, raising=False)
    small, large = [range(k * 40, k * 40 + 40) for k in range(40)], range(5000, 5307)
    rows = [("band", str(b[0]), i, len(b)) for b in (*small, large) for i in b]
    lib = spark.createDataFrame([(i, None, None) for _, _, i, _ in rows], "id long, dom_hash string, txt long")
    found = S.pairs(spark.createDataFrame(rows, "kind string, value string, id long, size long"), lib)
    want = {(a, b) for x in small for a in x for b in x if a < b}
    want |= {(a, b) for a in large for b in large if a < b and (b - a <= S.NEIGHBOURS or any((x - 5000) % 30 == 0 and (x - 5000) // 30 < S.ANCHORS for x in (a, b)))}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    assert max(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()) < 4 * S.TASK_PAIRS


def test_no_table_of_a_row_a_page_is_sent_through_the_driver(spark, monkeypatch):
    """Stored rows look far smaller than they are (an array of 78 counts as one number): they were broadcast until the driver's heap ran out."""
    from linkloom.operators import model as M
    from linkloom.plans import model_queries as Q
    from linkloom.session import cut

    plans = {}

    def told(df, name="cut"):
        plans[name] = plan(df)
        return cut(df, name)

    for module in (M, Q):
        monkeypatch.setattr(module, "cut", told)
    rows = Q.training_rows(Q.labelled_vectors(spark, SF))
    for name in ("joined", "counted", "labelled"):
        assert "SortMergeJoin" in plans[name] and "BroadcastHashJoin [page_id" not in plans[name]
    assert "SortMergeJoin [id" in plan(rows) and "BroadcastHashJoin [id" not in plan(rows)
