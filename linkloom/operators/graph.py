"""Signed link graphs of many sites at once: every table carries the probe whose neighbourhood it belongs to."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.session import cut


def site_labels(evidence: DataFrame) -> DataFrame:
    """site, label +1, -1 or 0: evidence has boolean scam, honest, listed, popular, official; conflict gives 0."""
    bad = F.col("scam") | F.col("listed")
    good = F.col("honest") | F.col("popular") | F.col("official")
    return evidence.select("site", F.when(bad & ~good, -1).when(good & ~bad, 1).otherwise(0).alias("label"))


def edge_sign(a: Column, b: Column) -> Column:
    return F.when(a == 0, 0).when((a < 0) | (b < 0), -1).otherwise(1)


def signed(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """probe, src, dst, sign of links between labelled members; links to oneself are dropped. labels: probe, site, label."""
    side = lambda c, n: labels.select("probe", F.col("site").alias(c), F.col("label").alias(n))
    both = edges.where("src <> dst").select("probe", "src", "dst").distinct().join(side("src", "a"), ["probe", "src"]).join(side("dst", "b"), ["probe", "dst"])
    return both.select("probe", "src", "dst", edge_sign(F.col("a"), F.col("b")).alias("sign"))


def balance_round(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(probe, src, dst, votes): votes of triangles i>j, j>k, i>k with one unknown link and one unlabelled site, added up.

    Triangles are found once each among pairs of linked sites, from the end with fewer neighbours, so a hub's pairs are never
    all listed; each is then read in its six directions.
    """
    ab, ba = F.when(F.col("src") < F.col("dst"), F.col("sign")), F.when(F.col("src") > F.col("dst"), F.col("sign"))
    pairs = edges.groupBy("probe", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max(ab).alias("ab"), F.max(ba).alias("ba"))
    sites = pairs.select("probe", F.explode(F.array("a", "b")).alias("site")).groupBy("probe", "site").agg(F.count("*").alias("d")).join(labels.select("probe", "site", "label"), ["probe", "site"])
    end = lambda c: sites.select("probe", F.col("site").alias(c), F.struct("d", "site", "label").alias("e" + c))
    known = cut(pairs.join(end("a"), ["probe", "a"]).join(end("b"), ["probe", "b"]), "pairs")
    low, up = F.struct("ea", "eb", F.col("ab").alias("there"), F.col("ba").alias("back")), F.struct(F.col("eb").alias("ea"), F.col("ea").alias("eb"), F.col("ba").alias("there"), F.col("ab").alias("back"))
    o = known.select("probe", F.when(F.col("ea") < F.col("eb"), low).otherwise(up).alias("o")).select("probe", F.col("o.ea.site").alias("u"), F.col("o.ea.label").alias("lu"), F.col("o.eb.site").alias("v"), F.col("o.eb.label").alias("lv"), "o.there", "o.back")
    side = lambda s: o.select("probe", "u", "lu", F.col("v").alias(s), F.col("lv").alias("l" + s), F.col("there").alias("u" + s), F.col("back").alias(s + "u"))
    wedge = side("x").join(side("y").drop("lu"), ["probe", "u"]).where("x < y")
    t = wedge.join(pairs.select("probe", F.col("a").alias("x"), F.col("b").alias("y"), F.col("ab").alias("xy"), F.col("ba").alias("yx")), ["probe", "x", "y"])
    t = t.where("int(lu = 0) + int(lx = 0) + int(ly = 0) = 1")
    way = lambda i, j, k: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), F.col(k).alias("k"), F.col(i + j).alias("s1"), F.col(j + k).alias("s2"), F.col(i + k).alias("s3"))
    ways = F.array(*[way(i, j, k) for i, j, k in (("u", "x", "y"), ("u", "y", "x"), ("x", "u", "y"), ("x", "y", "u"), ("y", "u", "x"), ("y", "x", "u"))])
    t = t.select("probe", F.explode(ways).alias("w")).select("probe", "w.*").where("int(s1 = 0) + int(s2 = 0) + int(s3 = 0) = 1")
    product = F.when(F.col("s1") == 0, 1).otherwise(F.col("s1")) * F.when(F.col("s2") == 0, 1).otherwise(F.col("s2")) * F.when(F.col("s3") == 0, 1).otherwise(F.col("s3"))
    src = F.when(F.col("s2") == 0, F.col("j")).otherwise(F.col("i"))
    dst = F.when(F.col("s1") == 0, F.col("j")).otherwise(F.col("k"))
    return t.select("probe", src.alias("src"), dst.alias("dst"), product.alias("v")).groupBy("probe", "src", "dst").agg(F.sum("v").alias("votes"))


def infer(edges: DataFrame, labels: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Unknown signs filled in round by round until none changes: probe, src, dst, sign, inferred.

    A round settles a link for good, so rounds end; should they outlast `max_rounds`, that is an error, not a result.
    """
    cur = cut(edges.withColumn("inferred", F.lit(False)), "signs")
    for _ in range(max_rounds):
        votes = balance_round(cur, labels).where("votes <> 0")
        fresh = (F.col("sign") == 0) & F.col("votes").isNotNull()
        new = cut(cur.join(votes, ["probe", "src", "dst"], "left").select("probe", "src", "dst", F.when(fresh, F.signum("votes").cast("int")).otherwise(F.col("sign")).alias("sign"), (F.col("inferred") | fresh).alias("inferred"), fresh.alias("fresh")), "signs")
        cur = new.drop("fresh")
        if new.where("fresh").isEmpty():
            return cur
    raise RuntimeError(f"signs did not settle in {max_rounds} rounds")


def judged(edges: DataFrame, labels: DataFrame, probes: DataFrame) -> DataFrame:
    """One row per probe: incoming signs, scam links out, degrees, label by strict 51 % and status."""
    into = edges.where("dst = probe").groupBy("probe").agg(F.count_if(F.col("sign") > 0).alias("positive_in"), F.count_if(F.col("sign") < 0).alias("negative_in"), F.count_if(F.col("sign") == 0).alias("unknown_in"))
    out = edges.where("src = probe").join(labels.select("probe", F.col("site").alias("dst"), "label"), ["probe", "dst"]).groupBy("probe").agg(F.count("*").alias("links_out"), F.count_if(F.col("label") < 0).alias("scam_links_out"))
    rows = probes.select("probe").distinct().join(into, "probe", "left").join(out, "probe", "left").na.fill(0)
    known = F.col("positive_in") + F.col("negative_in")
    label = F.when(known == 0, None).when(F.col("positive_in") / known > 0.51, "benign").when(F.col("negative_in") / known > 0.51, "malicious")
    return rows.withColumn("label", label).withColumn("status", F.when(known == 0, "no_links").when(F.col("label").isNull(), "abstained").otherwise("labelled"))


def _written(new: DataFrame, value: str, before: DataFrame | None, name: str, scale: float = 1.0) -> tuple[DataFrame, float]:
    """The round's values, written, and how far they are in sum from those of the round before (times scale), summed while they are written."""
    if before is None:
        return cut(new, name), float("inf")
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    both = new.join(before.select("site", F.col(value).alias("__before")), "site")
    out = cut(both.observe(seen, F.sum(F.abs(F.col(value) * scale - F.col("__before"))).alias("moved")).drop("__before"), name)
    return out, seen.get["moved"] or 0.0


def pagerank(edges: DataFrame, tolerance: float = 1e-6, most: int = 100, alpha: float = 0.85) -> DataFrame:
    """site, rank over the whole graph (src, dst); what sites without links hold is spread evenly. Ranks sum to 1.

    Rounds go on until ranks move by less than `tolerance` a site in one of them; it is an error if `most` do not do. Spreading
    that mass evenly only scales the solution that lets it go, so it is let go and the sum set to 1 at the end: a
    round is then one join and one aggregate over links that are dealt by src once. Every fifth round is written and measured.
    """
    e = cut(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    nodes = cut(e.select(F.col("src").alias("site")).union(e.select("dst")).distinct(), "nodes")
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    links = cut(e.join(e.groupBy("src").agg(F.count("*").alias("out")), "src"), "links")
    rank = nodes.withColumn("rank", F.lit(1.0 / n))
    for k in range(most):
        before = rank
        gives = links.join(rank, links.src == rank.site).groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        rank = nodes.join(gives, nodes.site == gives.dst, "left").select("site", ((1 - alpha) / n + alpha * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if k % 5 == 4:
            rank, moved = _written(rank, "rank", before, "rank")
            if moved < n * tolerance:
                break
        elif k % 5 == 3:
            rank = cut(rank, "rank")  # read twice by the next round
    else:
        raise RuntimeError(f"ranks did not settle in {most} rounds")
    total = rank.agg(F.sum("rank")).first()[0]
    return rank.select("site", (F.col("rank") / total).alias("rank"))


def eigenvector(edges: DataFrame, tolerance: float = 1e-4, most: int = 200) -> DataFrame:
    """site, score: eigenvector centrality of the undirected graph, of length 1, by power iteration on A + 1.

    Rounds go on until scores move by less than `tolerance` a site in one of them; it is an error if `most` do not do. A round is one
    join and one aggregate; every fifth, scores are set back to length 1, written and measured.
    """
    plain = edges.where("src <> dst").select("src", "dst")
    both = plain.union(plain.select("dst", "src")).union(plain.select("src", "src")).union(plain.select("dst", "dst")).toDF("src", "dst").distinct()
    both = cut(both, "both")
    nodes = cut(both.select(F.col("src").alias("site")).distinct(), "nodes")
    n = nodes.count()
    score = nodes.withColumn("score", F.lit(1.0 / max(n, 1) ** 0.5))
    length = lambda s: s.agg(F.sqrt(F.sum(F.col("score") * F.col("score")))).first()[0] or 1.0
    for k in range(most if n else 0):
        before = score
        score = both.join(score, both.src == score.site).groupBy("dst").agg(F.sum("score").alias("score")).withColumnRenamed("dst", "site")
        if k % 5 == 3:
            score = cut(score, "score")
            norm = length(score)
            score = score.select("site", (F.col("score") / norm).alias("score"))
        elif k % 5 == 4:
            score = cut(score, "score")
            norm = length(score)
            score, moved = _written(score.select("site", (F.col("score") / norm).alias("score")), "score", before, "score")
            if moved < n * tolerance:
                break
    else:
        if n:
            raise RuntimeError(f"scores did not settle in {most} rounds")
    return score


def clustering(edges: DataFrame) -> DataFrame:
    """site, clustering: closed share of the pairs of neighbours in the undirected graph; 0 under two neighbours.

    Links are directed from the end with fewer neighbours to the other, so a hub's pairs are never all listed.
    """
    und = cut(edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), "und")
    deg = cut(und.select(F.explode(F.array("a", "b")).alias("site")).groupBy("site").agg(F.count("*").alias("d")), "degrees")
    d = lambda c: deg.select(F.col("site").alias(c), F.col("d").alias("d" + c))
    o = und.join(d("a"), "a").join(d("b"), "b").select(F.when((F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b"))), F.struct(F.col("a").alias("u"), F.col("b").alias("v"))).otherwise(F.struct(F.col("b").alias("u"), F.col("a").alias("v"))).alias("e")).select("e.u", "e.v")
    o = cut(o, "oriented")
    wedge = o.select("u", F.col("v").alias("x")).join(o.select("u", F.col("v").alias("y")), "u").where("x < y")
    closed = wedge.join(und, (F.col("x") == und.a) & (F.col("y") == und.b)).select(F.explode(F.array("u", "x", "y")).alias("site")).groupBy("site").agg(F.count("*").alias("t"))
    return deg.join(closed, "site", "left").select("site", F.when(F.col("d") > 1, 2 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(F.lit(0.0)).alias("clustering"))


def for_map(edges: DataFrame, labels: DataFrame, most: int = 45) -> DataFrame:
    """probe, site, role, n: the scanned site, labelled neighbours, those that link to it, then by name; `most` at most."""
    into = edges.where("dst = probe").select("probe", F.col("src").alias("site"), F.lit(True).alias("i")).distinct()
    out = edges.where("src = probe").select("probe", F.col("dst").alias("site"), F.lit(True).alias("o")).distinct()
    rows = labels.join(into, ["probe", "site"], "left").join(out, ["probe", "site"], "left")
    role = F.when(F.col("site") == F.col("probe"), "scanned").when(F.col("i") & F.col("o"), "both").when(F.col("i"), "in").when(F.col("o"), "out").otherwise("near")
    w = W.partitionBy("probe").orderBy(F.col("site") != F.col("probe"), F.col("label") == 0, F.col("i").isNull(), "site")
    return rows.withColumn("role", role).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("probe", "site", "role", "n")


def visit_graph(hops: DataFrame, contacted: DataFrame, stopped: DataFrame, servers: DataFrame, most_domains: int = 24, most_blocked: int = 8) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of each visit: nodes are visit, id, kind, pos; links are visit, src, dst, kind, pos.

    hops: visit, n (order), host, blocked; contacted and stopped: visit, host; servers: visit, ip. Equal hosts in a row stand once.
    Other hosts that a visit contacted, and those that were blocked, hang on its last host, by name and up to the stated
    numbers; the server does unless the last hop was blocked. A visit's hops meet in one task, as a visit has few.
    """
    w = W.partitionBy("visit").orderBy("n")
    chain = hops.withColumn("p", F.lag("host").over(w)).withColumn("end", F.last("blocked").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).where("p is null or p <> host")
    chain = chain.select("visit", "host", F.coalesce("end", F.lit(False)).alias("end"), F.row_number().over(w).alias("pos"), F.lead("host").over(w).alias("dst"), F.lead("host", 2).over(w).isNull().alias("ends"))
    last = chain.where("dst is null").select("visit", F.col("host").alias("final"), "end")

    def hung(rows: DataFrame, most: int) -> DataFrame:
        other = rows.select("visit", "host").where("host is not null").distinct().join(chain, ["visit", "host"], "left_anti")
        return other.withColumn("pos", F.row_number().over(W.partitionBy("visit").orderBy("host"))).where(F.col("pos") <= most).join(last, "visit")

    loads, shut = hung(contacted, most_domains), hung(stopped, most_blocked)
    shut = shut.withColumn("host", F.concat(F.lit("blocked:"), "host"))
    hosted = servers.where("ip is not null").groupBy("visit").agg(F.concat(F.lit("server:"), F.min("ip")).alias("host")).join(last.where("not end"), "visit").withColumn("pos", F.lit(1))
    kind = F.when(F.col("dst").isNull(), F.when(F.col("end"), "blocked").otherwise("final")).when(F.col("pos") == 1, "origin").otherwise("hop")
    nodes = chain.select("visit", F.col("host").alias("id"), kind.alias("kind"), "pos")
    links = chain.where("dst is not null").select("visit", F.col("host").alias("src"), "dst", F.when(F.col("ends") & F.col("end"), "blocked").otherwise("hop").alias("kind"), "pos")
    for rows, node, link in ((loads, "domain", "loads"), (shut, "blocked", "blocked"), (hosted, "server", "hosted")):
        nodes = nodes.unionByName(rows.select("visit", F.col("host").alias("id"), F.lit(node).alias("kind"), "pos"))
        links = links.unionByName(rows.select("visit", F.col("final").alias("src"), F.col("host").alias("dst"), F.lit(link).alias("kind"), "pos"))
    return nodes, links
