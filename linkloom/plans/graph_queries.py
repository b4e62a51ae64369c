"""Queries over the link graph that orders and their parts make: consecutive parts of an order are linked."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.operators import graph as G
from linkloom.plans.registry import query
from linkloom.session import cut, table

EDGE_SQL = "ed as (select distinct src, dst from (select l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as dst from lineitem) where dst is not null and src <> dst)"
LAB_SQL = "lab as (select p_partkey as site, case when p_size <= 12 and p_size % 5 <> 0 then -1 when p_size >= 30 and p_size % 7 <> 0 then 1 else 0 end as label from part)"
#: Neighbourhoods of every hundredth part: its links and those between its neighbours.
HOOD_SQL = f"{EDGE_SQL}, {LAB_SQL}, nb as (select src as probe, dst as site from ed where src % 100 = 0 union select dst, src from ed where dst % 100 = 0 union select distinct src, src from ed where src % 100 = 0), mem as (select probe, nb.site, case when probe = nb.site then 0 else label end as label from nb join lab on lab.site = nb.site), he as (select a.probe, src, dst, case when a.label = 0 then 0 when a.label < 0 or b.label < 0 then -1 else 1 end as sign from ed join mem a on a.site = src join mem b on b.site = dst and b.probe = a.probe)"


ROUND_SQL = (
    "t{k} as (select x.probe, x.src as i, x.dst as j, y.dst as k, x.sign as s1, y.sign as s2, z.sign as s3 from e{k} x join e{k} y on y.probe = x.probe and y.src = x.dst join e{k} z on z.probe = x.probe and z.src = x.src and z.dst = y.dst "
    "join mm a on a.probe = x.probe and a.site = x.src join mm b on b.probe = x.probe and b.site = x.dst join mm c on c.probe = x.probe and c.site = y.dst "
    "where (x.sign = 0)::int + (y.sign = 0)::int + (z.sign = 0)::int = 1 and (a.label = 0)::int + (b.label = 0)::int + (c.label = 0)::int = 1), "
    "v{k} as (select probe, case when s2 = 0 then j else i end as src, case when s1 = 0 then j else k end as dst, sum(case when s1 = 0 then 1 else s1 end * case when s2 = 0 then 1 else s2 end * case when s3 = 0 then 1 else s3 end) as votes from t{k} group by all having votes <> 0), "
    "e{n} as materialized (select e.probe, e.src, e.dst, case when e.sign = 0 and votes is not null then sign(votes)::integer else e.sign end as sign, e.inferred or (e.sign = 0 and votes is not null) as inferred from e{k} e left join v{k} using (probe, src, dst))"
)
#: The rounds of the balance rule, of the rank and of the centrality, one table each.
INFER_SQL = f"with {HOOD_SQL}, mm as materialized (select * from mem), e0 as materialized (select *, false as inferred from he), " + ", ".join(ROUND_SQL.format(k=k, n=k + 1) for k in range(20)) + " select probe, src, dst, sign, inferred from e20"
RANK_SQL = (
    f"with {EDGE_SQL}, em as materialized (select * from ed), nd as materialized (select src as site from em union select dst from em), ln as materialized (select em.src, dst, o from em join (select src, count(*) as o from em group by 1) using (src)), r0 as (select site, 1.0::double / (select count(*) from nd) as rank from nd), "
    + ", ".join(f"r{k + 1} as materialized (select nd.site, (1 - 0.85::double) / (select count(*) from nd) + 0.85::double * coalesce(got, 0) as rank from nd left join (select dst, sum(rank / o) as got from ln join r{k} on src = site group by 1) on dst = nd.site)" for k in range(30))
    + " select site, round(rank / (select sum(rank) from r30), 7) as rank from r30"
)
CENTRE_SQL = (
    f"with {EDGE_SQL}, em as materialized (select * from ed), bo as materialized (select src, dst from em union select dst, src from em union select src, src from em union select dst, dst from em), c0 as (select distinct src as site, 1.0::double as score from bo), "
    + ", ".join(f"c{k + 1} as materialized (select dst as site, sum(score) as score from bo join c{k} on src = site group by 1)" for k in range(30))
    + " select site, round(score / (select sqrt(sum(score * score)) from c30), 5) as score from c30"
)


def edges(spark, sf):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    e = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return e.where("dst is not null and src <> dst").distinct()


def labels(spark, sf):
    s = F.col("p_size")
    return G.site_labels(table(spark, sf, "part").select(F.col("p_partkey").alias("site"), ((s <= 12)).alias("scam"), ((s <= 12) & (s % 5 == 0)).alias("honest"), F.lit(False).alias("listed"), ((s >= 30) & (s % 7 != 0)).alias("popular"), F.lit(False).alias("official")))


def hood(spark, sf):
    e = cut(edges(spark, sf), "edges")
    near = e.where("src % 100 = 0").select(F.col("src").alias("probe"), F.col("dst").alias("site")).union(e.where("dst % 100 = 0").select("dst", "src")).union(e.where("src % 100 = 0").select("src", "src")).distinct()
    mem = cut(near.join(labels(spark, sf), "site").select("probe", "site", F.when(F.col("probe") == F.col("site"), 0).otherwise(F.col("label")).alias("label")), "members")
    left = mem.select("probe", F.col("site").alias("src"))
    inner = e.join(left, "src").join(mem.select("probe", F.col("site").alias("dst")), ["probe", "dst"])
    return cut(G.signed(inner, mem), "hood"), mem


@query("g06_site_labels", f"with {LAB_SQL} select site, label from lab")
def g06(spark, sf):
    return labels(spark, sf)


@query("g07_signed_edges", f"with {HOOD_SQL} select probe, src, dst, sign from he")
def g07(spark, sf):
    return hood(spark, sf)[0]


@query("g08_balance_round", f"with {HOOD_SQL}, t as (select x.probe, x.src as i, x.dst as j, y.dst as k, x.sign as s1, y.sign as s2, z.sign as s3 from he x join he y on y.probe = x.probe and y.src = x.dst join he z on z.probe = x.probe and z.src = x.src and z.dst = y.dst where x.src <> y.dst and (x.sign = 0)::int + (y.sign = 0)::int + (z.sign = 0)::int = 1), u as (select t.* from t join mem a on a.probe = t.probe and a.site = i join mem b on b.probe = t.probe and b.site = j join mem c on c.probe = t.probe and c.site = k where (a.label = 0)::int + (b.label = 0)::int + (c.label = 0)::int = 1) select probe, case when s2 = 0 then j else i end as src, case when s1 = 0 then j else k end as dst, cast(sum(case when s1 = 0 then 1 else s1 end * case when s2 = 0 then 1 else s2 end * case when s3 = 0 then 1 else s3 end) as bigint) as votes from u group by all")
def g08(spark, sf):
    return G.balance_round(*hood(spark, sf))


@query("g08_infer", INFER_SQL)
def g08b(spark, sf):
    """Signs after all rounds of the balance rule."""
    e, mem = hood(spark, sf)
    return G.infer(e, mem)


@query("g09_judged", f"with {HOOD_SQL}, i as (select probe, count(*) filter (sign > 0) as positive_in, count(*) filter (sign < 0) as negative_in, count(*) filter (sign = 0) as unknown_in from he where dst = probe group by 1), o as (select he.probe, count(*) as links_out, count(*) filter (label < 0) as scam_links_out from he join mem on mem.probe = he.probe and mem.site = he.dst where src = he.probe group by 1), p as (select distinct probe from mem), r as (select probe, coalesce(positive_in, 0) as positive_in, coalesce(negative_in, 0) as negative_in, coalesce(unknown_in, 0) as unknown_in, coalesce(links_out, 0) as links_out, coalesce(scam_links_out, 0) as scam_links_out from p left join i using (probe) left join o using (probe)) select *, case when positive_in + negative_in = 0 then null when positive_in / (positive_in + negative_in) > 0.51 then 'benign' when negative_in / (positive_in + negative_in) > 0.51 then 'malicious' end as label, case when positive_in + negative_in = 0 then 'no_links' when positive_in / (positive_in + negative_in) > 0.51 or negative_in / (positive_in + negative_in) > 0.51 then 'labelled' else 'abstained' end as status from r")
def g09(spark, sf):
    e, mem = hood(spark, sf)
    return G.judged(e, mem, mem)


@query("g10_pagerank", RANK_SQL)
def g10(spark, sf):
    return G.pagerank(edges(spark, sf), tolerance=1e-12).withColumn("rank", F.round("rank", 7))


@query("g11_eigenvector", CENTRE_SQL)
def g11(spark, sf):
    return G.eigenvector(edges(spark, sf), tolerance=1e-9).withColumn("score", F.round("score", 5))


@query("g11_clustering", f"with {EDGE_SQL}, u as (select distinct least(src, dst) as a, greatest(src, dst) as b from ed), n as (select a as s, b as t from u union all select b, a from u), d as (select s, count(*) as d from n group by 1), w as (select x.s, count(*) as t from n x join n y on x.s = y.s and x.t < y.t join u on u.a = x.t and u.b = y.t group by 1) select d.s as site, round(case when d > 1 then 2 * coalesce(t, 0) / (d * (d - 1)) else 0 end, 6) as clustering from d left join w using (s)")
def g11b(spark, sf):
    return G.clustering(edges(spark, sf)).withColumn("clustering", F.round("clustering", 6))


@query("w06_map", f"with {HOOD_SQL}, x as (select mem.*, exists (select 1 from he where he.probe = mem.probe and dst = mem.probe and src = mem.site) as i, exists (select 1 from he where he.probe = mem.probe and src = mem.probe and dst = mem.site) as o from mem), r as (select *, row_number() over (partition by probe order by site <> probe, label = 0, not i, site) as n from x) select probe, site, case when site = probe then 'scanned' when i and o then 'both' when i then 'in' when o then 'out' else 'near' end as role, n from r where n <= 45")
def w06(spark, sf):
    return G.for_map(*hood(spark, sf))


VISIT_SQL = """with h as (select user_id as visit, event_type as host, event_id % 5 = 0 as blocked, row_number() over (partition by user_id order by ts, event_id) as n from events),
c as (select *, lag(host) over (partition by visit order by n) as p, last_value(blocked) over (partition by visit order by n rows between unbounded preceding and unbounded following) as stop from h),
k as (select visit, host, stop, row_number() over (partition by visit order by n) as pos, count(*) over (partition by visit) as total from c where p is null or p <> host),
f as (select visit, host as final, stop from k where pos = total),
o as (select visit, kind, host, row_number() over (partition by visit, kind order by host) as pos from (select distinct user_id as visit, 'loads' as kind, case when event_id % 3 = 0 then event_type else 'c' || (event_id % 40) || '.com' end as host from events union select distinct user_id, 'blocked', 'b' || (event_id % 30) || '.com' from events where event_id % 4 = 0) x where not exists (select 1 from k where k.visit = x.visit and k.host = x.host)),
e as (select visit, kind, case when kind = 'blocked' then 'blocked:' || host else host end as dst, final as src, pos from o join f using (visit) where pos <= case when kind = 'loads' then 24 else 8 end
union all select user_id, 'hosted', 'server:10.0.0.' || (user_id % 250), final, 1 from (select distinct user_id from events where user_id % 3 = 0) join f on f.visit = user_id where not stop)
select 'link' as part, a.visit, a.host as a, b.host as b, case when b.pos = b.total and a.stop then 'blocked' else 'hop' end as kind, a.pos from k a join k b on a.visit = b.visit and b.pos = a.pos + 1
union all select 'node', visit, host, '', case when pos = total then case when stop then 'blocked' else 'final' end when pos = 1 then 'origin' else 'hop' end, pos from k
union all select 'link', visit, src, dst, kind, pos from e union all select 'node', visit, dst, '', case kind when 'loads' then 'domain' when 'blocked' then 'blocked' else 'server' end, pos from e"""


@query("g12_visit_graph", VISIT_SQL)
def g12(spark, sf):
    """Each visit as typed nodes and links: the chain of hosts, what the last one loads, what was blocked, the server."""
    e = table(spark, sf, "events").withColumnRenamed("user_id", "visit")
    hops = e.select("visit", F.struct("ts", "event_id").alias("n"), F.col("event_type").alias("host"), (F.col("event_id") % 5 == 0).alias("blocked"))
    loaded = e.select("visit", F.expr("case when event_id % 3 = 0 then event_type else 'c' || (event_id % 40) || '.com' end").alias("host"))
    shut = e.where("event_id % 4 = 0").select("visit", F.expr("'b' || (event_id % 30) || '.com'").alias("host"))
    nodes, links = G.visit_graph(hops, loaded, shut, e.where("visit % 3 = 0").select("visit", F.expr("'10.0.0.' || (visit % 250)").alias("ip")))
    return links.select(F.lit("link").alias("part"), "visit", F.col("src").alias("a"), F.col("dst").alias("b"), "kind", "pos").unionByName(nodes.select(F.lit("node").alias("part"), "visit", F.col("id").alias("a"), F.lit("").alias("b"), "kind", "pos"))


@query("w08_moving_hosts", "with c as (select user_id as visit, event_type as host, ts, event_id, lag(event_type) over (partition by user_id order by ts, event_id) as p from events) select visit, string_agg(host, ' > ' order by ts, event_id) as hosts from c where p is null or p <> host group by 1")
def w08(spark, sf):
    """The hosts a chain moves over, one after the other: equal hosts in a row stand once."""
    w = W.partitionBy("visit").orderBy("ts", "event_id")
    h = table(spark, sf, "events").select(F.col("user_id").alias("visit"), "ts", "event_id", F.col("event_type").alias("host")).withColumn("p", F.lag("host").over(w)).where("p is null or p <> host")
    return h.groupBy("visit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "host"))), lambda x: x["host"]), " > ").alias("hosts"))


@query("j08_who_links", f"with {EDGE_SQL}, r as (select dst as site, src as linker, row_number() over (partition by dst order by src) as n from ed) select site, linker from r where n <= 120")
def j08(spark, sf):
    w = W.partitionBy("dst").orderBy("src")
    return edges(spark, sf).withColumn("n", F.row_number().over(w)).where("n <= 120").select(F.col("dst").alias("site"), F.col("src").alias("linker"))


@query("j09_a09_evidence", f"with {EDGE_SQL} select dst as site, bool_or(p_size <= 12) as any_scam, bool_or(p_size >= 30) as any_honest from ed join part on p_partkey = src group by 1")
def j09(spark, sf):
    """Per site: does any scam, does any honest site link to it."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("src"), "p_size")
    return edges(spark, sf).join(p, "src").groupBy(F.col("dst").alias("site")).agg(F.bool_or(F.col("p_size") <= 12).alias("any_scam"), F.bool_or(F.col("p_size") >= 30).alias("any_honest"))
