"""Queries on near copies and families, over pages and over documents as a labelled library."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.functions import prints as P
from linkloom.functions.html import words as split_words
from linkloom.operators import similar as S
from linkloom.plans.page_queries import PRINTS_SQL, fingerprints, shingle_sql, sim_sql
from linkloom.plans.registry import query
from linkloom.session import cut, kept, spread, table

LIB_WORDS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{M}]+'), lambda w: length(w) between 3 and 30)"
LIB_SQL = (
    f"ld as (select d.doc_id as id, source as site, lang as brand, case when toxic = 1 then 'phish' when quality = 1 then 'benign' else 'unknown' end as label, {LIB_WORDS} as w, n_chars from documents d left join labels l using (doc_id)), "
    f"ls as (select id, {shingle_sql('w', 3)} as s from ld where len(w) >= 12), " + sim_sql("ls", "id", "s", "txt") + ", "
    "lib as (select ld.id, site, brand, label, len(w) as words, txt, n_chars, case when len(w) >= 8 then substr(md5(array_to_string(w[:8], ' ')), 1, 16) end as dom_hash, cast(n_chars % 50 as integer) as icon from ld left join txt using (id)), "
    "icons as (select icon from lib where label = 'benign' group by icon having count(distinct site) >= 5), "
    "uu as (select id, case when txt < 0 then txt::hugeint + 18446744073709551616 else txt::hugeint end as u from lib where txt is not null), "
    "keys as (select lib.id, 'band' as kind, cast((4 + i) * 65536 + ((u >> (16 * i)::integer) & 65535) as varchar) as value from lib join uu using (id), range(4) r(i) where words >= 20 union all select id, 'dom', dom_hash from lib where dom_hash is not null and words >= 20 union all select id, 'icon', cast(icon as varchar) from lib where words >= 20 and icon not in (select icon from icons)), "
    "bk as (select kind, value, count(*) as size from keys group by all having count(*) > 1)"
)

def library(spark, sf):
    """documents and labels in the role of the page library: the table of prints, made once and then read."""
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    return kept(spark, "library", [d, lab], lambda: library_rows(d, lab))


def library_rows(d, lab):
    base = spread(d).select(F.col("doc_id").alias("id"), F.col("source").alias("site"), F.col("lang").alias("brand"), "n_chars", split_words(F.col("text")).alias("w"))
    # Prints are made where the text is; only they meet the labels.
    base = base.select("id", "site", "brand", F.size("w").alias("words"), "n_chars", F.when(F.size("w") >= 8, F.substring(F.md5(F.array_join(F.slice("w", 1, 8), " ").cast("binary")), 1, 16)).alias("dom_hash"), F.when(F.size("w") >= 12, F.array_join("w", " ")).alias("w"))
    base = base.withColumn("txt", P.similarity(F.col("w"), 3)).drop("w").join(lab.withColumnRenamed("doc_id", "id"), "id", "left")
    label = F.when(F.col("toxic") == 1, "phish").when(F.col("quality") == 1, "benign").otherwise("unknown")
    lib = base.select("id", "site", "brand", label.alias("label"), "words", "n_chars", "dom_hash", (F.col("n_chars") % 50).cast("int").alias("icon"), "txt")
    return lib.select("*", P.bands(F.col("txt"), 1).alias("bands"), F.lit(None).cast("string").alias("title"), F.lit(20).alias("tags"), F.lit(None).cast("long").alias("dom"), F.lit(None).cast("long").alias("look"))


@query("g01_page_copies", f"with {PRINTS_SQL}, q as (select *, case when txt < 0 then txt::hugeint + 18446744073709551616 else txt::hugeint end as u from prints), p2 as (select x.page_id as a, y.page_id as b, x.host as a_host, y.host as b_host, x.dom_hash is not distinct from y.dom_hash as same, bit_count(xor(x.dom, y.dom)) as sd, bit_count(xor(x.txt, y.txt)) as wd, least(x.tags, y.tags) < 15 as tiny from q x join q y on x.page_id < y.page_id where x.tags >= 15 and y.tags >= 15 and x.words >= 20 and y.words >= 20), s as (select *, case when same then 1.5 when sd <= 3 then 1.25 when sd <= 8 then 0.75 else 0 end as sp, case when wd <= 4 then 2.0 when wd <= 8 then 1.25 when wd <= 12 then 0.5 else 0 end as wp from p2) select a, b, a_host, b_host, round(sp + wp, 2)::double as points, cast(round_even(((case when same then 1.0 else 1 - sd / 64.0 end) + (1 - wd / 64.0)) * 50, 0) as integer) as percent from s where sp > 0 and wp > 0 and sp + wp >= 3.0")
def g01(spark, sf):
    """Which captured pages are copies of each other: structure and wording agree."""
    f = cut(fingerprints(spark, sf), "prints")
    lib = f.select(F.col("page_id").alias("id"), F.lit(None).cast("string").alias("title"), "words", "tags", "dom_hash", "dom", "txt", F.concat(P.bands(F.col("dom"), 0), P.bands(F.col("txt"), 1)).alias("bands"), F.lit(None).cast("int").alias("icon"), F.lit(None).cast("long").alias("look"), "host")
    none = spark.createDataFrame([], "icon int")
    found = S.compared(S.whole_pairs(S.buckets(lib, none), lib, words=4, looks=-1), lib, none).where("match")
    side = lambda k: lib.select(F.col("id").alias(k), F.col("host").alias(f"{k}_host"))
    return found.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_host", "b_host", "points", "percent")


@query("a05_common_icons", f"with {LIB_SQL} select icon from icons")
def a05(spark, sf):
    return S.common_icons(library(spark, sf))


@query("j02_buckets", f"with {LIB_SQL} select kind, value, id, size from keys join bk using (kind, value)")
def j02(spark, sf):
    lib = library(spark, sf)
    return S.buckets(lib, S.common_icons(lib))


PAIR_SQL = (
    "kk as (select keys.*, size from keys join bk using (kind, value)), pl as (select kind, value, size, id, row_number() over (partition by kind, value order by coalesce(dom_hash, ''), coalesce(txt, 0), id) - 1 as pos, greatest(size // 10, 1) as step from kk join lib using (id) where size > 48), "
    "prs as (select x.id as a, y.id as b from kk x join kk y using (kind, value) where x.size <= 48 and x.id < y.id union select least(x.id, y.id), greatest(x.id, y.id) from pl x join pl y on x.kind = y.kind and x.value = y.value and y.pos between x.pos + 1 and x.pos + 6 union select least(x.id, y.id), greatest(x.id, y.id) from pl x join pl y on x.kind = y.kind and x.value = y.value where x.id <> y.id and y.pos % y.step = 0 and y.pos / y.step < 10), "
    f"sc as (select prs.a, prs.b, x.dom_hash = y.dom_hash as same, bit_count(xor(x.txt, y.txt)) as d, x.icon = y.icon and x.icon not in (select icon from icons) as ic from prs join lib x on x.id = prs.a join lib y on y.id = prs.b), pts as (select a, b, case when same then 1.5 else 0 end + coalesce(case when d <= 4 then 2.0 when d <= 8 then 1.25 when d <= 12 then 0.5 end, 0) + case when ic then 1.0 else 0 end as points, coalesce(same, false)::int + coalesce(d <= 12, false)::int + coalesce(ic, false)::int as k, coalesce(d <= 12, false) or coalesce(ic, false) as content from sc), m as (select * from pts where points >= 3.0 and k >= 2 and content)"
)


@query("j03_pairs", f"with {LIB_SQL}, {PAIR_SQL} select a, b from prs")
def j03(spark, sf):
    lib = library(spark, sf)
    return S.pairs(S.buckets(lib, S.common_icons(lib)), lib)


def matches(spark, sf, lib):
    """Matching pairs of the library; made once and then read."""
    icons = S.common_icons(lib)
    return kept(spark, "matches", [lib], lambda: S.compared(S.pairs(S.buckets(lib, icons), lib), lib, icons).where("match"))


@query("g01_likeness", f"with {LIB_SQL}, {PAIR_SQL} select a, b, round(points, 2)::double as points, k as n_kinds from m")
def g01b(spark, sf):
    return matches(spark, sf, library(spark, sf)).select("a", "b", "points", F.size("kinds").alias("n_kinds"))


G2_SQL = "ed as (select a, b from m union select b, a from m), cc as (with recursive r(n, c) as (select a, a from ed union select ed.b, r.c from r join ed on ed.a = r.n where r.c < ed.b) select n as id, min(c) as component from r group by n)"


@query("g02_groups", f"with {LIB_SQL}, {PAIR_SQL}, {G2_SQL} select id, component from cc")
def g02(spark, sf):
    return S.grouped(matches(spark, sf, library(spark, sf)))


@query("g02_recall")
def g02_recall(spark, sf):
    """How many matches of every fiftieth page with whole buckets the groups hold, though large buckets are not compared in full."""
    lib = library(spark, sf)
    return S.recall(lib, S.common_icons(lib), S.grouped(matches(spark, sf, lib)))


FAM_SQL = "mem as (select lib.id, component, label, site, brand from cc join lib using (id)), fam as (select component, count(*) as size, count(distinct site) as sites, count(*) filter (label = 'phish') as scams, count(*) filter (label = 'benign') as ordinary from mem group by 1), fk as (select * from fam where size >= 3 and sites >= 2 and scams >= 2 and not (ordinary >= 2 and scams / (scams + ordinary) < 0.6)), tb as (select component, brand, count(*) as n, min(id) as f from mem where label = 'phish' group by all), tt as (select component, sum(n) as t from tb group by 1), tr as (select tb.component, brand, n, t, row_number() over (partition by tb.component order by n desc, f) as r from tb join tt using (component) where brand is not null)"


def member_rows(groups, lib):
    """Grouped pages with what families are judged by; documents have no scam type, title or thumbnail."""
    none = F.lit(None).cast("string")
    return groups.join(lib, "id").select("id", "component", "label", "site", "brand", none.alias("scam_type"), none.alias("title"), F.lit("2024-01-01").cast("timestamp").alias("seen_at"), F.lit(False).alias("has_thumb"))


@query("a06_families", f"with {LIB_SQL}, {PAIR_SQL}, {G2_SQL}, {FAM_SQL} select component as id, size, sites, brand, case when brand is null then 'unnamed scam kit' else 'fake ' || brand || ' page' end as label, round(n / t, 2) as purity from fk left join (select component, case when n / t >= 0.5 then brand end as brand, n, t from tr where r = 1) using (component)")
def a06(spark, sf):
    """Families of scam pages with their name and brand purity."""
    lib = library(spark, sf)
    mem = member_rows(S.grouped(matches(spark, sf, lib)), lib)
    return S.families(mem).select("id", "size", "sites", "brand", "label", "purity")


@query("a08_weighted_purity", f"with {LIB_SQL}, {PAIR_SQL}, {G2_SQL}, {FAM_SQL} select coalesce(round(sum(round(n / t, 2) * size) / sum(size), 4), 0) as purity from fk left join (select component, n, t from tr where r = 1) using (component)")
def a08(spark, sf):
    return a06(spark, sf).agg(F.coalesce(F.round(F.sum(F.col("purity") * F.col("size")) / F.sum("size"), 4), F.lit(0.0)).alias("purity"))


@query("s13_replace_families", f"with {LIB_SQL}, {PAIR_SQL}, {G2_SQL}, {FAM_SQL}, nf as (select id, component from mem where component in (select component from fk)), old as (select id, id % 7 as family from lib where id % 3 = 0) select coalesce(nf.id, old.id) as id, old.family as before, nf.component as after from nf full join old using (id) where old.family is distinct from nf.component")
def s13(spark, sf):
    """Pages whose family changes: members that leave, members that come or move."""
    lib = library(spark, sf)
    groups = cut(S.grouped(matches(spark, sf, lib)), "groups")
    fam = S.families(member_rows(groups, lib)).select(F.col("id").alias("component"))
    new = groups.join(fam, "component", "left_semi").select("id", F.col("component").alias("after"))
    old = lib.where("id % 3 = 0").select("id", (F.col("id") % 7).alias("before"))
    return new.join(old, "id", "full").where(~F.col("before").eqNullSafe(F.col("after"))).select("id", "before", "after")


@query("j01_g04_lookup", f"with {LIB_SQL}, k2 as (select id, value as key from (select lib.id, cast((4 + i) * 65536 + ((u >> (16 * i)::integer) & 65535) as varchar) as value from lib join uu using (id), range(4) r(i) union all select id, 'd' || dom_hash from lib where dom_hash is not null union all select id, 'i' || icon from lib)), h as (select distinct p.id as probe, l.id from k2 p join k2 l using (key) where p.id % 100 = 0 and p.id <> l.id), r as (select probe, h.id, row_number() over (partition by probe order by label <> 'phish', h.id) as n from h join lib using (id)), c as (select * from r where n <= 800), s as (select probe, c.id, x.dom_hash = y.dom_hash as same, bit_count(xor(x.txt, y.txt)) as d, x.icon = y.icon as ic from c join lib x on x.id = c.probe join lib y on y.id = c.id), pt as (select probe, id, round(case when same then 1.5 else 0 end + coalesce(case when d <= 4 then 2.0 when d <= 8 then 1.25 when d <= 12 then 0.5 end, 0) + case when ic then 1.0 else 0 end, 2)::double as points, cast(round_even((case when same then 1.0 else 0 end + coalesce(1 - d / 64.0, 0)) * 100 / (coalesce(same, false)::int + (d is not null)::int), 0) as integer) as percent from s where coalesce(same, false)::int + coalesce(d <= 12, false)::int + coalesce(ic, false)::int >= 2), w as (select *, row_number() over (partition by probe order by points desc, percent desc, id) as rank from pt where points >= 3.0) select probe, id, points, percent, rank from w where rank <= 12")
def j01(spark, sf):
    """Closest library pages of every hundredth page: candidates, likeness, rank."""
    from pyspark.sql import Window as W

    lib = library(spark, sf)
    c = S.lookup(lib.where("id % 100 = 0"), lib.withColumn("family_id", F.lit(None).cast("long")))
    none = spark.createDataFrame([], "icon int")
    alike = S.compared(c.select(F.col("probe").alias("a"), F.col("id").alias("b")), lib, none).where("match")
    w = W.partitionBy("a").orderBy(F.desc("points"), F.desc("percent"), "b")
    return alike.withColumn("rank", F.row_number().over(w)).where("rank <= 12").select(F.col("a").alias("probe"), F.col("b").alias("id"), "points", "percent", "rank")


VERDICT_SQL = """fm as (select id, component as fam from mem where component in (select component from fk)),
k2 as (select id, value as key from (select lib.id, cast((4 + i) * 65536 + ((u >> (16 * i)::integer) & 65535) as varchar) as value from lib join uu using (id), range(4) r(i) union all select id, 'd' || dom_hash from lib where dom_hash is not null union all select id, 'i' || icon from lib)),
h as (select distinct p.id as probe, l.id from k2 p join k2 l using (key) where p.id % 100 = 0 and p.id <> l.id),
r as (select probe, h.id, row_number() over (partition by probe order by fam is null, label <> 'phish', h.id) as n from h join lib using (id) left join fm using (id)),
s as (select probe, r.id, x.dom_hash = y.dom_hash as same, bit_count(xor(x.txt, y.txt)) as d, x.icon = y.icon and x.icon not in (select icon from icons) as ic, y.label, y.site, x.site as own from r join lib x on x.id = probe join lib y on y.id = r.id where n <= 800),
pt as (select *, round(case when same then 1.5 else 0 end + coalesce(case when d <= 4 then 2.0 when d <= 8 then 1.25 when d <= 12 then 0.5 end, 0) + case when ic then 1.0 else 0 end, 2)::double as points, cast(round_even((case when same then 1.0 else 0 end + coalesce(1 - d / 64.0, 0)) * 100 / (coalesce(same, false)::int + (d is not null)::int), 0) as integer) as percent from s where coalesce(same, false)::int + coalesce(d <= 12, false)::int + coalesce(ic, false)::int >= 2),
w as (select pt.*, fam, row_number() over (partition by probe order by points desc, percent desc, pt.id) as rank from pt left join fm using (id) where points >= 3.0 and OWN)"""
STATUS_SQL = """nf as (select probe, fam, count(*) as n, max(percent) as p from w where fam is not null group by all), bf as (select probe, arg_max(fam, (n, -fam)) as fam, arg_max(p, (n, -fam)) as p from nf group by 1),
rs as (select probe, count(*) filter (label = 'phish') as scams, arg_min(percent, rank) filter (label = 'phish') as alike, count(*) filter (label = 'benign' and d <= 12 and percent >= 85) as originals, arg_min(site, rank) filter (label = 'benign' and d <= 12 and percent >= 85) as original from w group by 1),
v as (select lib.id as probe, bf.fam, bf.p, coalesce(scams, 0) as scams, alike, original, case when (dom_hash is null and txt is null) or words < 20 then 'skipped' when bf.fam is not null then 'matched' when scams > 0 then 'similar' when originals > 0 then 'copy' else 'none' end as status from lib left join bf on bf.probe = id left join rs on rs.probe = id where id % 100 = 0)
select probe, status, case when status = 'matched' then fam end as family_id, case status when 'matched' then p when 'similar' then alike end as percent, case when status = 'skipped' then 0 else scams end as scam_matches, case when status = 'copy' then original end as copied_site from v"""


def probed(spark, sf, elsewhere):
    """(probes, matches) of every hundredth page against the whole library, ranked; only those on other sites, among 800 candidates, if `elsewhere`."""
    lib = library(spark, sf)
    groups = cut(S.grouped(matches(spark, sf, lib)), "groups")
    fam = S.families(member_rows(groups, lib)).select(F.col("id").alias("component"))
    known = lib.join(groups.join(fam, "component", "left_semi").select("id", F.col("component").alias("family_id")), "id", "left")
    probes = lib.where("id % 100 = 0")
    icons = S.common_icons(lib)
    c = S.lookup(probes, known) if elsewhere else S.whole_lookup(probes, lib, icons)
    alike = S.compared(c.select(F.col("probe").alias("a"), F.col("id").alias("b")), lib, icons).where("match").withColumnsRenamed({"a": "probe", "b": "id"})
    rows = alike.join(c.select("probe", "id", "label", "site", "family_id"), ["probe", "id"]) if elsewhere else alike.join(known.select("id", "label", "site", "family_id").hint("merge"), "id")
    rows = rows.join(probes.select(F.col("id").alias("probe"), F.col("site").alias("own_site")), "probe")
    rows = rows.where("not (site <=> own_site)") if elsewhere else rows
    return probes, S.best_first(rows.drop("own_site"), "probe")


@query("g04_verdict", f"with {LIB_SQL}, {PAIR_SQL}, {G2_SQL}, {FAM_SQL}, {VERDICT_SQL.replace('OWN', 'true').replace(' where n <= 800', '')}, {STATUS_SQL}")
def g04(spark, sf):
    """What the library says of every hundredth page: matched to a family, similar to scams, a copy, none, or skipped."""
    return S.verdicts(*probed(spark, sf, False))


@query("g05_same_design", f"with {LIB_SQL}, {PAIR_SQL}, {G2_SQL}, {FAM_SQL}, {VERDICT_SQL.replace('OWN', 'site <> own')}, k as (select probe, site as name, percent, rank, label, percent || '% alike: ' || case when same and d <= 12 and ic then 'the same page structure, nearly the same wording and the same site icon' when same and d <= 12 then 'the same page structure and nearly the same wording' when same then 'the same page structure and the same site icon' else 'nearly the same wording and the same site icon' end as why from w) select probe, name, arg_min(why, rank) as why, bool_or(label = 'phish') as known_scam from k group by all")
def g05b(spark, sf):
    """Other sites that share a page's design, one row a site."""
    probes, found = probed(spark, sf, True)
    return S.same_design(found, probes.select(F.col("id").alias("probe"), F.col("site").alias("own_site")))


@query("a04_family_board", f"with {LIB_SQL}, {PAIR_SQL}, {G2_SQL}, {FAM_SQL} (select 'family' as board, cast(component as varchar) as name, size as n from fk order by size desc, component limit 8) union all (select 'brand', brand, count(*) from lib where label = 'phish' and brand is not null group by 2 order by 3 desc, 2 limit 10)")
def a04(spark, sf):
    """The largest families and the brands copied most."""
    fam = a06(spark, sf).orderBy(F.desc("size"), "id").limit(8).select(F.lit("family").alias("board"), F.col("id").cast("string").alias("name"), F.col("size").alias("n"))
    lib = library(spark, sf).where("label = 'phish' and brand is not null").groupBy("brand").agg(F.count("*").alias("n"))
    return fam.unionByName(lib.orderBy(F.desc("n"), "brand").limit(10).select(F.lit("brand").alias("board"), F.col("brand").alias("name"), "n"))


TITLE_NOUNS = "case lang when 'de' then 'shop' when 'en' then 'banking' when 'es' then 'prize' end"


@query("g03_names", f"select doc_id, case when brand is not null and noun is not null then 'fake ' || brand || ' ' || noun when brand is not null then 'fake ' || brand || ' page' when noun is not null then noun || ' with no clear brand' when title is not null then 'pages titled \"' || substr(title, 1, 40) || '\"' else 'unnamed scam kit' end as name from (select doc_id, case when doc_id % 2 = 0 then source end as brand, case {TITLE_NOUNS} when 'shop' then 'shop' when 'banking' then 'banking page' when 'prize' then 'prize page' end as noun, case when doc_id % 3 = 0 then text end as title from documents)")
def g03(spark, sf):
    """What a family is called from its brand, type and title."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", S.named(F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.expr(TITLE_NOUNS), F.when(F.col("doc_id") % 3 == 0, F.col("text"))).alias("name"))


@query("j05_left_families", f"with {LIB_SQL}, {PAIR_SQL}, {G2_SQL}, {FAM_SQL} select id, component as family from mem where component not in (select component from fk)")
def j05(spark, sf):
    """Pages of groups that are no family (any more): those whose family must be cleared."""
    lib = library(spark, sf)
    groups = cut(S.grouped(matches(spark, sf, lib)), "groups")
    fam = S.families(member_rows(groups, lib)).select(F.col("id").alias("component"))
    return groups.join(fam, "component", "left_anti").select("id", F.col("component").alias("family"))


@query("w03_ranked_matches", f"with {LIB_SQL}, {PAIR_SQL}, mp as (select a, b, round(points, 2)::double as points, cast(round_even((case when same then 1.0 else 0 end + coalesce(1 - d / 64.0, 0)) * 100 / (coalesce(same, false)::int + (d is not null)::int), 0) as integer) as percent from m join sc using (a, b)), x as (select * from mp union all select b, a, points, percent from mp), r as (select *, row_number() over (partition by a order by points desc, percent desc, b)::integer as rank from x) select a as id, b as other, points, percent, rank from r where rank <= 12")
def w03(spark, sf):
    """The twelve best matches of each page: points, then percent, then the lower id."""
    from pyspark.sql import Window as W

    m = cut(matches(spark, sf, library(spark, sf)).select("a", "b", "points", "percent"), "matches")
    both = m.unionByName(m.select(F.col("b").alias("a"), F.col("a").alias("b"), "points", "percent"))
    w = W.partitionBy("a").orderBy(F.desc("points"), F.desc("percent"), "b")
    return both.withColumn("rank", F.row_number().over(w)).where("rank <= 12").select(F.col("a").alias("id"), F.col("b").alias("other"), "points", "percent", "rank")


@query("g05_described", f"with {LIB_SQL}, {PAIR_SQL} select m.a, m.b, case when same and d <= 12 and ic then 'the same page structure, nearly the same wording and the same site icon' when same and d <= 12 then 'the same page structure and nearly the same wording' when same then 'the same page structure and the same site icon' else 'nearly the same wording and the same site icon' end as alike from m join sc using (a, b)")
def g05(spark, sf):
    return matches(spark, sf, library(spark, sf)).select("a", "b", S.described(F.col("kinds")).alias("alike"))


@query("p03_boilerplate", "select page_id, html_title as title, regexp_matches(html_title, '(?i)suspended|not found|\\b40[34]\\b|forbidden') as notice from (select page_id, case page_id % 5 when 0 then 'Error 404' when 1 then 'Account Suspended' else 'fine' end as html_title from pages)")
def p03(spark, sf):
    t = F.expr("case page_id % 5 when 0 then 'Error 404' when 1 then 'Account Suspended' else 'fine' end")
    return table(spark, sf, "pages").select("page_id", t.alias("title")).select("page_id", "title", S.boilerplate(F.col("title"), F.lit(None).cast("int")).alias("notice"))
