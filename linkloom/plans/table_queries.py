"""Queries on sources, sinks, filters, joins, aggregates, windows and sets over events, orders, parts and documents."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.functions import links as L
from linkloom.operators import answers as A
from linkloom.operators import links as LT
from linkloom.operators import tables as T
from linkloom.operators.ranking import ranked
from linkloom.plans.link_queries import HOST_SQL, PAGE_SITES, with_sites
from linkloom.plans.registry import query
from linkloom.session import folder, table
from linkloom.sources import tables as D

VERDICT_SQL = "case event_type when 'error' then 'dangerous' when 'click' then 'suspicious' else 'safe' end"


def events(spark, sf):
    return table(spark, sf, "events").withColumn("verdict", F.expr(VERDICT_SQL))


# --- sources and sinks ---------------------------------------------------------------------------------------------


@query("s01_s02_admit", "select page_id, url, length(substr(html, 1, 2000000)) as kept from pages where length(html) >= 200 and regexp_matches(url, '^https?://') and page_id not in (select page_id from pages where page_id % 9 = 0)")
def s01(spark, sf):
    """Columns wanted, html cut to two million characters, rows that qualify, those already loaded left out."""
    p = table(spark, sf, "pages").select("page_id", "url", F.substring("html", 1, 2_000_000).alias("html"))
    done = p.where("page_id % 9 = 0").select("page_id")
    return p.where((F.length("html") >= 200) & F.col("url").rlike("^https?://")).join(done, "page_id", "left_anti").select("page_id", "url", F.length("html").alias("kept"))


@query("s01_rows", "select doc_id, place from (select doc_id, row_number() over () - 1 as place from documents) where place >= (select count(*) // 5 from documents) and place < (select count(*) // 5 + count(*) // 2 from documents)")
def s01_rows(spark, sf):
    """Half of a dataset after its first fifth, in dataset order; files wholly outside are not opened."""
    from linkloom.sources.dataset import files, read_rows

    n = files(spark, f"{sf}/documents.parquet").agg(F.sum("rows")).first()[0]
    return read_rows(spark, f"{sf}/documents.parquet", ["doc_id"], skip=n // 5, limit=n // 2)


@query("s03_s04_features", "select doc_id, cast(n_chars % 100 as smallint) as rule_score, cast(n_chars as float) as chars, lang as split from documents")
def s03(spark, sf):
    """A feature table written by split as zstd Parquet, read back behind a schema gate."""
    rows = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 100).cast("smallint").alias("rule_score"), F.col("n_chars").cast("float").alias("chars"), F.col("lang").alias("split"))
    return D.read_features(spark, D.write_features(rows, "split"), ["doc_id", "rule_score", "chars", "split"])


@query("s05_feed_lines", "with r as (select event_id, case event_id % 5 when 0 then '# note' when 1 then '' when 2 then 'hxxps://a' || (event_id % 50) || '[.]com/x' when 3 then '  https://a' || (event_id % 50) || '.com/x ' else 'http://localhost/' end as line from events), c as (select event_id, replace(replace(trim(line), 'hxxps', 'https'), '[.]', '.') as url from r where event_id % 5 in (2, 3)) select url, min(event_id) as first_pos from c group by url")
def s05(spark, sf):
    """A feed of text lines: comments, blanks and refused links dropped, links cleaned, first place kept."""
    line = F.expr("case event_id % 5 when 0 then '# note' when 1 then '' when 2 then concat('hxxps://a', event_id % 50, '[.]com/x') when 3 then concat('  https://a', event_id % 50, '.com/x ') else 'http://localhost/' end")
    return D.feed_lines(table(spark, sf, "events").select(F.col("event_id").alias("pos"), line.alias("line"))).select("url", F.col("pos").alias("first_pos"))


@query("s06_feeds", "select event_type as feed, event_id, row_number() over (partition by event_type order by ts desc, event_id) as n from events")
def s06(spark, sf):
    """Every feed's entries from the newest."""
    return table(spark, sf, "events").select(F.col("event_type").alias("feed"), "event_id", "ts").withColumn("n", F.row_number().over(W.partitionBy("feed").orderBy(F.desc("ts"), "event_id"))).drop("ts")


@query("s07_popularity", f"with {PAGE_SITES}, t as (select site, count(*) as c from h group by 1), r as (select site, cast(row_number() over (order by c desc, site) as integer) as rank from t) select page_id, site, case when rank <= 40 then rank end as rank, case when rank <= 40 then 'L' || (select count(*) from t) end as list_id from h left join r using (site)")
def s07(spark, sf):
    """A popularity list (here: sites by pages, written as its lines with a header) joined to pages; ranks beyond the list are null."""
    s = with_sites(spark, sf)
    counted = s.groupBy("site").agg((-F.count("*")).alias("less")).withColumn("all", F.lit(0))
    placed = ranked(counted, ["all"], ["less", "site"], "pos")
    lines = placed.select("pos", F.concat(F.col("pos").cast("string"), F.lit(","), F.upper("site")).alias("line")).unionByName(placed.agg(F.lit(0).cast("long").alias("pos"), F.concat(F.lit("#list_id=L"), F.count("*").cast("string")).alias("line")))
    return s.select("page_id", "site").join(T.popularity(lines, most=40).withColumnRenamed("domain", "site"), "site", "left").select("page_id", "site", "rank", "list_id")


@query("s08_brand_dimension", "select distinct p_brand as name, lower(p_brand) as label from part")
def s08(spark, sf):
    """The brand dimension as JSON lines read back by schema, one row per label."""
    b = table(spark, sf, "part").select(F.col("p_brand").alias("name")).distinct().select("name", F.array(F.lower("name")).alias("labels"), F.array(F.concat(F.lit("="), "name")).alias("keywords"))
    return D.json_round_trip(b).select("name", F.explode("labels").alias("label"))


@query("s09_block_lists", f"with {PAGE_SITES} select 'domain' as list, site as key from h where page_id % 11 = 0 group by 2 union all select 'link', host || coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') from h where page_id % 7 = 0 group by 2")
def s09(spark, sf):
    """Links keyed by host and path, domains by lower-cased name; one row per key, lists of any size."""
    s = with_sites(spark, sf)
    path = F.coalesce(F.nullif(L.path(F.col("url")), F.lit("")), F.lit("/"))
    links = s.where("page_id % 7 = 0").select(F.lit("link").alias("list"), F.concat("host", path).alias("key"))
    return links.unionByName(s.where("page_id % 11 = 0").select(F.lit("domain").alias("list"), F.lower("site").alias("key"))).distinct()


@query("s10_library_scan", "select doc_id as id, source as site, n_chars, text is not null as has_thumb from documents order by 1")
def s10(spark, sf):
    """The library without its wide column, which becomes a flag before anything is moved."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("site"), "n_chars", F.col("text").isNotNull().alias("has_thumb"))


@query("s11_upsert", "with old as (select o_orderkey as k, o_orderpriority as v, 0 as b from orders where o_orderkey % 3 <> 0), new as (select o_orderkey, o_orderstatus, 1 from orders where o_orderkey % 5 = 0), u as (select * from old union all select * from new) select k, arg_max(v, b) as v from u group by k")
def s11(spark, sf):
    o = table(spark, sf, "orders")
    old = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("v"))
    return D.upsert(old, o.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v")), ["k"])


@query("s12_insert_absent", "select o_custkey as k, min(o_orderkey) as v, 'old' as origin from orders where o_orderkey % 2 = 0 group by 1 union all select o_custkey, min(o_orderkey), 'new' from orders where o_orderkey % 2 = 1 and o_custkey not in (select o_custkey from orders where o_orderkey % 2 = 0) group by 1")
def s12(spark, sf):
    o = table(spark, sf, "orders")
    part = lambda r, n: o.where(f"o_orderkey % 2 = {r}").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderkey").alias("v")).withColumn("origin", F.lit(n))
    return D.insert_absent(part(0, "old"), part(1, "new"), ["k"])


@query("s14_retention", "select event_id, case when ts < timestamp '2024-01-20 00:00:00' then null else props end as props from events where not (event_type = 'view' and ts < timestamp '2024-01-10 00:00:00')")
def s14(spark, sf):
    """Old thumbnails to null, expired rows out, as of a given day."""
    e = table(spark, sf, "events")
    return D.retained(e, "ts", F.lit("2024-01-30").cast("timestamp"), {"props": 10}, (F.col("event_type") == "view"), 20).select("event_id", "props")


TABLE_SQL = """with o as (select o_orderkey as k, o_custkey as c, o_orderpriority as v, cast(o_orderdate as date) as day from orders),
old as (select * from o where k % 3 <> 0), up as (select k, c, 'up' as v, day from o where k % 5 = 0), u as (select * from old where k not in (select k from up) union all select * from up),
i as (select * from u union all select k, c, 'added' as v, day from o where k % 7 = 0 and k not in (select k from u))
select k, c, case when day < date '1995-01-01' then null else v end as v from i"""


@query("s11_s14_table", TABLE_SQL)
def s11_table(spark, sf):
    """A stored table through an upsert, an insert of what is absent and the retention of old rows, each in one step."""
    from linkloom.sources.snapshots import Table

    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("v"), F.col("o_orderdate").cast("date").alias("day"))
    t = Table(spark, f"{folder(spark)}/orders-{uuid.uuid4().hex}")
    t.create(o.where("k % 3 <> 0"), ["k"], 8)
    t.upsert(o.where("k % 5 = 0").withColumn("v", F.lit("up")))
    t.insert_absent(o.where("k % 7 = 0").withColumn("v", F.lit("added")))
    old = F.col("day") < "1995-01-01"
    t.change(old & F.col("v").isNotNull(), lambda d: d.withColumn("v", F.when(~old, F.col("v"))))
    return t.read().select("k", "c", "v")


@query("s13_one_step", "with o as (select o_custkey as k, min(o_orderkey) as family from orders where o_orderkey % 2 = 0 group by 1), n as (select o_custkey as k, min(o_orderkey) as family from orders where o_orderkey % 4 < 3 group by 1) select k, n.family as family, o.family is distinct from n.family as moved from n left join o using (k)")
def s13_table(spark, sf):
    """An assignment replaced in one step: readers of the version before go on with it, and what moved is the difference of the two."""
    from linkloom.sources.snapshots import Table

    first = lambda where: table(spark, sf, "orders").where(where).groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderkey").alias("family"))
    t = Table(spark, f"{folder(spark)}/families-{uuid.uuid4().hex}")
    before = t.create(first("o_orderkey % 2 = 0"), ["k"], 8)
    t.replace(first("o_orderkey % 4 < 3"))
    old = t.read(before.number).withColumnRenamed("family", "was")
    return t.read().join(old, "k", "left").select("k", "family", (~F.col("family").eqNullSafe(F.col("was"))).alias("moved"))


@query("s15_a18_runs", "select event_type as job, true as ok, count(*) as fetched, count(*) filter (value > 100) as added, count(*) filter (event_id % 10 = 0) as failed, null as note from events group by 1 union all select 'broken', false, null, null, null, 'ValueError: no feed'")
def s15_runs(spark, sf):
    """A run for each kind of event, and one that fails, in the log of runs; counts are observed while the run reads its rows."""
    from linkloom.sources.snapshots import Table, run_logged

    e, log = table(spark, sf, "events"), Table(spark, f"{folder(spark)}/runs-{uuid.uuid4().hex}")
    for job in [r[0] for r in e.select("event_type").distinct().collect()]:
        run_logged(log, job, e.where(F.col("event_type") == job), lambda d: d.where("value > 100").count(), failed=F.col("event_id") % 10 == 0)

    def broken(_):
        raise ValueError("no feed")

    try:
        run_logged(log, "broken", e, broken)
    except ValueError:
        pass  # it is in the log
    return log.read().select("job", "ok", "fetched", "added", "failed", "note")


@query("s15_run_log", "select event_type as job, count(*) as fetched, count(*) filter (value > 100) as added, count(*) filter (value is null) as failed, min(ts) as started_at, max(ts) as finished_at, true as ok from events group by 1")
def s15(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("job")).agg(F.count("*").alias("fetched"), F.count_if(F.col("value") > 100).alias("added"), F.count_if(F.col("value").isNull()).alias("failed"), F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"), F.lit(True).alias("ok"))


@query("s16_json_lines", "select page_id, url from pages")
def s16(spark, sf):
    """Rows written as JSON lines and read back by a fixed schema."""
    return D.json_round_trip(table(spark, sf, "pages").select("page_id", "url"))


@query("s17_scan_documents", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, 'ok' as comparison from events")
def s17(spark, sf):
    """An open JSON column read into a struct, one path of it replaced."""
    doc = F.from_json("props", "k long").withField("comparison", F.lit("ok"))
    return table(spark, sf, "events").select("event_id", doc.alias("d")).select("event_id", "d.k", "d.comparison")


@query("s18_lookup_cache", "select user_id as key, arg_max(value, ts) as value from events where ts + interval 5 days > timestamp '2024-01-29 00:00:00' group by 1")
def s18(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("key"), "value", "ts", (F.col("ts") + F.expr("interval 5 days")).alias("expires_at"))
    return D.still_valid(e, F.lit("2024-01-29").cast("timestamp"))


@query("s19_annotated", "select o_orderkey, 'https://x.com/' || o_orderkey as url, case when o_orderkey % 3 = 0 then null else o_orderpriority end as note from orders where o_orderkey % 4 <> 0")
def s19(spark, sf):
    line = F.expr("case when o_orderkey % 4 = 0 then '# skip' else concat(' https://x.com/', o_orderkey, ' | ', case when o_orderkey % 3 = 0 then '' else o_orderpriority end) end")
    rows = table(spark, sf, "orders").select("o_orderkey", F.trim(line).alias("l")).where("l not like '#%'")
    bit = F.split("l", "[|]", 2)
    return rows.select("o_orderkey", F.trim(bit[0]).alias("url"), F.nullif(F.trim(bit[1]), F.lit("")).alias("note"))


#: Certificate rows of two providers over orders; the same text in both dialects.
DOMAIN = "'d' || (o_custkey % 50) || '.com'"
LINES = "'*.D' || (o_custkey % 50) || '.com' || chr(10) || 'a' || (o_orderkey % 9) || '.d' || (o_custkey % 50) || '.com' || chr(10) || 'x.e' || (o_orderkey % 40) || '.org' || chr(10)"
CERT_SQL = f"""with l as (select {DOMAIN} as domain, o_orderkey % 4000 as id, o_orderdate as d, {LINES} as v, o_orderpriority as o from orders where o_orderkey % 3 > 0),
f as (select domain, id, min((d, v, o)) as m from l group by all), c as (select 'log' as source, domain, m[1] as d, m[2] as v, m[3] as issuer from (select domain, id, [cast(struct_extract(m, 1) as varchar), struct_extract(m, 2), struct_extract(m, 3)] as m from f)
union all select 'current', {DOMAIN}, cast(o_orderdate as varchar), 'b' || (o_orderkey % 40) || '.d' || (o_custkey % 50) || '.com' || chr(10) || 'd1.com', case when o_orderkey % 4 > 0 then o_orderstatus end from orders where o_orderkey % 3 = 0),
i as (select source, domain, issuer, count(*) as n from c where issuer is not null group by all), r as (select *, row_number() over (partition by source, domain order by n desc, issuer) as k from i),
n as (select distinct source, domain, regexp_replace(lower(trim(x)), '^\\*\\.', '') as name from (select source, domain, unnest(string_split(v, chr(10))) as x from c)),
t as (select distinct source, domain, ends_with(name, '.' || domain) as below, case when ends_with(name, '.' || domain) then name else array_to_string(string_split(name, '.')[-2:], '.') end as name from n where name <> '' and name <> domain),
q as (select *, row_number() over (partition by source, domain, below order by name) as k from t where name <> domain)
select source, domain, count(*) as certs, cast(min(d) as date) as first_seen, cast(max(d) as date) as latest, coalesce((select string_agg(issuer, '+' order by k) from r where r.source = c.source and r.domain = c.domain and k <= 3), '') as issuers,
coalesce((select string_agg(name, ',' order by name) from q where q.source = c.source and q.domain = c.domain and below and k <= 30), '') as subdomains, coalesce((select string_agg(name, ',' order by name) from q where q.source = c.source and q.domain = c.domain and not below and k <= 30), '') as other_domains from c group by source, domain"""


@query("s20_a10_certificates", CERT_SQL)
def s20(spark, sf):
    """Certificates of two providers, the first row of each id; then the history of each domain."""
    from linkloom.operators import links as LT

    o = table(spark, sf, "orders").withColumn("domain", F.expr(DOMAIN)).withColumn("not_before", F.col("o_orderdate").cast("date"))
    log = o.where("o_orderkey % 3 > 0").select("domain", (F.col("o_orderkey") % 4000).alias("id"), "not_before", F.expr(LINES).alias("name_value"), F.concat(F.lit("C=US, O="), "o_orderpriority", F.lit(", CN=x")).alias("issuer_name"))
    names = F.array(F.concat(F.lit("b"), (F.col("o_orderkey") % 40).cast("string"), F.lit("."), "domain"), F.lit("d1.com"))
    current = o.where("o_orderkey % 3 = 0").select("domain", names.alias("dns_names"), "not_before", F.struct(F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderstatus")).alias("friendly_name")).alias("issuer"))
    found = D.certificate_history(D.certificates(log, current), lambda h: LT.sites(h, LT.suffix_table(spark)))
    return found.select("source", "domain", "certs", "first_seen", "latest", F.array_join("issuers", "+").alias("issuers"), F.array_join("subdomains", ",").alias("subdomains"), F.array_join("other_domains", ",").alias("other_domains"))


CARD = "\"vcardArray\":[\"vcard\",[[\"version\",{},\"text\",\"4.0\"],[\"%s\",{\"type\":\"x\"},\"text\",\"%s\"]]]"
REGISTRATION_DOC = (
    "'{\"events\":[{\"eventAction\":\"registration\",\"eventDate\":\"2001-0' || (1 + c_custkey % 9) || '-03T04:05:06Z\"},{\"eventAction\":\"expiration\",\"eventDate\":\"2030-01-01\"}],\"status\":[\"client hold\",\"ok\"],\"secureDNS\":{\"delegationSigned\":' || (case when c_custkey % 2 = 0 then 'true' else 'false' end) || '},"
    "\"nameservers\":[{\"ldhName\":\"NS' || c_nationkey || '.X\"},{\"ldhName\":\"a.x\"},{\"ldhName\":\"\"}],\"entities\":[' || case when c_custkey % 5 = 0 then '' else '{\"roles\":[\"registrar\"]," + CARD % ("fn", "' || c_mktsegment || '")
    + ",\"entities\":[{\"roles\":[\"abuse\"]," + CARD % ("email", "abuse@' || c_custkey || '.org") + "}]},' end || repeat('{\"roles\":[\"technical\"],\"entities\":[', 1 + cast(c_custkey % 6 as int)) || '{\"roles\":[\"registrant\"]," + CARD % ("org", "' || c_name || '") + "}' || repeat(']}', 1 + cast(c_custkey % 6 as int)) || ']}'"
)


@query("s21_registrations", "select c_custkey, case when c_custkey % 5 > 0 then c_mktsegment end as registrar, case when c_custkey % 5 > 0 then 'abuse@' || c_custkey || '.org' end as abuse, c_name as registrant, make_date(2001, 1 + (c_custkey % 9)::int, 3) as created, cast(null as varchar) as updated, '2030-01-01' as expires, cast(date_diff('day', make_date(2001, 1 + (c_custkey % 9)::int, 3), date '2002-01-01') as integer) as age_days, 'a.x,ns' || c_nationkey || '.x' as nameservers, 'client hold,ok' as flags, c_custkey % 2 = 0 as dnssec from customer")
def s21(spark, sf):
    """Registration documents with nested entities and contact cards to a flat table."""
    docs = table(spark, sf, "customer").select("c_custkey", F.expr(REGISTRATION_DOC).alias("doc"))
    return D.registrations(docs, "c_custkey", F.lit("2002-01-01").cast("date")).withColumn("nameservers", F.array_join("nameservers", ",")).withColumn("flags", F.array_join("flags", ","))


@query("s22_owner_columns", "select c_custkey, substr(repeat(c_name, 30), 1, 200) as title, substr('https://a.com/' || repeat('p', 1900 + (c_custkey % 300)::int), 1, 2000) as url, '2001-02-03' as domain_created, c_nationkey || '.ns,x.ns' as ns_key, array_to_string(list_transform(range(0, 25 + c_custkey % 10), lambda i: 'o' || i || '.org') || list_transform(range(0, least(15 - c_custkey % 10, 30)), lambda i: 'n' || i || '.net'), ',') as cert_domains from customer")
def s22(spark, sf):
    """What the library stores of a page's title, link, server and owner, cut to its lengths."""
    c = F.col("c_custkey")
    ns = F.array(F.lit("X.NS."), F.concat(F.col("c_nationkey").cast("string"), F.lit(".Ns")))
    named = lambda n, a, z: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit(a), i.cast("string"), F.lit(z)))
    others = named(25 + c % 10, "o", ".org")
    return table(spark, sf, "customer").select("c_custkey", *D.owner_columns(F.repeat("c_name", F.lit(30)), F.concat(F.lit("https://a.com/"), F.repeat(F.lit("p"), (1900 + c % 300).cast("int"))), F.lit("2001-02-03T04:05:06"), ns, others, F.concat(F.slice(others, 1, 3), named(F.lit(30), "n", ".net")))).withColumn("cert_domains", F.array_join("cert_domains", ","))


# --- predicates ----------------------------------------------------------------------------------------------------


#: Feed links by page number: notices, away pages and front pages beside the pages' own; the same text in both dialects.
FEED_URL = "case page_id % 9 when 0 then 'https://l.facebook.com/l.php?u=' || page_id when 1 then 'https://vk.com/away' || page_id when 2 then 'https://' || site || '/' when 3 then 'https://www.' || site when 4 then 'https://' || site || '/?q=' || page_id when 5 then 'https://m.' || site || '/' when 6 then 'https://vk.com/feed' else url end"
POPULAR_SQL = "p as (select site, cast(row_number() over (order by count(*) desc, site) as integer) as rank from h group by 1 having count(*) >= 3)"


@query("p01_noise", f"with {PAGE_SITES}, {POPULAR_SQL}, f as (select page_id, {FEED_URL} as url, site from h) select page_id, url, page_id % 9 in (0, 1) or (page_id % 9 in (2, 3) and site in (select site from p where rank <= 20)) or (page_id % 9 > 6 and regexp_matches(url, '^[a-z]+://[^/?#]*/?$') and string_split(url, '/')[3] = site and site in (select site from p where rank <= 20)) as noise from f")
def p01(spark, sf):
    """Feed links that are not worth a visit."""
    s = with_sites(spark, sf)
    first = s.groupBy("site").agg(F.count("*").alias("c")).where("c >= 3").withColumn("all", F.lit(0))
    popular = ranked(first.withColumn("less", -F.col("c")), ["all"], ["less", "site"], "rank").select("site", "rank")
    feed = s.select("page_id", "site", F.expr(FEED_URL).alias("url"))
    rows = LT.sites(feed.select("page_id", "url", L.host(F.col("url")).alias("host")), LT.suffix_table(spark)).join(popular, "site", "left")
    return rows.select("page_id", "url", A.noise(F.col("url"), F.col("host"), F.col("site"), F.lit(None).cast("string"), F.col("rank"), popular=20).alias("noise"))


@query("p02_dead", "select event_id, event_type = 'error' or value < 12 or event_id % 50 = 0 as dead from events")
def p02(spark, sf):
    return table(spark, sf, "events").select("event_id", T.looks_dead(F.when(F.col("event_type") == "error", 500).otherwise(200), F.lit(None).cast("string"), F.col("value"), F.when(F.col("event_id") % 50 == 0, "Access denied").otherwise("fine")).alias("dead"))


@query("p04_p05_p07", "select event_id, user_id <= 10 or (event_id % 2 = 0 and user_id % 3 = 0) as trusted, event_type = 'view' and value < 50 as bot_screen, case when event_type = 'error' then 'phish' when event_type in ('view', 'signup', 'purchase') and user_id <= 10 then 'benign' else 'unknown' end as label from events")
def p04(spark, sf):
    """Trusted sites, bot-check screens, and the label a scan gets in the library."""
    e = events(spark, sf)
    trusted = T.trusted(F.when(F.col("event_id") % 2 == 0, F.when(F.col("user_id") % 3 == 0, "brand")), F.lit(None).cast("string"), F.when(F.col("user_id") <= 10, F.col("user_id")))
    screen = T.bot_screen(F.when(F.col("event_type") == "view", "check"), F.lit(True), F.lit(0), F.col("value"))
    label = T.library_label(F.col("verdict"), F.lit(None).cast("string"), F.when(F.col("user_id") <= 10, F.col("user_id")))
    return e.select("event_id", trusted.alias("trusted"), screen.alias("bot_screen"), label.alias("label"))


@query("p06_private", "with b as (select user_id, case when event_id % 3 = 0 then 'H' || user_id || '.com' else 'other.com' end as host, case event_id % 4 when 0 then 'a Private address' when 1 then 'reserved' else 'too slow' end as reason from events where event_type = 'error' and value < 20) select user_id, coalesce(bool_or(lower(host) = 'h' || user_id || '.com' and regexp_matches(reason, '(?i)private|local|reserved')), false) as private from (select distinct user_id from events) u left join b using (user_id) group by 1")
def p06(spark, sf):
    """Callers whose own link led to a private address: the host that was blocked is that of the link, and the reason says so."""
    e, c = table(spark, sf, "events"), F.col("event_id")
    scans = e.select("user_id").distinct().withColumn("url", F.concat(F.lit("https://h"), "user_id", F.lit(".com/x")))
    host = F.when(c % 3 == 0, F.concat(F.lit("H"), "user_id", F.lit(".com"))).otherwise("other.com")
    reason = F.when(c % 4 == 0, "a Private address").when(c % 4 == 1, "reserved").otherwise("too slow")
    return T.led_to_private(scans, e.where("event_type = 'error' and value < 20").select("user_id", host.alias("host"), reason.alias("reason")), "user_id")


@query("p08_honest_rows", "select event_id, coalesce(case when event_id % 3 = 0 then 'https://final/' || event_id end, 'https://link/' || event_id) as link from events where event_type <> 'error' and not (event_type = 'view' and value < 50)")
def p08(spark, sf):
    e = table(spark, sf, "events").where("event_type <> 'error'").where(~T.bot_screen(F.when(F.col("event_type") == "view", "check"), F.lit(True), F.lit(0), F.col("value")))
    return e.select("event_id", F.coalesce(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("https://final/"), "event_id")), F.concat(F.lit("https://link/"), "event_id")).alias("link"))


# --- joins ---------------------------------------------------------------------------------------------------------


@query("j04_j14_j15_unseen", "select o_orderkey from orders where o_custkey not in (select o_custkey from orders where o_orderkey % 10 = 0)")
def j04(spark, sf):
    """Rows whose key a ledger has not seen."""
    o = table(spark, sf, "orders")
    return o.join(o.where("o_orderkey % 10 = 0").select("o_custkey").distinct(), "o_custkey", "left_anti").select("o_orderkey")


@query("j10_same_server", "select a.p_partkey as probe, b.p_brand as site, bool_or(b.p_size < 5) as scam from part a join part b on a.p_size = b.p_size and a.p_type = b.p_type and a.p_brand <> b.p_brand where a.p_partkey % 100 = 0 group by all")
def j10(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("/", F.col("p_size").cast("string"), "p_type").alias("ip"), F.col("p_brand").alias("site"), (F.col("p_size") < 5).alias("scam"))
    return T.same_server(p.where("id % 100 = 0"), p)


@query("j11_same_owner", "select a.o_orderkey as probe, b.o_orderkey as id from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderpriority = b.o_orderpriority and abs(date_diff('day', a.o_orderdate, b.o_orderdate)) <= 2 and a.o_orderkey <> b.o_orderkey")
def j11(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("ns_key"), F.col("o_orderpriority").alias("registrar"), F.col("o_orderdate").cast("date").alias("created"))
    return T.same_owner(o, o)


@query("j12_address_ranges", "with x as (select o_orderkey, (o_orderkey * 2654435761) % 4294967296 as ip from orders), r as (select s_suppkey, (s_suppkey * 40000000) % 4294967296 as lo, (s_suppkey * 40000000) % 4294967296 + 30000000 as hi, s_nationkey from supplier) select o_orderkey, arg_max(s_nationkey, (lo, s_suppkey)) as country from x join r on ip between lo and hi group by 1")
def j12(spark, sf):
    """Addresses to the narrowest range that holds them, by an equal join on /8 blocks and a range filter."""
    x = table(spark, sf, "orders").select("o_orderkey", ((F.col("o_orderkey") * 2654435761) % 4294967296).alias("ip"))
    lo = (F.col("s_suppkey") * 40000000) % 4294967296
    r = table(spark, sf, "supplier").select(lo.alias("lo"), (lo + 30000000).alias("hi"), F.col("s_suppkey").alias("tie"), F.col("s_nationkey").alias("country"))
    return T.in_ranges(x, r, "o_orderkey", "ip", ["country"])


@query("j13_merge", "select o.o_orderkey, coalesce(s.o_orderstatus, n.o_orderpriority, o.o_orderstatus) as value from orders o left join (select * from orders where o_orderkey % 2 = 0) s using (o_orderkey) left join (select * from orders where o_orderkey % 3 = 0) n using (o_orderkey)")
def j13(spark, sf):
    o = table(spark, sf, "orders")
    base = o.select("o_orderkey", F.col("o_orderstatus").alias("v"))
    return T.merged(base, [o.where("o_orderkey % 3 = 0").select("o_orderkey", F.col("o_orderpriority").alias("v")), o.where("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_orderstatus").alias("v"))], "o_orderkey", "v").withColumnRenamed("v", "value")


# --- aggregates ----------------------------------------------------------------------------------------------------


@query("a01_library_counts", "select source, count(*) filter (toxic = 1) as phish, count(*) filter (toxic = 0 and quality = 1) as benign, count(*) filter (toxic is null or (toxic = 0 and quality = 0)) as unknown, count(*) as total from documents left join labels using (doc_id) group by 1")
def a01(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").withColumn("label", F.when(F.col("toxic") == 1, "phish").when(F.col("quality") == 1, "benign").otherwise("unknown"))
    return d.groupBy("source").pivot("label", ["phish", "benign", "unknown"]).count().na.fill(0).withColumn("total", F.col("phish") + F.col("benign") + F.col("unknown"))


@query("a02_latest_run", "select event_type as job, event_id, value from events qualify row_number() over (partition by event_type order by ts desc, event_id desc) = 1")
def a02(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("job")).agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("m")).select("job", "m.event_id", "m.value")


@query("a03_trends", f"select cast(ts as date) as day, count(*) filter ({VERDICT_SQL} = 'safe') as safe, count(*) filter ({VERDICT_SQL} = 'suspicious') as suspicious, count(*) filter ({VERDICT_SQL} = 'dangerous') as dangerous from events where ts >= timestamp '2024-01-05' group by 1")
def a03(spark, sf):
    return T.daily_verdicts(events(spark, sf).where("ts >= timestamp '2024-01-05'"))


@query("a04_boards", "(select 'type' as board, event_type as name, count(*) as n from events group by 2 order by n desc, name limit 9) union all (select 'user', cast(user_id as varchar), count(*) as n from events group by 2 order by n desc, 2 limit 10)")
def a04(spark, sf):
    e = table(spark, sf, "events")
    board = lambda b, c, k: e.groupBy(c.alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(k).select(F.lit(b).alias("board"), "name", "n")
    return board("type", F.col("event_type"), 9).unionByName(board("user", F.col("user_id").cast("string"), 10))


@query("a07_top_share", "with c as (select o_custkey, o_orderpriority as p, count(*) as n, min(o_orderkey) as f from orders group by all), r as (select *, sum(n) over (partition by o_custkey) as t, row_number() over (partition by o_custkey order by n desc, f) as k from c) select o_custkey, case when n / t >= 0.4 then p end as priority from r where k = 1")
def a07(spark, sf):
    from linkloom.operators.similar import top_share

    o = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))
    return top_share(o, "o_custkey", "priority", 0.4)


ENGINE = "case event_type when 'view' then 'Alpha' when 'click' then 'beta' when 'error' then 'Gamma' when 'purchase' then 'delta' else event_type end || (event_id % 11)"
SAYS = "case event_id % 5 when 0 then 'malicious' when 1 then 'suspicious' when 2 then 'harmless' when 3 then 'undetected' else 'timeout' end"


@query("a11_vendors", f"with r as (select user_id, {ENGINE} as engine, min({SAYS}) as says from events group by all), c as (select user_id, string_agg(distinct event_type, ',' order by event_type) as categories from events where value > 100 group by 1) select user_id, {', '.join(f"count(*) filter (says = '{x}') as {x}" for x in A.STATS)}, count(*) as engines, coalesce(string_agg(engine || '=' || says, ',' order by says <> 'malicious', lower(engine), engine) filter (says in ('malicious', 'suspicious')), '') as flagged, coalesce(max(categories), '') as categories from r left join c using (user_id) group by 1")
def a11(spark, sf):
    """Vendor reports per link: counts by verdict, who flags it, malicious first, and the categories it is put in."""
    e = table(spark, sf, "events")
    results = e.select("user_id", F.expr(ENGINE).alias("engine"), F.expr(SAYS).alias("category"), F.lit("x").alias("label"))
    v = A.vendor_reports(results, e.where("value > 100").select("user_id", F.col("event_type").alias("category")), "user_id")
    flagged = F.array_join(F.transform("flagged", lambda x: F.concat_ws("=", x["engine"], x["category"])), ",")
    return v.select("user_id", *A.STATS, "engines", flagged.alias("flagged"), F.array_join("categories", ",").alias("categories"))


@query("a12_history", f"with r as (select *, {VERDICT_SQL} as verdict, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) select user_id, count(*) as scans, count(*) filter (verdict = 'dangerous') as dangerous, arg_min(verdict, n) as last_verdict, arg_min(value, n) as last_score from r where n <= 50 group by 1")
def a12(spark, sf):
    return T.history(events(spark, sf), "user_id", 50)


@query("a13_rates", "with x as (select doc_id, toxic as y, n_chars % 101 as score, c from documents join labels using (doc_id), (values (40), (60), (80), (95)) t(c)), k as (select c as cutoff, count(*) filter (y = 1 and score >= c) as tp, count(*) filter (y = 0 and score >= c) as fp, count(*) filter (y = 1 and score < c) as fn, count(*) filter (y = 0 and score < c) as tn from x group by 1) select cutoff, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) as false_alarms from k")
def a13(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(F.col("toxic").alias("y"), (F.col("n_chars") % 101).alias("score"))
    return T.rates(d, [40, 60, 80, 95])


@query("a14_group_weights", "with d as (select toxic as y, case when n_chars < 200 then 0 when n_chars < 1000 then 1 when n_chars < 3000 then 2 when n_chars < 8000 then 3 else 4 end as step, lang = 'en' as bare from documents join labels using (doc_id)), g as (select s as step, b as bare from range(5) t(s), (values (true), (false)) u(b)), c as (select step, bare, count(*) filter (y = 1) as scam, count(*) filter (y = 0) as honest from d group by all) select cast(g.step as integer) as step, g.bare, case when coalesce(honest, 0) = 0 then 1.0 else least(greatest(scam / honest, 1), 20) end as weight from g left join c using (step, bare)")
def a14(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(F.col("toxic").alias("y"), F.col("n_chars").alias("size"), (F.col("lang") == "en").alias("bare"))
    return T.group_weights(d, [200, 1000, 3000, 8000])


@query("a15_a16_sizes", "select case when n_chars < 200 then 0 when n_chars < 1000 then 1 when n_chars < 3000 then 2 when n_chars < 8000 then 3 else 4 end as step, count(*) as pages, count(*) filter (n_chars % 101 >= 60) as above, round(avg((n_chars % 101 >= 60)::int), 6) as share, count(*) filter (n_chars % 101 >= 80 and toxic = 0) as honest_above from documents join labels using (doc_id) group by 1")
def a15(spark, sf):
    """Result tables by size step, and honest pages above a bound."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").withColumn("score", F.col("n_chars") % 101)
    high = F.col("score") >= 60
    return d.groupBy(T.size_step(F.col("n_chars"), [200, 1000, 3000, 8000]).alias("step")).agg(F.count("*").alias("pages"), F.count_if(high).alias("above"), F.round(F.avg(high.cast("int")), 6).alias("share"), F.count_if((F.col("score") >= 80) & (F.col("toxic") == 0)).alias("honest_above"))


@query("a17_shared_links", "select user_id as link, string_agg(distinct event_type, '+' order by event_type) as feeds, count(distinct event_type) as n from events group by 1")
def a17(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("link")).agg(F.array_join(F.array_sort(F.collect_set("event_type")), "+").alias("feeds"), F.countDistinct("event_type").alias("n"))


@query("a18_run_totals", "select count(*) as read, count(*) filter (length(html) >= 2000) as kept, count(*) filter (length(html) < 2000) as skipped from pages")
def a18(spark, sf):
    return table(spark, sf, "pages").agg(F.count("*").alias("read"), F.count_if(F.length("html") >= 2000).alias("kept"), F.count_if(F.length("html") < 2000).alias("skipped"))


ANSWER_SQL = """with e as (select *, 'u' || event_id as url from events),
v as (select user_id, arg_max(event_id % 7, (event_id % 7, -event_id)) filter (event_id % 3 > 0) as bad, arg_max(event_id % 2, (event_id % 7, -event_id)) filter (event_id % 3 > 0) as sus, arg_max(url, (event_id % 7, -event_id)) filter (event_id % 3 > 0) as url from e where event_type = 'view' group by 1),
m as (select user_id, min(event_id) filter (event_id % 4 = 0 and value > 200) as link, min(event_id) filter (event_id % 4 > 0 and value > 120) as host from e where event_type = 'click' group by 1),
s as (select user_id, sum(event_id % 3) as total, count(*) filter (value > 180) as bad from e where event_type = 'purchase' group by 1),
a as (select user_id, 'virustotal' as source, case when bad is null then 'unknown' when bad >= 3 then 'listed' when bad > 0 or sus > 0 then 'info' else 'clean' end as status, case when bad >= 3 then url end as matched, coalesce(bad, 0) as bad from v
 union all select user_id, 'urlhaus', case when link is not null then 'listed' when host is null then 'clean' when host % 5 > 0 then 'listed' else 'info' end, case when link is not null then 'u' || link end, case when coalesce(link, host) is null then 0 else 2 end from m
 union all select user_id, 'urlscan', case when total = 0 then 'unknown' when bad > 0 then 'listed' else 'info' end, null, bad from s)"""


def folded(spark, sf):
    e = table(spark, sf, "events").withColumn("url", F.concat(F.lit("u"), "event_id"))
    of = lambda kind: e.where(F.col("event_type") == kind)
    c, n = F.col("event_id"), F.col("value")
    vendors = of("view").select("user_id", c.alias("pos"), "url", (c % 3 > 0).alias("known"), (c % 7).alias("malicious"), (c % 2).alias("suspicious"))
    malware = of("click").select("user_id", c.alias("pos"), F.when(c % 4 == 0, "url").otherwise("host").alias("kind"), F.col("url").alias("key"), F.when(n > F.when(c % 4 == 0, 200).otherwise(120), 2).otherwise(0).alias("hits"), (c % 5).alias("live"))
    scans = of("purchase").select("user_id", (c % 3).alias("total"), F.when(n > 180, 1).otherwise(0).alias("malicious"))
    return A.answers(vendors, malware, scans, "user_id")


@query("a19_answers", f"{ANSWER_SQL} select user_id, source, status, matched, cast(bad as bigint) as bad from a")
def a19(spark, sf):
    """Outside answers folded to one status a source: the worst link of vendors, links over hosts, scans judged malicious."""
    return folded(spark, sf).select("user_id", "source", "status", "matched", "bad")


@query("a19_listed_by", f"{ANSWER_SQL} select user_id, coalesce(string_agg(source, ',' order by list_position(['virustotal', 'urlhaus', 'urlscan'], source)) filter (status = 'listed'), '') as listed_by from a group by 1")
def a19b(spark, sf):
    """Who lists a link, in the order of sources."""
    return A.listed_by(folded(spark, sf), "user_id").select("user_id", F.array_join("listed_by", ",").alias("listed_by"))


CONNECTION_SQL = "with e as (select user_id, event_type || (event_id % 4) as host, cast(80 + event_id % 2 as integer) as port, case when event_id % 3 > 0 then '10.0.0.' || (event_id % 250) end as ip, value <= 150 as allowed, case when event_id % 5 > 0 then 'reason ' || (event_id % 5) end as reason, row_number() over (partition by user_id order by ts, event_id) as seq from events)"


@query("a20_connections", f"{CONNECTION_SQL} select user_id, 'reached' as kind, host, cast(null as integer) as port, arg_min(ip, seq) filter (ip is not null) as told, cast(null as integer) as pos from e where allowed group by user_id, host union all select user_id, 'blocked', host, port, arg_min(coalesce(reason, 'blocked'), seq), cast(min(seq) as integer) from e where not allowed group by user_id, host, port")
def a20(spark, sf):
    """What each visit reached, with the first address, and the host and port pairs that were kept from it, with the first reason."""
    c, seq = F.col("event_id"), F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    log = table(spark, sf, "events").select("user_id", seq.alias("seq"), F.concat("event_type", (c % 4).cast("string")).alias("host"), (80 + c % 2).cast("int").alias("port"), F.when(c % 3 > 0, F.concat(F.lit("10.0.0."), (c % 250).cast("string"))).alias("ip"), (F.col("value") <= 150).alias("allowed"), F.when(c % 5 > 0, F.concat(F.lit("reason "), (c % 5).cast("string"))).alias("reason"))
    reached, shut = A.connections(log, "user_id")
    none = F.lit(None).cast("int")
    return reached.select("user_id", F.lit("reached").alias("kind"), "host", none.alias("port"), F.col("ip").alias("told"), none.alias("pos")).unionByName(shut.select("user_id", F.lit("blocked").alias("kind"), "host", "port", F.col("reason").alias("told"), "pos"))


#: Links with words in host, path and query; the same text in both dialects.
WORD_URL = "case page_id % 4 when 0 then 'https://login-secure' || page_id || '.com/verify/account?bonus=1' when 1 then 'https://free.gift.com/claim-it/claim?wallet' when 2 then 'https://example.com/Account/UPDATE' else url end"


# --- windows and sets ----------------------------------------------------------------------------------------------


@query("w01_interleave", "with l as (select event_type as feed, user_id as link, max(ts) as t from events group by all), r as (select *, row_number() over (partition by feed order by t desc, link) as turn from l), o as (select link, count(*) > 1 as shared, min(turn) as turn, arg_min(feed, (turn, feed)) as feed from r group by 1) select *, row_number() over (order by not shared, turn, feed) as place from o")
def w01(spark, sf):
    """All feeds as one list: links that several feeds have first, then the feeds' newest in turn."""
    lists = table(spark, sf, "events").groupBy(F.col("event_type").alias("feed"), F.col("user_id").alias("link")).agg((-F.unix_micros(F.max("ts").cast("timestamp"))).alias("pos"))
    return T.interleaved(lists)


@query("w02_choose", f"with {PAGE_SITES}, r as (select page_id, site, row_number() over (partition by site order by page_id % 3, md5(url)) as n from h where page_id % 10 <> 0) select page_id, site from (select *, md5(cast(page_id as varchar)) as o from r where n = 1) order by page_id % 3, o limit 40")
def w02(spark, sf):
    """Unseen links, one a site, newest tier first then a seeded shuffle, forty in all."""
    s = with_sites(spark, sf).where("page_id % 10 <> 0")
    one = s.groupBy("site").agg(F.min_by("page_id", F.struct(F.col("page_id") % 3, F.md5(F.col("url").cast("binary")))).alias("page_id"))
    return one.orderBy(F.col("page_id") % 3, F.md5(F.col("page_id").cast("string").cast("binary"))).limit(40).select("page_id", "site")


@query("w04_sibling_tab", "with g as (select p_brand as probe, p_name as name, bool_or(p_size < 5) as scam, min(p_type) as why from part group by all), r as (select *, row_number() over (partition by probe order by not scam, name) as n, count(*) over (partition by probe) as total from g) select probe, name, scam, why, total from r where n <= 25")
def w04(spark, sf):
    g = table(spark, sf, "part").groupBy(F.col("p_brand").alias("probe"), F.col("p_name").alias("name")).agg(F.bool_or(F.col("p_size") < 5).alias("scam"), F.min("p_type").alias("why"))
    w = W.partitionBy("probe").orderBy(~F.col("scam"), "name")
    return g.withColumn("n", F.row_number().over(w)).withColumn("total", F.count("*").over(W.partitionBy("probe"))).where("n <= 25").drop("n")


@query("w05_hold_out", "with r as (select o_orderkey, row_number() over (order by cast(o_orderdate as date), o_orderkey) as n, count(*) over () as t from orders) select o_orderkey, n > floor(t * 0.85) as held_back from r")
def w05(spark, sf):
    """The last 15 % by date decide stopping; ranks only inside the date of the cut."""
    return T.hold_out(table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day")), "o_orderkey", "day", 0.85)


@query("w07_sorted_reasons", "select user_id, string_agg(points || ':' || event_type, ',' order by points desc, event_type) as reasons from (select user_id, event_type, cast(count(*) as bigint) as points from events group by all) group by 1")
def w07(spark, sf):
    c = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("points")).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("points")).alias("m"), "event_type"))).alias("r"))
    return c.select("user_id", F.array_join(F.transform("r", lambda x: F.concat_ws(":", (-x["m"]).cast("string"), x["event_type"])), ",").alias("reasons"))


@query("x01_x02_union", "with n as (select distinct user_id as link from events where event_type = 'click'), b as (select distinct user_id as link from events where event_type = 'error') select link, 'new' as list from n where link % 13 <> 0 union all select link, 'backlog' from b where link % 13 <> 0 and link not in (select link from n)")
def x01(spark, sf):
    """New and backlog links without repeats, noise taken from both."""
    e = table(spark, sf, "events")
    part = lambda t: e.where(F.col("event_type") == t).select(F.col("user_id").alias("link")).distinct()
    noise = e.where("user_id % 13 = 0").select(F.col("user_id").alias("link")).distinct()
    new = part("click").join(noise, "link", "left_anti")
    return new.withColumn("list", F.lit("new")).unionByName(part("error").join(noise, "link", "left_anti").join(new, "link", "left_anti").withColumn("list", F.lit("backlog")))


@query("x03_x04_arrays", "with a as (select user_id, list_sort(list_distinct(list(event_type) filter (event_id % 2 = 0))) as l, list_sort(list_distinct(list(event_type) filter (event_id % 2 = 1))) as f from events group by 1) select user_id, array_to_string(list_filter(f, lambda x: not list_contains(coalesce(l, []), x)), ',') as fresh, array_to_string(list_sort(list_intersect(coalesce(l, []), ['click', 'error'])), ',') as hits from a")
def x03(spark, sf):
    """What one list has that the other lacks, and what both share with a fixed set."""
    side = lambda r: F.array_sort(F.collect_set(F.when(F.col("event_id") % 2 == r, F.col("event_type"))))
    a = table(spark, sf, "events").groupBy("user_id").agg(side(0).alias("l"), side(1).alias("f"))
    return a.select("user_id", F.array_join(F.filter("f", lambda x: ~F.array_contains("l", x)), ",").alias("fresh"), F.array_join(F.array_sort(F.array_intersect("l", F.array(F.lit("click"), F.lit("error")))), ",").alias("hits"))


@query("x04_url_words", f"select page_id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) || ' ' || regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)), '[^a-z0-9-]+') || string_split_regex({HOST_SQL}, '[^a-z0-9]+'), lambda w: w in ({', '.join(f"'{w}'" for w in L.URL_WORDS)})))), ',') as words from (select page_id, {WORD_URL} as url from pages)")
def x04(spark, sf):
    """Scam words among the words of host, path and query together."""
    p = table(spark, sf, "pages").select("page_id", F.expr(WORD_URL).alias("url"))
    return LT.facts(p, LT.suffix_table(spark)).select("page_id", F.array_join("url_words", ",").alias("words"))


@query("j06_host_counts", f"select {HOST_SQL} as host, count(*) as pages from pages group by 1")
def j06(spark, sf):
    return table(spark, sf, "pages").groupBy(L.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))


OWNERS = "select c_custkey as id, 's' || c_custkey || '.com' as site, case c_custkey % 5 when 0 then 'Privacy Protect' when 1 then null else c_mktsegment || c_nationkey end as registrant, 'ns' || c_nationkey as ns_key, c_mktsegment as registrar, c_acctbal < 0 as scam"


@query("j11_siblings", f"with o as ({OWNERS}, date '2024-01-01' + cast(c_custkey % 400 as integer) as created, c_custkey // 3 as cert from customer), p as (select * from o where id % 100 = 0), t as (select p.id as probe, p.site as own, o.site as name, 1 as tie, o.scam from p join o using (registrant) where registrant not ilike '%privacy%' union all select p.id, p.site, o.site, 2, o.scam from p join o using (ns_key, registrar) where abs(date_diff('day', p.created, o.created)) <= 2 union all select p.id, p.site, o.site, 3, o.scam from p join o using (cert)), g as (select probe, name, min(tie) as tie, bool_or(scam) as known_scam from t where name <> own group by all) select probe, name, case tie when 1 then 'registered by the same owner' when 2 then 'same registrar and name servers, registered within two days' else 'on the same certificate' end as why, known_scam from g")
def j11b(spark, sf):
    """Sites of the same owner by registrant, by registrar, name servers and date, or by certificate."""
    c = table(spark, sf, "customer").selectExpr(*OWNERS.removeprefix("select ").split(", "), "date_add(date '2024-01-01', cast(c_custkey % 400 as int)) as created", "c_custkey div 3 as cert")
    return T.siblings(c.where("id % 100 = 0"), c, c.select("cert", F.col("site").alias("name")))


@query("j12_registry", "with x as (select o_orderkey, (o_orderkey * 2654435761) % 4294967296 as ip from orders), n as (select 4 + s_suppkey % 21 as length, (s_suppkey * 40000000) % 4294967296 as a, s_nationkey from supplier), r as (select length, a - a % (1::bigint << (32 - length)::integer) as net, s_nationkey as registry from n) select o_orderkey, registry from x join r on ip >= net and ip < net + (1::bigint << (32 - length)::integer) qualify row_number() over (partition by o_orderkey order by length desc, registry) = 1")
def j12b(spark, sf):
    """The registry of the longest network prefix that holds an address."""
    x = table(spark, sf, "orders").select("o_orderkey", ((F.col("o_orderkey") * 2654435761) % 4294967296).alias("ip"))
    n = table(spark, sf, "supplier").select((4 + F.col("s_suppkey") % 21).cast("int").alias("length"), ((F.col("s_suppkey") * 40000000) % 4294967296).alias("a"), F.col("s_nationkey").alias("registry"))
    r = n.select("length", (F.col("a") - F.col("a") % F.pow(F.lit(2.0), 32 - F.col("length")).cast("long")).alias("net"), "registry")
    return T.longest_prefix(x, r, "o_orderkey", "ip", ["registry"])
