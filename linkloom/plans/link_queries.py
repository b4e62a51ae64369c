"""Queries over link columns; every one reads the whole table of pages."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.functions import links as L
from linkloom.operators import answers as A
from linkloom.operators import links as O
from linkloom.plans.registry import query
from linkloom.session import table

HOST_SQL = "regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '\\.$', '')"
#: Hosts of the given pages end in one of three private suffixes of two labels.
SITE_SQL = f"array_to_string(string_split({HOST_SQL}, '.')[-3:], '.')"
VARIANT_SQL = (
    "d as (select distinct label, label || '.com' as domain from (select string_split(site, '.')[1] as label from h)), pl as (select label, domain, unnest(range(1, length(label) + 1)) as i from d), inn as (select label, domain, unnest(range(2, greatest(length(label), 2) + 1)) as i from d), "
    "mk as (select domain, 1 as k, label || '.' || e as v from d, unnest(['com', 'net', 'org', 'in', 'co.in', 'xyz', 'top', 'info', 'online', 'site', 'shop', 'live', 'app']) u(e) union all select domain, 2, substr(label, 1, i - 1) || substr(label, i + 1) || '.com' from pl union all select domain, 3, substr(label, 1, i) || substr(label, i) || '.com' from pl "
    "union all select domain, 4, substr(label, 1, i - 2) || substr(label, i, 1) || substr(label, i - 1, 1) || substr(label, i + 1) || '.com' from inn union all select domain, 5, substr(label, 1, i - 1) || '-' || substr(label, i) || '.com' from inn union all select domain, 6, label || 's.com' from d union all select domain, 7, translate(label, 'oliea', '01134') || '.com' from d), "
    "gd as (select domain, v as variant, min(k) as k from mk where v <> domain and v not like '.%' and v not like '-%' and v not like '%-.%' and v not like '%--%' group by all), "
    "rk as (select *, row_number() over (partition by domain order by k, variant)::integer as n from gd) select domain, variant, n from rk where n <= 90"
)
PAGE_SITES = f"h as (select page_id, url, html, {HOST_SQL} as host, {SITE_SQL} as site from pages)"


def pages(spark, sf):
    return table(spark, sf, "pages")


def with_sites(spark, sf):
    return O.sites(pages(spark, sf).withColumn("host", L.host(F.col("url"))), O.suffix_table(spark))


def site_brands(spark, sf):
    """A brand for each site of the pages: a dimension derived from the data."""
    s = with_sites(spark, sf).select("site").distinct()
    label = F.regexp_extract("site", r"^([^.]*)", 1)
    return s.select(F.col("site").alias("ord"), F.initcap(label).alias("name"), F.array("site").alias("domains"), F.array(label).alias("labels"))


@query("u01_refang", "select page_id, url as refanged, regexp_replace(replace(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1), '.', '[.]'), '^http', 'hxxp') || regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1) as defanged from pages")
def u01(spark, sf):
    d = L.defang(F.col("url"))
    return pages(spark, sf).select("page_id", L.refang(d).alias("refanged"), d.alias("defanged"))


RAW = "case page_id % 8 when 0 then '  ' || url || ' ' when 1 then regexp_replace(url, '^http', 'hXXp') when 2 then regexp_replace(url, '^https?://', '') when 3 then 'ftp://' || page_id when 4 then 'http://localhost/' || page_id when 5 then 'http://192.168.1.' || (page_id % 256) || '/x' when 6 then 'mailto:a@b' else 'http://nodots/' || page_id end"


@query("u02_clean", "select page_id, case page_id % 8 when 2 then 'https://' || regexp_replace(url, '^https?://', '') when 3 then 'ftp://' || page_id when 4 then 'http://localhost/' || page_id when 5 then 'http://192.168.1.' || (page_id % 256) || '/x' when 6 then 'mailto:a@b' when 7 then 'http://nodots/' || page_id else url end as clean, case page_id % 8 when 3 then 'not a web link' when 6 then 'not a web link' when 4 then 'local address' when 5 then 'private address' when 7 then 'not a full address' end as reject from pages")
def u02(spark, sf):
    c = pages(spark, sf).select("page_id", L.clean(F.expr(RAW)).alias("clean"))
    return c.select("page_id", "clean", L.reject_reason(F.col("clean")).alias("reject"))


@query("u03_split", f"select page_id, {HOST_SQL} as host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) as query, regexp_extract(url, '#(.*)$', 1) as fragment, cast(null as integer) as port from pages")
def u03(spark, sf):
    u = F.col("url")
    return pages(spark, sf).select("page_id", L.host(u).alias("host"), L.path(u).alias("path"), L.query(u).alias("query"), L.fragment(u).alias("fragment"), L.port(u).alias("port"))


@query("u04_sites", f"with {PAGE_SITES} select page_id, host, site, array_to_string(string_split(host, '.')[-2:], '.') as registered_domain, array_to_string(string_split(host, '.')[-2:], '.') as free_hosting, string_split(host, '.')[-1] as suffix, cast(greatest(len(string_split(host, '.')) - 3, 0) as integer) as subdomain_depth from h")
def u04(spark, sf):
    return with_sites(spark, sf).select("page_id", "host", "site", "registered_domain", "free_hosting", "suffix", "subdomain_depth")


@query("u05_redact", "select page_id, regexp_extract(url, '^([a-z]+://)', 1) || 'REDACTED@' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || '/REDACTED?email=REDACTED&n=' || page_id || '&t=REDACTED' as safe from pages")
def u05(spark, sf):
    raw = F.concat(F.regexp_extract("url", "^([a-z]+://)", 1), F.lit("me:pw@"), F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), F.lit("/a.b@mail.com?email=x%40y&n="), F.col("page_id").cast("string"), F.lit("&t=abcdefghij0123456789abcdef"))
    return pages(spark, sf).select("page_id", L.redact(raw).alias("safe"))


@query("u07_keys", f"with {PAGE_SITES}, k as (select page_id, host || coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') as b, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) as q from h), a as (select page_id, 'link' as kind, 0 as pos, b || case when q <> '' then '?' || q else '' end as key from k union all select page_id, 'link', 1, b from k where q <> ''), n as (select page_id, 'host' as kind, i - 1 as pos, array_to_string(string_split(host, '.')[i:], '.') as key, site from h, unnest(range(1, len(string_split(host, '.')) + 1)) t(i)) select page_id, kind, cast(pos as integer) as pos, key from a union all select page_id, kind, cast(pos as integer), key from n where length(key) >= length(site)")
def u07(spark, sf):
    rows = with_sites(spark, sf).select("page_id", "url", "host", "site")
    cols = ["page_id", "kind", "pos", "key"]
    return O.link_keys(rows).withColumn("kind", F.lit("link")).select(*cols).unionByName(O.host_keys(rows).withColumn("kind", F.lit("host")).select(*cols))


HOP_URL = "case when event_type = 'error' and event_id % 2 = 0 then 'ftp://x/' || event_id else 'https://h' || (event_id % 40) || '.com/p?token=' || event_id || '&n=' || (event_id % 3) end"
HOPS_SQL = f"with e as (select user_id, event_id, value, replace({HOP_URL}, 'token=' || event_id, 'token=REDACTED') as url, row_number() over (partition by user_id order by ts, event_id) as pos from events), o as (select user_id, url, min(pos) as pos from e where url like 'https:%' and not (value > 300) group by all), r as (select *, row_number() over (partition by user_id order by pos) as n, count(*) over (partition by user_id) as c from o)"


@query("u08_links_to_check", f"{HOPS_SQL} select user_id, cast(case when n = c and c > 8 then 8 else n end as integer) as n, url from r where n <= 7 or n = c or (n = 8 and c = 8)")
def u08(spark, sf):
    """The links of each caller's visits that are worth asking about: not blocked, redacted, each once, eight with the last."""
    pos = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    hops = table(spark, sf, "events").select("user_id", pos.alias("pos"), F.expr(HOP_URL).alias("url"), (F.col("value") > 300).alias("blocked"))
    return A.links_to_check(hops, "user_id")


MD5_SQL = "(select case when u >= 9223372036854775808 then (u::hugeint - 18446744073709551616)::bigint else u::bigint end from (select ('0x' || substr(md5({0}), 1, 16))::ubigint as u))"


@query("u09_link_hash", "with x as (select page_id, ('0x' || substr(md5(url), 1, 16))::ubigint as u from pages) select page_id, case when u >= 9223372036854775808 then (u::hugeint - 18446744073709551616)::bigint else u::bigint end as url_hash from x")
def u09(spark, sf):
    return pages(spark, sf).select("page_id", L.md5_long(F.col("url")).alias("url_hash"))


@query("u10_entropy", "with w as (select p_partkey, p_name, unnest(string_split(p_name, '')) as c from part), n as (select p_partkey, c, count(*) as k from w group by all), s as (select p_partkey, sum(k) as t from n group by 1) select p_partkey, round(sum(-(k / t) * log2(k / t)), 6) as entropy from n join s using (p_partkey) group by 1")
def u10(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(L.entropy(F.col("p_name")), 6).alias("entropy"))


@query("u11_random_name", "with h as (select c_custkey, md5(c_name)[:14] as t from customer), l as (select c_custkey, t, unnest(string_split(t, '')) as c from h), n as (select c_custkey, t, c, count(*) as k from l group by all), e as (select c_custkey, t, sum(-(k / 14.0) * log2(k / 14.0)) as e from n group by all) select c_custkey, t as name, e >= 3.0 and ((regexp_matches(t, '[a-z]') and len(regexp_extract_all(t, '[aeiou]')) / greatest(len(regexp_extract_all(t, '[a-z]')), 1) < 0.2) or len(regexp_extract_all(t, '[0-9]+')) * 2 - (regexp_matches(t, '^[0-9]'))::int - (regexp_matches(t, '[0-9]$'))::int >= 3 or regexp_matches(t, '[bcdfghjklmnpqrstvwxz]{6}')) as random_name from e")
def u11(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.substring(F.md5(F.col("c_name").cast("binary")), 1, 14).alias("name")).withColumn("random_name", L.looks_random(F.col("name")))


@query("u12_skeleton", "select page_id, translate(lower(url), '01345789', 'oleastbg') as skeleton from pages")
def u12(spark, sf):
    return pages(spark, sf).select("page_id", L.skeleton(F.col("url")).alias("skeleton"))


@query("u13_punycode", f"with {PAGE_SITES} select page_id, case page_id % 4 when 0 then 'xn--bcher-kva.' when 1 then 'xn--80ak6aa92e.' when 2 then 'xn--ß.' else '' end || host as host, case page_id % 4 when 0 then 'bücher.' when 1 then 'аррӏе.' when 2 then 'ß.' else '' end || host as seen from h")
def u13(spark, sf):
    """Names as people see them, label by label; broken punycode loses its prefix only."""
    h = pages(spark, sf).select("page_id", F.concat(F.element_at(F.array(F.lit("xn--bcher-kva."), F.lit("xn--80ak6aa92e."), F.lit("xn--ß."), F.lit("")), (F.col("page_id") % 4 + 1).cast("int")), L.host(F.col("url"))).alias("host"))
    return h.join(O.seen_names(h), "host", "left").select("page_id", "host", F.coalesce("seen", "host").alias("seen"))


@query("u14_link_facts", f"with {PAGE_SITES} select page_id, cast(length(url) as integer) as length, cast(greatest(len(string_split(host, '.')) - 3, 0) as integer) as subdomain_depth, round(len(regexp_extract_all(host, '[0-9]')) / length(host), 2) as digit_ratio, cast(len(regexp_extract_all(string_split(host, '.')[-2], '-')) as integer) as hyphens, contains(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '@') as has_at, contains(substr(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), 2), '//') as double_slash_path, string_split(host, '.')[-1] in ('xyz', 'top') as abused_ending, coalesce((select string_agg(w, ',' order by w) from (select distinct unnest(string_split_regex(lower(regexp_extract(url, '^[a-z]+://(.*)$', 1)), '[^a-z0-9]+')) as w) where w in ('free', 'win', 'login', 'verify', 'update', 'secure', 'bonus', 'gift', 'prize', 'support', 'account', 'pan')), '') as url_words from h")
def u14(spark, sf):
    f = O.facts(pages(spark, sf), O.suffix_table(spark))
    return f.select("page_id", "length", "subdomain_depth", "digit_ratio", "hyphens", "has_at", "double_slash_path", F.col("abused_tld").alias("abused_ending"), F.array_join("url_words", ",").alias("url_words"))


BODY_SQL = "replace(host, '.example.org', case when page_id % 3 = 0 then '.bank.in' when page_id % 3 = 1 then '.gov.in' else '.in' end)"


@query("u15_official", f"with {PAGE_SITES}, x as (select distinct {BODY_SQL} as host, site from h), y as (select host, case when ends_with(host, '.bank.in') then 'a registered Indian bank' when ends_with(host, '.gov.in') then 'Government of India' when not ends_with(host, '.in') then upper(substr(site, 1, 1)) || lower(substr(string_split(site, '.')[1], 2)) end as brand from x) select * from y where brand is not null")
def u15(spark, sf):
    """Whose own site a host is: a brand's, or that of a body that alone can register its ending."""
    hosts = pages(spark, sf).select("page_id", L.host(F.col("url")).alias("host")).select(F.expr(BODY_SQL).alias("host"))
    b = site_brands(spark, sf)
    return O.official_names(hosts, b.withColumn("name", F.concat(F.upper(F.substring(F.col("labels")[0], 1, 1)), F.lower(F.substring(F.col("labels")[0], F.lit(2), F.length(F.col("labels")[0]))))))


@query("u16_imitations", "with b as (select lower(replace(n_name, '_', '')) as l from nation), x as (select distinct case c_custkey % 4 when 0 then 'nat1on' || c_nationkey when 1 then 'nation' || c_nationkey || 'x' when 2 then 'login-nation' || c_nationkey || '-page' else lower(replace(c_name, '#', '')) end as label from customer), p as (select label, l, case when label <> l and translate(label, '01345789', 'oleastbg') = l then 0 when length(l) >= 6 and label <> l and damerau_levenshtein(label, l) <= case when length(l) >= 9 then 2 else 1 end then 1 when label <> l and (list_contains(string_split_regex(label, '[-_.0-9]+'), l) or contains(label, l)) then 2 end as k from x, b) select label as host, arg_min(l, ((k > 0)::int, l)) as brand, case when arg_min(k, ((k > 0)::int, l)) = 2 then 'combo' else 'typo' end as kind from p where k is not null group by label")
def u16(spark, sf):
    """Which of a fixed set of names (the nations) the labels of all customers imitate."""
    label = F.lower(F.replace("n_name", F.lit("_"), F.lit("")))
    b = table(spark, sf, "nation").select(label.alias("ord"), label.alias("name"), F.array(label).alias("labels"))
    raw = F.expr("case c_custkey % 4 when 0 then concat('nat1on', c_nationkey) when 1 then concat('nation', c_nationkey, 'x') when 2 then concat('login-nation', c_nationkey, '-page') else lower(replace(c_name, '#', '')) end")
    return O.imitations(table(spark, sf, "customer").select(raw.alias("host"), raw.alias("label"), F.lit("").alias("subdomain")), b)


@query("u17_variants", f"with {PAGE_SITES}, {VARIANT_SQL}")
def u17(spark, sf):
    return O.variants(with_sites(spark, sf).select(F.concat(F.regexp_extract("site", r"^([^.]*)", 1), F.lit(".com")).alias("domain")).distinct())


@query("u18_display_brand", "with b as (select distinct p_brand as name, lower(replace(p_brand, '#', '-')) as label from part), x as (select o_orderkey, case o_orderkey % 5 when 0 then lower('Brand#' || (o_orderkey % 30)) when 1 then ' other ' when 2 then lower(o_orderpriority) when 3 then 'brand-' || (o_orderkey % 60) else o_orderpriority end as raw from orders) select o_orderkey, case when lower(trim(raw)) in ('', 'none', 'other', 'unknown', 'generic', 'n/a', 'na', 'null') then null when b.name is not null then b.name when trim(raw) <> lower(trim(raw)) then trim(raw) else upper(substr(trim(raw), 1, 1)) || substr(trim(raw), 2) end as brand from x left join b on lower(b.name) = lower(trim(raw)) or b.label = lower(trim(raw))")
def u18(spark, sf):
    """Outside names tidied: placeholders go, known names and labels get their spelling, the rest a capital."""
    b = table(spark, sf, "part").select(F.col("p_brand").alias("ord"), F.col("p_brand").alias("name"), F.array(F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))).alias("labels")).distinct()
    raw = F.expr("case o_orderkey % 5 when 0 then lower(concat('Brand#', o_orderkey % 30)) when 1 then ' other ' when 2 then lower(o_orderpriority) when 3 then 'brand-' || (o_orderkey % 60) else o_orderpriority end")
    return A.display_brand(table(spark, sf, "orders").select("o_orderkey", raw.alias("raw")), b).select("o_orderkey", "brand")


@query("u19_dates", "select o_orderkey, cast(o_orderdate as date) as created, cast(greatest(date_diff('day', cast(o_orderdate as date), date '2002-01-01'), 0) as integer) as age_days from orders")
def u19(spark, sf):
    """Dates in several spellings, and the age in days at a given day."""
    d = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(d, "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 1, F.date_format(d, "dd-MMM-yyyy")).when(F.col("o_orderkey") % 4 == 2, F.date_format(d, "yyyy.MM.dd")).otherwise(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"))
    x = table(spark, sf, "orders").select("o_orderkey", L.parse_date(text).alias("created"))
    return x.withColumn("age_days", F.greatest(F.datediff(F.lit("2002-01-01").cast("date"), "created"), F.lit(0)))


IP_SQL = (
    "case o_orderkey % 7 when 0 then a || '.' || b || '.1.2' when 1 then '::ffff:' || a || '.' || b || '.1.2' when 2 then '64:FF9B::' || a || '.' || b || '.1.2' when 3 then '2002:' || lower(hex(a * 256 + b)) || ':102::1'"
    " when 4 then '2001:0:4136:e378:8000:63bf:' || lower(hex(65535 - a * 256 - b)) || ':fefd' when 5 then '2a00:1450::' || lower(hex(a * 256 + b)) else case a % 9 when 0 then '::1' when 1 then '::' when 2 then 'fe80::1%eth0' when 3 then 'ff02::' || b when 4 then 'fd12:3456::1'"
    " when 5 then '2001:db8:0:0:0:0:0:' || b when 6 then '169.254.169.254' when 7 then '4000::1' else 'fd00:ec2::254' end end"
)
IP_ROWS = "(o_orderkey * 48271) % 256 as a, o_orderkey % 256 as b"


@query("u20_addresses", f"with x as (select o_orderkey, {IP_ROWS} from orders), y as (select *, {IP_SQL} as ip, case when a = 0 then 'private' when a in (10, 127) then case a when 10 then 'private' else 'loopback' end when a = 100 and b between 64 and 127 then 'reserved' when a = 172 and b between 16 and 31 then 'private' when a = 192 and b = 168 then 'private' when a = 198 and b in (18, 19) then 'private' when a = 169 and b = 254 then 'link-local' when a between 224 and 239 then 'multicast' when a >= 240 then 'private' end as four from x) select o_orderkey, ip, case when o_orderkey % 7 < 5 then four when o_orderkey % 7 = 5 then null else ['loopback', 'unspecified', 'link-local', 'multicast', 'private', 'private', 'metadata', 'reserved', 'metadata'][a % 9 + 1] end as blocked from y")
def u20(spark, sf):
    """Why an address is not public, null if it is: IPv4, IPv6, and IPv6 forms that carry an IPv4 address."""
    x = table(spark, sf, "orders").selectExpr("o_orderkey", *IP_ROWS.split(", ")).select("o_orderkey", F.expr(IP_SQL).alias("ip"))
    return x.withColumn("blocked", L.blocked(F.col("ip")))


@query("j07_listed", f"with {PAGE_SITES}, links as (select distinct host || coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') as key from h where page_id % 7 = 0), doms as (select distinct site as key from h where page_id % 11 = 0), k as (select page_id, url, site, host || coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') as key from h), a as (select k.page_id as scan_id, 'link' as match, k.url, k.key, k.site from k join links using (key)), b as (select page_id as scan_id, 'domain' as match, url, site as key, site from h join doms on doms.key = h.site where page_id not in (select scan_id from a)), u as (select * from a union all select * from b), p as (select site from h group by 1 having count(*) >= 5) select scan_id, match, url, key, p.site is not null as popular from u left join p using (site)")
def j07(spark, sf):
    s = with_sites(spark, sf).select(F.col("page_id").alias("scan_id"), F.lit(0).alias("url_pos"), "url", "host", "site")
    links = O.link_keys(s.where("scan_id % 7 = 0")).where(~F.col("key").contains("?")).select("key")
    return O.listed(s, links, s.where("scan_id % 11 = 0").select(F.col("site").alias("key")), s.groupBy("site").count().where("count >= 5"))
