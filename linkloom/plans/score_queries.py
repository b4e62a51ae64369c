"""Queries on scoring over events as scans: facts follow from the row by fixed arithmetic, in both dialects."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.operators import score as S
from linkloom.plans.registry import ORACLES, query
from linkloom.session import cut, table

K = "event_id"
LINK_FACTS = {
    "imitation": "case event_id % 9 when 0 then 'homograph' when 1 then 'typo' when 2 then 'combo' end", "is_ip": "event_id % 31 = 0", "has_at": "event_id % 13 = 0", "unicode_host": "case when event_id % 18 in (0, 5) then 'x' end",
    "free_hosting": "case when event_id % 4 = 0 then 'h.io' end", "abused": "event_id % 3 = 0", "rank": "case when event_id % 10 = 0 then event_id % 20000 end", "depth": "event_id % 5", "random_name": "event_id % 17 = 0", "hyphens": "event_id % 4",
    "official": "case when event_id % 19 = 0 then 'b' end", "length": "event_id % 150", "port": "case when event_id % 23 = 0 then 8080 end", "double_slash": "event_id % 29 = 0", "shortener": "event_id % 37 = 0",
}
LINK_SQL = "case event_id % 9 when 0 then 45 when 1 then 35 when 2 then 25 else 0 end + 20 * (event_id % 31 = 0)::int + 15 * (event_id % 13 = 0)::int + 10 * (event_id % 18 = 5)::int + 10 * (event_id % 4 = 0)::int + 8 * (event_id % 3 = 0 and event_id % 10 <> 0)::int + 8 * (event_id % 5 >= 3)::int + 8 * (event_id % 17 = 0)::int + 5 * (event_id % 4 >= 2)::int + case when event_id % 19 <> 0 and event_id % 10 <> 0 then least(4 * (event_id % 5), 12) else 0 end + 5 * (event_id % 150 > 100)::int + 8 * (event_id % 23 = 0)::int + 5 * (event_id % 29 = 0)::int + 5 * (event_id % 37 = 0)::int"


def links(spark, sf):
    e = table(spark, sf, "events").select(K, *[F.expr(v).alias(k) for k, v in LINK_FACTS.items()])
    return e.withColumn("url_words", F.when(F.col(K) % 5 == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.col(K) % 5), lambda i: F.concat(F.lit("w"), i.cast("string")))))


@query("r01_link_reasons", f"select event_id, cast({LINK_SQL} as bigint) as points from events")
def r01(spark, sf):
    return links(spark, sf).select(K, F.aggregate(S.link_reasons(), F.lit(0), lambda a, r: a + r["points"]).cast("long").alias("points"))


@query("r02_page_reasons", "with x as (select event_id, event_id % 2 = 0 as asked, event_id % 11 = 0 as off, event_id % 7 = 0 as http, event_id % 5 = 0 as imp, event_id % 3 as m from events) select event_id, cast(case when asked and not off then 35 else 0 end + case when asked and not off and http then 20 else 0 end + case when imp and asked then 25 when imp and m = 0 then 10 else 0 end + case when m = 1 then 15 else 0 end + case when m = 2 and asked then 5 else 0 end + case when event_id % 1000 < 600 and not off then 10 else 0 end + case when event_id % 1000 < 600 then 10 else 0 end + case when event_id % 6 = 0 then 15 else 0 end + case when event_id % 8 >= 3 then 8 else 0 end as bigint) as points from x")
def r02(spark, sf):
    c, e = F.col(K), table(spark, sf, "events")
    none = F.array().cast("array<string>")
    x = e.select(
        K, F.when(c % 2 == 0, F.array(F.lit("otp"), F.lit("password"))).otherwise(none).alias("asks"), (c % 11 == 0).alias("official_site"), (c % 7 == 0).alias("plain_http"), F.when(c % 5 == 0, "B").alias("impersonated"), (c % 3 == 0).alias("brand_in_title"), (c % 3 == 1).alias("form_away"), (c % 3 == 2).alias("form_hidden"), F.lit(False).alias("mailto"),
        none.alias("wallets"), (c % 1000).alias("words"), F.array(F.lit("urgency"), F.lit("prize")).alias("phrases"), F.when(c % 6 == 0, 1).otherwise(0).alias("programs"), F.lit(False).alias("right_click"), (c % 8).alias("obfuscation"), F.lit(0).alias("hidden_frames"), F.lit(9).alias("links"), F.lit(0.2).alias("empty_share"), F.lit(0.0).alias("blob_share"),
    )
    return x.select(K, F.aggregate(S.page_reasons(), F.lit(0), lambda a, r: a + r["points"]).cast("long").alias("points"))


@query("r03_behaviour", "with w as (select user_id, array_agg(event_type order by ts, event_id) as h from events group by 1), m as (select user_id, h, (select count(*) from range(1, len(h) + 1) t(i) where i = 1 or h[i] <> h[i - 1]) as moves from w) select user_id, cast(case when user_id % 7 = 0 then 25 else 0 end + case when user_id % 5 = 0 then 30 else 0 end + case when moves >= 3 then 5 else 0 end + case when list_contains(h[2:], 'click') then 5 else 0 end + case when user_id % 3 = 0 then 3 else 0 end + case when user_id % 4 = 0 then 3 else 0 end as bigint) as points from m")
def r03(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("hosts"))
    u = F.col("user_id")
    x = e.select("user_id", "hosts", F.when(u % 7 == 0, "blocked").alias("stopped"), F.when(u % 5 == 0, 1).otherwise(0).alias("downloads"), F.transform("hosts", lambda h: F.when(h == "click", "meta").otherwise("http")).alias("hop_kinds"), F.when(u % 3 == 0, "v").alias("bot_check"), F.when(u % 4 == 0, 1).otherwise(0).alias("popups"))
    return x.select("user_id", F.aggregate(S.behaviour_reasons(), F.lit(0), lambda a, r: a + r["points"]).cast("long").alias("points"))


@query("r04_domain", "with x as (select o_orderkey as k, date_diff('day', cast(o_orderdate as date), date '2002-01-01') as age from orders) select k as o_orderkey, cast(case when k % 6 = 0 then 0 when k % 5 = 0 then 10 when age < 7 then 25 when age < 30 then 15 when age < 180 then 5 when age >= 3650 then -15 when age >= 1825 then -10 else 0 end + case when k % 6 <> 0 and k % 8 = 0 then 15 else 0 end + case when k % 9 = 0 then 5 else 0 end + case when k % 7 = 0 then 15 else 0 end + case when k % 6 <> 0 and k % 20 < 7 then 8 else 0 end as bigint) as points from x")
def r04(spark, sf):
    k = F.col("o_orderkey")
    x = table(spark, sf, "orders").select("o_orderkey", F.when(k % 5 == 0, "not_found").otherwise("ok").alias("status"), F.datediff(F.lit("2002-01-01").cast("date"), "o_orderdate").alias("age_days"), F.when(k % 8 == 0, "clientHold").otherwise("").alias("flags"), F.when(k % 9 == 0, "not_found").otherwise("ok").alias("dns"), (k % 7 != 0).alias("cert_trusted"), (k % 20).alias("first_cert_days"), (k % 6 == 0).alias("shared_host"))
    return x.select("o_orderkey", F.aggregate(S.domain_reasons(), F.lit(0), lambda a, r: a + r["points"]).cast("long").alias("points"))


def sources(c):
    one = lambda i, s, m, p, bad, live: F.struct(F.lit(i).alias("id"), s.alias("status"), m.alias("match"), p.alias("popular"), bad.alias("malicious"), live.alias("live"))
    on = lambda cond: F.when(cond, "listed").otherwise("clean")
    no = F.lit(False)
    return F.array(one("safe_browsing", on(c % 97 == 0), F.lit(""), no, F.lit(0), no), one("phishing_database", on(c % 12 == 0), F.when(c % 24 == 0, "link").otherwise("domain"), c % 36 == 12, F.lit(0), no), one("virustotal", F.when(c % 14 == 0, "listed").when(c % 14 == 1, "info").otherwise("clean"), F.lit(""), no, (c % 10).cast("int"), no), one("urlhaus", F.when(c % 41 == 0, "listed").when(c % 41 == 1, "info"), F.lit(""), no, F.lit(0), c % 2 == 0), one("urlscan", on(c % 53 == 0), F.lit(""), no, F.lit(0), no))


LIST_SQL = "[case when k % 97 = 0 then 70 end, case when k % 12 = 0 then case when k % 24 = 0 then 60 when k % 36 = 12 then 15 else 45 end end, case when k % 14 = 0 then case when k % 10 >= 5 then 60 else 35 end when k % 14 = 1 then 10 end, case when k % 41 = 0 then case when k % 2 = 0 then 70 else 45 end when k % 41 = 1 then 15 end, case when k % 53 = 0 then 30 end]"


@query("r05_lists", f"with x as (select event_id as k from events) select k as event_id, cast(coalesce(list_sum(list_filter({LIST_SQL}, lambda v: v is not null)), 0) as bigint) as points from x")
def r05(spark, sf):
    x = table(spark, sf, "events").select(K, sources(F.col(K)).alias("sources"))
    return x.select(K, F.aggregate(S.list_reasons(), F.lit(0), lambda a, r: a + r["points"]).cast("long").alias("points"))


@query("r06_r07_library", "select event_id, cast(case when event_id % 10 = 0 then 0 else case event_id % 4 when 0 then case when event_id % 100 >= 90 then 40 else 35 end when 1 then 25 when 2 then 20 else 0 end + case when event_id % 5 > 0 and event_id % 3 <> 0 then case when event_id % 5 >= 3 then 20 else 15 end else 0 end + case event_id % 6 when 0 then 0 when 1 then 20 when 2 then 20 else 25 end + case when event_id % 2 = 0 then case when event_id % 8 >= 2 then 20 else 10 end when event_id % 7 >= 3 then -10 else 0 end + case when event_id % 11 > 0 then 15 else 0 end end as bigint) as points from events")
def r06(spark, sf):
    c = F.col(K)
    x = table(spark, sf, "events").select(
        K, F.element_at(F.array(F.lit("matched"), F.lit("similar"), F.lit("copy"), F.lit("none")), (c % 4 + 1).cast("int")).alias("family_status"), (c % 100).alias("percent"), (c % 5).alias("scams_on_server"), (c % 3 == 0).alias("shared_network"), (c % 6).alias("scams_of_owner"), (c % 10 == 0).alias("trusted"),
        F.lit("labelled").alias("graph_status"), F.when(c % 2 == 0, "malicious").otherwise("benign").alias("graph_label"), (c % 7).alias("positive_in"), (c % 8).alias("negative_in"), (c % 11).alias("scam_links_out"),
    )
    return x.select(K, F.aggregate(F.concat(S.family_reasons(), S.graph_reasons()), F.lit(0), lambda a, r: a + r["points"]).cast("long").alias("points"))


REP_SQL = "case when event_id % 19 = 0 and event_id % 9 > 2 then -40 else 0 end + case when event_id % 10 = 0 then case when event_id % 20000 <= 10000 then -30 else -15 end else 0 end"


@query("r08_reputation", f"select event_id, cast({REP_SQL} as bigint) as points from events")
def r08(spark, sf):
    x = links(spark, sf).withColumn("impersonated", F.lit(None).cast("string"))
    return x.select(K, F.aggregate(S.reputation_reasons(), F.lit(0), lambda a, r: a + r["points"]).cast("long").alias("points"))


JUDGE_SQL = f"x as (select event_id as k, event_id, {LINK_SQL} as lp, {REP_SQL} as rp, list_filter({LIST_SQL.replace('k %', 'event_id %')}, lambda v: v is not null) as l, event_id % 25 = 0 as blocked from events), s as (select *, lp + rp + coalesce(list_sum(l), 0) as t, coalesce(list_max(l), 0) as top from x), y as (select *, least(greatest(t, 0), 100) as rule_score, least(greatest(t - 10 * (event_id % 4 = 0)::int, 0), 100) as backing from s), z as (select *, greatest(rule_score, case when blocked then 40 else 0 end, case when top >= 60 then 70 when top >= 30 then 31 else 0 end) as score from y)"


def judged(spark, sf):
    x = links(spark, sf).withColumn("impersonated", F.lit(None).cast("string")).withColumn("sources", sources(F.col(K))).withColumn("stopped", F.when(F.col(K) % 25 == 0, "blocked"))
    return S.judge(x.withColumn("reasons", F.concat(S.link_reasons(), S.list_reasons(), S.reputation_reasons())))


@query("r09_verdict", f"with {JUDGE_SQL} select event_id, cast(rule_score as integer) as rule_score, cast(backing as integer) as backing, cast(score as integer) as score, case when score <= 30 then 'safe' when score <= 69 then 'suspicious' else 'dangerous' end as verdict from z")
def r09(spark, sf):
    return judged(spark, sf).select(K, "rule_score", "backing", "score", "verdict")


@query("r11_scam_type", "with x as (select event_id, event_id % 3 = 0 as bank, event_id % 2 = 0 as otp, event_id % 5 = 0 as seed, event_id % 4 as prize, event_id % 7 = 0 as dl from events), p as (select event_id, [case when bank then 3 else 0 end + case when otp then 2 else 0 end, case when otp then 2 else 0 end, case when seed then 4 else 0 end, case when prize >= 2 then 3 when prize > 0 then 1 else 0 end, 0, 0, case when dl then 4 else 0 end, 0, 0] as l from x) select event_id, case when list_max(l) >= 3 then ['banking', 'credentials', 'crypto', 'prize', 'shop', 'tech_support', 'malware', 'job', 'government'][list_position(l, list_max(l))] end as type from p")
def r11(spark, sf):
    c = F.col(K)
    x = table(spark, sf, "events").select(
        K, F.concat(F.when(c % 2 == 0, F.array(F.lit("otp"), F.lit("password"))).otherwise(F.array().cast("array<string>")), F.when(c % 5 == 0, F.array(F.lit("seed_phrase"))).otherwise(F.array().cast("array<string>"))).alias("asks"), F.create_map(F.lit("prize"), (c % 4).cast("int")).alias("phrases"),
        F.when(c % 3 == 0, F.array(F.lit("bank"))).otherwise(F.array().cast("array<string>")).alias("categories"), F.array().cast("array<string>").alias("wallets"), F.lit(0).alias("phones"), F.lit(False).alias("form_away"), F.when(c % 7 == 0, 1).otherwise(0).alias("downloads"), F.lit(0).alias("programs"),
    )
    return x.select(K, S.scam_type().alias("type"))


TYPE_ROWS = ", ".join(f"('{k}', '{S.TYPE_NOUNS[k]}', '{S.TYPE_SAID[k]}', {str(k in S.NAME_USED).lower()})" for k in S.SCAM_TYPES)
SUMMARY_SQL = f"""with {JUDGE_SQL}, ty as ({ORACLES['r11_scam_type']}), w(type, noun, said, used) as (values {TYPE_ROWS}),
v as (select event_id, score, blocked, case when score <= 30 then 'safe' when score <= 69 then 'suspicious' else 'dangerous' end as verdict, case when event_id % 3 = 0 then 'Brand' || (event_id % 7) end as brand, event_id % 19 = 0 as official, event_id % 10 = 0 as ranked, event_id % 7 = 0 as partial, event_id % 4 = 1 as small, case when event_id % 11 = 0 then ['A', 'B', 'C'] when event_id % 13 = 0 then ['A'] else [] end as lists from z),
j as (select v.*, case when verdict <> 'safe' then ty.type end as type from v join ty using (event_id)),
k as (select j.*, noun, said, used, case when small then 'Only small warning signs found' else 'No warning signs found' end as found from j left join w on w.type = j.type)
select event_id, case when blocked then 'This link leads to a private address, which real websites never do. Don''t trust it.' when len(lists) = 3 and verdict <> 'safe' and type is null then 'A and B list this link as unsafe. Don''t open it.' when len(lists) = 1 and verdict <> 'safe' and type is null then 'A lists this link as unsafe. Don''t open it.'
 when type is not null and brand is not null and used then 'This looks like a ' || noun || ' using ' || brand || '''s name.' when type is not null and brand is not null then 'This looks like a fake ' || brand || ' ' || noun || '.' when type is not null then said when verdict = 'dangerous' then 'Several strong warning signs. Treat this link as dangerous.'
 when verdict = 'suspicious' then 'Some warning signs. Be careful with this link.' || case when partial then ' The page itself couldn''t be checked.' else '' end when official then 'This looks like the real website of b. ' || found || '.' when ranked then 'A well-known site with ' || case when small then 'only small' else 'no' end || ' warning signs found.'
 when partial and small then 'Only small warning signs found, but the page itself couldn''t be checked.' when partial then 'No warning signs in the link, but the page itself couldn''t be checked.' else found || '. That doesn''t guarantee it''s safe, so stay careful.' end as summary from k"""


@query("r12_summary", SUMMARY_SQL)
def r12(spark, sf):
    """One sentence on each judged scan, from its verdict, type, brand, lists, site and what could be read."""
    c = F.col(K)
    none = F.array().cast("array<string>")
    rows = judged(spark, sf).join(r11(spark, sf), K).withColumn("type", F.when(F.col("verdict") != "safe", F.col("type")))
    lists = F.when(c % 11 == 0, F.array(*map(F.lit, "ABC"))).when(c % 13 == 0, F.array(F.lit("A"))).otherwise(none)
    brand = F.when(c % 3 == 0, F.concat(F.lit("Brand"), (c % 7).cast("string")))
    return rows.select(K, S.summary(F.col("verdict"), F.col("type"), brand, F.col("official"), F.col("rank"), F.col("stopped"), lists, c % 7 == 0, c % 4 == 1).alias("summary"))


@query("r13_own_score", f"with {JUDGE_SQL} select event_id, cast(least(greatest(lp + rp, 0), 100) as integer) as own_score from z")
def r13(spark, sf):
    return judged(spark, sf).select(K, S.own_score().alias("own_score"))


#: Scan documents of pages as JSON text, parts missing here and there; the same text in both dialects.
SCAN_PARTS = (
    """'{"id":"p' || page_id || '","created_at":"2024-01-01T00:00:00Z"'""",
    """case when page_id % 7 = 0 then '' else ',"analysis":{"score":' || (length(html) % 101) || ',"verdict":"safe","summary":"s' || length(url) || '","scam_type":' || case when page_id % 3 = 0 then 'null' else '"banking"' end || ',"partial":false,"reasons":[{"text":"on a list","points":45,"area":"blacklist","backs":true},{"text":"length","points":' || (length(url) % 60) || ',"area":"link"}]' || case when page_id % 2 = 0 then '' else ',"good_signs":[{"text":"old","points":-' || (length(html) % 30) || ',"area":"domain"}]' end || ',"model":{"probability":0.' || (10 + length(html) % 90) || '},"link":{"unicode_host":null,"lookalike":"typo"}}' end""",
    """case when page_id % 5 = 0 then ',"visit":null' else ',"visit":{"final_url":"' || url || '","title":"t' || page_id || '","stopped":' || case when page_id % 4 = 0 then '"blocked"' else 'null' end || ',"notes":["a","b"],"hops":[{"url":"' || url || '"},{"url":"x"}],"downloads":[],"bot_check":null}' end""",
    """case when page_id % 3 = 0 then '' else ',"recon":{"registration":{"registrar":"r' || (length(url) % 9) || '","created":"2020-01-01","age_days":' || length(html) || '},"server":{"country":"NL","as_org":"o' || (length(html) % 5) || '"},"cert_history":{"first_seen":"2021-01-01","cert_count":' || (length(url) % 7) || '}}' end""",
    """',"blacklists":{"sources":[{"id":"urlhaus","name":"u","status":"listed","note":"n' || page_id || '","live":true}]},"family":{"status":"matched","library_size":' || length(html) || ',"family":{"label":"f' || (length(html) % 5) || '","pages":3}}'""",
    """case when page_id % 2 = 0 then '' else ',"siblings":{"same_server":{"total":' || (length(url) % 5) || '},"lookalikes":{"total":2}}' end || '}'""",
)
SCAN_DOCUMENT = " || ".join(SCAN_PARTS)
_TEXT = lambda path: f"d->>'$.{path}'"
_FIELDS = {
    "id": "id", "scanned_at": "created_at", "verdict": "analysis.verdict", "summary": "analysis.summary", "scam_type": "analysis.scam_type", "unicode_host": "analysis.link.unicode_host", "lookalike": "analysis.link.lookalike", "final_url": "visit.final_url",
    "title": "visit.title", "stopped": "visit.stopped", "bot_check": "visit.bot_check", "registrar": "recon.registration.registrar", "created": "recon.registration.created", "country": "recon.server.country", "network": "recon.server.as_org", "abuse_email": "recon.server.abuse_email",
    "certs_first_seen": "recon.cert_history.first_seen", "family_status": "family.status", "family_note": "family.note", "copied_site": "family.copied_site", "family_name": "family.family.label",
}
_NUMBERS = {"score": "analysis.score", "model": "analysis.model.probability", "age_days": "recon.registration.age_days", "cert_count": "recon.cert_history.cert_count", "library_size": "family.library_size"}
_FOUND = lambda k: f"coalesce(json_extract(d, '$.analysis.{k}[*]'), [])"
_SHOWN = lambda k: f"array_to_string(list_transform({_FOUND(k)}, lambda r: concat_ws('/', r->>'$.text', r->>'$.points', r->>'$.area')), ',')"
R14_SQL = (
    f"with x as (select page_id, ({SCAN_DOCUMENT})::json as d from pages) select page_id, "
    + ", ".join(f"{_TEXT(p)} as {n}" for n, p in _FIELDS.items())
    + ", "
    + ", ".join(f"cast({_TEXT(p)} as {'double' if n == 'model' else 'bigint' if n == 'library_size' else 'integer'}) as {n}" for n, p in _NUMBERS.items())
    + f", cast({_TEXT('analysis.partial')} as boolean) as partial, {_SHOWN('reasons')} as reasons, {_SHOWN('good_signs')} as good_signs, "
    + f"cast(least(greatest(coalesce(list_sum(list_transform(list_filter({_FOUND('reasons')} || {_FOUND('good_signs')}, lambda r: r->>'$.area' <> 'blacklist'), lambda r: cast(r->>'$.points' as integer))), 0), 0), 100) as integer) as own_score, "
    + "array_to_string(coalesce(json_extract_string(d, '$.visit.notes[*]'), []), ',') as notes, array_to_string(coalesce(json_extract_string(d, '$.visit.blocked[*]'), []), ',') as blocked, "
    + "cast(coalesce(json_array_length(d, '$.visit.hops'), 0) as integer) as hops, cast(coalesce(json_array_length(d, '$.visit.downloads'), 0) as integer) as downloads, "
    + "array_to_string(list_transform(json_extract(d, '$.blacklists.sources[*]'), lambda s: concat_ws('/', s->>'$.id', s->>'$.name', s->>'$.status', s->>'$.note')), ',') as lists, "
    + ", ".join(f"coalesce(cast({_TEXT(f'siblings.{k}.total')} as bigint), 0) as {k}" for k in ("same_server", "same_owner", "same_design", "lookalikes"))
    + " from x"
)


@query("r14_comparison", R14_SQL)
def r14(spark, sf):
    """The fields that a comparison shows, from stored scan documents; lists as text."""
    c = S.comparison(table(spark, sf, "pages").select("page_id", F.expr(SCAN_DOCUMENT).alias("document")), "page_id")
    shown = lambda n, *parts: F.array_join(F.transform(n, lambda r: F.concat_ws("/", *[r[p].cast("string") for p in parts])), ",")
    lists = {"reasons": ("text", "points", "area"), "good_signs": ("text", "points", "area"), "lists": ("id", "name", "status", "note")}
    return c.withColumns({n: shown(n, *parts) for n, parts in lists.items()} | {n: F.array_join(n, ",") for n in ("notes", "blocked")})


@query("r15_ledger", f"with {JUDGE_SQL} select event_id, 'lists' as line, cast(list_sum(l) as bigint) as points from z where len(l) > 0 union all select event_id, 'good signs', cast(rp as bigint) from z where rp < 0 union all select event_id, 'raised', cast(score - rule_score as bigint) from z where score > rule_score union all select event_id, 'findings', cast(lp as bigint) from z where lp > 0")
def r15(spark, sf):
    """Where a score comes from; the separate findings add up to one line here."""
    rows = S.ledger(cut(judged(spark, sf).select(K, "score", "reasons"), "judged"), K)
    return rows.groupBy(K, F.when(F.col("line").like("%finding%"), "findings").otherwise(F.col("line")).alias("line")).agg(F.sum("points").alias("points"))


@query("w07_reasons_order", f"with {JUDGE_SQL} select event_id, case when lp > 0 or len(l) > 0 then true else false end as any_risk from z")
def w07(spark, sf):
    """Risks come before good signs, the strongest first."""
    o = judged(spark, sf).select(K, S.ordered().alias("o"))
    return o.select(K, F.coalesce(F.get("o", F.lit(0))["points"] > 0, F.lit(False)).alias("any_risk"))
