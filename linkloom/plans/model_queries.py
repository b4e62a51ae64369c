"""Queries on the page model over documents and labels, and streams over events."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from linkloom.functions import html as H
from linkloom.functions import links as L
from linkloom.functions import prints as P
from linkloom.operators import boosting as B
from linkloom.operators import digest as DG
from linkloom.operators import links as LT
from linkloom.operators import model as M
from linkloom.operators import pages as PT
from linkloom.operators import score as S2
from linkloom.operators import tables as T
from linkloom.operators import similar
from linkloom.operators.similar import near_sets
from linkloom.plans.link_queries import HOST_SQL
from linkloom.plans.page_queries import ATT, AUG, EL, PRINTS_SQL, TAGS_SQL, TEXT_SQL, WORDS_SQL, decoded, fingerprints, quoted, read, shingle_sql
from linkloom.plans.registry import query
from linkloom.session import cut, folder, table
from linkloom.sources import tables as D
from linkloom.sources.snapshots import Table
from linkloom.streaming import jobs as S


def labelled(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    t = F.col("text")
    return d.select(F.col("doc_id").alias("id"), "n_chars", (F.regexp_count(t, F.lit("[!#*$%&|]")) / F.greatest(F.length(t), F.lit(1))).alias("marks"), (F.regexp_count(t, F.lit("[A-Z]")) / F.greatest(F.length(t), F.lit(1))).alias("capitals"), (F.col("lang") == "en").alias("english"), (F.col("quality") == 0).cast("int").alias("y"))


FEATURE_SQL = "f as (select doc_id as id, ln(1 + n_chars) as f0, len(regexp_extract_all(text, '[!#*$%&|]')) / greatest(length(text), 1) as f1, len(regexp_extract_all(text, '[A-Z]')) / greatest(length(text), 1) as f2, (lang = 'en')::int as f3, (quality = 0)::int as y from documents join labels using (doc_id))"

FEATURE_ROWS_SQL = "fl as (select doc_id as id, n_chars, len(regexp_extract_all(text, '[!#*$%&|]')) / greatest(length(text), 1) as marks, len(regexp_extract_all(text, '[A-Z]')) / greatest(length(text), 1) as capitals, (quality = 0)::int as y from documents join labels using (doc_id))"


def vectors(spark, sf):
    return M.vector(labelled(spark, sf), "id", ["n_chars"], ["marks", "capitals"], ["english"])


#: Links whose sites are registered names, and some odd ones by page number; the same text in both dialects.
URL = "replace(url, '.example.', '.')"
ODD = (
    "case page_id % 11 when 0 then 'https://' || (page_id % 200) || '.7.1.2:8080//login/' || page_id when 1 then 'http://user@login-tionsh' || (page_id % 7) || '.xyz' when 2 then 'https://thther.' || substr(md5(url), 1, 16) || '.top/verify?account=1'"
    " when 3 then 'https://xn--bcher-kva.com/sign-in' when 4 then 'https://ti0nsh.net/free//x' else " + URL + " end"
)
#: A stated set of names: ord, name, domains, labels, keywords.
NAMES = [(1, "Thther", ["thther.com"], ["thther"], ["the", "thther"]), (2, "Tionsh", ["tionsh.net"], ["tionsh"], ["que"]), (3, "Theron", ["theron.com", "theron.net"], ["theron"], ["congratulations", "und"])]


def odd_pages(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", F.expr(ODD).alias("url"), F.expr(AUG).alias("html"))


def vector_sql(final: str | None = None) -> str:
    """The vector in DuckDB: link, forms, wording, structure, names and other sites, each from the link and the html."""
    att = lambda n: ATT.format("t", n)
    tail = lambda h, n: f"array_to_string(string_split({h}, '.')[-{n}:], '.')"
    private = "regexp_matches({0}, '(^|\\.)example\\.(com|net|org)$')"
    site = lambda h: f"case when {private.format(h)} then {tail(h, 3)} else {tail(h, 2)} end"
    ent = lambda x: f"coalesce(list_sum(list_transform(list_distinct(string_split({x}, '')), lambda c: -((length({x}) - length(replace({x}, c, ''))) / length({x})) * log2((length({x}) - length(replace({x}, c, ''))) / length({x})))), 0)"
    odd = (
        "length(w) >= 10 and not regexp_matches(w, '[^\\x00-\\x7F]') and " + ent("w") + " >= 3.0 and ((regexp_matches(w, '[a-z]') and len(regexp_extract_all(w, '[aeiou]')) / greatest(len(regexp_extract_all(w, '[a-z]')), 1) < 0.2)"
        " or len(regexp_extract_all(w, '[0-9]+')) * 2 - regexp_matches(w, '^[0-9]')::int - regexp_matches(w, '[0-9]$')::int >= 3 or regexp_matches(w, '[bcdfghjklmnpqrstvwxz]{6}'))"
    )
    rest = "'^[a-z]+://[^/?#]*([^?#]*)'"
    kinds = "case when u.l <> b.l and translate(u.l, '01345789', 'oleastbg') = b.l then 0 when u.l <> b.l and damerau_levenshtein(u.l, b.l) <= 1 then 1 when u.l <> b.l and (list_contains(string_split_regex(u.l, '[-_.0-9]+'), b.l) or contains(u.l, b.l)) then 2 when list_contains(u.below, b.l) or len(list_filter(u.below, lambda s: starts_with(s, b.l || '-'))) > 0 then 3 end"
    names = ", ".join(f"({i}, '{n}', {d}, '{k[0]}', {w})" for i, n, d, k, w in NAMES)
    fields = "list_transform(list_filter(f, lambda t: lower({0}) not in ({1})), lambda t: lower(concat_ws(' ', {2})))".format(att("type"), ", ".join(f"'{k}'" for k in PT.SKIPPED_KINDS), ", ".join(att(x) for x in ("name", "id", "placeholder", "aria-label", "autocomplete", "title", "type")))
    of = "len(list_filter(f, lambda t: lower({0}) = '{1}'))"
    asks = ", ".join(f"(len(list_filter(x, lambda v: regexp_matches(v, '{p}'))) > 0" + (" or secret > 0" if k == "password" else "") + f")::int as asks_{k}" for k, p in H.ASKS.items())
    words = ", ".join(f"least(len(list_distinct(regexp_extract_all(lower(said), {quoted('|'.join(p))}))), 5) as phrases_{g}" for g, p in H.PHRASES.items())
    links = " union all ".join(f"select page_id, '{t}' as kind, unnest(list_filter(list_transform({EL.format(t)}, lambda t: trim({att(a)})), lambda v: regexp_matches(v, '(?i)^(https?:)?//'))) as v from p" for t, a in (("form", "action"), ("script", "src"), ("a", "href")))
    host_of = HOST_SQL.replace("url", "regexp_replace(v, '^//', 'https://')")
    return f"""with p as (select page_id, {ODD} as url, {AUG} as html from pages),
h as (select page_id, url, {HOST_SQL} as host, coalesce(nullif(regexp_extract(url, {rest}, 1), ''), '/') as path from p),
u as (select *, length(url) as url_length, regexp_matches(host, '^[0-9.]+$') as ip, replace(host, 'xn--bcher-kva', 'bücher') as seen, {tail('host', 2)} as reg, {site('host')} as site, string_split({tail('host', 2)}, '.')[1] as l, string_split({tail('replace(host, \'xn--bcher-kva\', \'bücher\')', 2)}, '.')[1] as label, string_split(host, '.')[:-3] as below from h),
b(ord, name, domains, l, keys) as (values {names}),
off as (select u.host, arg_min(name, ord) as body from (select distinct host from u) u, (select ord, name, unnest(domains) as d from b) b where u.host = d or ends_with(u.host, '.' || d) group by 1),
im as (select host, arg_min(name, ((k > 0)::int, ord)) as imitated, arg_min(k, ((k > 0)::int, ord)) as k from (select u.host, b.ord, b.name, {kinds} as k from (select distinct host, l, below from u where not ip) u, b where host not in (select host from off)) x where k is not null group by 1),
link as (select u.page_id, length(seen) as host_length, length(path) as path_length, length(path) - length(replace(path, '/', '')) as path_depth, length(host) - length(replace(host, '.', '')) as host_dots, starts_with(url, 'https://')::int as https,
case when ip then 0 else greatest(len(string_split(host, '.')) - 2, 0) end as subdomain_depth, case when ip then 0 else round(len(regexp_extract_all(seen, '[0-9]')) / length(seen), 2) end as digit_ratio, case when ip then 0 else length(label) - length(replace(label, '-', '')) end as hyphens,
case when ip then 0 else round({ent('label')}, 2) end as entropy, (not ip and len(list_filter(string_split_regex(lower(label), '[-_.]+'), lambda w: {odd})) > 0)::int as random_name, ip::int as is_ip, contains(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '@')::int as has_at,
contains(substr(path, 2), '//')::int as double_slash_path, (string_split(host, '.')[-1] in ('xyz', 'top'))::int as abused_tld, 0 as shortener, regexp_matches(url, ':8080')::int as odd_port, contains(host, 'xn--')::int as punycode,
len(list_filter(list_distinct(string_split_regex(lower(regexp_extract(url, {rest}, 1) || ' ' || regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)), '[^a-z0-9-]+') || string_split_regex(host, '[^a-z0-9]+')), lambda w: w in ({', '.join(quoted(w) for w in L.URL_WORDS)}))) as url_words,
(k is not null)::int as lookalike, 0 as lookalike_homograph, (coalesce(k, 9) in (0, 1))::int as lookalike_typo, (coalesce(k, 9) = 2)::int as lookalike_combo, (coalesce(k, 9) = 3)::int as lookalike_subdomain, imitated, body, k, url_length from u left join im using (host) left join off using (host)),
fs as (select page_id, html, {EL.format('input|select|textarea')} as f, {EL.format('form')} as fm, {EL.format('iframe')} as fr, {EL.format('meta')} as m, list_transform({EL.format('a')}, lambda t: trim({att('href')})) as a, {TEXT_SQL} as text, trim(substr({decoded("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, 1, 200)) as title, {TAGS_SQL} as tg, {WORDS_SQL} as wd from p),
ft as (select *, list_transform(fm, lambda t: trim({att('action')})) as ac, {fields} as x, {of.format(att('type'), 'password')} as secret, concat_ws(' ', title, text, array_to_string(list_transform({EL.format('img')}, lambda t: {att('alt')}), ' ')) as said from fs),
page as (select page_id, 1 as captured, len(fm) as forms, len(f) as inputs, secret as password_fields, {of.format(att('type'), 'hidden')} as hidden_fields, {asks}, (len(list_filter(ac, lambda v: v in ('', '#', 'about:blank') or regexp_matches(v, '(?i)^javascript:'))) > 0)::int as form_without_target, (len(list_filter(ac, lambda v: regexp_matches(v, '(?i)^mailto:'))) > 0)::int as mailto_form,
regexp_matches(text, '\\b0x[a-fA-F0-9]{{40}}\\b')::int + regexp_matches(text, '\\b(bc1[ac-hj-np-z02-9]{{25,60}}|[13][a-km-zA-HJ-NP-Z1-9]{{25,34}})\\b')::int + regexp_matches(text, '\\bT[1-9A-HJ-NP-Za-km-z]{{33}}\\b')::int as wallets, {words},
len(fr) as iframes, len(list_filter(fr, lambda t: {att('width')} in ('0', '1') or {att('height')} in ('0', '1') or contains(replace({att('style')}, ' ', ''), 'display:none'))) as hidden_iframes, regexp_matches(html, '(?i)oncontextmenu *= *["'']? *return +false')::int as right_click_blocked,
len(regexp_extract_all(html, '\\beval *\\(|\\batob *\\(|\\bunescape *\\(|String\\.fromCharCode|document\\.write *\\(')) as obfuscation, round(coalesce(list_sum(list_transform(regexp_extract_all(html, '{PT.BLOB}'), lambda v: length(v))), 0) / length(html), 3) as base64_share, len(a) as links,
case when len(a) > 0 then round(len(list_filter(a, lambda v: v in ('', '#') or regexp_matches(v, '(?i)^javascript:'))) / len(a), 2) else 0 end as empty_link_share, least(len(list_distinct(list_filter(a, lambda v: regexp_matches(v, '(?i)\\.(exe|msi|scr|bat|cmd|ps1|vbs|jar|apk|dmg|pkg|iso)(\\?|$)')))), 10) as executable_links,
len(list_distinct(regexp_extract_all(text, '(\\+?\\d[\\d\\s().-]{{8,}}\\d)'))) as phone_numbers, len({EL.format('script')}) as scripts, len({EL.format('img')}) as images, (len(list_filter(m, lambda t: lower({att('http-equiv')}) = 'refresh')) > 0)::int as meta_refresh, (len(list_filter(m, lambda t: lower({att('name')}) = 'robots' and contains(lower({att('content')}), 'noindex'))) > 0)::int as noindex,
(title <> '')::int as has_title, length(title) as title_length, ln(1 + len(tg)) as tags_log, ln(1 + len(wd)) as words_log, case when len(tg) > 0 then len(wd) / len(tg) else 0 end as words_per_tag, said, title from ft),
wb as (select b.ord, b.name, unnest(keys) as word from b),
mn as (select page_id, name, ord, count(*) as times from (select page_id, unnest(regexp_extract_all(lower(said), '[\\p{{L}}\\p{{N}}_]+')) as word from page) w join wb using (word) group by all),
mc as (select page_id, count(*) as brands_mentioned, arg_min(name, (-times, ord)) as top, max(times) as mentions from mn group by 1),
ti as (select page_id, list_distinct(list(name)) as tl from (select page_id, unnest(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_]+')) as word from page) w join wb using (word) group by 1),
ls as (select page_id, kind, {host_of} as th from ({links}) l),
aw as (select ls.page_id, count(*) filter (kind = 'form' and {tail('th', 2)} <> reg) as ff, count(*) filter (kind = 'script' and {tail('th', 2)} <> reg) as fsx, count(*) filter (kind = 'a' and {tail('th', 2)} <> reg) as fa, least(count(distinct {site('th')}) filter (kind = 'a' and {site('th')} <> site), 60) as fo from ls join (select page_id, case when ip then '{{}}' else reg end as reg, site from u) o using (page_id) where th <> '' group by 1),
al as (select *, case when {' + '.join(f'asks_{k}' for k in H.ASKS)} > 0 and mentions >= 3 and brands_mentioned <= 3 then top end as about from link join page using (page_id) left join mc using (page_id) left join ti using (page_id) left join aw using (page_id)),
z as (select *, {' + '.join(f'asks_{k}' for k in H.ASKS)} as asks_count, (coalesce(ff, 0) > 0)::int as form_to_other_domain, coalesce(len(tl), 0) as brand_in_title, len(list_distinct(list_filter([imitated] || list_filter(coalesce(tl, []) || [about], lambda v: v is distinct from body), lambda v: v is not null))) as impersonated,
coalesce(fsx, 0) as external_scripts, case when links > 0 then round(coalesce(fa, 0) / links, 2) else 0 end as external_link_share, coalesce(fo, 0) as out_domains from al)
""" + (final or f"select page_id, {', '.join(f'round(cast(coalesce({n}, 0) as double), 6) as {n}' for n in M.FEATURES)} from z")


@query("m01_vector", vector_sql())
def m01(spark, sf):
    """The 78 numbers of every page."""
    v = M.page_vector(odd_pages(spark, sf), LT.suffix_table(spark), spark.createDataFrame(NAMES, "ord int, name string, domains array<string>, labels array<string>, keywords array<string>"))
    return v.select("page_id", *[F.round(n, 6).alias(n) for n in M.FEATURES])


#: What the rules say of a page, from its numbers.
DIGEST_SQL = vector_sql(
    "select * from (with q as (select page_id, body, k, coalesce(impersonated, 0) > 0 as posing, " + ", ".join(f"coalesce({n}, 0) as {n}" for n in M.FEATURES if n not in ("impersonated", "captured", "tags_log", "words_log")) + ", round(exp(words_log) - 1) as n_words, imitated, tl, about, url_length from z), "
    "f as (select *, list_filter([" + ", ".join(f"case when asks_{k} > 0 then {v} end" for k, v in S2.FIELD_POINTS.items()) + "], lambda v: v is not null) as fp, coalesce([imitated], []) || list_sort(coalesce(tl, [])) || [about] as claimed, coalesce(body is not null and k is null, false) as own, n_words < 600 as short from q), "
    "s as (select *, list_filter(claimed, lambda v, i: v is not null and (i = 1 or v is distinct from body) and list_position(claimed, v) = i) as posed, (case when lookalike_typo > 0 then 35 when lookalike_combo > 0 then 25 when lookalike_subdomain > 0 then 30 else 0 end + 20 * is_ip + 15 * has_at + 10 * punycode + 8 * abused_tld + 8 * (subdomain_depth >= 3)::int + 8 * random_name + 5 * (hyphens >= 2)::int + case when body is null then least(4 * url_words, 12) else 0 end + 5 * (url_length > 100)::int + 8 * odd_port + 5 * double_slash_path "
    "+ case when len(fp) > 0 and not own then least(list_max(fp) + 5 * (len(fp) - 1), 45) + 20 * (1 - https) else 0 end + case when posing and len(fp) > 0 then 25 when posing and brand_in_title > 0 then 10 else 0 end + 15 * form_to_other_domain + case when len(fp) > 0 then 5 * form_without_target else 0 end + 10 * mailto_form + 10 * (wallets > 0)::int "
    + " ".join(f"+ case when short and phrases_{g} > 0" + (" and not own" if g in ("urgency", "government") else "") + f" then {v} else 0 end" for g, v in S2.PHRASE_POINTS.items())
    + " + 15 * (executable_links > 0)::int + 8 * right_click_blocked + 8 * (obfuscation >= 3)::int + 5 * (hidden_iframes > 0)::int + 8 * (links >= 5 and empty_link_share > 0.5)::int + 5 * (base64_share > 0.3)::int) as risk, case when own then 40 else 0 end as credit from f), "
    "r as (select *, cast(greatest(0, least(100, risk - credit)) as integer) as rule_score from s), v as (select *, case when rule_score <= 30 then 'safe' when rule_score <= 69 then 'suspicious' else 'dangerous' end as verdict, "
    "[case when asks_netbanking + asks_otp + asks_upi_pin + asks_atm_pin + asks_card + asks_cvv + asks_bank_account > 0 then 2 else 0 end, case when asks_password > 0 then 2 + form_to_other_domain else 0 end, 4 * asks_seed_phrase + 2 * (wallets > 0)::int + 2 * (phrases_crypto >= 2)::int, "
    "case when phrases_prize >= 2 then 3 when phrases_prize > 0 then 1 else 0 end + (phrases_prize > 0 and asks_card + asks_cvv + asks_bank_account + asks_upi_pin > 0)::int, 2 * (phrases_shopping >= 2)::int + (phrases_shopping > 0 and asks_card + asks_cvv > 0)::int, 3 * (phrases_tech_support >= 2)::int + (phrases_tech_support > 0 and phone_numbers > 0)::int, "
    "2 * (executable_links > 0)::int + (phrases_download > 0)::int, 3 * (phrases_job >= 2)::int, 2 * (phrases_government > 0)::int + (phrases_government > 0 and asks_card + asks_cvv + asks_upi_pin + asks_bank_account + asks_aadhaar + asks_pan > 0)::int] as e from r), "
    "t as (select *, case when verdict <> 'safe' and list_max(e) >= 3 then [" + ", ".join(f"'{k}'" for k in S2.SCAM_TYPES) + "][list_position(e, list_max(e))] end as scam_type from v) "
    "select page_id, rule_score, verdict, scam_type, array_to_string(posed, ',') as posed, own as trusted, case when scam_type is not null and len(posed) > 0 then case when scam_type in ('prize', 'job', 'malware', 'tech_support') then 'This looks like a ' || noun || ' using ' || posed[1] || '''s name.' else 'This looks like a fake ' || posed[1] || ' ' || noun || '.' end "
    "when scam_type is not null then said when verdict = 'dangerous' then 'Several strong warning signs. Treat this link as dangerous.' when verdict = 'suspicious' then 'Some warning signs. Be careful with this link.' when body is not null then 'This looks like the real website of ' || body || case when risk > 0 then '. Only small warning signs found.' else '. No warning signs found.' end "
    "else case when risk > 0 then 'Only small warning signs found' else 'No warning signs found' end || '. That doesn''t guarantee it''s safe, so stay careful.' end as summary from t left join (values " + ", ".join(f"('{k}', '{S2.TYPE_NOUNS[k]}', '{S2.TYPE_SAID[k]}')" for k in S2.SCAM_TYPES) + ") w(scam_type, noun, said) using (scam_type))"
)


@query("h14_r12_digest", DIGEST_SQL)
def h14b(spark, sf):
    """What link and html say of every page as a judgement: rule score, verdict, type, brands it poses as, one sentence."""
    names = spark.createDataFrame(NAMES, "ord int, name string, domains array<string>, labels array<string>, keywords array<string>")
    d = DG.digest(odd_pages(spark, sf), LT.suffix_table(spark), names)
    return d.select("page_id", "rule_score", "verdict", "scam_type", F.array_join("posed", ",").alias("posed"), "trusted", "summary")


#: Two small trees for checks by hand; f -1 marks a leaf.
TREES = [(0, 0, 1, 0.02, 1, 2, 0.1), (0, 1, -1, 0.0, -1, -1, -0.8), (0, 2, 0, 8.0, 3, 4, 1.5), (0, 3, -1, 0.0, -1, -1, 1.0), (0, 4, -1, 0.0, -1, -1, 2.2), (1, 0, 2, 0.1, 1, 2, 0.1), (1, 1, -1, 0.0, -1, -1, -0.3), (1, 2, -1, 0.0, -1, -1, 1.4)]
TREE_SQL = "s as (select id, y, case when f1::float <= 0.02 then -0.8 when f0::float <= 8.0 then 1.0 else 2.2 end + case when f2::float <= 0.1 then -0.3 else 1.4 end as raw, (f1::float <= 0.02) as a, (f0::float <= 8.0) as b, (f2::float <= 0.1) as c from f)"


def scored(spark, sf):
    nodes = spark.createDataFrame(TREES, "tree int, node int, f int, t double, l int, r int, v double")
    return M.score(vectors(spark, sf), nodes)


@query("m04_score", f"with {FEATURE_SQL}, {TREE_SQL} select id, round(raw, 6)::double as raw, round(1 / (1 + exp(-raw)), 6) as probability, 0.0::double as rest from s")
def m04(spark, sf):
    """Sum of leaves and its logistic; what the steps and the roots leave unexplained is zero."""
    s = scored(spark, sf)
    told = F.aggregate("steps", F.lit(0.0), lambda a, x: a + x["d"])
    return s.select("id", F.round("raw", 6).alias("raw"), F.round(1 / (1 + F.exp(-F.col("raw"))), 6).alias("probability"), F.abs(F.round(F.col("raw") - F.col("roots") - told, 6)).alias("rest"))


@query("m04_causes", f"with {FEATURE_SQL}, {TREE_SQL}, p as (select id, 1 as f, case when a then -0.9 else 1.4 end as push from s union all select id, 0, case when b then -0.5 else 0.7 end from s where not a union all select id, 2, case when c then -0.4 else 1.3 end from s) select id, f, round(push, 6)::double as push from p")
def m04b(spark, sf):
    return M.causes(scored(spark, sf)).withColumn("push", F.round("push", 6))


@query("m05_m06_points", "with x as (select event_id, (event_id % 101) / 100.0 as p, event_id % 40 as rule, event_id % 13 as backing, event_id % 9 = 0 as trusted, event_id % 5 = 0 as shared from events), y as (select *, case when p >= 0.95 then 50 when p >= 0.8 then 40 when p >= 0.6 then 25 when p >= 0.4 then 10 when p <= 0.05 then -20 when p <= 0.15 then -10 else 0 end as pts from x), z as (select *, case when pts > 0 and trusted then 0 when pts > 0 and backing < 8 then greatest(0, least(pts, 20, 30 - rule)) when pts > 0 and shared then least(pts, 20) else pts end as said from y) select event_id, cast(pts as integer) as points, cast(said as integer) as said, cast(least(greatest(rule + said, 0), 100) as integer) as score from z")
def m05(spark, sf):
    c = F.col("event_id")
    x = table(spark, sf, "events").select("event_id", ((c % 101) / 100.0).alias("p"), (c % 40).alias("rule"), (c % 13).alias("backing"), (c % 9 == 0).alias("trusted"), (c % 5 == 0).alias("shared"))
    said = M.say(F.col("p"), F.col("rule"), F.col("backing"), F.col("trusted"), F.col("shared")).cast("int")
    return x.select("event_id", M.points(F.col("p")).alias("points"), said.alias("said"), F.least(F.greatest(F.col("rule") + said, F.lit(0)), F.lit(100)).cast("int").alias("score"))


@query("m07_auc", f"with {FEATURE_SQL}, q as (select y, least(f1 * 10, 1) as g from f), c as (select g, count(*) filter (y = 1) as a, count(*) filter (y = 0) as b from q group by 1), r as (select *, sum(a) over (order by g desc) as ta, sum(b) over (order by g desc) as tb from c) select round(sum(b * (ta - a / 2)) / (sum(a) * sum(b)), 6) as roc_auc, round(sum(a * ta / (ta + tb)) / sum(a), 6) as pr_auc from r")
def m07(spark, sf):
    rows = labelled(spark, sf).select("y", F.least(F.col("marks") * 10, F.lit(1.0)).alias("p"))
    return M.auc(rows).select(F.round("roc_auc", 6).alias("roc_auc"), F.round("pr_auc", 6).alias("pr_auc"))


def labelled_vectors(spark, sf):
    """id, size, path and features of every page, y: a page that says it is not in English stands for a scam (the pages have no labels)."""
    odd, names = odd_pages(spark, sf), spark.createDataFrame(NAMES, "ord int, name string, domains array<string>, labels array<string>, keywords array<string>")
    v = cut(M.page_vector(odd, LT.suffix_table(spark), names), "vectors")
    known = odd.select("page_id", (~F.col("html").rlike('(?i)<html[^>]* lang="?en')).cast("int").alias("y"))
    # Merge, here and below: an array counts as one number in Spark's sizes, so rows of 78 look small enough to be sent through the driver.
    return cut(M.assembled(v, "page_id", "tags_log", "path_length").join(known.hint("merge"), "page_id").withColumnRenamed("page_id", "id"), "labelled")


def training_rows(rows):
    """Adds held_back (the last 15 % by date, here the id) and weight (honest pages of groups with more scams count for more)."""
    held = T.hold_out(rows.withColumn("day", F.floor(F.col("id") / 1000)), "id", "day", 0.85)
    sized = rows.join(held.hint("merge"), "id").withColumn("size", F.round(F.expm1("tags_log")).cast("long")).withColumn("bare", F.col("path_length") < 2)
    edges = [40, 100, 300, 1000]
    weights = T.group_weights(sized.where("not held_back").select("y", "size", "bare"), edges)
    stepped = sized.withColumn("step", T.size_step(F.col("size"), edges)).join(weights.select("step", "bare", "weight"), ["step", "bare"])
    return stepped.withColumn("weight", F.when(F.col("y") == 0, F.col("weight")).otherwise(1.0))


def trained(spark, sf, trees=12):
    """(node rows, training rows): boosted trees on the 78 numbers of the pages; a dozen trees, as each takes some passes."""
    v = labelled_vectors(spark, sf)
    data = cut(training_rows(v).select("id", "features", "y", "weight", "held_back"), "training")
    return B.fit(data, settings=B.Settings(trees=trees)).nodes(spark), data


@query("m02_m03_m09_training")
def m02(spark, sf):
    """Train on the vectors of pages, score all of them by the table of nodes, report rates."""
    nodes, data = trained(spark, sf)
    raw = M.score(data, nodes).select("id", (100 / (1 + F.exp(-F.col("raw")))).alias("score")).join(data.select("id", "y").hint("merge"), "id")
    return M.report(raw, [40, 60, 80, 95])


#: The first two trees of one split each, over stated thresholds, from sums over all labelled rows.
STUMP_STEPS = {"n_chars": [200, 1000, 3000, 8000], "marks": [0.0, 0.01, 0.02, 0.05], "capitals": [0.01, 0.02, 0.05]}
STUMP_SQL = (
    "y0 as (select id, y, array[n_chars::double, marks, capitals] as x from fl), base as (select ln(sum(y) / sum(1 - y)) as b from y0), r0 as (select id, y, x, (select b from base) as m from y0), "
    + ", ".join(
        f"g{k} as (select id, y, x, m, 1 / (1 + exp(-m)) as p from r{k}), c{k} as (select f, t, sum(p - y) filter (x[f + 1] <= t) as gl, sum(p * (1 - p)) filter (x[f + 1] <= t) as hl, count(*) filter (x[f + 1] <= t) as nl, sum(p - y) as g, sum(p * (1 - p)) as h, count(*) as n from g{k}, cand group by all), "
        f"b{k} as (select *, gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1) as gain from c{k} where nl >= 40 and n - nl >= 40 order by gain desc, f, t limit 1), r{k + 1} as (select id, y, x, m - 0.3 * case when x[f + 1] <= t then gl / (hl + 1) else (g - gl) / (h - hl + 1) end as m from r{k}, b{k})"
        for k in range(2)
    )
    + ", nodes as ("
    + " union all ".join(
        f"select {k} as tree, 0 as node, f, t, 1 as l, 2 as r, -0.3 * g / (h + 1) + {'b' if k == 0 else '0'} as v, gain, n from b{k}, base union all select {k}, 1, -1, 0, -1, -1, -0.3 * gl / (hl + 1) + {'b' if k == 0 else '0'}, 0, nl from b{k}, base "
        f"union all select {k}, 2, -1, 0, -1, -1, -0.3 * (g - gl) / (h - hl + 1) + {'b' if k == 0 else '0'}, 0, n - nl from b{k}, base"
        for k in range(2)
    )
    + ")"
)
STUMP_CAND = "cand as (select f, t from (" + " union all ".join(f"select {i} as f, {float(t)}::double as t" for i, x in enumerate(STUMP_STEPS.values()) for t in x) + "))"


def stumps(spark, sf):
    rows = labelled(spark, sf).select("id", "y", F.array(F.col("n_chars").cast("double"), "marks", "capitals").alias("features"), F.lit(1.0).alias("weight"), F.lit(False).alias("held_back"))
    bounds = [np.array(x, float) for x in STUMP_STEPS.values()]
    return B.fit(rows, settings=B.Settings(rate=0.3, leaves=2, trees=2, rows=1.0, features=1.0), bounds=bounds).nodes(spark)


@query("m03_nodes", f"with {FEATURE_ROWS_SQL}, {STUMP_CAND}, {STUMP_SQL} select tree, node, cast(f as integer) as f, round(cast(t as double), 6) as t, l, r, round(v, 3) as v, round(gain, 2) as gain, n from nodes")
def m03(spark, sf):
    """Trees as rows: two trees of one split, learnt from all labelled documents."""
    return stumps(spark, sf).select("tree", "node", "f", F.round("t", 6).alias("t"), "l", "r", F.round("v", 3).alias("v"), F.round("gain", 2).alias("gain"), "n")


@query("m08_gain_shares", f"with {FEATURE_ROWS_SQL}, {STUMP_CAND}, {STUMP_SQL} select ['n_chars', 'marks', 'capitals'][f + 1] as feature, round(sum(gain) / (select sum(gain) from nodes where f >= 0), 3) as share from nodes where f >= 0 group by 1")
def m08(spark, sf):
    """How much of those trees' gain each feature has."""
    return B.gain_shares(stumps(spark, sf), list(STUMP_STEPS)).withColumn("share", F.round("share", 3))


@query("m08_page_gains")
def m08b(spark, sf):
    """The fifteen numbers of a page with most of the gain of the trees learnt on pages."""
    return B.gain_shares(trained(spark, sf)[0], M.FEATURES).withColumn("share", F.round("share", 6))


#: An evaluation's lines for the twin: section, line, which rows, what is met.
LINES = (
    [("cutoff", c, "true", f"p >= {c / 100}") for c in (95, 80, 60, 50, 40)] + [("low", c, "true", f"p <= {c / 100}") for c in (5, 15)] + [("fresh", 50, "fresh", "p >= 0.5")]
    + [("size", k, f"step = {k}", "p >= 0.5") for k in range(5)] + [("small", 50, "step <= 1", "p >= 0.5"), ("plain", 50, "true", "plain >= 0.5"), ("plain", "small", "step <= 1", "plain >= 0.5")]
    + [("scan", f"{n} {w}", "true", f"{c} > {at}") for n, c in (("rules", "rule"), ("both", "total"), ("unlimited", "free")) for w, at in (("suspicious", 30), ("dangerous", 69))]
)
OUTSIDE_LINES = [("outside", c, "outside", f"p >= {c / 100}") for c in (40, 60, 80, 95)] + [("outside", "plain 60", "outside", "plain >= 0.6"), ("outside", "both suspicious", "outside", "total > 30"), ("outside", "unlimited suspicious", "outside", "free > 30")]
#: How an evaluation's other columns follow from a labelled row, in both dialects: f0 to f3 and y as in FEATURE_SQL.
SEEN = {"size": "cast(round(exp(f0) - 1) as bigint)", "fresh": "f3 = 0", "outside": "y = 0 and f1 = 0", "rule": "cast(least(floor(f2 * 1500), 100) as int)", "backing": "cast(least(floor(f2 * 500), 100) as int)", "trusted": "f2 < 0.01", "shared": "f1 > 0.03"}
EVALUATION_SQL = (
    f"with {FEATURE_SQL}, {TREE_SQL.replace('select id, y,', 'select f.*,')}, x as (select *, 1 / (1 + exp(-raw)) as p, 1 / (1 + exp(case when a then 0.8 when b then -1.0 else -2.2 end)) as plain, {', '.join(f'{v} as {k}' for k, v in SEEN.items())} from s), "
    "g as (select *, case when size < 200 then 0 when size < 1000 then 1 when size < 3000 then 2 when size < 8000 then 3 else 4 end as step, case when p >= 0.95 then 50 when p >= 0.8 then 40 when p >= 0.6 then 25 when p >= 0.4 then 10 when p <= 0.05 then -20 when p <= 0.15 then -10 else 0 end as pts from x), "
    "t as (select *, least(greatest(rule + pts, 0), 100) as free, least(greatest(rule + case when pts > 0 and trusted then 0 when pts > 0 and backing < 8 then greatest(0, least(pts, 20, 30 - rule)) when pts > 0 and shared then least(pts, 20) else pts end, 0), 100) as total from g), "
    f"l as ({' union all '.join(f"select '{a}' as section, '{b}' as line, y, {hit} as hit, {among} as among from t where {'' if a == 'outside' else 'not '}outside" for a, b, among, hit in LINES + OUTSIDE_LINES)}), "
    "k as (select section, line, count(*) filter (among and hit and y = 1) as tp, count(*) filter (among and hit and y = 0) as fp, count(*) filter (among and not hit and y = 1) as fn, count(*) filter (among and not hit and y = 0) as tn from l group by all) "
    "select *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) as false_alarms from k"
)


@query("m09_evaluation", EVALUATION_SQL)
def m09(spark, sf):
    """All tables of an evaluation, for two small trees against the first of them alone."""
    rows = cut(labelled(spark, sf), "labelled")
    v = M.vector(rows, "id", ["n_chars"], ["marks", "capitals"], ["english"])
    chance = lambda nodes, name: M.score(v, spark.createDataFrame(nodes, "tree int, node int, f int, t double, l int, r int, v double")).select("id", (1 / (1 + F.exp(-F.col("raw")))).alias(name))
    both = chance(TREES, "p").join(chance([n for n in TREES if n[0] == 0], "plain"), "id")
    seen = rows.select("id", "y", F.log1p("n_chars").alias("f0"), F.col("marks").alias("f1"), F.col("capitals").alias("f2"), F.col("english").cast("int").alias("f3"))
    return M.evaluation(seen.withColumns({k: F.expr(e) for k, e in SEEN.items()}).join(both, "id"), [200, 1000, 3000, 8000])


# --- fingerprints of vectors ---------------------------------------------------------------------------------------


@query("f05_bit_distance", "with x as (select o_orderkey, o_custkey, o_orderkey * 7919 as a, o_custkey * 104729 as b from orders) select o_orderkey, bit_count(xor(a::bigint, b::bigint)) as bits from x")
def f05(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", P.distance((F.col("o_orderkey") * 7919).cast("long"), (F.col("o_custkey") * 104729).cast("long")).alias("bits"))


CODE_SQL = f"ct as (select page_id, {TAGS_SQL} as t from pages), cs as (select page_id, list_sort(list_distinct({shingle_sql('t', 4)})) as s from ct), cg as (select page_id, s, min(page_id) over (partition by s) as structure from cs where len(s) > 0)"


def structures(spark, sf):
    """page_id, its tag shingles as a sorted set, and the first page with the same set."""
    # Empty sets go once the others are written: a filter would move below the walk of the page, and every page would be walked twice.
    s = cut(read(spark, sf).select("page_id", F.array_sort(F.array_distinct(P.shingles(F.col("tags"), 4))).alias("s")), "shingles").where(F.size("s") > 0)
    return s.join(s.groupBy("s").agg(F.min("page_id").alias("structure")), "s")


@query("f06_structures", f"with {CODE_SQL} select page_id, structure from cg")
def f06b(spark, sf):
    """Which pages have one structure, named by its first page."""
    return structures(spark, sf).select("page_id", "structure")


@query("f06_code_likeness", f"with {CODE_SQL}, x as (select page_id, len(s) as n, unnest(s) as i from cg where page_id = structure), j as (select x.page_id as a, y.page_id as b, x.n + y.n - count(*) as u, count(*) as c from x join x y using (i) where x.page_id < y.page_id group by x.page_id, y.page_id, x.n, y.n), d as (select a, b, round((u - c) / u, 4) as distance from j where c >= 0.8 * u - 1e-9) select a, b, distance, case when distance <= 0.05 then 2.5 when distance <= 0.1 then 2.0 else 1.0 end::double as points from d")
def f06(spark, sf):
    """Page structures whose tag shingles share 0.8 or more, and point steps for the rest; one row for two structures."""
    s = structures(spark, sf).where("page_id = structure")
    near = near_sets(s, "page_id", "s").select("a", "b", F.round((F.col("both") - F.col("same")) / F.col("both"), 4).alias("distance"))
    return near.withColumn("points", F.when(F.col("distance") <= 0.05, 2.5).when(F.col("distance") <= 0.1, 2.0).otherwise(1.0))


LOOK_SQL = "with s as (select vec_id, b, sum(case when hash_bit = 1 then x else -x end) as s from (select vec_id, b, embedding[i + 1] as x, ('0x' || substr(md5(b || '/' || i), 1, 1))::integer & 1 as hash_bit from embeddings, range(64) t(b), range(64) u(i)) group by all) select vec_id, cast(sum(case when s > 0 then case when b = 63 then -9223372036854775808::hugeint else (1::hugeint << b::integer) end else 0 end) as bigint) as look from s group by 1"


@query("f07_look_hash", LOOK_SQL)
def f07(spark, sf):
    """A 64-bit sign hash of each embedding: 64 fixed planes of plus and minus ones."""
    import hashlib

    planes = [[1.0 if int(hashlib.md5(f"{b}/{i}".encode()).hexdigest()[0], 16) & 1 else -1.0 for i in range(64)] for b in range(64)]
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    signs = e.select("vec_id", F.transform(F.array(*[F.array(*[F.lit(x) for x in p]) for p in planes]), lambda p: F.aggregate(F.zip_with("e", p, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))).alias("s"))
    bit = lambda i: F.when(F.element_at("s", i + 1) > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
    value = F.lit(0).cast("long")
    for i in range(64):
        value = value.bitwiseOR(bit(i))
    return signs.select("vec_id", value.alias("look"))


ALIKE_SQL = f"""with {PRINTS_SQL}, lk as ({LOOK_SQL}), {CODE_SQL}, x as (select page_id, len(s) as n, unnest(s) as i from cg where page_id = structure),
j as (select x.page_id as a, y.page_id as b, x.n + y.n - count(*) as u, count(*) as c from x join x y using (i) where x.page_id < y.page_id group by x.page_id, y.page_id, x.n, y.n), nr as (select a, b, round((u - c) / u, 4) as distance from j where c >= 0.8 * u - 1e-9),
q as (select prints.*, look, structure from prints left join lk on vec_id = page_id left join cg using (page_id)),
p2 as (select x.page_id as a, y.page_id as b, x.dom_hash is not distinct from y.dom_hash as same, xor(x.dom, y.dom) as xd, xor(x.txt, y.txt) as xt, bit_count(xor(x.look, y.look)) as ld, least(x.structure, y.structure) as s1, greatest(x.structure, y.structure) as s2 from q x join q y on x.page_id < y.page_id where x.tags >= 15 and y.tags >= 15 and x.words >= 20 and y.words >= 20),
p3 as (select p2.*, bit_count(xd) as sd, bit_count(xt) as wd, case when s1 = s2 then 0 else cast(least(round(distance * 600), 100) as integer) end as code from p2 left join nr on nr.a = s1 and nr.b = s2 where same or {' or '.join(f'((xd >> {16 * i}) & 65535) = 0 or ((xt >> {16 * i}) & 65535) = 0' for i in range(4))}),
s as (select *, case when code <= 30 then 2.5 when code <= 60 then 2.0 when code <= 100 then 1.0 else 0 end as cp, case when same then 1.5 when sd <= 3 then 1.25 when sd <= 8 then 0.75 else 0 end as sp, case when wd <= 4 then 2.0 when wd <= 8 then 1.25 when wd <= 12 then 0.5 else 0 end as wp, case when ld <= 4 then 2.0 when ld <= 8 then 1.25 when ld <= 10 then 0.5 else 0 end as lp from p3)
select a, b, round(cp + sp + wp + lp, 2)::double as points, concat_ws(',', case when cp > 0 then 'code' end, case when sp > 0 then 'structure' end, case when wp > 0 then 'words' end, case when lp > 0 then 'look' end) as kinds from s where cp + sp + wp + lp >= 3.0 and (cp > 0)::int + (sp > 0)::int + (wp > 0)::int + (lp > 0)::int >= 2 and (wp > 0 or lp > 0)"""


@query("g01_all_kinds", ALIKE_SQL)
def g01_kinds(spark, sf):
    """Pages alike by code (shared runs of tags), structure, words and look (sign hashes of the vectors of the same number)."""
    f = cut(fingerprints(spark, sf), "prints")
    look = f07(spark, sf).select(F.col("vec_id").alias("page_id"), "look")
    none = F.lit(None)
    lib = f.join(look, "page_id", "left").select(F.col("page_id").alias("id"), none.cast("string").alias("title"), "words", "tags", "dom_hash", "dom", "txt", F.concat(P.bands(F.col("dom"), 0), P.bands(F.col("txt"), 1)).alias("bands"), none.cast("int").alias("icon"), "look")
    lib, icons = cut(lib, "library"), spark.createDataFrame([], "icon int")
    s = cut(structures(spark, sf), "structures")
    near = near_sets(s.where("page_id = structure"), "page_id", "s").select("a", "b", F.round((F.col("both") - F.col("same")) / F.col("both"), 4).alias("distance"))
    near, coded = cut(near, "near"), s.select(F.col("page_id").alias("id"), "structure")
    pairs = cut(similar.whole_pairs(similar.buckets(lib, icons), lib, alike=similar.code_groups(coded, near)), "pairs")
    codes = similar.code_distances(pairs, coded, near)
    return similar.compared(pairs, lib, icons, codes).where("match").select("a", "b", "points", F.array_join("kinds", ",").alias("kinds"))


# --- streams -------------------------------------------------------------------------------------------------------


def event_stream(spark, sf):
    return S.landed(spark, sf, table(spark, sf, "events").schema, "events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


LINE = "concat('hxxp://site', user_id, '[.]com/', event_type)"


@query("t01_feed_stream", "select 'http://site' || user_id || '.com/' || event_type as url from events group by 1")
def t01(spark, sf):
    return S.run_once(S.feed(event_stream(spark, sf).select("ts", F.expr(LINE).alias("line")), late="60 days").select("url"))


@query("t03_trend_stream", "with d as (select cast(ts as date) as day, event_type as verdict, count(*) as n from events group by all) select day, verdict, n from d")
def t03(spark, sf):
    return S.trends(table(spark, sf, "events").withColumnRenamed("event_type", "verdict"))


@query("t03_trend_stream_final", "with d as (select cast(ts as date) as day, event_type as verdict, count(*) as n from events group by 1, 2) select day, verdict, n from d where day + interval 2 day <= (select max(ts) from events)")
def t03b(spark, sf):
    """Days that the watermark has closed, from the stream itself."""
    return S.run_once(S.trends(event_stream(spark, sf).withColumnRenamed("event_type", "verdict")))


QUOTA_SQL = "with recursive c as (select event_id as id, user_id as caller, epoch_us(ts) / 1e6 as tm, row_number() over (partition by user_id order by ts, event_id) as n from events), q as (select id, caller, n, true as allowed, 0.0::double as wait_s, tm as last from c where n = 1 union all select c.id, c.caller, c.n, last <= c.tm - 36000, case when last <= c.tm - 36000 then 0.0::double else last + 36000 - c.tm end, case when last <= c.tm - 36000 then c.tm else last end from q join c on c.caller = q.caller and c.n = q.n + 1) select id, caller, allowed, wait_s from q"


@query("t04_quota", QUOTA_SQL)
def t04(spark, sf):
    return S.quota(table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("caller"), F.col("ts").cast("timestamp").alias("ts")), limit=1, seconds=36_000)


@query("t04_quota_stream", QUOTA_SQL)
def t04b(spark, sf):
    """The quota of callers on a stream: state and timers by event time."""
    calls = event_stream(spark, sf).select(F.col("event_id").alias("id"), F.col("user_id").alias("caller"), F.col("ts").cast("timestamp").alias("ts"))
    with S.rocks(spark):
        return S.run_once(S.quota_stream(calls, limit=1, seconds=36_000, late="60 days"))


@query("t05_latest", "select user_id, arg_max(event_type, (ts, event_id)) as event_type from events group by 1")
def t05(spark, sf):
    return S.latest(table(spark, sf, "events"), "user_id", "event_type", ["ts", "event_id"])


FEEDBACK_SQL = "select event_id, event_id % 500 as scan_id, 'mail [email removed] now' as note, s.event_type as verdict from events e join (select event_id as sid, event_type from events) s on s.sid = e.event_id % 500 where e.event_type in ('click', 'view')"


def feedback_of(e, scans):
    notes = e.select("event_id", (F.col("event_id") % 500).alias("scan_id"), F.col("event_type").alias("kind"), F.concat(F.lit(" mail me"), F.col("user_id").cast("string"), F.lit("@mail.com now ")).alias("note"))
    return S.feedback(notes, scans.select(F.col("event_id").alias("scan_id"), F.col("event_type").alias("verdict")), ("click", "view")).drop("kind")


@query("t06_feedback", FEEDBACK_SQL)
def t06(spark, sf):
    e = table(spark, sf, "events")
    return feedback_of(e, e)


def table_at(spark, name, rows, keys, parts=4):
    """A new table of the snapshot kind in this application's folder."""
    t = Table(spark, f"{folder(spark)}/{name}-{uuid.uuid4().hex}")
    t.create(rows, keys, parts)
    return t


def brought(spark, stream, target, name, rows, **how):
    """The table once the stream has been brought into it."""
    S.into_table(stream, target, name, rows, f"{target.path}-state", **how).awaitTermination()
    return target.read()


@query("t05_latest_stream", "select user_id, arg_max(event_type, (ts, event_id)) as event_type from events group by 1")
def t05b(spark, sf):
    """The last state of each caller, kept by a stream in update mode and brought into a table in one step a batch."""
    state = S.latest(event_stream(spark, sf), "user_id", "event_type", ["ts", "event_id"])
    target = table_at(spark, "latest", spark.createDataFrame([], "user_id long, event_type string"), ["user_id"])
    return brought(spark, state, target, "latest", lambda b: b, output="update")


@query("t06_feedback_stream", FEEDBACK_SQL)
def t06b(spark, sf):
    """Notes as a stream, joined to the table of scans."""
    return S.run_once(feedback_of(event_stream(spark, sf), table(spark, sf, "events")))


LEDGER_SQL = "with l as (select event_id, 'http://site' || user_id || '.com/' || event_type as url from events), old as (select 'http://site' || user_id || '.com/view' as url from events where user_id % 3 = 0) select url, max(seen) as seen from (select url, 'before' as seen from old union all select url, 'stream' from l where url not in (select url from old)) group by 1"


@query("t01_ledger", LEDGER_SQL)
def t01b(spark, sf):
    """A feed brought into the ledger of seen links: only those not in it are added, each once."""
    ledger = "url_hash long, url string, seen string"
    rows = lambda b, seen: b.select(L.md5_long(F.col("url")).alias("url_hash"), "url", F.lit(seen).alias("seen")).to(spark.createDataFrame([], ledger).schema)
    old = table(spark, sf, "events").where("user_id % 3 = 0").select(F.concat(F.lit("http://site"), "user_id", F.lit(".com/view")).alias("url")).distinct()
    target = table_at(spark, "ledger", rows(old, "before"), ["url_hash"])
    feed = event_stream(spark, sf).select("ts", F.expr(LINE).alias("line"))
    clean = lambda b: S.feed(b).select("url")
    return brought(spark, feed, target, "feed", lambda b: rows(clean(b), "stream"), mode="insert_absent").select("url", "seen")


LIBRARY = ["source", "source_ref", "url", "site", "title", "brand", "scam_type", "verdict", "rule_score", "words"]
LIBRARY_PAGES_SQL = (
    f"with g as ({DIGEST_SQL}), p as (select page_id, {ODD} as url, {AUG} as html from pages), w as (select page_id, url, trim(substr({decoded('''regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)''')}, 1, 200)) as title, len({WORDS_SQL}) as words from p where length(html) >= 200), "
    f"h as (select page_id, {HOST_SQL} as host from p) select 'feed' as source, md5(url) as source_ref, replace(replace(url, 'user@', 'REDACTED@'), 'account=1', 'account=REDACTED') as url, array_to_string(string_split(host, '.')[-2:], '.') as site, nullif(title, '') as title, nullif(string_split(posed, ',')[1], '') as brand, scam_type, verdict, rule_score, words from w join g using (page_id) join h using (page_id) qualify row_number() over (partition by url order by page_id desc) = 1"
)


@query("t02_pages_to_library", LIBRARY_PAGES_SQL)
def t02(spark, sf):
    """Captured pages landing as files, through the admission filter and the digest, to rows of the library; a page that is there already is replaced."""
    names = spark.createDataFrame(NAMES, "ord int, name string, domains array<string>, labels array<string>, keywords array<string>")
    suffixes = LT.suffix_table(spark)

    def rows(batch):
        odd = batch.select("page_id", F.expr(ODD).alias("url"), F.expr(AUG).alias("html"))
        return D.library_rows(odd, DG.digest(odd, suffixes, names), "feed").select(*LIBRARY)

    old = rows(table(spark, sf, "pages").where("page_id % 50 = 0")).withColumn("verdict", F.lit("old"))
    target = table_at(spark, "library", old, ["source", "source_ref"])
    stream = S.landed(spark, sf, table(spark, sf, "pages").schema, "pages*.parquet")
    return brought(spark, stream, target, "pages", rows)


@query("u06_redact_record", "select page_id, 'https://x.com/?q=1&token=REDACTED' as final, 'https://y.com/#top' as popup, 2 as n from pages")
def u06(spark, sf):
    """Every link field of a nested record made safe."""
    from linkloom.functions.links import redact

    p = table(spark, sf, "pages").select("page_id", F.struct(F.concat(F.lit("https://x.com/?q=1&token="), F.col("page_id").cast("string")).alias("final"), F.array(F.lit("https://y.com/#top"), F.lit("https://z.com")).alias("popups")).alias("scan"))
    safe = p.withColumn("scan", F.col("scan").withField("final", redact(F.col("scan.final"))).withField("popups", F.transform("scan.popups", redact)))
    return safe.select("page_id", "scan.final", F.get("scan.popups", F.lit(0)).alias("popup"), F.size("scan.popups").alias("n"))


RATED = "select event_id, (event_id % 101) / 100.0 as p, event_id % 40 as rule, event_id % 13 as backing, event_id % 9 = 0 as trusted, event_id % 5 = 0 as shared from events"


@query("m06_rated", f"with x as ({RATED}), y as (select *, case when p >= 0.95 then 50 when p >= 0.8 then 40 when p >= 0.6 then 25 when p >= 0.4 then 10 when p <= 0.05 then -20 when p <= 0.15 then -10 else 0 end as pts from x), z as (select *, case when pts > 0 and trusted then 0 when pts > 0 and backing < 8 then greatest(0, least(pts, 20, 30 - rule)) when pts > 0 and shared then least(pts, 20) else pts end as said from y) select event_id, cast(least(greatest(rule + said, 0), 100) as integer) as total, cast(least(greatest(rule + pts, 0), 100) as integer) as free from z")
def m06(spark, sf):
    """Scores of rules plus model, with and without the limits."""
    e = table(spark, sf, "events").selectExpr(*RATED.removeprefix("select ").removesuffix(" from events").split(", ")).withColumn("p", F.col("p").cast("double"))
    return M.rated(e).select("event_id", F.col("total").cast("int").alias("total"), F.col("free").cast("int").alias("free"))


@query("m07_parity", f"with {FEATURE_SQL}, {TREE_SQL} select count(*) as rows, 0.0::double as worst from s")
def m07b(spark, sf):
    """How far apart the walk over the table of nodes and the same trees as one expression are."""
    f = lambda i: F.get("features", F.lit(i))
    at = lambda x: F.lit(x).cast("float")
    raw = F.when(f(1) <= at(0.02), -0.8).otherwise(F.when(f(0) <= at(8.0), 1.0).otherwise(2.2)) + F.when(f(2) <= at(0.1), -0.3).otherwise(1.4)
    v = vectors(spark, sf)
    return M.furthest(scored(spark, sf).select("id", F.col("raw").alias("p")), v.select("id", raw.alias("p"))).withColumn("worst", F.round("worst", 9))
