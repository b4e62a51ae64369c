"""Page tables: facts read from the html column of a whole table, one row per page and nothing moved unless said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.functions import html as H
from linkloom.functions import links as L
from linkloom.functions import tokens as T

SKIPPED_KINDS = ("hidden", "submit", "button", "image", "reset", "checkbox", "radio")
#: Fixed values: (technology, header, text in its value; "" for any value).
HEADER_RULES = [
    ("Cloudflare", "cf-ray", ""),
    ("Cloudflare", "server", "cloudflare"),
    ("Vercel", "x-vercel-id", ""),
    ("Netlify", "x-nf-request-id", ""),
    ("Amazon CloudFront", "x-amz-cf-id", ""),
    ("Amazon S3", "server", "amazons3"),
    ("Fastly", "x-fastly-request-id", ""),
    ("Fastly", "x-served-by", "cache-"),
    ("GitHub Pages", "server", "github.com"),
    ("Google Cloud", "server", "google frontend"),
    ("Firebase Hosting", "x-firebase-hosting", ""),
    ("Shopify", "x-shopid", ""),
    ("Wix", "x-wix-request-id", ""),
    ("nginx", "server", "nginx"),
    ("Apache", "server", "apache"),
    ("LiteSpeed", "server", "litespeed"),
    ("Microsoft IIS", "server", "microsoft-iis"),
    ("PHP", "x-powered-by", "php"),
    ("Express", "x-powered-by", "express"),
    ("ASP.NET", "x-powered-by", "asp.net"),
    ("ASP.NET", "x-aspnet-version", ""),
    ("Next.js", "x-powered-by", "next.js"),
]
#: Fixed values: (technology, pattern in the html).
HTML_RULES = [
    ("WordPress", "/wp-content/|/wp-includes/"),
    ("Shopify", r"cdn\.shopify\.com"),
    ("Wix", r"static\.wixstatic\.com"),
    ("Squarespace", r"static1\.squarespace\.com"),
    ("Weebly", r"weebly\.com"),
    ("jQuery", r"jquery(?:\.min)?\.js"),
]
#: The html of bot checks, first match wins.
BOT_CHECKS = [
    ("Cloudflare challenge", r"challenges\.cloudflare\.com|cf-chl-|cf_chl_|/cdn-cgi/challenge-platform"),
    ("reCAPTCHA", "google\\.com/recaptcha|recaptcha/api\\.js|class=[\"'][^\"']*g-recaptcha"),
    ("hCaptcha", "hcaptcha\\.com|class=[\"'][^\"']*h-captcha"),
]
#: Fixed value: long runs of base64.
BLOB = "[A-Za-z0-9+/]{200,}={0,2}"
#: Addresses of crypto wallets by kind.
WALLETS = {"Bitcoin": r"\b(bc1[ac-hj-np-z02-9]{25,60}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})\b", "Ethereum": r"\b0x[a-fA-F0-9]{40}\b", "Tron": r"\bT[1-9A-HJ-NP-Za-km-z]{33}\b"}
SECURITY_HEADERS = ("strict-transport-security", "content-security-policy", "x-frame-options", "x-content-type-options", "referrer-policy")


def read(html: str, tokens: str | None) -> Column:
    """The column of tokens, walked from the html where the caller has none."""
    return F.col(tokens) if tokens else T.tokens(F.col(html))


def forms(pages: DataFrame, key: str = "page_id", html: str = "html", tokens: str | None = None) -> DataFrame:
    """(key, forms, inputs, hidden_fields, password_fields, asks): asks is the sorted list of private data asked for."""
    page = read(html, tokens)
    fields = H.elements(page, "input", "select", "textarea")
    kind = lambda t: F.lower(H.attribute(t, "type"))
    open_fields = F.filter("fields", lambda t: ~kind(t).isin(*SKIPPED_KINDS))
    texts = F.transform(open_fields, lambda t: F.lower(F.concat_ws(" ", *[H.attribute(t, a) for a in ("name", "id", "placeholder", "aria-label", "autocomplete", "title", "type")])))
    matching = lambda p: F.exists("texts", lambda x: x.rlike(p))
    secret = F.exists("fields", lambda t: kind(t) == "password")
    asks = F.array_sort(F.filter(F.array(*[F.when(matching(p) | secret if k == "password" else matching(p), F.lit(k)) for k, p in H.ASKS.items()]), lambda x: x.isNotNull()))
    rows = pages.select(key, fields.alias("fields"), F.size(H.elements(page, "form")).alias("forms"))
    rows = rows.withColumn("texts", texts)
    return rows.select(key, "forms", F.size("fields").alias("inputs"), F.size(F.filter("fields", lambda t: kind(t) == "hidden")).alias("hidden_fields"), F.size(F.filter("fields", lambda t: kind(t) == "password")).alias("password_fields"), asks.alias("asks"))


def form_targets(pages: DataFrame, key: str = "page_id", html: str = "html", host: str = "host", tokens: str | None = None) -> DataFrame:
    """(key, targets, mailto, without_target): other hosts that forms send to, sorted."""
    page = read(html, tokens)
    actions = F.transform(H.elements(page, "form"), lambda t: F.trim(H.attribute(t, "action")))
    rows = pages.select(key, host, actions.alias("a"))
    away = F.filter(F.transform(F.filter("a", lambda x: x.rlike("(?i)^https?://")), L.host), lambda h: (h != "") & (h != F.col(host)))
    empty = F.exists("a", lambda x: (x == "") | x.isin("#", "about:blank") | x.rlike("(?i)^javascript:"))
    return rows.select(key, F.array_sort(F.array_distinct(away)).alias("targets"), F.exists("a", lambda x: x.rlike("(?i)^mailto:")).alias("mailto"), empty.alias("without_target"))


def terms(pages: DataFrame, key: str = "page_id", words: str = "words", most: int = 40, least: int = 12) -> DataFrame:
    """(key, n, term, times): the most used words of pages with `least` or more, ties by first place.

    Counts are added up map-side before pages meet; the ranking sees one row per page and word.
    """
    # The limit stands inside the list: as a filter it would move below the walk of the page, and every page would be walked twice.
    told = F.when(F.size(words) >= least, F.filter(words, lambda w: ~w.isin(*H.STOPWORDS)))
    rows = pages.select(key, F.posexplode(told).alias("at", "term"))
    counted = rows.groupBy(key, "term").agg(F.count("*").alias("times"), F.min("at").alias("at"))
    w = W.partitionBy(key).orderBy(F.desc("times"), "at")
    return counted.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select(key, "n", "term", "times")


def out_sites(pages: DataFrame, key: str = "page_id", html: str = "html", host: str = "host", most: int = 60) -> DataFrame:
    """(key, pos, target): hosts that absolute links of a page lead to, its own left out, first-seen order."""
    page = T.tokens(F.col(html))
    hrefs = F.slice(F.transform(H.elements(page, "a"), lambda t: F.trim(H.attribute(t, "href"))), 1, 2000)
    hosts = F.array_distinct(F.filter(F.transform(F.filter(hrefs, lambda x: x.rlike("(?i)^(https?:)?//")), lambda x: L.host(F.regexp_replace(x, "^//", "https://"))), lambda h: h.contains(".")))
    rows = pages.select(key, host, hosts.alias("hosts"))
    return rows.select(key, F.posexplode(F.slice(F.filter("hosts", lambda h: h != F.col(host)), 1, most)).alias("pos", "target"))


def structure(pages: DataFrame, key: str = "page_id", html: str = "html", host: str = "host", tokens: str | None = None) -> DataFrame:
    """Counts of scripts, images, frames and links, and the tricks a page plays."""
    c, page = F.col(html), read(html, tokens)
    scripts = F.transform(H.elements(page, "script"), lambda t: H.attribute(t, "src"))
    frames = H.elements(page, "iframe")
    hrefs = F.transform(H.elements(page, "a"), lambda t: F.trim(H.attribute(t, "href")))
    away = lambda x: x.rlike("(?i)^(https?:)?//") & (L.host(F.regexp_replace(x, "^//", "https://")) != F.col(host))
    empty = lambda x: (x == "") | (x == "#") | x.rlike("(?i)^javascript:")
    hidden = lambda t: H.attribute(t, "width").isin("0", "1") | H.attribute(t, "height").isin("0", "1") | F.replace(H.attribute(t, "style"), F.lit(" "), F.lit("")).contains("display:none")
    rows = pages.select(key, host, html, scripts.alias("s"), frames.alias("f"), hrefs.alias("a"), F.size(H.elements(page, "img")).alias("images"), H.elements(page, "meta").alias("m"))
    share = lambda n: F.when(F.size("a") > 0, F.round(n / F.size("a"), 2)).otherwise(F.lit(0.0))
    return rows.select(
        key, F.size("s").alias("scripts"), F.size(F.filter("s", away)).alias("external_scripts"), "images", F.size("f").alias("iframes"), F.size(F.filter("f", hidden)).alias("hidden_iframes"),
        F.exists("m", lambda t: F.lower(H.attribute(t, "http-equiv")) == "refresh").alias("meta_refresh"), F.exists("m", lambda t: (F.lower(H.attribute(t, "name")) == "robots") & F.lower(H.attribute(t, "content")).contains("noindex")).alias("noindex"),
        F.size("a").alias("links"), share(F.size(F.filter("a", empty))).alias("empty_link_share"), share(F.size(F.filter("a", away))).alias("external_link_share"),
        F.array_sort(F.array_distinct(F.transform(F.filter("a", lambda x: x.rlike(r"(?i)\.(exe|msi|scr|bat|cmd|ps1|vbs|jar|apk|dmg|pkg|iso)(\?|$)")), lambda x: F.substring_index(x, "/", -1)))).alias("programs"),
        c.rlike("(?i)oncontextmenu *= *[\"']? *return +false").alias("right_click_blocked"), F.regexp_count(c, F.lit(r"\beval *\(|\batob *\(|\bunescape *\(|String\.fromCharCode|document\.write *\(")).alias("obfuscation"),
    )


def mentions(pages: DataFrame, brands: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """(key, brand, times): how often each brand's keywords stand in a text as whole words.

    Texts are cut into words and joined to keywords by equality, so the keyword table may be of any size.
    """
    words = pages.select(key, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}_]+"), 0)).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))
    keys = brands.select("ord", F.col("name").alias("brand"), F.explode("keywords").alias("word")).withColumn("word", F.lower("word"))
    return words.join(keys, "word").groupBy(key, "ord", "brand").agg(F.sum("n").alias("times")).select(key, "ord", "brand", "times")


def wallets(text: Column, kinds: tuple[str, ...] = tuple(WALLETS)) -> Column:
    """Those of the kinds whose wallet addresses are in a text, sorted."""
    return F.filter(F.array(*[F.when(text.rlike(WALLETS[k]), F.lit(k)) for k in sorted(kinds)]), lambda x: x.isNotNull())


def technology(rows: DataFrame, key: str, headers: str, html: str | None = None) -> DataFrame:
    """(key, technologies in rule order, missing security headers, generator) from a map of lower-cased headers and the html."""
    value = lambda h: F.try_element_at(F.col(headers), F.lit(h))
    hits = [F.when(value(h).isNotNull() & F.lower(value(h)).contains(v), F.lit(t)) for t, h, v in HEADER_RULES]
    hits += [F.when(F.col(html).rlike("(?i)" + p), F.lit(t)) for t, p in HTML_RULES] if html else []
    found = F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull()))
    missing = F.filter(F.array(*[F.lit(h) for h in SECURITY_HEADERS]), lambda h: ~F.map_contains_key(headers, h))
    named = F.nullif(F.trim(F.regexp_extract(F.col(html), "(?i)<meta[^>]+name=[\"']generator[\"'][^>]*content=[\"']([^\"']{1,80})", 1)), F.lit("")) if html else F.lit(None).cast("string")
    return rows.select(key, found.alias("technologies"), missing.alias("missing"), named.alias("generator"))


def refresh_target(page: Column) -> Column:
    """Where the first meta refresh among a page's tokens leads; empty if nowhere."""
    metas = F.filter(H.elements(page, "meta"), lambda t: F.lower(H.attribute(t, "http-equiv")) == "refresh")
    return F.coalesce(F.regexp_extract(H.attribute(F.get(metas, F.lit(0)), "content"), "(?i)url=([^\"'>]*)", 1), F.lit(""))


def declared_icon(page: Column) -> Column:
    icons = F.filter(H.elements(page, "link"), lambda t: F.lower(H.attribute(t, "rel")).contains("icon"))
    return F.coalesce(H.attribute(F.get(icons, F.lit(0)), "href"), F.lit(""))


def bot_check(html: Column) -> Column:
    """The vendor of a bot check, null if there is none."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(BOT_CHECKS):
        out = F.when(html.rlike("(?i)" + pattern), name).otherwise(out)
    return out


def blob_share(html: Column) -> Column:
    """Share of the html that is encoded blobs, three places."""
    found = F.aggregate(F.regexp_extract_all(html, F.lit(BLOB), 0), F.lit(0), lambda a, x: a + F.length(x))
    return F.round(found / F.greatest(F.length(html), F.lit(1)), 3)


def impersonated(imitated: Column, in_title: Column, top: Column, mentions: Column, named: Column, asks: Column, official: Column) -> Column:
    """Brands that a page pretends to be: the one its link imitates, those in its title, and the one it is about if it asks for data.

    in_title and official (brands whose real site this is) are arrays of names; named counts the brands mentioned, asks the
    kinds of data asked for. A page is about a brand that it names at least three times and beside two others at most.
    """
    about = F.when((asks > 0) & (mentions >= 3) & (named <= 3), top)
    empty = F.array().cast("array<string>")
    claimed = F.filter(F.concat(F.coalesce(in_title, empty), F.array(about)), lambda b: b.isNotNull() & ~F.array_contains(F.coalesce(official, empty), b))
    return F.array_distinct(F.concat(F.filter(F.array(imitated), lambda b: b.isNotNull()), claimed))


def first_mention(df: DataFrame, key: str) -> DataFrame:
    """The most named brand of each page and its count; ties go to the first brand."""
    w = W.partitionBy(key).orderBy(F.desc("times"), "ord")
    return df.withColumn("r", F.row_number().over(w)).where("r = 1").select(key, "brand", "times")


def beside(rows: DataFrame, operator) -> DataFrame:
    """The columns of `rows` and what a narrow page operator finds in their html and host: one pass, no join."""
    packed = rows.select(F.struct("*").alias("__row"))
    return operator(packed).select("__row.*", "*").drop("__row")


def reached(page: Column) -> Column:
    """(kind, host) of every absolute form target, script and link, in order."""
    host = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), L.host(F.regexp_replace(x, "^//", "https://")).alias("host"))
    found = lambda tag, a: F.transform(F.filter(F.transform(H.elements(page, tag), lambda t: F.trim(H.attribute(t, a))), lambda x: x.rlike("(?i)^(https?:)?//")), host(tag))
    return F.filter(F.concat(found("form", "action"), found("script", "src"), found("a", "href")), lambda r: r["host"] != "")


def page_facts(pages: DataFrame, key: str = "page_id", html: str = "html", host: str = "host") -> DataFrame:
    """key, said (title, visible text and image descriptions), reached and the page's own facts, in one pass over the html.

    A null or empty page is not captured and has empty facts.
    """
    rows = pages.select(key, F.coalesce(F.col(host), F.lit("")).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("tokens", T.tokens(F.col("html")))
    for operator in (forms, form_targets, structure):
        rows = beside(rows, lambda x, f=operator: f(x, key="__row", html="__row.html", tokens="__row.tokens", **({} if f is forms else {"host": "__row.host"})))
    c, page = F.col("html"), F.col("tokens")
    rows = rows.withColumn("title", H.title(page)).withColumn("text", H.visible_text(page))
    alts = F.array_join(F.transform(H.elements(page, "img"), lambda t: H.attribute(t, "alt")), " ")
    rows = rows.withColumn("said", F.concat_ws(" ", "title", "text", alts))
    kept = [x for x in rows.columns if x not in ("html", "tokens", "text", "host", "targets")]
    return rows.select(
        *kept, (c != "").alias("captured"), reached(page).alias("reached"), F.size(H.tags(page)).alias("tags"), F.size(H.words(F.col("text"))).alias("words"), blob_share(c).alias("base64_share"),
        F.size(wallets(F.col("text"))).alias("wallets"), F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\+?\d[\d\s().-]{8,}\d)"), 0))).alias("phone_numbers"),
        *[F.size(H.phrase_hits(F.col("said"), g)).alias(f"phrases_{g}") for g in H.PHRASES],
    )


def reach(facts: DataFrame, own: DataFrame, sites, key: str = "page_id", most: int = 60) -> DataFrame:
    """(key, form_to_other_domain, external_scripts, external_links, out_domains) of pages that reach other domains.

    facts: key, reached; own: key, registered_domain, site; sites: adds site and registered_domain to rows with `host`. Equal
    hosts of a page are counted before they meet the suffixes.
    """
    hosts = facts.select(key, F.explode("reached").alias("r")).groupBy(key, "r.kind", "r.host").agg(F.count("*").alias("n"))
    met = sites(hosts).select(key, "kind", "n", F.coalesce("registered_domain", "host").alias("there"), F.col("site").alias("there_site")).join(own.select(key, F.col("registered_domain").alias("here"), F.col("site").alias("here_site")).hint("merge"), key)
    away = F.col("there") != F.col("here")
    count = lambda kind: F.coalesce(F.sum(F.when(away & (F.col("kind") == kind), F.col("n"))), F.lit(0))
    other = (F.col("kind") == "a") & F.col("there_site").contains(".") & ~F.col("there_site").eqNullSafe(F.col("here_site"))
    return met.groupBy(key).agg((count("form") > 0).alias("form_to_other_domain"), count("script").alias("external_scripts"), count("a").alias("external_links"), F.least(F.countDistinct(F.when(other, F.col("there_site"))), F.lit(most)).alias("out_domains"))
