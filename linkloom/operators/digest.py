"""Everything that link and html say of a page, in one row: facts, prints, brands, model features, rule score, type and summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import html as H
from linkloom.functions import prints as P
from linkloom.functions import tokens as T
from linkloom.operators import model as M
from linkloom.operators import score as S
from linkloom.session import cut, spread


def prints(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, tags, words (counts), dom_hash, dom, txt of every page."""
    page = T.tokens(F.col("html"))
    r = spread(pages).select(key, page.alias("t"))
    return P.printed(r.select(key, H.tags(F.col("t")).alias("tags"), H.words(H.visible_text(F.col("t"))).alias("words")), key)


def judged(rows: DataFrame, categories: DataFrame | None = None, popular: DataFrame | None = None, key: str = "page_id", downloads: str | None = None) -> DataFrame:
    """Adds reasons, rule_score, backing, score, verdict, trusted, scam_type, scam_brand and summary to rows of model.read_pages.

    categories: brand, category (of the names a page may pose as); popular: site, rank; downloads: a boolean column. Nothing
    from outside is asked: no lists, owners or families.
    """
    c, none = F.col, F.array().cast("array<string>")
    yes = lambda n: c(n) > 0
    rows = rows.join(popular.select("site", F.col("rank").cast("int").alias("rank")), "site", "left") if popular is not None else rows.withColumn("rank", F.lit(None).cast("int"))
    if categories is not None:
        kinds = rows.select(key, F.explode("posed").alias("brand")).join(categories, "brand").groupBy(key).agg(F.collect_set("category").alias("categories"))
        rows = rows.join(kinds, key, "left").withColumn("categories", F.coalesce("categories", none))
    else:
        rows = rows.withColumn("categories", none)
    many = lambda n: F.when(yes(n), F.array_repeat(F.lit("x"), c(n).cast("int"))).otherwise(none)
    hits = F.filter(F.array(*[F.when(yes(f"phrases_{g}"), F.lit(g)) for g in H.PHRASES]), lambda x: x.isNotNull())
    loaded = F.coalesce(c(downloads), F.lit(False)) if downloads else F.lit(False)
    view = {
        "is_ip": yes("is_ip"), "has_at": yes("has_at"), "unicode_host": F.when(yes("punycode"), c("host")), "free_hosting": c("free_hosting"), "abused": yes("abused_tld"), "rank": c("rank"), "depth": c("subdomain_depth"), "random_name": yes("random_name"), "hyphens": c("hyphens"),
        "url_words": many("url_words"), "official": c("official"), "imitation": c("imitation"), "length": c("url_length"), "port": F.when(yes("odd_port"), 1), "double_slash": yes("double_slash_path"), "shortener": yes("shortener"),
        "asks": c("asks"), "official_site": c("official").isNotNull() & c("imitation").isNull(), "plain_http": ~yes("https"), "impersonated": F.get("posed", F.lit(0)), "brand_in_title": yes("brand_in_title"), "form_away": yes("form_to_other_domain"), "form_hidden": yes("form_without_target"), "mailto": yes("mailto_form"),
        "wallets": many("wallets"), "words": c("n_words"), "phrases": hits, "programs": c("executable_links"), "right_click": yes("right_click_blocked"), "obfuscation": c("obfuscation"), "hidden_frames": c("hidden_iframes"), "links": c("links"), "empty_share": c("empty_link_share"), "blob_share": c("base64_share"),
        "stopped": F.lit(None).cast("string"),
    }
    # Written in steps: in one projection the code of all rules would outgrow what is compiled.
    seen = rows.select(key, *[v.alias(k) for k, v in view.items()], F.when(loaded, 1).otherwise(0).alias("downloads"), c("phone_numbers").alias("phones"), "categories", F.create_map(*[x for g in H.PHRASES for x in (F.lit(g), c(f"phrases_{g}").cast("int"))]).alias("phrase_counts"), (c("captured") > 0).alias("captured"))
    seen = cut(seen, "view")
    load = S.reason(c("downloads") > 0, "downloads a file", 30, "behaviour")
    found = cut(seen.withColumn("by_link", S.link_reasons()), "by_link").withColumn("by_page", S.page_reasons())
    found = cut(S.judge(cut(found, "by_page").withColumn("reasons", F.concat("by_link", "by_page", S.listed(load), S.reputation_reasons())).drop("by_link", "by_page")), "judged")
    found = found.withColumn("phrases", c("phrase_counts"))
    found = found.withColumn("scam_type", F.when(c("verdict") != "safe", S.scam_type())).withColumn("scam_brand", F.when(c("scam_type").isNotNull(), c("impersonated")))
    risks = F.exists("reasons", lambda r: r["points"] > 0)
    said = S.summary(c("verdict"), c("scam_type"), c("scam_brand"), c("official"), c("rank"), c("stopped"), none, ~c("captured"), risks)
    trusted = c("official_site") | F.coalesce(c("rank") <= 10_000, F.lit(False))
    return rows.join(found.select(key, "reasons", "rule_score", "backing", "score", "verdict", trusted.alias("trusted"), "scam_type", "scam_brand", said.alias("summary")), key)


def digest(pages: DataFrame, suffixes: DataFrame, brands: DataFrame, key: str = "page_id", categories: DataFrame | None = None, popular: DataFrame | None = None, downloads: str | None = None) -> DataFrame:
    """One row a page: host, site, title, posed, asks, features (the 78 numbers), prints (tags, words, dom_hash, dom, txt, bands), scores, verdict, type, brand, summary.

    pages: key (unique), url, html; a null or empty html is a page that was not captured.
    """
    rows = cut(M.read_pages(pages, suffixes, brands, key), "read")
    if downloads:
        rows = rows.join(pages.select(key, downloads), key)
    said = judged(rows, categories, popular, key, downloads)
    features = F.array(*[F.col(n).cast("float") for n in M.FEATURES]).alias("features")
    facts = said.select(key, "host", "site", "registered_domain", "free_hosting", "official", "imitation", "posed", "asks", "title", features, "reasons", "rule_score", "backing", "score", "verdict", "trusted", "scam_type", "scam_brand", "summary")
    p = prints(pages, key)
    return facts.join(p.withColumn("bands", F.concat(P.bands(F.col("dom"), 0), P.bands(F.col("txt"), 1))), key)
