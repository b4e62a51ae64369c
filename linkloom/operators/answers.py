"""What others say of links, and what a visit did: noise in feeds, links to check, vendor reports, list answers, connections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.functions import links as L

#: Hosts that only say that one leaves a site, and sites whose away pages do.
NOTICES = ("away.vk.ru", "l.facebook.com", "lm.facebook.com", "l.instagram.com", "href.li")
AWAY = ("vk.com", "m.vk.com")
#: Raw names that stand for no brand.
PLACEHOLDERS = ("", "none", "other", "unknown", "generic", "n/a", "na", "null")
#: In what order sources are named.
SOURCES = ("safe_browsing", "phishing_database", "virustotal", "urlhaus", "urlscan", "history")
STATS = ("malicious", "suspicious", "harmless", "undetected", "timeout")


def noise(url: Column, host: Column, site: Column, official: Column, rank: Column, popular: int = 10_000) -> Column:
    """Whether a feed link is not worth a visit: a redirect notice, an away page, or the bare front page of a brand's own or a very popular site.

    host: lower case; official: the brand whose own site it is, else null; rank: place in the popularity list, else null.
    """
    path = L.path(url)
    notice = host.isin(*NOTICES) | (host.isin(*AWAY) & path.startswith("/away"))
    bare = path.isin("", "/") & (L.query(url) == "")
    front = F.coalesce((host == site) | (host == F.concat(F.lit("www."), site)), F.lit(False))
    return F.coalesce(notice | (bare & front & (official.isNotNull() | F.coalesce(rank <= popular, F.lit(False)))), F.lit(False))


def links_to_check(hops: DataFrame, scan: str = "scan", most: int = 8) -> DataFrame:
    """(scan, n, url): the links of each scan that are worth asking about, redacted, each once in order, `most` at most with the last kept.

    hops: scan, pos (the pasted link first, the final one last), url, blocked. Blocked hops and links that are not http(s) drop
    out; null flags count as not blocked. Of a scan with very many hops only the first `most` and the last are ranked.
    """
    ok = hops.where(~F.coalesce("blocked", F.lit(False)) & F.col("url").rlike("^https?://")).select(scan, "pos", L.redact(F.col("url")).alias("url"))
    once = ok.groupBy(scan, "url").agg(F.min("pos").alias("pos"))
    ends = once.groupBy(scan).agg(F.count("*").alias("links"), F.max(F.struct("pos", "url")).alias("last")).select(F.col(scan).alias("__scan"), "links", "last")
    first = once.withColumn("n", F.row_number().over(W.partitionBy(scan).orderBy("pos", "url"))).where(F.col("n") <= most)
    kept = first.join(ends, F.col(scan).eqNullSafe(F.col("__scan"))).where((F.col("n") < most) | (F.col("links") <= most)).select(scan, "n", "url")
    tail = ends.where(F.col("links") > most).select(F.col("__scan").alias(scan), F.lit(most).alias("n"), "last.url")
    return kept.unionByName(tail)


def display_brand(names: DataFrame, known: DataFrame, raw: str = "raw", into: str = "brand") -> DataFrame:
    """Adds the proper spelling of a brand's name from outside: null for placeholders, the known one's where name or label is known, else a capital first.

    known: ord, name, labels. Of brands that share a name or label the first by ord.
    """
    low = F.lower(F.trim(F.col(raw)))
    keys = F.transform(F.concat(F.array("name"), F.coalesce("labels", F.array().cast("array<string>"))), F.lower)
    spelt = known.select("ord", "name", F.explode(keys).alias("__low")).groupBy("__low").agg(F.min_by("name", "ord").alias("__name"))
    rows = names.withColumn("__low", low).join(spelt, "__low", "left")
    trimmed = F.trim(F.col(raw))
    own = F.when(trimmed != F.lower(trimmed), trimmed).otherwise(F.concat(F.upper(F.substring(trimmed, 1, 1)), F.substring(trimmed, F.lit(2), F.length(trimmed))))
    return rows.withColumn(into, F.when(F.col("__low").isin(*PLACEHOLDERS), None).otherwise(F.coalesce("__name", own))).drop("__low", "__name")


def vendor_reports(results: DataFrame, labels: DataFrame, link: str = "link") -> DataFrame:
    """One row a link: counts by verdict, engines, who flags it (malicious first, then by name) and what categories it is put in.

    results: link, engine, category, label, one row for each engine; labels: link, category. Engines are named
    once; a link has as many as there are engines.
    """
    one = results.groupBy(link, "engine").agg(F.min(F.struct("category", "label")).alias("r"))
    stats = [F.count_if(F.col("r.category") == s).alias(s) for s in STATS]
    bad = F.when(F.col("r.category").isin("malicious", "suspicious"), F.struct((F.col("r.category") != "malicious").alias("late"), F.lower("engine").alias("low"), "engine", F.col("r.category").alias("category"), F.col("r.label").alias("label")))
    told = one.groupBy(link).agg(*stats, F.count("*").alias("engines"), F.array_sort(F.collect_list(bad)).alias("f"))
    flagged = F.transform("f", lambda x: F.struct(x["engine"].alias("engine"), x["category"].alias("category"), x["label"].alias("label")))
    kinds = labels.where("category is not null").groupBy(link).agg(F.array_sort(F.collect_set("category")).alias("categories"))
    rows = told.withColumn("flagged", flagged).drop("f").join(kinds, link, "left")
    return rows.withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))


def answers(vendors: DataFrame, malware: DataFrame, scans: DataFrame, scan: str = "scan", listed_at: int = 3) -> DataFrame:
    """(scan, source, status, matched, bad, live): the answers of three sources folded to one each.

    vendors: scan, pos, url, known, malicious, suspicious. The link that most vendors flag decides (ties: the first): listed from
    `listed_at`, info if any flag it, else clean; unknown if none is known.
    malware: scan, pos, kind (url or host), key, hits, live. A link beats a host, an earlier one a later: a link that is known is listed; a
    host is listed if any of its links is live, info if it has others; else clean.
    scans: scan, total, malicious. listed if any scan was judged malicious, unknown without scans, else info.
    """
    worst = vendors.groupBy(scan).agg(F.max(F.when(F.col("known"), F.struct("malicious", (-F.col("pos")).alias("turn"), "suspicious", "url"))).alias("w"))
    w = F.col("w")
    status = F.when(w.isNull(), "unknown").when(w["malicious"] >= listed_at, "listed").when((w["malicious"] > 0) | (w["suspicious"] > 0), "info").otherwise("clean")
    one = worst.select(scan, F.lit("virustotal").alias("source"), status.alias("status"), F.when(w["malicious"] >= listed_at, w["url"]).alias("matched"), F.coalesce(w["malicious"], F.lit(0)).cast("long").alias("bad"), F.lit(None).cast("boolean").alias("live"))
    hit = F.when(F.col("hits") > 0, F.struct((F.col("kind") != "url").alias("late"), "pos", "key", "live", "hits"))
    best = malware.groupBy(scan).agg(F.min(hit).alias("h"))
    h = F.col("h")
    status = F.when(h.isNull(), "clean").when(~h["late"] | (h["live"] > 0), "listed").otherwise("info")
    two = best.select(scan, F.lit("urlhaus").alias("source"), status.alias("status"), F.when(~h["late"], h["key"]).alias("matched"), F.coalesce(h["hits"], F.lit(0)).cast("long").alias("bad"), (h["live"] > 0).alias("live"))
    sums = scans.groupBy(scan).agg(F.sum("total").alias("total"), F.sum("malicious").alias("malicious"))
    status = F.when(F.coalesce("total", F.lit(0)) == 0, "unknown").when(F.col("malicious") > 0, "listed").otherwise("info")
    three = sums.select(scan, F.lit("urlscan").alias("source"), status.alias("status"), F.lit(None).cast("string").alias("matched"), F.coalesce("malicious", F.lit(0)).cast("long").alias("bad"), F.lit(None).cast("boolean").alias("live"))
    return one.unionByName(two).unionByName(three)


def listed_by(folded: DataFrame, scan: str = "scan") -> DataFrame:
    """(scan, listed_by): the sources that list a scan, in their order; no more than there are sources."""
    order = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    found = folded.groupBy(scan).agg(F.array_sort(F.collect_set(F.when(F.col("status") == "listed", F.struct(order.alias("o"), "source")))).alias("l"))
    return found.select(scan, F.transform("l", lambda x: x["source"]).alias("listed_by"))


def connections(log: DataFrame, visit: str = "visit") -> tuple[DataFrame, DataFrame]:
    """(hosts, blocked) of each visit: (visit, host, ip) of hosts reached, with the first address; (visit, pos, host, port, reason) of
    host and port pairs kept from it, each once with its first reason, in order.

    log: visit, seq, host, port, ip, allowed, reason. Rows, not lists: a visit may have any number.
    """
    reached = log.where("allowed").groupBy(visit, "host").agg(F.min_by("ip", F.when(F.col("ip").isNotNull(), F.col("seq"))).alias("ip"))
    shut = log.where("not allowed").groupBy(visit, "host", "port").agg(F.min(F.struct("seq", F.coalesce("reason", F.lit("blocked")).alias("reason"))).alias("m"))
    return reached, shut.select(visit, F.col("m.seq").alias("pos"), "host", "port", "m.reason")
