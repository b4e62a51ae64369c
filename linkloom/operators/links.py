"""Link tables: sites, official names, imitations, variants and lookup keys, as joins on exploded names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.functions import links as L

#: Endings that only one kind of body can register, and what that body is.
RESTRICTED = [(".bank.in", "a registered Indian bank"), (".gov.in", "Government of India"), (".nic.in", "Government of India")]


def suffix_table(spark: SparkSession, rows=None) -> DataFrame:
    """(suffix, private): a dimension of a few thousand rows at most."""
    return spark.createDataFrame(rows or L.SUFFIXES, "suffix string, private boolean")


def sites(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Adds suffix, free_hosting, registered_domain, site, label, subdomain_depth to rows with `host`.

    Each name is joined on its parents; the longest public suffix decides the registered domain, the longest of all the
    site. A name without a known suffix keeps its last two labels. The suffix table is a dimension; Spark broadcasts it
    while it is under its limit and shuffles otherwise. One row per host is matched, so repeated hosts cost once.
    """
    names = hosts.select("host").where("host is not null").distinct().select("host", F.split("host", r"\.").alias("labels"), F.posexplode(L.host_suffixes(F.col("host"))).alias("i", "suffix"))
    hit = names.join(suffixes, "suffix").groupBy("host").agg(
        F.min(F.when(~F.col("private"), F.col("i"))).alias("public_at"), F.min("i").alias("any_at"), F.min_by("suffix", "i").alias("any_suffix"), F.min_by("private", "i").alias("any_private"), F.min_by("suffix", F.when(~F.col("private"), F.col("i"))).alias("public_suffix")
    )
    tail = lambda at: F.array_join(F.slice(F.split("host", r"\."), F.greatest(at, F.lit(1)), F.size(F.split("host", r"\."))), ".")
    n = F.size(F.split("host", r"\."))
    one = hosts.select("host").where("host is not null").distinct().join(hit, "host", "left").select(
        "host",
        F.coalesce("public_suffix", F.element_at(F.split("host", r"\."), -1)).alias("suffix"),
        F.when(F.col("any_private"), F.col("any_suffix")).alias("free_hosting"),
        F.when(F.coalesce("public_at", n - 1) >= 1, tail(F.coalesce("public_at", n - 1))).alias("registered_domain"),
        F.when(F.coalesce("any_at", n - 1) >= 1, tail(F.coalesce("any_at", n - 1))).alias("site"),
        F.greatest(F.coalesce("any_at", n - 1) - 1, F.lit(0)).alias("subdomain_depth"),
    )
    one = one.withColumn("label", F.element_at(F.split("registered_domain", r"\."), 1))
    return hosts.join(one, "host", "left")


def seen_names(hosts: DataFrame) -> DataFrame:
    """(host, seen) of punycode hosts as people see them, label by label; a broken label only loses its prefix."""
    labels = hosts.select("host").where(F.col("host").contains("xn--")).distinct().select("host", F.posexplode(F.split("host", r"\.")).alias("i", "x"))
    decoded = F.nullif(F.try_reflect(F.lit("java.net.IDN"), F.lit("toUnicode"), F.col("x"), F.lit(1)), F.col("x"))
    shown = labels.withColumn("x", F.when(~F.col("x").startswith("xn--"), F.col("x")).otherwise(F.coalesce(decoded, F.substring("x", F.lit(5), F.length("x")))))
    return shown.groupBy("host").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]), ".").alias("seen"))


def facts(urls: DataFrame, suffixes: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, site, registered_domain, label, free_hosting, subdomain and what the link itself says, one row per row.

    The path of a link without one is "/". Names are measured as people see them; an address has no label, depth,
    digits, hyphens or entropy. A null link has null facts.
    """
    u = F.col(url)
    rows = sites(urls.select(key, url, L.host(u).alias("host")), suffixes)
    rows = rows.join(seen_names(rows), "host", "left")
    address = F.col("host").rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | F.col("host").startswith("[")
    shown = F.coalesce("seen", "host")
    label = F.coalesce(F.try_element_at(F.split(shown, r"\."), -F.size(F.split("registered_domain", r"\."))), F.lit(""))
    path = F.when(L.path(u) == "", "/").otherwise(L.path(u))
    words = F.array_union(F.split(F.lower(F.concat(L.path(u), F.lit(" "), L.query(u))), "[^a-z0-9-]+"), F.split("host", "[^a-z0-9]+"))
    named = lambda c: F.when(address, F.lit(0).cast(c[1])).otherwise(c[0].cast(c[1]))
    below = F.length("host") - F.length("registered_domain") - 1
    return rows.select(
        key, "host", "site", "registered_domain", "label", "free_hosting", F.when(below > 0, F.substring("host", F.lit(1), below)).otherwise("").alias("subdomain"),
        F.length(u).alias("length"), F.length(shown).alias("host_length"), F.length(path).alias("path_length"), F.regexp_count(path, F.lit("/")).alias("path_depth"), F.regexp_count("host", F.lit("[.]")).alias("host_dots"), u.rlike("(?i)^https://").alias("https"),
        named((F.col("subdomain_depth"), "int")).alias("subdomain_depth"), named((F.round(F.regexp_count(shown, F.lit("[0-9]")) / F.greatest(F.length(shown), F.lit(1)), 2), "double")).alias("digit_ratio"),
        named((F.regexp_count(label, F.lit("-")), "int")).alias("hyphens"), named((F.round(L.entropy(label), 2), "double")).alias("entropy"), (L.looks_random(label) & ~address).alias("random_name"), address.alias("is_ip"),
        L.authority(u).contains("@").alias("has_at"), F.substring(L.path(u), F.lit(2), F.length(u)).contains("//").alias("double_slash_path"),
        (F.coalesce(F.substring_index("suffix", ".", -1).isin(L.ABUSED), F.lit(False)) & ~address).alias("abused_tld"), F.coalesce(F.col("registered_domain").isin(L.SHORTENERS), F.lit(False)).alias("shortener"),
        L.port(u).isNotNull().alias("odd_port"), (F.col("host").contains("xn--") & ~address).alias("punycode"), F.array_sort(F.array_intersect(words, F.array(*[F.lit(w) for w in L.URL_WORDS]))).alias("url_words"),
    )


def official_names(hosts: DataFrame, brands: DataFrame) -> DataFrame:
    """(host, brand): the brand whose own site a host is, else the body that alone can register its ending."""
    names = hosts.select("host").where("host is not null").distinct().join(official(hosts, brands), "host", "left")
    body = F.coalesce(*[F.when(F.col("host").endswith(e), F.lit(b)) for e, b in RESTRICTED])
    return names.select("host", F.coalesce("brand", body).alias("brand")).where("brand is not null")


def official(hosts: DataFrame, brands: DataFrame) -> DataFrame:
    """(host, brand) of hosts on a brand's own domain, below it or below its own ending; the first brand by `ord`."""
    names = hosts.select("host").distinct().select("host", F.explode(L.host_suffixes(F.col("host"))).alias("domain"))
    domains = brands.select("ord", F.col("name").alias("brand"), F.explode("domains").alias("domain")).distinct()
    return names.join(domains, "domain").where("domain like '%.%' or host <> domain").groupBy("host").agg(F.min_by("brand", "ord").alias("brand"))


def _without(text: Column, i: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.lit(9999)))


def shortened(text: Column, most: int) -> Column:
    """The text and what is left of it without one letter, or without one and without two."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    one = F.transform(places, lambda i: _without(text, i))
    if most == 1:
        return F.array_distinct(F.concat(F.array(text), one))
    two = F.flatten(F.transform(F.filter(places, lambda i: i < F.length(text)), lambda i: F.transform(F.sequence(i, F.greatest(F.length(text) - 1, F.lit(1))), lambda j: _without(_without(text, i), j))))
    return F.array_distinct(F.concat(F.array(text), one, two))


def _swaps(text: Column) -> Column:
    """The text with each two neighbours swapped."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.lit(1)), F.substring(text, i, F.lit(1)), F.substring(text, i + 2, F.lit(9999))))


def _slips(n: Column) -> Column:
    """How many slips a brand label of that length may be away."""
    return F.when(n >= 9, 2).when(n >= 6, 1).otherwise(0)


def _keys(*given: tuple[str, Column]) -> Column:
    """One array of keys, each told apart by its kind."""
    told = lambda kind: lambda v: F.xxhash64(F.lit(kind), v)
    return F.array_distinct(F.concat(*[F.transform(F.coalesce(x, F.array().cast("array<string>")), told(k)) for k, x in given]))


def imitations(labels: DataFrame, brands: DataFrame) -> DataFrame:
    """Which brand a label (of a host that is not official) imitates, and how: (host, brand, kind).

    labels: host, label, subdomain. brands: ord, name, labels; any number of either. Look-alike letters and digits win outright, in
    brand order; else the first of a near spelling, added words or a sub-domain.
    Labels meet brand labels by equal keys only, then every pair that met is checked: the letters that a label looks like; what is
    left of both without one or two letters (names one or two slips apart, swaps among them, share one such rest); the words in a
    label and its runs of five letters; the parts of a sub-domain and what stands before their hyphens.
    """
    forms = brands.select("ord", F.col("name").alias("brand"), F.posexplode("labels").alias("pos", "b")).where("b is not null and b <> ''")
    rows = labels.select("host", "label", "subdomain").where("label is not null").distinct()
    n, size, none = F.length("b"), F.length("label"), F.array().cast("array<string>")
    longest = forms.agg(F.max(n)).first()[0] or 0
    five = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 4, F.lit(1))), lambda i: F.substring(x, i, F.lit(5)))
    tokens, parts = F.split(F.lower("label"), "[-_.0-9]+"), F.split(F.lower("subdomain"), r"\.")
    before = F.flatten(F.transform(parts, lambda p: F.transform(F.sequence(F.lit(1), F.size(F.split(p, "-"))), lambda i: F.array_join(F.slice(F.split(p, "-"), 1, i), "-"))))

    known = forms.withColumn("key", F.explode(_keys(
        ("looks", F.array("b")), ("one", F.when(n.between(6, 8), shortened(F.col("b"), 1))), ("two", F.when(n >= 9, shortened(F.col("b"), 2))),
        ("word", F.array("b")), ("five", F.when(n >= 5, F.array(F.substring("b", 1, 5)))),
    )))
    by_label = rows.select("label").distinct().withColumn("key", F.explode(_keys(
        ("looks", F.array(L.skeleton(F.col("label")))), ("one", F.when(size.between(5, 9), shortened(F.col("label"), 1))), ("two", F.when(size.between(7, longest + 2), shortened(F.col("label"), 2))),
        ("word", tokens), ("five", F.when(size >= 5, five(F.col("label")))),
    )))
    under = forms.withColumn("part", F.col("b"))
    by_part = rows.select("subdomain").distinct().withColumn("part", F.explode(F.array_distinct(F.concat(parts, before))))
    pair = ["ord", "brand", "pos", "b"]
    met = by_label.join(known, "key").select("label", *pair).distinct().join(rows, "label").select("host", "label", "subdomain", *pair)
    met = met.unionByName(by_part.join(under, "part").select("subdomain", *pair).distinct().join(rows, "subdomain").select("host", "label", "subdomain", *pair)).distinct()

    far = _slips(n)
    # One slip is a letter in, out or other, or a swap of neighbours; of two slips any, in either order.
    ours, theirs = _swaps(F.col("label")), _swaps(F.col("b"))
    near = (F.levenshtein("label", "b") <= far) | F.exists(ours, lambda s: F.levenshtein(s, F.col("b")) <= far - 1) | F.exists(theirs, lambda s: F.levenshtein(s, F.col("label")) <= far - 1) | ((far == 2) & F.arrays_overlap(ours, theirs))
    other = F.col("label") != F.col("b")
    kind = (
        F.when(other & (L.skeleton(F.col("label")) == F.col("b")), F.when(F.col("label").rlike(r"[^\x00-\x7F]"), "homograph").otherwise("swap"))
        .when((far > 0) & other & near, "typo")
        .when(other & (F.array_contains(tokens, F.col("b")) | ((n >= 5) & F.col("label").contains(F.col("b")))), "combo")
        .when(F.array_contains(F.coalesce(parts, none), F.col("b")) | F.exists(F.coalesce(parts, none), lambda s: s.startswith(F.concat(F.col("b"), F.lit("-")))), "subdomain")
    )
    found = met.withColumn("kind", kind).where("kind is not null")
    first = F.struct(F.when(F.col("kind").isin("homograph", "swap"), 0).otherwise(1).alias("turn"), "ord", "pos", "brand", "kind")
    return found.groupBy("host").agg(F.min(first).alias("m")).select("host", "m.brand", F.when(F.col("m.kind") == "swap", "typo").otherwise(F.col("m.kind")).alias("kind"))


def variants(domains: DataFrame, endings=("com", "net", "org", "in", "co.in", "xyz", "top", "info", "online", "site", "shop", "live", "app"), most: int = 90) -> DataFrame:
    """(domain, variant, n): names that one slip or swap away would reach, unique, at most `most` a domain, in a fixed order."""
    base = domains.select("domain", F.regexp_extract("domain", r"^([^.]*)", 1).alias("label"), F.regexp_extract("domain", r"\.(.*)$", 1).alias("tail"))
    places = F.sequence(F.lit(1), F.length("label"))
    inner = F.sequence(F.lit(2), F.greatest(F.length("label"), F.lit(2)))
    sub = lambda a, b: F.substring("label", a, b)
    rest = lambda i: F.substring("label", i, F.lit(9999))
    made = F.flatten(F.array(
        F.transform(F.array(*[F.lit(e) for e in endings]), lambda e: F.struct(F.lit(1).alias("k"), F.concat("label", F.lit("."), e).alias("v"))),
        F.transform(places, lambda i: F.struct(F.lit(2).alias("k"), F.concat(sub(F.lit(1), i - 1), rest(i + 1), F.lit("."), "tail").alias("v"))),
        F.transform(places, lambda i: F.struct(F.lit(3).alias("k"), F.concat(sub(F.lit(1), i), rest(i), F.lit("."), "tail").alias("v"))),
        F.transform(inner, lambda i: F.struct(F.lit(4).alias("k"), F.concat(sub(F.lit(1), i - 2), sub(i, F.lit(1)), sub(i - 1, F.lit(1)), rest(i + 1), F.lit("."), "tail").alias("v"))),
        F.transform(inner, lambda i: F.struct(F.lit(5).alias("k"), F.concat(sub(F.lit(1), i - 1), F.lit("-"), rest(i), F.lit("."), "tail").alias("v"))),
        F.array(F.struct(F.lit(6).alias("k"), F.concat("label", F.lit("s."), "tail").alias("v")), F.struct(F.lit(7).alias("k"), F.concat(F.translate("label", "oliea", "01134"), F.lit("."), "tail").alias("v"))),
    ))
    rows = base.select("domain", F.explode(made).alias("m")).select("domain", "m.k", F.col("m.v").alias("variant"))
    good = rows.where("variant <> domain and variant not like '.%' and variant not like '-%' and variant not like '%-.%' and variant not like '%--%'").groupBy("domain", "variant").agg(F.min("k").alias("k"))
    return good.withColumn("n", F.row_number().over(W.partitionBy("domain").orderBy("k", "variant"))).where(F.col("n") <= most).select("domain", "variant", "n")


def link_keys(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds pos, key: host, path and query first, then host and path where that differs."""
    h, p, q = L.host(F.col(url)), F.coalesce(F.nullif(L.path(F.col(url)), F.lit("")), F.lit("/")), L.query(F.col(url))
    keys = F.array_distinct(F.array(F.concat(h, p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")), F.concat(h, p)))
    return urls.select("*", F.posexplode(keys).alias("pos", "key"))


def host_keys(urls: DataFrame, site: str = "site", host: str = "host") -> DataFrame:
    """Adds pos, key: the host and each parent down to its site."""
    parents = F.filter(L.host_suffixes(F.col(host)), lambda x: F.length(x) >= F.length(site))
    return urls.select("*", F.posexplode(parents).alias("pos", "key"))


def listed(scans: DataFrame, links: DataFrame, domains: DataFrame, popular: DataFrame) -> DataFrame:
    """The best listing of each scan: (scan_id, match, url, key, popular). scans: scan_id, url_pos, url, host, site.

    An exact link beats a domain, earlier links beat later ones, longer names beat their parents. Lists are tables of
    keys of any size; popular is (site).
    """
    by_link = link_keys(scans).join(links.select("key").distinct(), "key").select("scan_id", F.lit(0).alias("kind"), "url_pos", "pos", "url", "key", "site")
    by_host = host_keys(scans).join(domains.select("key").distinct(), "key").select("scan_id", F.lit(1).alias("kind"), "url_pos", "pos", "url", "key", "site")
    best = by_link.unionByName(by_host).groupBy("scan_id").agg(F.min(F.struct("kind", "url_pos", "pos", "url", "key", "site")).alias("m"))
    rows = best.select("scan_id", F.when(F.col("m.kind") == 0, "link").otherwise("domain").alias("match"), "m.url", "m.key", "m.site")
    return rows.join(popular.select("site", F.lit(True).alias("p")).distinct(), "site", "left").select("scan_id", "match", "url", "key", F.coalesce("p", F.lit(False)).alias("popular"))
