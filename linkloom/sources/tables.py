"""Sources and sinks: feature tables, feeds, upserts, retention, certificates and registrations."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.functions import links as L
from linkloom.session import cut, folder


def write_features(rows: DataFrame, split: str, per_file: int = 3072) -> str:
    """Write a feature table by split, small zstd files; returns its folder."""
    path = f"{folder(rows.sparkSession)}/features-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").option("maxRecordsPerFile", per_file).partitionBy(split).parquet(path)
    return path


def read_features(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """The feature table at path; fails with the first column that is missing."""
    df = spark.read.parquet(path)
    for name in wanted:
        if name not in df.columns:
            raise ValueError(f"the feature table has no column {name}")
    return df.select(*wanted)


def json_round_trip(rows: DataFrame) -> DataFrame:
    path = f"{folder(rows.sparkSession)}/lines-{uuid.uuid4().hex}"
    rows.write.json(path)
    return rows.sparkSession.read.schema(rows.schema).json(path)


def feed_lines(lines: DataFrame) -> DataFrame:
    """url, pos of a text feed (pos, line): comments, blanks and refused links dropped, the first place of each kept."""
    text = F.trim("line")
    ok = lines.where((text != "") & ~text.startswith("#") & (F.length(text) <= 1500)).select("pos", L.clean(F.col("line")).alias("url"))
    return ok.where(L.reject_reason(F.col("url")).isNull()).groupBy("url").agg(F.min("pos").alias("pos"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; of equal keys the new row."""
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("__b", F.lit(0)).unionByName(new.withColumn("__b", F.lit(1)))
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__b").alias("m"))
    return best.select(*keys, *[F.col(f"m.{c}").alias(c) for c in rest])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def retained(rows: DataFrame, at: str, as_of: Column, null_after_days: dict[str, int], expires: Column, expire_days: int) -> DataFrame:
    """Columns to null once a row is older than their days; rows under `expires` out once older than expire_days."""
    old = lambda d: F.col(at) < as_of - F.make_interval(days=F.lit(d))
    out = rows.where(~(expires & old(expire_days)))
    for name, days in null_after_days.items():
        out = out.withColumn(name, F.when(~old(days), F.col(name)))
    return out


def still_valid(cache: DataFrame, as_of: Column) -> DataFrame:
    """key, value: the latest row of each key among those that have not expired."""
    return cache.where(F.col("expires_at") > as_of).groupBy("key").agg(F.max_by("value", "ts").alias("value"))


def issuer_organisation(dn: Column) -> Column:
    """The first O= part of an issuer's name, null if there is none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(dn, r"(?:^|,)\s*O=([^,]+)", 1), '^"+|"+$', ""), F.lit(""))


def certificates(log: DataFrame, current: DataFrame) -> DataFrame:
    """(source, domain, names, not_before, issuer) of two providers' rows.

    log: domain, id, name_value (names on lines), not_before, issuer_name; the first row of each domain and id stays (by day,
    then names). current: domain, dns_names, not_before, issuer (a struct with friendly_name); every row stays.
    """
    first = log.groupBy("domain", "id").agg(F.min(F.struct("not_before", "name_value", "issuer_name")).alias("m"))
    old = first.select(F.lit("log").alias("source"), "domain", F.split(F.coalesce("m.name_value", F.lit("")), "\n").alias("names"), "m.not_before", issuer_organisation(F.col("m.issuer_name")).alias("issuer"))
    return old.unionByName(current.select(F.lit("current").alias("source"), "domain", F.coalesce("dns_names", F.array().cast("array<string>")).alias("names"), "not_before", F.col("issuer.friendly_name").alias("issuer")))


def certificate_history(certs: DataFrame, sites, top: int = 3, most: int = 30) -> DataFrame:
    """Per source and domain: certificates, first and latest day, main issuers, and names below it and elsewhere, sorted.

    certs: as from `certificates`; sites: adds registered_domain to rows with `host`. Issuers of equal count go by name.
    Names are made unique before they meet or are gathered, and a domain keeps `most` of each kind.
    """
    by = ["source", "domain"]
    counts = certs.groupBy(*by, "issuer").agg(F.count("*").alias("n"), F.min("not_before").alias("a"), F.max("not_before").alias("z"))
    main = F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("issuer").isNotNull(), F.struct((-F.col("n")).alias("m"), "issuer")))), 1, top), lambda x: x["issuer"])
    facts = counts.groupBy(*by).agg(F.sum("n").alias("certs"), F.min("a").alias("first_seen"), F.max("z").alias("latest"), main.alias("issuers"))
    names = certs.select(*by, F.explode("names").alias("raw")).select(*by, F.regexp_replace(F.lower(F.trim("raw")), r"^\*\.", "").alias("host")).where("host <> '' and host <> domain").distinct()
    below = F.endswith("host", F.concat(F.lit("."), F.col("domain")))
    other = sites(names.where(~below)).select(*by, F.lit("other").alias("kind"), F.col("registered_domain").alias("name")).where("name <> domain").distinct()
    told = names.where(below).select(*by, F.lit("below").alias("kind"), F.col("host").alias("name")).unionByName(other)
    w = W.partitionBy(*by, "kind").orderBy("name")
    kept = told.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).groupBy(*by).agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("name")))).alias(k) for k in ("below", "other")])
    empty = F.array().cast("array<string>")
    return facts.join(kept, by, "left").select(*by, "certs", "first_seen", "latest", "issuers", F.coalesce("below", empty).alias("subdomains"), F.coalesce("other", empty).alias("other_domains"))


def ns_key(names: Column) -> Column:
    """Name servers in lower case without trailing dot, sorted, unique, joined; null if there is none."""
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(F.transform(names, lambda x: F.regexp_replace(F.lower(x), r"\.$", "")))), ","), F.lit(""))


def owner_columns(title: Column, url: Column, created: Column, nameservers: Column, other_domains: Column, names: Column) -> list[Column]:
    """title, url, domain_created, ns_key, cert_domains of a library row: redacted and cut to what the library stores."""
    both = F.concat(F.coalesce(other_domains, F.array().cast("array<string>")), F.coalesce(names, F.array().cast("array<string>")))
    return [
        F.nullif(F.substring(title, 1, 200), F.lit("")).alias("title"), F.substring(L.redact(url), 1, 2000).alias("url"), F.nullif(F.substring(created, 1, 10), F.lit("")).alias("domain_created"),
        ns_key(nameservers).alias("ns_key"), F.slice(F.array_distinct(both), 1, 40).alias("cert_domains"),
    ]


def library_rows(pages: DataFrame, digests: DataFrame, source: str, key: str = "page_id") -> DataFrame:
    """Rows of the page library from captured pages and their digests: admitted pages only (200 characters of html and a web link).

    pages: key, url, html; digests: as from digest.digest. source_ref is the digest of the link, so a page captured again is
    the same row; of pages with one link the largest key stays. The link is redacted and cut, as is the title.
    """
    admitted = pages.where((F.length("html") >= 200) & F.col("url").rlike("(?i)^https?://")).select(key, "url")
    url, title, _, _, _ = owner_columns(F.col("title"), F.col("url"), F.lit(None).cast("string"), F.array().cast("array<string>"), F.array().cast("array<string>"), F.array().cast("array<string>"))
    rows = admitted.join(digests, key).select(
        key, F.lit(source).alias("source"), F.md5(F.col("url").cast("binary")).alias("source_ref"), url, "site", title, F.get("posed", F.lit(0)).alias("brand"), "scam_type", "verdict", "rule_score",
        "tags", "words", "dom_hash", "dom", "txt", "bands", "features",
    )
    rest = [c for c in rows.columns if c not in (key, "source", "source_ref")]
    one = rows.groupBy("source", "source_ref").agg(F.max_by(F.struct(*rest), key).alias("m"))
    return one.select("source", "source_ref", *[F.col(f"m.{c}").alias(c) for c in rest])


#: Registration documents; entities hold entities to any depth and are read level by level.
REGISTRATION = "events array<struct<eventAction:string,eventDate:string>>, nameservers array<struct<ldhName:string>>, status array<string>, secureDNS struct<delegationSigned:boolean>, entities array<string>"
ENTITY = "roles array<string>, vcardArray array<string>, entities array<string>"


def entities(docs: DataFrame, key: str, raw: str = "entities", most: int = 100) -> DataFrame:
    """(key, path, roles, card): every entity in the documents, with its place on each level.

    docs: key, and entities as JSON texts. Each pass reads one more level of those that have one, until none has; it is an
    error if documents go deeper than `most`. In order of path an entity comes before those in it, and those before the next.
    """
    level = docs.select(key, F.posexplode(raw).alias("at", "text")).select(key, F.array("at").alias("path"), "text")
    found = None
    for _ in range(most):
        read = cut(level.select(key, "path", F.from_json("text", ENTITY).alias("e")).select(key, "path", "e.roles", F.col("e.vcardArray").alias("card"), F.col("e.entities").alias("inside")), "entities")
        found = read.drop("inside") if found is None else found.unionByName(read.drop("inside"))
        deeper = read.where(F.size("inside") > 0)
        if deeper.isEmpty():
            return found
        level = deeper.select(key, "path", F.posexplode("inside").alias("at", "text")).select(key, F.concat("path", F.array("at")).alias("path"), "text")
    raise ValueError(f"entities go deeper than {most} levels")


def registrations(docs: DataFrame, key: str, as_of: Column, doc: str = "doc") -> DataFrame:
    """One flat row per registration document: who registered a name where and when, its servers, flags and signing.

    An entity is the first that has its role, those inside each looked at before the next; the contact for abuse is looked for
    inside the registrar. Broken documents have nulls.
    """
    d = cut(docs.select(key, F.from_json(doc, REGISTRATION).alias("d")).withColumn("__id", F.monotonically_increasing_id()), "registrations")
    every = entities(d.select("__id", "d.entities"), "__id")
    having = lambda role: F.min(F.when(F.array_contains("roles", role), F.struct("path", "card")))
    main = every.groupBy("__id").agg(having("registrant").alias("owner"), having("registrar").alias("agent"))
    under = every.join(main.where("agent is not null").select("__id", F.col("agent.path").alias("above")), "__id")
    inside = under.where((F.size("path") > F.size("above")) & (F.slice("path", F.lit(1), F.size("above")) == F.col("above")))
    abuse = inside.groupBy("__id").agg(having("abuse").alias("abuse"))
    cells = lambda e: F.from_json(e["card"][1], "array<array<string>>")
    field = lambda e, name: F.nullif(F.trim(F.get(F.filter(cells(e), lambda i: i[0] == name), F.lit(0))[3]), F.lit(""))
    day = lambda action: F.get(F.filter("d.events", lambda e: e["eventAction"] == action), F.lit(0))["eventDate"]
    rows = d.join(main, "__id", "left").join(abuse, "__id", "left").withColumn("created", L.parse_date(day("registration")))
    return rows.select(
        key, field(F.col("agent"), "fn").alias("registrar"), field(F.col("abuse"), "email").alias("abuse"), F.coalesce(field(F.col("owner"), "org"), field(F.col("owner"), "fn")).alias("registrant"),
        "created", day("last changed").alias("updated"), day("expiration").alias("expires"), F.greatest(F.datediff(as_of, "created"), F.lit(0)).alias("age_days"),
        F.array_sort(F.array_distinct(F.filter(F.transform("d.nameservers", lambda n: F.lower(n["ldhName"])), lambda n: n != ""))).alias("nameservers"), F.col("d.status").alias("flags"), F.col("d.secureDNS.delegationSigned").alias("dnssec"),
    )
