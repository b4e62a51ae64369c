"""Jobs on tables: owners, address ranges, counts and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.functions import links as L
from linkloom.operators.ranking import ranked, running
from linkloom.operators.similar import NOTICE
from linkloom.session import cut


def looks_dead(status: Column, stopped: Column, tags: Column, title: Column) -> Column:
    return F.coalesce(status >= 400, F.lit(False)) | stopped.isNotNull() | F.coalesce(tags < 12, F.lit(False)) | F.coalesce(title.rlike(NOTICE), F.lit(False))


def library_label(verdict: Column, official: Column, rank: Column) -> Column:
    """What a scan teaches the library: a dangerous one is a scam, a safe one on a known site is honest, the rest is unknown."""
    return F.when(verdict == "dangerous", "phish").when((verdict == "safe") & (official.isNotNull() | rank.isNotNull()), "benign").otherwise("unknown")


def led_to_private(scans: DataFrame, blocked: DataFrame, scan: str = "scan") -> DataFrame:
    """(scan, private): whether the pasted link itself led to a private or local address; such scans are never joined to outside data.

    scans: scan (unique), url; blocked: scan, host, reason.
    """
    why = F.lower("reason").rlike("private|local|reserved")
    shut = blocked.where(why).select(scan, F.lower("host").alias("__host")).distinct()
    own = scans.select(scan, L.host(F.col("url")).alias("__host")).where("__host <> ''")
    hit = own.join(shut, [scan, "__host"]).select(scan, F.lit(True).alias("private"))
    return scans.select(scan).join(hit, scan, "left").select(scan, F.coalesce("private", F.lit(False)).alias("private"))


def popularity(lines: DataFrame, most: int = 100_000) -> DataFrame:
    """(domain, rank, list_id) of a popularity list's lines (pos, line): `rank,domain`, and `#list_id=` for which list it is.

    Domains in lower case; of a domain named twice the last line counts, of several list ids too. Other lines drop out.
    """
    said = lines.select("pos", F.trim("line").alias("line"))
    head = said.where(F.col("line").startswith("#list_id=")).agg(F.max_by(F.substring("line", 10, 1000), "pos").alias("list_id"))
    rows = said.where(F.col("line").rlike(r"^\d{1,9},\s*\S")).select("pos", F.substring_index("line", ",", 1).cast("int").alias("rank"), F.lower(F.trim(F.regexp_extract("line", r"^\d+,(.*)$", 1))).alias("domain"))
    list_id = head.first()[0]
    one = rows.where(F.col("rank") <= most).groupBy("domain").agg(F.max_by("rank", "pos").alias("rank"))
    return one.withColumn("list_id", F.lit(list_id).cast("string"))


def trusted(official: Column, lookalike: Column, rank: Column) -> Column:
    return (official.isNotNull() & lookalike.isNull()) | F.coalesce(rank <= 10_000, F.lit(False))


def bot_screen(check: Column, captured: Column, inputs: Column, words: Column) -> Column:
    return check.isNotNull() & captured & (inputs == 0) & F.coalesce(words < 50, F.lit(False))


def same_server(probes: DataFrame, library: DataFrame, most: int = 200) -> DataFrame:
    """probe, site, scam: other sites on a probe's address, flagged if any page is a scam; the first `most` by name."""
    one = library.groupBy("ip", "site").agg(F.bool_or("scam").alias("scam"))
    p = probes.select(F.col("id").alias("probe"), "ip", F.col("site").alias("own"))
    rows = p.join(one, "ip").where("own <> site").select("probe", "site", "scam")
    return rows.withColumn("n", F.row_number().over(W.partitionBy("probe").orderBy("site"))).where(F.col("n") <= most).drop("n")


HIDDEN_OWNER = "(?i)redacted|privacy|withheld|protect"


def same_owner(probes: DataFrame, library: DataFrame, days: int = 2) -> DataFrame:
    """probe, id: same name servers and registrar, and created within `days` of each other.

    Both sides carry the period of `days` + 1 days in which they were created, the probe its neighbours too, so a large
    registrar's domains meet only those of about the same date.
    """
    period = lambda c: F.floor(F.unix_date(F.col(c).cast("date")) / (days + 1))
    p = probes.select(F.col("id").alias("probe"), "ns_key", "registrar", F.col("created").alias("at"), F.explode(F.sequence(period("created") - 1, period("created") + 1)).alias("__k"))
    known = library.withColumn("__k", period("created"))
    return p.join(known, ["ns_key", "registrar", "__k"]).where((F.col("probe") != F.col("id")) & (F.abs(F.datediff("at", "created")) <= days)).select("probe", "id")


def siblings(probes: DataFrame, library: DataFrame, certificates: DataFrame, days: int = 2) -> DataFrame:
    """(probe, name, why, known_scam): sites with the same registrant, the same registrar, name servers and date, or a common certificate.

    probes: id, site, registrant, ns_key, registrar, created; library: those and scam; certificates: cert, name. Hidden
    registrants tie nobody together. One row a probe and name; of several ties the first of these three, scams kept.
    """
    own = probes.select(F.col("id").alias("probe"), F.col("site").alias("own"), "registrant")
    named = own.where((F.coalesce(F.trim("registrant"), F.lit("")) != "") & ~F.col("registrant").rlike(HIDDEN_OWNER))
    sites = library.where("site is not null").groupBy("registrant", "site").agg(F.bool_or("scam").alias("scam"))
    by_owner = named.join(sites, "registrant").select("probe", "own", "site", "scam", F.lit(1).alias("tie"))
    near = same_owner(probes, library, days).join(library.select("id", "site", "scam"), "id").join(own.select("probe", "own"), "probe")
    by_date = near.where("site is not null").select("probe", "own", "site", "scam", F.lit(2).alias("tie"))
    certs = certificates.select("cert", "name").distinct()
    shared = own.join(certs, own.own == certs.name).select("probe", "own", "cert").join(certs, "cert").select("probe", "own", F.col("name").alias("site"))
    marks = library.groupBy("site").agg(F.bool_or("scam").alias("scam"))
    by_cert = shared.join(marks, "site", "left").select("probe", "own", "site", F.coalesce("scam", F.lit(False)).alias("scam"), F.lit(3).alias("tie"))
    ties = by_owner.unionByName(by_date).unionByName(by_cert).where("not (site <=> own)").groupBy("probe", F.col("site").alias("name")).agg(F.min("tie").alias("tie"), F.bool_or("scam").alias("known_scam"))
    why = F.when(F.col("tie") == 1, "registered by the same owner").when(F.col("tie") == 2, "same registrar and name servers, registered within two days").otherwise("on the same certificate")
    return ties.select("probe", "name", why.alias("why"), "known_scam")


def blocks(lo: Column, hi: Column, bits: int = 32) -> Column:
    """The range as aligned blocks (k, at), 2^k addresses from at * 2^k on; two of each k at most."""

    def of(k: Column) -> Column:
        left = F.ceil(lo / F.pow(F.lit(2.0), k)).cast("long")
        right = F.floor((hi + 1) / F.pow(F.lit(2.0), k)).cast("long")
        take = lambda odd, at: F.when((left < right) & (odd % 2 == 1), F.struct(k.cast("int").alias("k"), at.alias("at")))
        return F.array(take(left, left), take(right, right - 1))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(bits)), of)), lambda x: x.isNotNull())


def in_ranges(rows: DataFrame, ranges: DataFrame, key: str, ip: str, facts: list[str]) -> DataFrame:
    """key and facts of the range that holds the address and starts last. ranges: lo, hi, tie and facts.

    Ranges are cut into aligned blocks and addresses look up their block of each size that occurs (33 at most), so the
    join is an equal one, every hit is a true one, and no address meets the ranges of its neighbourhood. All addresses of a
    block are in all its ranges, so a block keeps the one that starts last: an address has 33 hits at most, however many ranges hold it.
    """
    r = ranges.select("lo", "tie", *facts, F.explode(blocks(F.col("lo"), F.col("hi"))).alias("__b")).select("lo", "tie", *facts, "__b.k", "__b.at")
    r = cut(r.groupBy("k", "at").agg(F.max(F.struct("lo", "tie")).alias("__last"), F.max_by(F.struct(*facts), F.struct("lo", "tie")).alias("__f")), "blocks")
    sizes = sorted(x.k for x in r.select("k").distinct().collect())
    places = F.array(*[F.struct(F.lit(k).alias("k"), F.shiftright(F.col(ip), k).alias("at")) for k in sizes])
    asked = rows.select(key, F.explode(places).alias("__b")) if sizes else rows.limit(0).select(key, F.struct(F.lit(0).alias("k"), F.lit(0).cast("long").alias("at")).alias("__b"))
    hit = asked.select(key, "__b.k", "__b.at").join(r, ["k", "at"])
    best = hit.groupBy(key).agg(F.max_by("__f", "__last").alias("m"))
    return best.select(key, "m.*")


def longest_prefix(rows: DataFrame, registry: DataFrame, key: str, ip: str, facts: list[str]) -> DataFrame:
    """key and facts of the narrowest network (net, length) that holds the address; of equal networks the least facts."""
    lengths = sorted(x.length for x in registry.select("length").distinct().collect())
    places = F.array(*[F.struct(F.lit(n).alias("length"), F.shiftleft(F.shiftright(F.col(ip), 32 - n), 32 - n).alias("net")) for n in lengths])
    asked = rows.select(key, F.explode(places).alias("__p")).select(key, "__p.*") if lengths else rows.limit(0).select(key, F.lit(0).alias("length"), F.lit(0).cast("long").alias("net"))
    one = registry.select(F.col("length").cast("int").alias("length"), F.col("net").cast("long").alias("net"), *facts).groupBy("length", "net").agg(F.min(F.struct(*facts)).alias("f"))
    return asked.join(one, ["length", "net"]).groupBy(key).agg(F.max_by("f", "length").alias("f")).select(key, "f.*")


def interleaved(lists: DataFrame) -> DataFrame:
    """(link, shared, turn, feed, place): links of several feeds first, then each feed's newest in turn. lists: feed, link, pos.

    Turns inside a feed and the final places are ranks over range partitions, so one feed may hold most links.
    """
    turns = ranked(lists, ["feed"], ["pos", "link"], "turn")
    one = turns.groupBy("link").agg((F.count_distinct("feed") > 1).alias("shared"), F.min(F.struct("turn", "feed")).alias("m"))
    rows = one.select("link", "shared", "m.turn", "m.feed", (~F.col("shared")).alias("__alone"))
    return ranked(rows, [], ["__alone", "turn", "feed"], "place").drop("__alone")


def merged(base: DataFrame, others: list[DataFrame], key: str, value: str) -> DataFrame:
    """base with later frames laid over it; the last one that has the key wins."""
    out = base.withColumnRenamed(value, "__0")
    for i, o in enumerate(others, 1):
        out = out.join(o.withColumnRenamed(value, f"__{i}"), key, "left")
    return out.select(key, F.coalesce(*[F.col(f"__{i}") for i in range(len(others), -1, -1)]).alias(value))


def daily_verdicts(scans: DataFrame) -> DataFrame:
    """day, safe, suspicious, dangerous: zero-filled counts of the days that have scans."""
    return scans.groupBy(F.to_date("ts").alias("day")).pivot("verdict", ["safe", "suspicious", "dangerous"]).count().na.fill(0)


def history(scans: DataFrame, key: str, most: int) -> DataFrame:
    """Of each key's last scans: how many, how many dangerous, the last verdict and score."""
    w = W.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
    r = scans.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    return r.groupBy(key).agg(F.count("*").alias("scans"), F.count_if(F.col("verdict") == "dangerous").alias("dangerous"), F.min_by("verdict", "n").alias("last_verdict"), F.min_by("value", "n").alias("last_score"))


def rates(rows: DataFrame, cutoffs: list[int]) -> DataFrame:
    """Confusion counts and rates at each cut-off (0 where undefined). rows: y (0/1), score. One aggregate."""
    x = rows.withColumn("cutoff", F.explode(F.array(*[F.lit(c) for c in cutoffs])))
    hit = F.col("score") >= F.col("cutoff")
    k = x.groupBy("cutoff").agg(F.count_if(hit & (F.col("y") == 1)).alias("tp"), F.count_if(hit & (F.col("y") == 0)).alias("fp"), F.count_if(~hit & (F.col("y") == 1)).alias("fn"), F.count_if(~hit & (F.col("y") == 0)).alias("tn"))
    r = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return k.select("*", r(tp, tp + fp).alias("precision"), r(tp, tp + fn).alias("recall"), r(2 * tp, 2 * tp + fp + fn).alias("f1"), r(fp, fp + tn).alias("false_alarms"))


def size_step(size: Column, bounds: list[int]) -> Column:
    out = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        out = F.when(size < bounds[i], i).otherwise(out)
    return out


def group_weights(rows: DataFrame, bounds: list[int]) -> DataFrame:
    """step, bare, weight of honest rows: scams over honest ones, between 1 and 20; 1 where a group has no honest row."""
    c = rows.groupBy(size_step(F.col("size"), bounds).alias("step"), "bare").agg(F.count_if(F.col("y") == 1).alias("scam"), F.count_if(F.col("y") == 0).alias("honest"))
    grid = rows.sparkSession.range(2 * (len(bounds) + 1)).select(F.floor(F.col("id") / 2).cast("int").alias("step"), (F.col("id") % 2 == 0).alias("bare"))
    j = grid.join(c, ["step", "bare"], "left")
    return j.select("step", "bare", F.when(F.coalesce("honest", F.lit(0)) == 0, 1.0).otherwise(F.least(F.greatest(F.col("scam") / F.col("honest"), F.lit(1.0)), F.lit(20.0))).alias("weight"))


def hold_out(rows: DataFrame, key: str, day: str, share: float) -> DataFrame:
    """key, held_back: whether a row comes after the first `share` of all rows by (day, key).

    Days are counted first (a small table), and only rows of the day in which the cut falls are ranked, over range
    partitions. A null day comes first.
    """
    days = cut(rows.groupBy(day).agg(F.count("*").alias("c")), "days")
    total = days.agg(F.sum("c")).first()[0] or 0
    run = running(days, [day], {"before": "c"}).select(F.col(day).alias("__day"), "c", (F.floor(F.lit(total) * share) - F.col("before")).alias("take"))
    j = rows.select(key, day).join(run, F.col(day).eqNullSafe(F.col("__day")))
    clear = j.where((F.col("take") <= 0) | (F.col("take") >= F.col("c"))).select(key, (F.col("take") <= 0).alias("held_back"))
    inside = ranked(j.where((F.col("take") > 0) & (F.col("take") < F.col("c"))).select(key, "take"), [], [key], "__n")
    return clear.unionByName(inside.select(key, (F.col("__n") > F.col("take")).alias("held_back")))
