"""Near copies of pages: candidate buckets, pairs, likeness, families and lookups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.functions.prints import distance
from linkloom.operators.components import components
from linkloom.operators.ranking import ranked
from linkloom.session import cut

MIN_TAGS = 15
MIN_WORDS = 20
SMALL_BUCKET = 48
NEIGHBOURS = 6
ANCHORS = 10
#: About so many pairs are made, or told apart, in one task.
TASK_PAIRS = 1 << 20
#: Pages of a large bucket that meet its anchors under one key.
STRETCH = 1 << 14
#: Titles of notices that thousands of unrelated sites show.
NOTICE = (
    r"(?i)suspended|not found|\b40[34]\b|forbidden|access denied|domain (is )?for sale|parked|just a moment|attention required|site can.t be reached|default web ?page|coming soon|account (has been )?(disabled|terminated)|deceptive site|phishing (warning|detected)|"
    r"under construction|welcome to nginx|apache2? (ubuntu |debian )?default|index of /|website (is )?(expired|unavailable)|bad gateway|service unavailable|default web ?site page|resources and information|deceptive page|\b5\d\d: |web server is down|connection timed out|error code \d|^error$|page not available"
)
KINDS = ("code", "structure", "words", "look", "icon")
#: What each kind of agreement is called.
KIND_WORDS = {"code": "nearly the same code", "structure": "the same page structure", "words": "nearly the same wording", "look": "the same look", "icon": "the same site icon"}
#: Nouns for scam types.
NOUNS = {"banking": "banking page", "credentials": "login page", "crypto": "crypto page", "prize": "prize page", "shop": "shop", "tech_support": "support page", "malware": "download page", "job": "job page", "government": "government page"}


def boilerplate(title: Column, words: Column) -> Column:
    return F.coalesce(words < MIN_WORDS, F.lit(False)) | F.coalesce(title.rlike(NOTICE), F.lit(False))


def common_icons(library: DataFrame, least: int = 5) -> DataFrame:
    """Icons that `least` or more ordinary sites use: they prove nothing."""
    return library.where("icon is not null and label = 'benign' and site is not null").groupBy("icon").agg(F.countDistinct("site").alias("sites")).where(F.col("sites") >= least).select("icon")


def buckets(library: DataFrame, icons: DataFrame) -> DataFrame:
    """(kind, value, id): places where two or more pages meet. library: id, title, words, tags, bands, dom_hash, icon."""
    fit = library.where((F.coalesce(F.nullif("tags", F.lit(0)), F.lit(MIN_TAGS)) >= MIN_TAGS) & ~boilerplate(F.col("title"), F.col("words")))
    plain = fit.join(icons.withColumn("common", F.lit(True)), "icon", "left")
    keys = F.concat(
        F.transform("bands", lambda b: F.struct(F.lit("band").alias("kind"), b.cast("string").alias("value"))),
        F.array(F.struct(F.lit("dom").alias("kind"), F.col("dom_hash").alias("value")), F.struct(F.lit("icon").alias("kind"), F.when(F.col("common").isNull(), F.col("icon")).cast("string").alias("value"))),
    )
    rows = plain.select("id", F.explode(keys).alias("k")).select("k.kind", "k.value", "id").where("value is not null").distinct()
    sizes = rows.groupBy("kind", "value").agg(F.count("*").alias("size")).where("size > 1")
    # Merge: tables that grow with the library are not sent through the driver, here and in pairs.
    return rows.join(sizes.hint("merge"), ["kind", "value"])


def _tasks(df: DataFrame, pairs: Column) -> int:
    """How many tasks make the pairs that df's rows bring by the given column."""
    made = df.agg(F.sum(pairs)).first()[0] or 0
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(made / TASK_PAIRS))


def _near(small: DataFrame) -> tuple[DataFrame, int]:
    """(a, b), a < b: all pairs of buckets (kind, value, id, size), and the number of tasks that make them."""
    n = _tasks(small, (F.col("size") - 1) / 2)
    met = small.select("kind", "value", "id").repartition(n, "kind", "value")
    return met.alias("x").join(met.alias("y").hint("merge"), ["kind", "value"]).where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b")), n


def _told_apart(every: DataFrame, n: int) -> DataFrame:
    """Distinct (a, b) in n tasks. Pairs move as they are made: a map of them in the task that makes them would save little and hold all."""
    return every.repartition(n, "a", "b").distinct()


def pairs(bucketed: DataFrame, library: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of small buckets; in larger ones each page's next six and ten evenly spread anchors.

    Large buckets are ranked over partitions, so their work grows with their size and not with its square. Tasks are as many as
    the pairs need (TASK_PAIRS): what one holds grows neither with the table nor with a bucket.
    """
    bucketed = cut(bucketed.select("kind", "value", "id", "size"), "buckets")
    near, n = _near(bucketed.where(F.col("size") <= SMALL_BUCKET))
    large = bucketed.where(F.col("size") > SMALL_BUCKET).join(library.select("id", F.coalesce("dom_hash", F.lit("")).alias("d"), F.coalesce("txt", F.lit(0)).alias("t")).hint("merge"), "id")
    placed = ranked(large, ["kind", "value"], ["d", "t", "id"]).withColumn("pos", F.col("n") - 1).select("kind", "value", "size", "id", "pos")
    placed = cut(placed, "placed")
    n_next, n_spread = (_tasks(placed, F.lit(x)) for x in (NEIGHBOURS, ANCHORS))
    ahead = placed.select("kind", "value", F.col("id").alias("b"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(NEIGHBOURS)), lambda i: F.col("pos") - i)).alias("pos"))
    dealt = lambda df, k, *keys: df.repartition(k, "kind", "value", *keys)
    next_ = dealt(placed, n_next, "pos").join(dealt(ahead, n_next, "pos").hint("merge"), ["kind", "value", "pos"]).select(F.col("id").alias("a"), "b")
    step = F.greatest(F.floor(F.col("size") / ANCHORS), F.lit(1))
    # A bucket of any size is dealt by stretches, to each of which its anchors go.
    stretches = F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / STRETCH))
    anchors = placed.where((F.col("pos") % step == 0) & (F.col("pos") / step < ANCHORS)).select("kind", "value", F.col("id").alias("b"), F.explode(stretches).alias("stretch"))
    laid = placed.select("kind", "value", "id", F.floor(F.col("pos") / STRETCH).alias("stretch"))
    spread = dealt(laid, n_spread, "stretch").join(dealt(anchors, n_spread, "stretch").hint("merge"), ["kind", "value", "stretch"]).where("id <> b").select(F.col("id").alias("a"), "b")
    every = near.unionByName(next_).unionByName(spread)
    return _told_apart(every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), n + n_next + n_spread)


def _pieces(h: str, differ: int) -> list[Column]:
    """Parts of a 64-bit hash: two hashes of at most `differ` differing bits have one in common."""
    ends = [64 * i // (differ + 1) for i in range(differ + 2)] if differ >= 0 else []
    return [F.shiftrightunsigned(h, a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1).cast("long")) for a, b in zip(ends, ends[1:])]


def _near_in(rows: DataFrame, group: list[str], words: int, looks: int) -> DataFrame:
    """(a, b), a < b: rows (id, txt, look) of one group with at most `words` differing bits of txt or `looks` of look (under 0: not asked)."""
    keys = [F.when(F.col(h).isNotNull(), F.xxhash64(*group, F.lit(h), F.lit(i), x)) for h, most in (("txt", words), ("look", looks)) for i, x in enumerate(_pieces(h, most))]
    keyed = rows.select("id", "txt", "look", F.explode(F.array_compact(F.array(*keys))).alias("key"))
    side = lambda s: keyed.select("key", *[F.col(c).alias(f"{s}_{c}") for c in ("id", "txt", "look")])
    met = side("x").join(side("y"), "key").where("x_id < y_id")
    close = (distance(F.col("x_txt"), F.col("y_txt")) <= words) | (distance(F.col("x_look"), F.col("y_look")) <= looks)
    return met.where(F.coalesce(close, F.lit(False))).select(F.col("x_id").alias("a"), F.col("y_id").alias("b")).distinct()


def whole_pairs(bucketed: DataFrame, library: DataFrame, words: int = 8, looks: int = 8, alike: DataFrame | None = None) -> DataFrame:
    """(a, b), a < b: all pairs of small buckets, and of larger ones every pair that can match. For libraries without icons.

    Without near code a match has at most 8 differing bits of txt or look: what structure adds is under 2 points. So pages of a large
    bucket meet where their hashes have a part in common, and only pairs that near stay. alike: id, group, see code_groups; pages
    of one group may differ by the bits that still count for anything. Where there is no look, `words` 4 and `looks` -1 are enough.
    """
    bucketed = cut(bucketed.select("kind", "value", "id", "size"), "buckets")
    near, _ = _near(bucketed.where(F.col("size") <= SMALL_BUCKET))
    large = cut(bucketed.where(F.col("size") > SMALL_BUCKET).select("kind", "value", "id").join(library.select("id", "txt", "look"), "id"), "large")
    every = near.unionByName(_near_in(large, ["kind", "value"], words, looks))
    if alike is not None:
        every = every.unionByName(_near_in(large.join(alike, "id"), ["kind", "value", "group"], 12, 10))
    return every.distinct()


def code_groups(structures: DataFrame, near: DataFrame) -> DataFrame:
    """(id, group): pages of one structure share a group, and pages of two near ones; structures, near: as for code_distances."""
    both = F.concat_ws("/", F.col("a").cast("string"), F.col("b").cast("string"))
    pairs = near.select(both.alias("group"), F.explode(F.array("a", "b")).alias("structure"))
    own = structures.select("id", F.col("structure").cast("string").alias("group"))
    return own.unionByName(structures.join(pairs, "structure").select("id", "group"))


def likeness(joined: DataFrame) -> DataFrame:
    """Adds points, kinds, percent, match to rows that hold two pages' prints: x_ and y_ of dom_hash, dom, txt, look, icon, tags, code.

    code: distance of two code prints, null where there is none. Rows whose icon is common carry a null icon.
    """
    c = lambda n: (F.col(f"x_{n}"), F.col(f"y_{n}"))
    dom, txt, look = (distance(*c(n)) for n in ("dom", "txt", "look"))
    same = F.coalesce(c("dom_hash")[0] == c("dom_hash")[1], F.lit(False))
    code = F.col("code")
    gained = {
        "code": F.when(code <= 30, 2.5).when(code <= 60, 2.0).when(code <= 100, 1.0),
        "structure": F.when(same, 1.5).when(dom <= 3, 1.25).when(dom <= 8, 0.75),
        "words": F.when(txt <= 4, 2.0).when(txt <= 8, 1.25).when(txt <= 12, 0.5),
        "look": F.when(look <= 4, 2.0).when(look <= 8, 1.25).when(look <= 10, 0.5),
        "icon": F.when(c("icon")[0] == c("icon")[1], 1.0),
    }
    shares = F.filter(F.array(F.when(code.isNotNull(), F.greatest(F.lit(0.0), 1 - code / 300)), F.when(same, 1.0).otherwise(1 - dom / 64), 1 - txt / 64, 1 - look / 64), lambda x: x.isNotNull())
    tiny = F.least(*[F.coalesce(F.nullif(t, F.lit(0)), F.lit(MIN_TAGS)) for t in c("tags")]) < MIN_TAGS
    points = sum((F.coalesce(g, F.lit(0.0)) for g in gained.values()), F.lit(0.0)) - F.when(tiny, 1.5).otherwise(0.0)
    kinds = F.filter(F.array(*[F.when(g.isNotNull(), F.lit(k)) for k, g in gained.items()]), lambda x: x.isNotNull())
    out = joined.withColumn("points", F.round(points, 2)).withColumn("kinds", kinds).withColumn("shares", shares)
    out = out.withColumn("percent", F.when(F.size("shares") > 0, F.bround(F.aggregate("shares", F.lit(0.0), lambda a, x: a + x) * 100 / F.size("shares")).cast("int")).otherwise(0)).drop("shares")
    content = F.arrays_overlap("kinds", F.array(F.lit("words"), F.lit("look"), F.lit("icon")))
    return out.withColumn("match", (F.col("points") >= 3.0) & (F.size("kinds") >= 2) & content)


def code_distances(candidates: DataFrame, structures: DataFrame, near: DataFrame) -> DataFrame:
    """(a, b, code) of candidate pairs whose code is nearly the same: 0 for one structure, up to 60 for a tenth and 100 for a fifth of it.

    structures: id, structure (the first page of the same one); near: a, b, distance (structures that share four fifths or
    more, see near_sets). Pairs of other structures have no row.
    """
    side = lambda s: structures.select(F.col("id").alias(s), F.col("structure").alias(f"{s}_s"))
    met = candidates.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    met = met.select("a", "b", F.least("a_s", "b_s").alias("x"), F.greatest("a_s", "b_s").alias("y"))
    known = near.select(F.col("a").alias("x"), F.col("b").alias("y"), "distance")
    code = F.when(F.col("x") == F.col("y"), 0).otherwise(F.least(F.round(F.col("distance") * 600), F.lit(100)).cast("int"))
    return met.join(known, ["x", "y"], "left").select("a", "b", code.alias("code")).where("code is not null")


def recall(library: DataFrame, icons: DataFrame, groups: DataFrame, every: int = 50) -> DataFrame:
    """(matches, together, recall): of the matches of every `every`th page with all pages that it meets in any bucket, how many are in its group.

    What large buckets leave out (see pairs) is measured so: each page asked about is compared with whole buckets.
    """
    met = buckets(library, icons).select("kind", "value", "id")
    asked = met.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("kind", "value", F.col("id").alias("p"))
    both = asked.join(met, ["kind", "value"]).where("p <> id").select(F.least("p", "id").alias("a"), F.greatest("p", "id").alias("b")).distinct()
    found = compared(both, library, icons).where("match").select("a", "b")
    side = lambda k: groups.select(F.col("id").alias(k), F.col("component").alias(f"{k}_g"))
    placed = found.join(side("a"), "a", "left").join(side("b"), "b", "left")
    one = placed.agg(F.count("*").alias("matches"), F.count_if(F.col("a_g") == F.col("b_g")).alias("together"))
    return one.withColumn("recall", F.try_divide("together", "matches"))


def compared(candidates: DataFrame, library: DataFrame, icons: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """(a, b, points, kinds, percent, match) of candidate pairs; library: id and its prints; codes: a, b, code, see code_distances."""
    prints = ["dom_hash", "dom", "txt", "look", "icon", "tags"]
    plain = library.join(icons.withColumn("common", F.lit(True)), "icon", "left").withColumn("icon", F.when(F.col("common").isNull(), F.col("icon"))).select("id", *prints)
    side = lambda s, k: plain.select(F.col("id").alias(k), *[F.col(p).alias(f"{s}_{p}") for p in prints]).hint("merge")
    # The hint: a stored library looks smaller than it is, compressed, and would be sent whole through the driver.
    joined = candidates.join(side("x", "a"), "a").join(side("y", "b"), "b")
    joined = joined.join(codes, ["a", "b"], "left") if codes is not None else joined.withColumn("code", F.lit(None).cast("int"))
    return likeness(joined).select("a", "b", "points", "kinds", "percent", "match")


def near_sets(sets: DataFrame, key: str, items: str, least: float = 0.8) -> DataFrame:
    """(a, b, same, both), a < b: rows whose item sets share `same` of `both` items, at least `least` of them; exact.

    Items are ordered from rare to common over the whole table. Two such sets share one of the first n - ceil(least * n) + 1
    items of each, so rows meet on those only, in neighbouring classes of size; where a pair meets bounds what it can still
    share, and pairs that cannot reach it drop out before their sets are fetched. Keys are unique; empty and null sets
    meet nothing.
    """
    flat = sets.select(F.col(key).alias("id"), F.explode(F.array_distinct(items)).alias("item")).where("item is not null")
    often = flat.groupBy("item").agg(F.count("*").alias("often"))
    rows = flat.join(often, "item").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("often", "item"))), lambda x: x["item"]).alias("items"))
    rows = cut(rows.withColumn("n", F.size("items")), "sets")
    first = F.slice("items", F.lit(1), F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1)
    heads = rows.select("id", "n", F.floor(F.log("n") / F.log(F.lit(1 / least)) + 1e-9).alias("class"), F.posexplode(first).alias("pos", "item"))
    side = lambda s: heads.select("item", *[F.col(c).alias(f"{s}_{c}") for c in ("id", "n", "class", "pos")])
    guests = side("y").withColumn("x_class", F.explode(F.array(F.col("y_class"), F.col("y_class") + 1)))
    wanted = F.ceil((F.col("x_n") + F.col("y_n")) * (least / (1 + least)) - 1e-9)
    met = side("x").join(guests, ["item", "x_class"]).where((F.col("x_class") != F.col("y_class")) | (F.col("x_id") < F.col("y_id")))
    met = met.where(F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos")) >= wanted).select("x_id", "y_id").distinct()
    whole = lambda s: rows.select(F.col("id").alias(f"{s}_id"), F.col("items").alias(s), F.col("n").alias(f"{s}_n"))
    shared = met.join(whole("x"), "x_id").join(whole("y"), "y_id").withColumn("same", F.size(F.array_intersect("x", "y"))).withColumn("both", F.col("x_n") + F.col("y_n") - F.col("same"))
    return shared.where(F.col("same") >= F.col("both") * least - 1e-9).select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"), "same", "both")


def grouped(matches: DataFrame) -> DataFrame:
    """(id, component) of pages linked by matches, named by the lowest id."""
    return components(matches, "a", "b").select(F.col("node").alias("id"), "component")


def top_share(df: DataFrame, by: str, value: str, least: float, tie: str = "id") -> DataFrame:
    """(by, value): the most common value if it covers `least` of all rows, nulls among them; ties go to the lowest id."""
    counts = df.groupBy(by, value).agg(F.count("*").alias("n"), F.min(tie).alias("first"))
    total = counts.groupBy(by).agg(F.sum("n").alias("total"), F.max(F.when(F.col(value).isNotNull(), F.struct("n", (-F.col("first")).alias("f"), value))).alias("m"))
    return total.select(by, F.when(F.col("m.n") / F.col("total") >= least, F.col(f"m.{value}")).alias(value))


def families(members: DataFrame) -> DataFrame:
    """Scam families among grouped pages. members: id, component, label, site, brand, scam_type, title, seen_at, has_thumb."""
    scam = F.col("label") == "phish"
    a = members.groupBy("component").agg(
        F.count("*").alias("size"), F.countDistinct("site").alias("sites"), F.count_if(scam).alias("scams"), F.count_if(F.col("label") == "benign").alias("ordinary"), F.min("id").alias("id"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"),
        F.max_by("id", F.when(scam & F.col("has_thumb"), F.struct("seen_at", -F.col("id")))).alias("shown"), F.count_if(scam & F.col("brand").isNotNull()).alias("branded"),
    )
    scams = members.where(scam)
    most = scams.where("brand is not null").groupBy("component", "brand").count().groupBy("component").agg(F.max("count").alias("most"))
    kept = a.join(most, "component", "left").withColumn("purity", F.coalesce(F.round(F.col("most") / F.col("branded"), 2), F.lit(1.0)))
    template = ((F.col("ordinary") >= 2) & (F.col("scams") / (F.col("scams") + F.col("ordinary")) < 0.6)) | ((F.col("branded") >= 8) & (F.col("most") / F.col("branded") < 0.3))
    kept = kept.where((F.col("size") >= 3) & ~F.coalesce(template, F.lit(False)) & (F.col("sites") >= 2) & (F.col("scams") >= 2))
    for value, least in (("brand", 0.5), ("scam_type", 0.4), ("title", 0.5)):
        kept = kept.join(top_share(scams, "component", value, least), "component", "left")
    return kept.select("id", named(F.col("brand"), F.col("scam_type"), F.col("title")).alias("label"), "brand", "scam_type", "size", "sites", "first_seen", "last_seen", F.coalesce("shown", "id").alias("sample_page"), "purity")


def named(brand: Column, scam_type: Column, title: Column) -> Column:
    noun = F.element_at(F.create_map(*[F.lit(x) for kv in NOUNS.items() for x in kv]), scam_type)
    return (
        F.when(brand.isNotNull() & noun.isNotNull(), F.concat(F.lit("fake "), brand, F.lit(" "), noun)).when(brand.isNotNull(), F.concat(F.lit("fake "), brand, F.lit(" page")))
        .when(noun.isNotNull(), F.concat(noun, F.lit(" with no clear brand"))).when(title.isNotNull(), F.concat(F.lit('pages titled "'), F.substring(title, 1, 40), F.lit('"'))).otherwise("unnamed scam kit")
    )


def lookup(probes: DataFrame, library: DataFrame, most: int = 800) -> DataFrame:
    """(probe, id, ...) candidates of each probe: shared band, structure or icon; family members, then scams, first.

    Of the pages that share one value only the first `most` + 1 in that order can be among a probe's first `most`, so each
    value's pages are ranked over partitions before probes meet them: a value that a third of all pages share costs a probe
    no more than any other.
    """
    values = F.concat(F.transform("bands", lambda b: b.cast("string")), F.filter(F.array(F.concat(F.lit("d"), "dom_hash"), F.concat(F.lit("i"), F.col("icon").cast("string"))), lambda x: x.isNotNull()))
    asked = probes.select(F.col("id").alias("probe"), F.explode(values).alias("key"))
    known = library.select("id", F.col("family_id").isNull().alias("loose"), (F.col("label") != "phish").alias("tame"), F.explode(values).alias("key"))
    known = known.join(asked.select("key").distinct(), "key", "left_semi")
    first = ranked(known, ["key"], ["loose", "tame", "id"], "place").where(F.col("place") <= most + 1)
    hits = asked.join(first, "key").where("probe <> id").select("probe", "id", "loose", "tame").distinct()
    w = W.partitionBy("probe").orderBy("loose", "tame", "id")
    found = hits.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("loose", "tame")
    return found.join(library.select("id", "family_id", "label", "site"), "id")


def whole_lookup(probes: DataFrame, library: DataFrame, icons: DataFrame) -> DataFrame:
    """(probe, id): of the pages that share a band, structure or icon with a probe, every one that can match; no bound. For libraries without looks.

    Without looks and near code a match has at most 4 differing bits of txt, or an icon that proves something and at most 8 of them, or
    12 with one structure. So pages meet under a shared value and a part of their hashes that such pairs have in common, and
    only pairs that near stay: what is made grows with what matches, however many pages share a value.
    """
    common = icons.withColumn("common", F.lit(True))

    def keyed(rows: DataFrame, side: str) -> DataFrame:
        rows = rows.select("id", "txt", "dom_hash", "bands", "icon").join(common, "icon", "left").withColumn("sign", F.when(F.col("common").isNull(), F.col("icon")))
        shared = F.array_compact(F.concat(F.transform("bands", lambda b: b.cast("string")), F.array(F.concat(F.lit("d"), "dom_hash"), F.concat(F.lit("i"), F.col("icon").cast("string")))))
        parts = lambda most: [F.struct(F.lit(i).alias("i"), x.alias("part")) for i, x in enumerate(_pieces("txt", most))]
        near = F.flatten(F.transform(shared, lambda v: F.array(*[F.xxhash64(F.lit("near"), v, x) for x in parts(4)])))
        signed = F.array(*[F.xxhash64(F.lit("signed"), "sign", x) for x in parts(8)])
        built = F.array(F.xxhash64(F.lit("built"), "sign", "dom_hash"))
        told, none = F.col("txt").isNotNull(), F.array().cast("array<bigint>")
        asked = ((told, near), (told & F.col("sign").isNotNull(), signed), (told & F.col("sign").isNotNull() & F.col("dom_hash").isNotNull(), built))
        return rows.select(F.explode(F.concat(*[F.when(x, keys).otherwise(none) for x, keys in asked])).alias("key"), *[F.col(c).alias(f"{side}_{c}") for c in ("id", "txt", "dom_hash", "sign")])

    met = keyed(probes, "x").join(keyed(library, "y").hint("merge"), "key").where("x_id <> y_id")
    apart = distance(F.col("x_txt"), F.col("y_txt"))
    close = (apart <= 4) | ((F.col("x_sign") == F.col("y_sign")) & ((apart <= 8) | ((apart <= 12) & (F.col("x_dom_hash") == F.col("y_dom_hash")))))
    return met.where(F.coalesce(close, F.lit(False))).select(F.col("x_id").alias("probe"), F.col("y_id").alias("id")).distinct()


def best_first(matches: DataFrame, by: str, other: str = "id") -> DataFrame:
    """Adds rank: points, then percent, then the lower id. A page's matches are bounded by its candidates."""
    return matches.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc("points"), F.desc("percent"), other)))


def verdicts(probes: DataFrame, matches: DataFrame, least: int = 85) -> DataFrame:
    """One row per probe: status, family_id, percent, scam_matches, copied_site.

    probes: id, title, words and prints (dom_hash, txt, look). matches: probe, rank, label, site, family_id (null if the page is
    in no family), percent, kinds. skipped: nothing to compare, or a notice; matched: the family of most matches, of
    equal ones the lowest; similar: scams without a family; copy: wording and `least` percent of an ordinary page; else none.
    """
    scam = F.col("label") == "phish"
    copied = (F.col("label") == "benign") & F.array_contains("kinds", "words") & (F.col("percent") >= least)
    family = matches.where("family_id is not null").groupBy("probe", "family_id").agg(F.count("*").alias("n"), F.max("percent").alias("p"))
    family = family.groupBy("probe").agg(F.max_by(F.struct("family_id", "p"), F.struct("n", (-F.col("family_id")).alias("low"))).alias("f"))
    rest = matches.groupBy("probe").agg(F.count_if(scam).alias("scams"), F.min_by("percent", F.when(scam, F.col("rank"))).alias("alike"), F.min_by(F.struct("site"), F.when(copied, F.col("rank"))).alias("original"))
    nothing = F.col("dom_hash").isNull() & F.col("txt").isNull() & F.col("look").isNull()
    rows = probes.select(F.col("id").alias("probe"), (nothing | boilerplate(F.col("title"), F.col("words"))).alias("skip")).join(family, "probe", "left").join(rest, "probe", "left")
    status = F.when(F.col("skip"), "skipped").when(F.col("f").isNotNull(), "matched").when(F.col("scams") > 0, "similar").when(F.col("original").isNotNull(), "copy").otherwise("none")
    rows = rows.withColumn("status", status)
    return rows.select(
        "probe", "status", F.when(F.col("status") == "matched", F.col("f.family_id")).alias("family_id"),
        F.when(F.col("status") == "matched", F.col("f.p")).when(F.col("status") == "similar", F.col("alike")).alias("percent"),
        F.when(F.col("skip"), 0).otherwise(F.coalesce("scams", F.lit(0))).cast("long").alias("scam_matches"), F.when(F.col("status") == "copy", F.col("original.site")).alias("copied_site"),
    )


def same_design(matches: DataFrame, own: DataFrame) -> DataFrame:
    """(probe, name, why, known_scam): other sites among a probe's matches, one row a name with its best match, scams kept.

    matches: probe, rank, site, label, percent, kinds; own: probe, own_site.
    """
    rows = matches.join(own, "probe").where("site is not null and not (site <=> own_site)")
    alike = described(F.col("kinds"))
    why = F.concat(F.col("percent").cast("string"), F.lit("% alike"), F.when(alike != "", F.concat(F.lit(": "), alike)).otherwise(""))
    return rows.withColumn("why", why).groupBy("probe", F.col("site").alias("name")).agg(F.min_by("why", "rank").alias("why"), F.bool_or(F.col("label") == "phish").alias("known_scam"))


def described(kinds: Column) -> Column:
    words = F.transform(kinds, lambda k: F.element_at(F.create_map(*[F.lit(x) for kv in KIND_WORDS.items() for x in kv]), k))
    n = F.size(words)
    return F.when(n == 0, "").when(n == 1, words[0]).otherwise(F.concat(F.array_join(F.slice(words, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(words, -1)))
