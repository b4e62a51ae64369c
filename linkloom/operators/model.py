"""The page model: features, boosted trees, trees as tables, scores with their causes, and how good they are."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.functions import html as H
from linkloom.functions import links as L
from linkloom.operators import links as LT
from linkloom.operators import pages as PT
from linkloom.operators.ranking import running
from linkloom.session import cut, spread


def vector(df: DataFrame, key: str, sizes: list[str], shares: list[str], flags: list[str]) -> DataFrame:
    """key and `features`: log of one plus each size, shares as they are, flags as 0 or 1; floats in that order, null as 0."""
    values = [F.log1p(F.coalesce(F.col(c), F.lit(0))) for c in sizes] + [F.coalesce(F.col(c), F.lit(0.0)) for c in shares] + [F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in flags]
    return df.select(key, F.array(*[v.cast("float") for v in values]).alias("features"))


#: The numbers of a page's vector, in their order.
FEATURES = (
    "host_length path_length path_depth host_dots https subdomain_depth digit_ratio hyphens entropy random_name is_ip has_at double_slash_path abused_tld shortener odd_port punycode url_words "
    "lookalike lookalike_homograph lookalike_typo lookalike_combo lookalike_subdomain "
    "captured forms inputs password_fields hidden_fields asks_count " + " ".join(f"asks_{k}" for k in H.ASKS) + " "
    "form_to_other_domain form_without_target mailto_form brands_mentioned brand_in_title impersonated wallets " + " ".join(f"phrases_{g}" for g in H.PHRASES) + " "
    "iframes hidden_iframes right_click_blocked obfuscation base64_share links empty_link_share external_link_share executable_links phone_numbers scripts external_scripts images meta_refresh noindex "
    "has_title title_length tags_log words_log words_per_tag out_domains"
).split()


def read_pages(pages: DataFrame, suffixes: DataFrame, brands: DataFrame, key: str = "page_id") -> DataFrame:
    """key, a double for each of FEATURES and what else link and html say: url, host, site, registered_domain, free_hosting, official
    (whose own site it is), imitation (how the link imitates a brand), posed (brands the page poses as), asks and title.

    pages: key (unique), url, html. suffixes as in links.sites; brands: ord, name, domains, labels, keywords (a stated set of
    names). The html is walked once; what it says is written and then read for counts of brand names and of other sites. Each
    of these is written too: as one plan they cost the driver more memory and time than the rows cost the tasks.
    What is absent is 0.
    """
    pages = spread(pages)
    link = cut(LT.facts(pages, suffixes, key), "links")
    page = cut(PT.page_facts(pages.withColumn("host", L.host(F.col("url"))), key), "pages")
    away = cut(PT.reach(page, link, lambda h: LT.sites(h, suffixes), key), "away")
    official = cut(LT.official_names(link, brands), "official")
    labels = cut(link.where("registered_domain is not null").join(official, "host", "left_anti").select("host", "label", "subdomain").distinct(), "labels")
    posing = cut(LT.imitations(labels, brands).select("host", F.col("brand").alias("imitated"), "kind"), "posing")
    named = cut(PT.mentions(page, brands, key, "said"), "named")
    counted = cut(named.groupBy(key).agg(F.count("*").alias("brands_mentioned")).join(PT.first_mention(named, key).select(key, F.col("brand").alias("top"), F.col("times").alias("mentions")).hint("merge"), key), "counted")
    titled = cut(PT.mentions(page, brands, key, "title").groupBy(key).agg(F.array_sort(F.collect_list("brand")).alias("in_title")), "titled")
    # Merge: a stored table of a row a page looks small enough to be sent through the driver, and is not.
    rows = link.join(posing.hint("merge"), "host", "left").join(official.withColumnRenamed("brand", "official").hint("merge"), "host", "left")
    rows = rows.join(page.drop("said", "reached", "external_scripts", "external_link_share").hint("merge"), key)
    rows = rows.join(away.hint("merge"), key, "left").join(counted.hint("merge"), key, "left").join(titled.hint("merge"), key, "left")
    none = F.array().cast("array<string>")
    own = F.when(F.col("official").isNull(), none).otherwise(F.array("official"))
    posed = PT.impersonated(F.col("imitated"), F.col("in_title"), F.col("top"), F.coalesce("mentions", F.lit(0)), F.coalesce("brands_mentioned", F.lit(0)), F.size("asks"), own)
    rows = cut(rows.withColumn("posed", posed), "joined")
    values = {
        "url_words": F.size("url_words"), "lookalike": F.col("kind").isNotNull(), "asks_count": F.size("asks"), "form_without_target": F.col("without_target"), "mailto_form": F.col("mailto"), "brand_in_title": F.size(F.coalesce("in_title", none)),
        "impersonated": F.size("posed"),
        "executable_links": F.least(F.size("programs"), F.lit(10)), "external_link_share": F.when(F.col("links") > 0, F.round(F.coalesce("external_links", F.lit(0)) / F.col("links"), 2)), "has_title": F.col("title") != "", "title_length": F.length("title"),
        "tags_log": F.log1p("tags"), "words_log": F.log1p("words"), "words_per_tag": F.when(F.col("tags") > 0, F.col("words") / F.col("tags")),
    }
    values |= {f"lookalike_{k}": F.col("kind") == k for k in ("homograph", "typo", "combo", "subdomain")} | {f"asks_{k}": F.array_contains("asks", k) for k in H.ASKS}
    told = ["host", "site", "registered_domain", "free_hosting", "official", F.col("kind").alias("imitation"), "posed", "asks", "title", F.col("length").alias("url_length"), F.col("words").cast("long").alias("n_words")]
    out = rows.select(key, *told, *[F.coalesce(values.get(n, F.col(n)).cast("double"), F.lit(0.0)).alias(n) for n in FEATURES])
    return out


def page_vector(pages: DataFrame, suffixes: DataFrame, brands: DataFrame, key: str = "page_id") -> DataFrame:
    """key and a double for each of FEATURES, see read_pages."""
    return read_pages(pages, suffixes, brands, key).select(key, *FEATURES)


def assembled(vectors: DataFrame, key: str = "page_id", *others: str) -> DataFrame:
    """key, `others` and `features`: the floats of a table of numbers, in the order of FEATURES."""
    return vectors.select(key, *others, F.array(*[F.col(n).cast("float") for n in FEATURES]).alias("features"))


def score(rows: DataFrame, nodes: DataFrame, key: str = "id", most_nodes: int = 200_000) -> DataFrame:
    """key, raw, roots, steps: the sum of leaves, that of roots, and what each feature on the paths adds; roots and steps add up to raw.

    A value equal to a threshold goes left; where the features are floats, a threshold is the nearest float. The trees are a model of bounded size (`most_nodes`, an error beyond) that
    every task holds once; rows walk all trees in Arrow batches and are not moved.
    """
    table = nodes.limit(most_nodes + 1).toPandas().sort_values(["tree", "node"])
    if len(table) > most_nodes:
        raise ValueError(f"the model has over {most_nodes} nodes")
    if rows.schema["features"].dataType.elementType.typeName() == "float":
        table["t"] = table["t"].astype(np.float32).astype(float)
    sent = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        trees = [t.set_index("node").reindex(range(t["node"].max() + 1), fill_value=-1) for _, t in sent.value.groupby("tree")]
        trees = [tuple(t[c].to_numpy() for c in ("f", "t", "l", "r", "v")) for t in trees]
        for batch in batches:
            x = np.array(batch["features"].tolist(), float).reshape(len(batch), -1)
            raw, roots, push, met = np.zeros(len(x)), 0.0, {}, {}
            for f, t, left, right, v in trees:
                at, every = np.zeros(len(x), int), np.arange(len(x))
                roots += v[0]
                while (open_ := every[f[at] >= 0]).size:
                    now = at[open_]
                    to = np.where(x[open_, f[now]] <= t[now], left[now], right[now])
                    for k in np.unique(f[now]):
                        mine = open_[f[now] == k]
                        push.setdefault(k, np.zeros(len(x)))[mine] += (v[to] - v[now])[f[now] == k]
                        met.setdefault(k, np.zeros(len(x), bool))[mine] = True
                    at[open_] = to
                raw += v[at]
            steps = [[{"f": int(k), "d": float(push[k][i])} for k in sorted(push) if met[k][i]] for i in range(len(x))]
            yield pd.DataFrame({key: batch[key], "raw": raw, "roots": roots, "steps": steps})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "features").mapInPandas(run, f"{key} {kind}, raw double, roots double, steps array<struct<f:int,d:double>>")


def causes(scored: DataFrame, key: str = "id", top: int = 4, least: float = 0.05) -> DataFrame:
    """key, f, push: the features that moved a row most."""
    s = scored.select(key, F.explode("steps").alias("s")).groupBy(key, F.col("s.f").alias("f")).agg(F.sum("s.d").alias("push")).where(F.abs("push") >= least)
    return s.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(F.abs("push")), "f"))).where(F.col("n") <= top).drop("n")


def points(p: Column) -> Column:
    return F.when(p >= 0.95, 50).when(p >= 0.8, 40).when(p >= 0.6, 25).when(p >= 0.4, 10).when(p <= 0.05, -20).when(p <= 0.15, -10).otherwise(0)


def say(p: Column, rule: Column, backing: Column, trusted: Column, shared: Column) -> Column:
    """Points the model adds: none to trusted sites, few without backing and never out of Safe, few on shared hosts."""
    x = points(p)
    return F.when((x > 0) & trusted, 0).when((x > 0) & (backing < 8), F.greatest(F.lit(0), F.least(x, F.lit(20), F.lit(30) - rule))).when((x > 0) & shared, F.least(x, F.lit(20))).otherwise(x)


def auc(rows: DataFrame) -> DataFrame:
    """One row: ROC AUC with mean ranks of ties, and average precision. rows: y (0/1), p.

    Rows are counted by value of p, and the counts added up from above over range partitions, so p may take any number of values.
    """
    c = rows.groupBy((-F.col("p")).alias("down")).agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b"))
    run = running(c, ["down"], {"ra": "a", "rb": "b"}).withColumn("ta", F.col("ra") + F.col("a")).withColumn("tb", F.col("rb") + F.col("b"))
    s = run.agg(F.sum(F.col("b") * (F.col("ta") - F.col("a") / 2)).alias("u"), F.sum("a").alias("A"), F.sum("b").alias("B"), F.sum(F.try_divide(F.col("a") * F.col("ta"), F.col("ta") + F.col("tb"))).alias("ap"))
    return s.select(F.try_divide(F.col("u"), F.col("A") * F.col("B")).alias("roc_auc"), F.try_divide("ap", "A").alias("pr_auc"))


def furthest(a: DataFrame, b: DataFrame, key: str = "id", value: str = "p") -> DataFrame:
    """rows, worst: how many rows two scorers share and their largest difference."""
    return a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key).agg(F.count("*").alias("rows"), F.max(F.abs(F.col("x") - F.col("y"))).alias("worst"))


def rated(rows: DataFrame) -> DataFrame:
    """Adds total and free: rule score plus the model's points with and without the limits, in 0..100.

    rows: p, rule, backing, trusted, shared. Without limits the page counts as backed; trusted sites stay as they are.
    A null p adds nothing, a null rule gives null.
    """
    clamp = lambda x: F.when(x.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), x)))
    c = {n: F.col(n) for n in ("p", "rule", "backing", "trusted", "shared")}
    bound = say(c["p"], c["rule"], c["backing"], c["trusted"], c["shared"])
    free = say(c["p"], c["rule"], F.lit(100), F.lit(False), F.lit(False))
    return rows.withColumn("total", clamp(c["rule"] + bound)).withColumn("free", clamp(c["rule"] + free))


def report(scored: DataFrame, cutoffs: list[int]) -> DataFrame:
    from linkloom.operators.tables import rates

    return rates(cut(scored, "scored"), cutoffs)


def evaluation(rows: DataFrame, bounds: list[int], safe: int = 30, suspicious: int = 69) -> DataFrame:
    """The tables of an evaluation: section, line, confusion counts and rates (0 where undefined).

    rows: y (0/1), p and plain (the chances by a model with and one without group weights), size, fresh (on a site that
    training never saw), outside (an honest page from elsewhere), rule, backing, trusted, shared. Sections: cutoff and low
    (p at or above, at or below percent), fresh, size (steps between bounds), small (the two lowest steps), scan (rules, both, both without limits),
    plain (the unweighted model), outside. Outside pages count in their own section only. A test on a null counts as
    not met; rows whose y is null are left out. One aggregate reads the rows once and moves one row a partition.
    """
    from linkloom.operators.tables import size_step

    p, plain = F.col("p"), F.col("plain")
    step, inner = size_step(F.col("size"), bounds), ~F.coalesce(F.col("outside"), F.lit(False))
    always, half = F.lit(True), p >= 0.5
    lines = [("cutoff", str(c), always, p >= c / 100) for c in (95, 80, 60, 50, 40)] + [("low", str(c), always, p <= c / 100) for c in (5, 15)]
    lines += [("fresh", "50", F.col("fresh"), half)] + [("size", str(k), step == k, half) for k in range(len(bounds) + 1)] + [("small", "50", step <= 1, half)]
    lines += [("scan", f"{n} {at}", always, F.col(c) > level) for n, c in (("rules", "rule"), ("both", "total"), ("unlimited", "free")) for at, level in (("suspicious", safe), ("dangerous", suspicious))]
    lines += [("plain", "50", always, plain >= 0.5), ("plain", "small", step <= 1, plain >= 0.5)]
    lines = [(s, n, inner & among, hit) for s, n, among, hit in lines]
    lines += [("outside", str(c), ~inner, p >= c / 100) for c in (40, 60, 80, 95)] + [("outside", "plain 60", ~inner, plain >= 0.6)] + [("outside", n, ~inner, F.col(c) > safe) for n, c in (("both suspicious", "total"), ("unlimited suspicious", "free"))]
    counts = []
    for i, (_, _, among, hit) in enumerate(lines):
        hit, scam, honest = F.coalesce(hit, F.lit(False)), among & (F.col("y") == 1), among & (F.col("y") == 0)
        counts += [F.count_if(scam & hit).alias(f"tp{i}"), F.count_if(honest & hit).alias(f"fp{i}"), F.count_if(scam & ~hit).alias(f"fn{i}"), F.count_if(honest & ~hit).alias(f"tn{i}")]
    one = rated(rows).agg(*counts)
    table = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(n).alias("line"), *[F.col(f"{k}{i}").alias(k) for k in ("tp", "fp", "fn", "tn")]) for i, (s, n, _, _) in enumerate(lines)])
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return one.select(F.explode(table).alias("r")).select("r.*").select("*", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(fp, fp + tn).alias("false_alarms"))
