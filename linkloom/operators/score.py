"""Explainable scoring: rules as columns. A reason is a struct (text, points, area, backs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAFE_MAX = 30
SUSPICIOUS_MAX = 69
LONG_PAGE = 600
#: Points by kind of imitation, by private field and by wording.
IMITATION_POINTS = {"homograph": 45, "typo": 35, "subdomain": 30, "combo": 25}
FIELD_POINTS = {"seed_phrase": 40, "otp": 30, "upi_pin": 30, "atm_pin": 30, "card": 25, "cvv": 25, "expiry": 15, "aadhaar": 20, "pan": 20, "ssn": 20, "netbanking": 15, "bank_account": 15, "password": 10}
PHRASE_POINTS = {"urgency": 10, "prize": 10, "job": 10, "tech_support": 15, "government": 10, "download": 8}
SCAM_TYPES = ("banking", "credentials", "crypto", "prize", "shop", "tech_support", "malware", "job", "government")
REASON = "struct<text:string,points:int,area:string,backs:boolean>"


def reason(when: Column, text: Column | str, points: Column | int, area: str, backs: bool = True) -> Column:
    text, points = (F.lit(x) if not isinstance(x, Column) else x for x in (text, points))
    return F.when(F.coalesce(when, F.lit(False)), F.struct(text.cast("string").alias("text"), points.cast("int").alias("points"), F.lit(area).alias("area"), F.lit(backs).alias("backs")))


def listed(*reasons: Column) -> Column:
    """The reasons that hold, in rule order."""
    return F.filter(F.array(*reasons), lambda r: r.isNotNull())


def lookup(points: dict[str, int], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in points.items() for x in kv]), key)


def link_reasons(requested: Column | None = None) -> Column:
    """From columns imitation, is_ip, has_at, unicode_host, free_hosting, abused, rank, depth, random_name, hyphens, url_words, official, length, port, double_slash, shortener."""
    c = F.col
    n = F.size("url_words")
    return listed(
        reason(c("imitation").isNotNull(), F.concat(F.lit("imitates by "), c("imitation")), lookup(IMITATION_POINTS, c("imitation")), "link"),
        reason(c("is_ip"), "bare address", 20, "link"),
        reason(c("has_at"), "destination hidden behind @", 15, "link"),
        reason(c("unicode_host").isNotNull() & ~c("imitation").eqNullSafe(F.lit("homograph")), "special characters", 10, "link"),
        reason(c("free_hosting").isNotNull(), "free hosting", 10, "link", backs=False),
        reason(c("abused") & c("rank").isNull(), "abused ending", 8, "link"),
        reason(c("depth") >= 3, "many sub-domains", 8, "link"),
        reason(c("random_name"), "random name", 8, "link"),
        reason(c("hyphens") >= 2, "several hyphens", 5, "link"),
        reason((n > 0) & c("official").isNull() & c("rank").isNull(), "scam words", F.least(n * 4, F.lit(12)), "link"),
        reason(c("length") > 100, "very long", 5, "link"),
        reason(c("port").isNotNull(), "unusual port", 8, "link"),
        reason(c("double_slash"), "second address inside", 5, "link"),
        reason((requested if requested is not None else F.lit(True)) & c("shortener"), "shortened", 5, "link"),
    )


def page_reasons() -> Column:
    """From columns asks, official_site, plain_http, impersonated, brand_in_title, form_away, form_hidden, mailto, wallets, words, phrases, programs, right_click, obfuscation, hidden_frames, links, empty_share, blob_share."""
    c = F.col
    scored = F.transform(F.filter("asks", lambda a: a.isin(*FIELD_POINTS)), lambda a: lookup(FIELD_POINTS, a))
    asked = F.size(scored) > 0
    top = F.least(F.array_max(scored) + 5 * (F.size(scored) - 1), F.lit(45))
    short = c("words") < LONG_PAGE
    return listed(
        reason(asked & ~c("official_site"), "asks for private data", top, "page"),
        reason(asked & ~c("official_site") & c("plain_http"), "without encryption", 20, "page"),
        reason(c("impersonated").isNotNull() & asked, "shows a brand that is not its own", 25, "page"),
        reason(c("impersonated").isNotNull() & ~asked & c("brand_in_title"), "title names a brand", 10, "page"),
        reason(c("form_away"), "form sends elsewhere", 15, "page"),
        reason(c("form_hidden") & asked, "form sends by hidden code", 5, "page"),
        reason(c("mailto"), "form mails", 10, "page"),
        reason(F.size("wallets") > 0, "wallet addresses", 10, "page"),
        *[reason(short & F.array_contains("phrases", k) & ~(c("official_site") & F.lit(k in ("urgency", "government"))), k, p, "page") for k, p in PHRASE_POINTS.items()],
        reason(c("programs") > 0, "program files", 15, "page"),
        reason(c("right_click"), "no right click", 8, "page"),
        reason(c("obfuscation") >= 3, "scrambled code", 8, "page"),
        reason(c("hidden_frames") > 0, "hidden frames", 5, "page"),
        reason((c("links") >= 5) & (c("empty_share") > 0.5), "links go nowhere", 8, "page"),
        reason(c("blob_share") > 0.3, "encoded blobs", 5, "page"),
    )


def behaviour_reasons() -> Column:
    """From columns stopped, downloads, hosts (chain), hop_kinds, bot_check, popups."""
    c = F.col
    moves = F.size(F.filter("hosts", lambda h, i: (i == 0) | (h != F.get("hosts", i - 1))))
    return listed(
        reason(c("stopped") == "blocked", "private address", 25, "behaviour"),
        reason((c("downloads") > 0) | (c("stopped") == "download"), "downloads a file", 30, "behaviour"),
        reason(moves >= 3, "many hops", 5, "behaviour"),
        reason(F.exists(F.slice("hop_kinds", 2, 1000), lambda k: k.isin("meta", "script", "form")), "hidden redirect", 5, "behaviour"),
        reason(c("bot_check").isNotNull(), "bot check", 3, "behaviour"),
        reason(c("popups") > 0, "popups", 3, "behaviour"),
    )


def domain_reasons() -> Column:
    """Risks and good signs from columns status, age_days, flags, dns, cert_trusted, first_cert_days, shared_host."""
    c, own = F.col, ~F.col("shared_host")
    age, ok = c("age_days"), (F.col("status") == "ok") & ~F.col("shared_host")
    return listed(
        reason(ok & (age < 7), "days old", 25, "domain"),
        reason(ok & age.between(7, 29), "weeks old", 15, "domain"),
        reason(ok & age.between(30, 179), "months old", 5, "domain"),
        reason(own & (c("status") == "not_found"), "no record", 10, "domain"),
        reason(own & c("flags").rlike("(?i)hold|suspend"), "on hold", 15, "domain"),
        reason(c("dns") == "not_found", "gone from DNS", 5, "domain"),
        reason(~c("cert_trusted"), "certificate not trusted", 15, "certificate"),
        reason(own & (c("first_cert_days") < 7), "first certificate is new", 8, "certificate"),
        reason(ok & (age >= 3650), "ten years old", -15, "domain"),
        reason(ok & age.between(1825, 3649), "five years old", -10, "domain"),
    )


def list_reasons() -> Column:
    """From column sources: array of (id, status, match, popular, malicious, live)."""

    def points(s: Column) -> Column:
        on, info = s["status"] == "listed", s["status"] == "info"
        return (
            F.when((s["id"] == "safe_browsing") & on, 70)
            .when((s["id"] == "phishing_database") & on, F.when(s["match"] == "link", 60).when(s["popular"], 15).otherwise(45))
            .when((s["id"] == "virustotal") & on, F.when(s["malicious"] >= 5, 60).otherwise(35))
            .when((s["id"] == "virustotal") & info, 10)
            .when((s["id"] == "urlhaus") & on, F.when(s["live"], 70).otherwise(45))
            .when((s["id"] == "urlhaus") & info, 15)
            .when((s["id"] == "urlscan") & on, 30)
        )

    return F.filter(F.transform("sources", lambda s: reason(points(s).isNotNull(), F.concat(F.lit("listed by "), s["id"]), points(s), "blacklist")), lambda r: r.isNotNull())


def family_reasons() -> Column:
    """From columns family_status, percent, scams_on_server, shared_network, scams_of_owner, trusted."""
    c, on = F.col, ~F.col("trusted")
    return listed(
        reason(on & (c("family_status") == "matched"), "known family", F.when(c("percent") >= 90, 40).otherwise(35), "family"),
        reason(on & (c("family_status") == "similar"), "like scam pages", 25, "family"),
        reason(on & (c("family_status") == "copy"), "copy of another page", 20, "family"),
        reason(on & (c("scams_on_server") > 0) & ~c("shared_network"), "scams on its server", F.when(c("scams_on_server") >= 3, 20).otherwise(15), "family"),
        reason(on & (c("scams_of_owner") > 0), "scams of its owner", F.when(c("scams_of_owner") >= 3, 25).otherwise(20), "family"),
    )


def graph_reasons() -> Column:
    """From columns graph_status, graph_label, positive_in, negative_in, scam_links_out, trusted."""
    c, on = F.col, ~F.col("trusted")
    named = on & (c("graph_status") == "labelled")
    return listed(
        reason(named & (c("graph_label") == "malicious"), "scam sites link to it", F.when(c("negative_in") >= 2, 20).otherwise(10), "graph"),
        reason(on & (c("scam_links_out") > 0), "links to scam sites", 15, "graph"),
        reason(named & (c("graph_label") == "benign") & (c("positive_in") >= 3), "honest sites link to it", -10, "graph"),
    )


def reputation_reasons() -> Column:
    c = F.col
    return listed(
        reason(c("official").isNotNull() & c("imitation").isNull(), "the real site", -40, "reputation"),
        reason(c("rank").isNotNull() & c("impersonated").isNull(), "popular", F.when(c("rank") <= 10_000, -30).otherwise(-15), "reputation"),
    )


def total(reasons: Column, backed: bool = False) -> Column:
    """Points added up, between 0 and 100; no reasons (null) are 0, null points too. backed: without signs that honest and scam sites share."""
    points = lambda r: F.coalesce(F.when(r["backs"], r["points"]) if backed else r["points"], F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(F.aggregate(reasons, F.lit(0), lambda a, r: a + points(r)), F.lit(0))))


def judge(df: DataFrame, reasons: str = "reasons", stopped: str = "stopped") -> DataFrame:
    """Adds rule_score, backing, score (with floors), verdict."""
    listing = F.coalesce(F.array_max(F.transform(F.filter(reasons, lambda r: r["area"] == "blacklist"), lambda r: r["points"])), F.lit(0))
    rule = total(F.col(reasons))
    floor = F.greatest(F.when(F.col(stopped) == "blocked", SAFE_MAX + 10).otherwise(0), F.when(listing >= 60, SUSPICIOUS_MAX + 1).when(listing >= 30, SAFE_MAX + 1).otherwise(0))
    score = F.greatest(rule, floor)
    return df.withColumn("rule_score", rule).withColumn("backing", total(F.col(reasons), backed=True)).withColumn("score", score).withColumn("verdict", F.when(score <= SAFE_MAX, "safe").when(score <= SUSPICIOUS_MAX, "suspicious").otherwise("dangerous"))


def own_score(reasons: Column | str = "reasons") -> Column:
    return total(F.filter(reasons, lambda r: ~F.coalesce(r["area"] == "blacklist", F.lit(False))))


FOUND = "array<struct<text:string,points:int,area:string>>"
#: A stored scan document, as far as comparisons read it. Parts of which only the number counts stay JSON text.
SCAN = (
    f"id string, created_at string, analysis struct<score:int,verdict:string,summary:string,scam_type:string,partial:boolean,reasons:{FOUND},good_signs:{FOUND},model:struct<probability:double>,link:struct<unicode_host:string,lookalike:string>>, "
    "visit struct<final_url:string,title:string,stopped:string,notes:array<string>,hops:array<string>,blocked:array<string>,downloads:array<string>,bot_check:string>, "
    "recon struct<registration:struct<registrar:string,created:string,age_days:int>,server:struct<country:string,as_org:string,abuse_email:string>,cert_history:struct<first_seen:string,cert_count:int>>, "
    "blacklists struct<sources:array<struct<id:string,name:string,status:string,note:string>>>, "
    "family struct<status:string,note:string,copied_site:string,library_size:long,family:struct<label:string>>, "
    "siblings struct<same_server:struct<total:long>,same_owner:struct<total:long>,same_design:struct<total:long>,lookalikes:struct<total:long>>"
)


def comparison(scans: DataFrame, key: str, document: str = "document") -> DataFrame:
    """key and the 39 fields that a comparison of scans shows, from each scan's JSON document.

    A missing part is null; lists that are missing are empty, counts 0. A document that is null or no JSON reads as one without parts.
    """
    d = F.col("d")
    found = lambda path: F.coalesce(d[path[0]][path[1]], F.from_json(F.lit("[]"), FOUND))
    texts = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    analysis, visit, recon, family = d["analysis"], d["visit"], d["recon"], d["family"]
    reasons, good = found(("analysis", "reasons")), found(("analysis", "good_signs"))
    fields = {
        "id": d["id"], "scanned_at": d["created_at"], "score": analysis["score"], "own_score": own_score(F.concat(reasons, good)), "verdict": analysis["verdict"], "summary": analysis["summary"], "scam_type": analysis["scam_type"], "partial": analysis["partial"],
        "reasons": reasons, "good_signs": good, "model": analysis["model"]["probability"], "unicode_host": analysis["link"]["unicode_host"], "lookalike": analysis["link"]["lookalike"],
        "final_url": visit["final_url"], "title": visit["title"], "stopped": visit["stopped"], "notes": texts(visit["notes"]), "hops": F.size(texts(visit["hops"])), "blocked": texts(visit["blocked"]), "downloads": F.size(texts(visit["downloads"])), "bot_check": visit["bot_check"],
        "registrar": recon["registration"]["registrar"], "created": recon["registration"]["created"], "age_days": recon["registration"]["age_days"], "country": recon["server"]["country"], "network": recon["server"]["as_org"], "abuse_email": recon["server"]["abuse_email"],
        "certs_first_seen": recon["cert_history"]["first_seen"], "cert_count": recon["cert_history"]["cert_count"], "lists": F.coalesce(d["blacklists"]["sources"], F.from_json(F.lit("[]"), "array<struct<id:string,name:string,status:string,note:string>>")),
        "family_status": family["status"], "family_note": family["note"], "copied_site": family["copied_site"], "library_size": family["library_size"], "family_name": family["family"]["label"],
    } | {k: F.coalesce(d["siblings"][k]["total"], F.lit(0)) for k in ("same_server", "same_owner", "same_design", "lookalikes")}
    return scans.select(key, F.from_json(F.col(document).cast("string"), SCAN).alias("d")).select(key, *[c.alias(n) for n, c in fields.items()])


def ordered(reasons: str = "reasons") -> Column:
    """Risks by points, most first, then good signs, strongest first; ties by text."""
    by = F.transform(reasons, lambda r: F.struct((r["points"] < 0).alias("good"), (-F.abs(r["points"])).alias("p"), r["text"].alias("text"), r["points"].alias("points")))
    return F.transform(F.array_sort(by), lambda r: F.struct(r["text"].alias("text"), r["points"].alias("points")))


def scam_type() -> Column:
    """The first type with the most evidence, null under 3 points. From asks, phrases (map of counts), categories, wallets, phones, form_away, downloads, programs, impersonated."""
    c = F.col
    asks = lambda *k: F.arrays_overlap("asks", F.array(*[F.lit(x) for x in k]))
    said = lambda k: F.coalesce(F.element_at("phrases", k), F.lit(0))
    kind = lambda *k: F.arrays_overlap("categories", F.array(*[F.lit(x) for x in k]))
    p = lambda cond, n: F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)
    money = kind("bank", "payment")
    points = {
        "banking": p(money, 3) + p(asks("netbanking", "otp", "upi_pin", "atm_pin", "card", "cvv", "bank_account"), 2) + p((said("urgency") > 0) & money, 1),
        "credentials": p(asks("password"), 2) + p((F.size("categories") > 0) & ~kind("bank", "payment", "crypto", "government"), 2) + p(c("form_away") & asks("password"), 1),
        "crypto": p(asks("seed_phrase"), 4) + p(F.size("wallets") > 0, 2) + p(said("crypto") >= 2, 2) + p(kind("crypto"), 2),
        "prize": F.when(said("prize") >= 2, 3).when(said("prize") > 0, 1).otherwise(0) + p((said("prize") > 0) & asks("card", "cvv", "bank_account", "upi_pin"), 1),
        "shop": p(said("shopping") >= 2, 2) + p((said("shopping") > 0) & asks("card", "cvv"), 1) + p(kind("shopping"), 2),
        "tech_support": p(said("tech_support") >= 2, 3) + p((said("tech_support") > 0) & (c("phones") > 0), 1),
        "malware": p(c("downloads") > 0, 4) + p(c("programs") > 0, 2) + p(said("download") > 0, 1),
        "job": p(said("job") >= 2, 3),
        "government": p(kind("government"), 3) + p(said("government") > 0, 2) + p((said("government") > 0) & asks("card", "cvv", "upi_pin", "bank_account", "aadhaar", "pan"), 1),
    }
    best = F.array_max(F.array(*[F.struct(v.alias("points"), F.lit(-i).alias("turn"), F.lit(k).alias("type")) for i, (k, v) in enumerate(points.items())]))
    return F.when(best["points"] >= 3, best["type"])


#: What a type of scam is called, and what is said of one without a brand.
TYPE_NOUNS = {
    "banking": "banking page", "credentials": "login page", "crypto": "crypto wallet page", "prize": "prize or lottery scam", "shop": "online shop",
    "tech_support": "tech support page", "malware": "download that may be malware", "job": "job or task offer", "government": "government notice",
}
TYPE_SAID = {
    "banking": "This looks like a fake banking page that steals account details.", "credentials": "This looks like a fake login page that steals passwords.",
    "crypto": "This looks like a crypto scam that tries to take your wallet.", "prize": "This looks like a fake prize or lottery scam.", "shop": "This looks like a fake online shop.",
    "tech_support": "This looks like a tech support scam.", "malware": "This link tries to get you to download something that may be malware.",
    "job": "This looks like a job or task scam.", "government": "This looks like a fake government notice.",
}
#: Types in whose sentence the brand's name is used by a page, not the page's own.
NAME_USED = ("prize", "job", "malware", "tech_support")


def summary(verdict: Column, kind: Column, brand: Column, official: Column, rank: Column, stopped: Column, listed_by: Column, partial: Column, small_signs: Column) -> Column:
    """One sentence on a judged scan: a private address, lists without a type, the type and brand, strong or some signs, else what a safe page is.

    kind and brand: of the judged scam type, null if there is none; official: whose own site it is; listed_by: names of lists that
    list it; partial: the page could not be read; small_signs: a safe page with findings. Null flags count as false.
    """
    flag = lambda c: F.coalesce(c, F.lit(False))
    safe, lists = verdict == "safe", F.coalesce(listed_by, F.array().cast("array<string>"))
    noun = lookup(TYPE_NOUNS, kind)
    article = F.when(F.substring(noun, 1, 1).isin(*"aeiou"), "an").otherwise("a")
    branded = F.when(kind.isin(*NAME_USED), F.concat(F.lit("This looks like "), article, F.lit(" "), noun, F.lit(" using "), brand, F.lit("'s name."))).otherwise(F.concat(F.lit("This looks like a fake "), brand, F.lit(" "), noun, F.lit(".")))
    found = F.when(flag(small_signs), "Only small warning signs found").otherwise("No warning signs found")
    calm = (
        F.when(official.isNotNull(), F.concat(F.lit("This looks like the real website of "), official, F.lit(". "), found, F.lit(".")))
        .when(rank.isNotNull(), F.concat(F.lit("A well-known site with "), F.when(flag(small_signs), "only small").otherwise("no"), F.lit(" warning signs found.")))
        .when(flag(partial) & flag(small_signs), "Only small warning signs found, but the page itself couldn't be checked.")
        .when(flag(partial), "No warning signs in the link, but the page itself couldn't be checked.")
        .otherwise(F.concat(found, F.lit(". That doesn't guarantee it's safe, so stay careful.")))
    )
    return (
        F.when(stopped == "blocked", "This link leads to a private address, which real websites never do. Don't trust it.")
        .when((F.size(lists) > 0) & ~safe & kind.isNull(), F.concat(F.array_join(F.slice(lists, 1, 2), " and "), F.when(F.size(lists) == 1, " lists").otherwise(" list"), F.lit(" this link as unsafe. Don't open it.")))
        .when(~safe & kind.isNotNull() & brand.isNotNull(), branded)
        .when(~safe & kind.isNotNull(), F.coalesce(lookup(TYPE_SAID, kind), F.lit("This link shows several warning signs.")))
        .when(verdict == "dangerous", "Several strong warning signs. Treat this link as dangerous.")
        .when(~safe, F.concat(F.lit("Some warning signs. Be careful with this link."), F.when(flag(partial), " The page itself couldn't be checked.").otherwise("")))
        .otherwise(calm)
    )


def ledger(df: DataFrame, key: str, reasons: str = "reasons") -> DataFrame:
    """key, line, points: three strongest own findings, the rest of them, lists, good signs, and what a floor added."""
    r = df.select(key, "score", F.posexplode(reasons).alias("i", "r")).select(key, "score", "i", "r.*")
    from pyspark.sql import Window as W

    own = r.where("area <> 'blacklist' and points > 0").withColumn("n", F.row_number().over(W.partitionBy(key).orderBy(F.desc("points"), "i")))
    lines = own.select(key, F.when(F.col("n") <= 3, F.concat(F.lit("finding "), F.col("n").cast("string"))).otherwise("other findings").alias("line"), "points").unionByName(r.where("area = 'blacklist'").select(key, F.lit("lists").alias("line"), "points")).unionByName(r.where("points < 0").select(key, F.lit("good signs").alias("line"), "points"))
    raised = df.select(key, F.lit("raised").alias("line"), (F.col("score") - total(F.col(reasons))).alias("points")).where("points > 0")
    return lines.unionByName(raised).groupBy(key, "line").agg(F.sum("points").alias("points"))
