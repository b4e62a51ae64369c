"""What others say of links: edges that the given tables lack."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.functions import links as L
from linkloom.operators import answers as A


def test_noise(spark):
    rows = [
        ("https://l.facebook.com/l.php?u=x", "facebook.com", None, None, True), ("https://m.vk.com/away.php?to=x", "vk.com", None, None, True), ("https://vk.com/feed", "vk.com", None, 5, False),
        ("https://www.bank.com/", "bank.com", "Bank", None, True), ("https://bank.com", "bank.com", "Bank", None, True), ("https://bank.com/?a=1", "bank.com", "Bank", None, False), ("https://login.bank.com/", "bank.com", "Bank", None, False),
        ("https://big.org/", "big.org", None, 10_000, True), ("https://big.org/", "big.org", None, 10_001, False), ("https://1.2.3.4/", None, None, None, False), (None, None, None, None, False),
    ]
    df = spark.createDataFrame(rows, "url string, site string, official string, rank int, want boolean")
    got = df.select("url", "want", A.noise(F.col("url"), L.host(F.col("url")), F.col("site"), F.col("official"), F.col("rank")).alias("noise")).collect()
    assert all(r.noise == r.want for r in got), got


def test_links_to_check(spark):
    hops = [("a", i, f"https://x.com/{i}", None) for i in range(12)] + [("a", 12, "https://x.com/0", False), ("b", 0, "https://x.com/?token=s3cr3t", False), ("b", 1, "http://10.0.0.1/", True), ("b", 2, "mailto:x", False), ("b", 3, None, False), (None, 0, "https://n.com/", None), ("c", 0, "ftp://x", None)]
    got = {}
    for r in A.links_to_check(spark.createDataFrame(hops, "scan string, pos int, url string, blocked boolean")).collect():
        got.setdefault(r.scan, []).append((r.n, r.url))
    assert sorted(got["a"]) == [(i + 1, f"https://x.com/{i}") for i in range(7)] + [(8, "https://x.com/11")]
    assert got["b"] == [(1, "https://x.com/?token=REDACTED")] and got[None] == [(1, "https://n.com/")] and "c" not in got


def test_answers(spark):
    vendors = [("a", 0, "u0", True, 3, 0), ("a", 1, "u1", True, 3, 0), ("b", 0, "u0", True, 2, 0), ("c", 0, "u0", True, 0, 1), ("d", 0, "u0", True, 0, 0), ("e", 0, "u0", False, 9, 9), ("f", 0, "u0", None, 9, 9)]
    malware = [("a", 1, "host", "h", 4, 0), ("a", 2, "url", "u2", 1, 0), ("b", 0, "host", "h", 4, 0), ("b", 1, "host", "g", 4, 2), ("c", 0, "url", "u", 0, 0)]
    scans = [("a", 5, 1), ("b", 5, 0), ("c", 0, 0)]
    found = A.answers(
        spark.createDataFrame(vendors, "scan string, pos int, url string, known boolean, malicious long, suspicious long"), spark.createDataFrame(malware, "scan string, pos int, kind string, key string, hits long, live long"), spark.createDataFrame(scans, "scan string, total long, malicious long")
    )
    got = {(r.scan, r.source): (r.status, r.matched) for r in found.collect()}
    assert [got[s, "virustotal"] for s in "abcdef"] == [("listed", "u0"), ("info", None), ("info", None), ("clean", None), ("unknown", None), ("unknown", None)]
    assert [got[s, "urlhaus"] for s in "abc"] == [("listed", "u2"), ("info", None), ("clean", None)]
    assert [got[s, "urlscan"][0] for s in "abc"] == ["listed", "info", "unknown"]
    assert {r.scan: r.listed_by for r in A.listed_by(found).collect()}["a"] == ["virustotal", "urlhaus", "urlscan"]


def test_reports_connections_and_names(spark):
    results = [("l", "B", "malicious", "x"), ("l", "a", "suspicious", None), ("l", "C", "harmless", None), ("l", "aa", "malicious", "y"), ("l", "aa", "malicious", "y"), ("m", "B", None, None)]
    got = {r.link: r for r in A.vendor_reports(spark.createDataFrame(results, "link string, engine string, category string, label string"), spark.createDataFrame([("l", "shop"), ("l", "shop"), ("l", None)], "link string, category string")).collect()}
    assert [(f.engine, f.category) for f in got["l"].flagged] == [("aa", "malicious"), ("B", "malicious"), ("a", "suspicious")]
    assert (got["l"].engines, got["l"].malicious, got["l"].categories, got["m"].engines, got["m"].categories) == (4, 2, ["shop"], 1, [])
    log = [("v", 0, "h", 80, None, True, None), ("v", 1, "h", 80, "1.1.1.1", True, None), ("v", 2, "p", 81, None, False, None), ("v", 3, "p", 81, None, False, "late"), ("v", 4, "p", 82, None, False, "x")]
    reached, shut = A.connections(spark.createDataFrame(log, "visit string, seq int, host string, port int, ip string, allowed boolean, reason string"))
    assert [(r.host, r.ip) for r in reached.collect()] == [("h", "1.1.1.1")] and sorted((r.pos, r.port, r.reason) for r in shut.collect()) == [(2, 81, "blocked"), (4, 82, "x")]
    known = spark.createDataFrame([(1, "PayPal", ["paypal", "pp"]), (2, "PP", None)], "ord int, name string, labels array<string>")
    names = spark.createDataFrame([("paypal",), (" pp ",), ("N/A",), ("acme bank",), ("eBay",), (None,)], "raw string")
    assert {r.raw: r.brand for r in A.display_brand(names, known).collect()} == {"paypal": "PayPal", " pp ": "PayPal", "N/A": None, "acme bank": "Acme bank", "eBay": "eBay", None: None}
