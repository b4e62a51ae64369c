"""Imitated names against a comparison of every label with every brand label."""

from __future__ import annotations

import random
import re

from linkloom.functions import links as L
from linkloom.operators import links


def slips(a: str, b: str) -> int:
    """Edits and swaps of neighbours, in any order (Damerau)."""
    far, last = len(a) + len(b), {}
    d = {(-1, -1): far}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = far, j
    for i in range(1, len(a) + 1):
        met = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), met
            if a[i - 1] == b[j - 1]:
                met = j
            d[i, j] = min(d[i - 1, j - 1] + (a[i - 1] != b[j - 1]), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def plain(rows, brands, skeleton):
    out = {}
    for host, label, sub in rows:
        best = None
        for ord_, name, forms in brands:
            for pos, b in enumerate(forms):
                far = 2 if len(b) >= 9 else 1 if len(b) >= 6 else 0
                parts = [p for p in (sub or "").lower().split(".") if p]
                if label != b and skeleton[label] == b:
                    kind = (0, "homograph" if re.search(r"[^\x00-\x7f]", label) else "typo")
                elif far and label != b and slips(label, b) <= far:
                    kind = (1, "typo")
                elif label != b and (b in re.split("[-_.0-9]+", label.lower()) or (len(b) >= 5 and b in label)):
                    kind = (1, "combo")
                elif b in parts or any(p.startswith(b + "-") for p in parts):
                    kind = (1, "subdomain")
                else:
                    continue
                row = (kind[0], ord_, pos, name, kind[1])
                best = min(best or row, row)
        if best:
            out[host] = best[3:]
    return out


def test_same_rows_as_every_label_with_every_brand(spark):
    draw = random.Random(2)
    word = lambda n: "".join(draw.choice("abceo1") for _ in range(n))
    brands = [(i, f"B{i}", list(dict.fromkeys(word(draw.choice([3, 5, 6, 7, 9, 11])) for _ in range(draw.randrange(1, 3))))) for i in range(40)]
    names = [b for _, _, forms in brands for b in forms]
    rows = []
    for i in range(600):
        b, k = draw.choice(names), draw.randrange(9)
        label = list(b)
        for _ in range(k if k < 4 else 0):
            at = draw.randrange(len(label)) if label else 0
            act = draw.randrange(4)
            if act == 0 and label:
                label.pop(at)
            elif act == 1:
                label.insert(at, draw.choice("abcz"))
            elif act == 2 and label:
                label[at] = draw.choice("abcz")
            elif at + 1 < len(label):
                label[at], label[at + 1] = label[at + 1], label[at]
        label = "".join(label)
        label = {4: f"my-{b}-login", 5: f"x{b}y", 6: b.replace("o", "0").replace("e", "3"), 7: word(8), 8: b}.get(k, label)
        sub = draw.choice(["", "www", b, f"{b}-secure.www", f"a.{b}.c", f"x{b}", None])
        rows.append((f"h{i}", label, sub))
    rows.append(("none", None, "x"))
    table = spark.createDataFrame(rows, "host string, label string, subdomain string")
    skeleton = {r.label: r.s for r in table.select("label", L.skeleton(table.label).alias("s")).collect()}
    found = links.imitations(table, spark.createDataFrame(brands, "ord int, name string, labels array<string>"))
    got = {r.host: (r.brand, r.kind) for r in found.collect()}
    want = plain([r for r in rows if r[1]], brands, skeleton)
    assert got == want and len(want) > 200
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
