"""Quality rules as learned decision lists, with DataFrame operations only.

Sequential covering: grow a conjunction of thresholds by the gain of its labelled counts, prune it on rows that did not
grow it, keep it if it is sure enough, leave what it covers, repeat. The list becomes one ordered Spark condition.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.session import cut

SPACES = r"[\x20\x09-\x0D]+"
SOLID = r"[^\x20\x09-\x0D]"
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: What rules may test; all but the first are shares.
FEATURES = ("n_words", "symbol_share", "mean_word", "dup_line_share", "repeat_share", "upper_share", "digit_share", "bang_share", "bar_share", "stop_share")


def _without(body: Column, chars: str) -> Column:
    return F.length(F.translate(body, chars, ""))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, counts of the whole text, FEATURES), one row per row of docs; nothing is moved.

    n_repeat_words: words inside 5-word windows that occur twice or more. Windows are compared by 64-bit hashes; texts in
    which all differ end there, in the others equal hashes are found by sorting (hash, place).
    Null text: as empty, all counts 0 and all shares 0.
    """
    body = docs.select(F.col("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    words = body.withColumn("words", F.filter(F.split("body", SPACES), lambda w: w != ""))
    lines = F.filter(F.split("body", "\n"), lambda x: x.rlike(SOLID))
    counted = words.select(
        "doc_id",
        "words",
        F.size("words").cast("long").alias("n_words"),
        _without(F.col("body"), WHITE).cast("long").alias("word_chars"),
        (F.length("body") - _without(F.col("body"), SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.regexp_count("body", F.lit(r"\p{Lu}")).alias("n_upper"),
        (F.length("body") - _without(F.col("body"), "0123456789")).alias("n_digits"),
        (F.length("body") - _without(F.col("body"), "!")).alias("n_bangs"),
        (F.length("body") - _without(F.col("body"), "|")).alias("n_bars"),
        (F.length("body") - _without(F.col("body"), ".,;:?")).alias("n_stops"),
    )
    at = lambda i, k: F.get("words", i + k)
    windows = F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)])))
    hashed = counted.withColumn("windows", windows).withColumn("n_lines", F.size("lines")).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("words", "lines")
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = hashed.withColumn("sorted", F.when(some, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("windows")
    twice = F.transform("sorted", lambda x, j: F.when((x["h"] == F.get("sorted", j - 1)["h"]) | (x["h"] == F.get("sorted", j + 1)["h"]), x["i"]))
    starts = placed.withColumn("starts", F.sort_array(F.filter(twice, lambda x: x.isNotNull()))).drop("sorted")
    covers = F.aggregate(F.transform("starts", lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", j + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)
    n = starts.withColumn("n_repeat_words", F.coalesce(covers, F.lit(0)).cast("long"))
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return n.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("n_symbols", "word_chars").alias("symbol_share"), share("word_chars", "n_words").alias("mean_word"), share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"), share("n_upper", "word_chars").alias("upper_share"), share("n_digits", "word_chars").alias("digit_share"),
        share("n_bangs", "n_words").alias("bang_share"), share("n_bars", "n_words").alias("bar_share"), share("n_stops", "n_words").alias("stop_share"),
    )


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    bound: float

    def column(self) -> Column:
        return F.col(self.feature) > self.bound if self.above else F.col(self.feature) <= self.bound

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.bound:.6g}"


Rule = tuple[Test, ...]


def _all(rule: Rule) -> Column:
    out = F.lit(True)
    for test in rule:
        out = out & test.column()
    return out


def learn(labelled: DataFrame, steps: int = 40, max_rules: int = 8, max_tests: int = 3, sure: float = 0.95, least: int = 5) -> list[Rule]:
    """Rules for bad rows, in order. labelled: doc_id, FEATURES, bad (boolean); every labelled row is counted.

    Two thirds of the rows (by crc32 of the id) grow rules, one third prunes them. A rule stays if at least `sure` of
    the pruning rows that it covers are bad and it covers `least` rows of either part. What comes to the driver are
    counts by feature and step: 10 features, `steps` steps, two classes, whatever the input. No bad row: no rule.
    """
    marked = labelled.where("bad is not null").withColumn("prune", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 0)
    grid = [i / steps for i in range(1, steps)]
    found = marked.agg(*[F.percentile_approx(f, grid, 10_000).alias(f) for f in FEATURES], *[F.percentile_approx(F.when(F.col("bad"), F.col(f)), grid, 10_000).alias(f + "_bad") for f in FEATURES]).first()
    bounds = {f: sorted({float(x) for x in [*(found[f] or []), *(found[f + "_bad"] or [])]}) for f in FEATURES}
    place = lambda f: F.size(F.filter(F.array(*[F.lit(b) for b in bounds[f]]), lambda b: F.col(f) > b)) if bounds[f] else F.lit(0)
    rows = cut(marked.select("bad", "prune", *FEATURES, F.array(*[place(f) for f in FEATURES]).alias("steps")), "labelled")
    rules: list[Rule] = []
    while len(rules) < max_rules:
        left = rows
        for rule in rules:
            left = left.where(~_all(rule))
        rule: Rule = ()
        while len(rule) < max_tests:
            counts = left.where(~F.col("prune")).where(_all(rule)).select("bad", F.posexplode("steps").alias("f", "s")).groupBy("f", "s").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
            if (test := _best(counts, bounds)) is None:
                break
            rule += (test,)
        if not rule:
            break
        ends = range(1, len(rule) + 1)
        sums = left.agg(*[F.count_if(_all(rule[:k]) & (F.col("bad") if bad else ~F.col("bad")) & (F.col("prune") if prune else ~F.col("prune"))) for k in ends for bad in (True, False) for prune in (True, False)]).first()
        scored = []
        for k in ends:
            p_prune, p_grow, n_prune, n_grow = sums[4 * (k - 1) : 4 * k]
            if p_prune + p_grow >= least and p_prune >= sure * (p_prune + n_prune) and p_grow >= sure * (p_grow + n_grow):
                scored.append(((p_prune + 1 - n_prune) / (p_prune + n_prune + 2), -k, p_prune + p_grow))
        if not scored:
            break
        rules.append(rule[: -max(scored)[1]])
    return rules


def _best(counts: list, bounds: dict[str, list[float]]) -> Test | None:
    """The threshold with the highest gain of bad rows over all; None if there is nothing left to gain."""
    by: dict[int, dict[int, tuple[int, int]]] = {}
    for r in counts:
        by.setdefault(r.f, {})[r.s] = (r.p, r.n)
    best: tuple[float, Test] | None = None
    for f, name in enumerate(FEATURES):
        cells = by.get(f, {})
        P, N = sum(p for p, _ in cells.values()), sum(n for _, n in cells.values())
        if not P or not N:
            return None
        before, p, n = math.log2(P / (P + N)), 0, 0
        for s, bound in enumerate(bounds[name]):
            p, n = p + cells.get(s, (0, 0))[0], n + cells.get(s, (0, 0))[1]
            for above, (a, b) in ((False, (p, n)), (True, (P - p, N - n))):
                if a and (gain := a * (math.log2(a / (a + b)) - before)) > 1e-9 and (best is None or gain > best[0]):
                    best = (gain, Test(name, above, bound))
    return best[1] if best else None


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """(kept, rule): the ordered conditions; rule: number of the one that decided, from 1, 0 where none did."""
    kept, which = F.when(F.lit(False), True), F.when(F.lit(False), 0)
    for i, rule in enumerate(rules, 1):
        kept, which = kept.when(_all(rule), False), which.when(_all(rule), i)
    return kept.otherwise(True), which.otherwise(0)


def describe(rules: list[Rule]) -> list[str]:
    return [" and ".join(map(str, rule)) for rule in rules]


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", **how) -> DataFrame:
    """(doc_id, counts, base_failed, kept, rule, FEATURES) of every row of docs; rules are learnt from labels (doc_id, quality).

    base_failed: under 10 words, or over 20 in 100 of them in repeated windows. kept: not base_failed and no rule covers
    the row. Several labels of a document: the best counts; null labels and null ids count for nothing. No labels or no
    bad ones: only the base decides. Repeated rows: each is judged. Very long texts: one row in memory with its windows'
    hashes, 8 bytes a word. A value equal to a threshold is not above it; of thresholds with equal gain the first by feature, then the
    lowest, stands. Empty table: no rows.
    """
    rows = cut(statistics(docs, text), "statistics")
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg((F.max("quality") == 0).alias("bad"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rules = learn(rows.where(~failed).join(marks, "doc_id"), **how)
    kept, which = verdict(rules)
    shares = [f for f in FEATURES if f != "n_words"]
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & kept).alias("kept"), which.cast("int").alias("rule"), *shares)
