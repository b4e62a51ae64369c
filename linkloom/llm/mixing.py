"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

The rates r of documents minimise sum(r ln r - r + 1) under one token constraint for each source,
sum(size * r) = target, and 0 <= r <= most. The dual is convex with one multiplier a source; its Newton steps need the
tilted token totals and their slopes, which Spark sums up. The rates min(most, exp(multiplier * size)) are then rounded
into copies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.operators.ranking import ranked, running
from linkloom.session import cut

WORD = r"[^\x20\x09-\x0D]+"
SALTS = 64
PRE = "__mix_"


def size(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def named(source: str = "source") -> Column:
    """The source as a key that is never null and sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), F.col(source).cast("string")), F.lit("1"))


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Adds `target` to (source, source_size): the share of all sizes by repeating weights, `most` times the size at most.

    Sources (as `named` makes them; a table of one row each) are numbered by code point, null last. What is above a
    source's limit is shared again by weight among the others until none is above: with sources sorted by limit over
    weight, those up to some place are full and the rest take one common level, which running sums find without a loop.
    Numbers and sums run over range partitions, so any number of sources will do; two numbers come to the driver.
    """
    nth = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("k") - 1) % len(weights) + 1).cast("int"))
    weighed = ranked(sources, [], ["source"], "k").select("source", "source_size", nth.alias("w"))
    # A source without words has limit 0 and so is full from the start.
    rising = weighed.withColumn("limit", F.col("source_size") * F.lit(float(most))).withColumn("level", F.col("limit") / F.col("w"))
    summed = cut(running(rising, ["level", "source"], {"full": "limit", "before": "w"}), "levels")
    size, all_w = summed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    common = (F.lit(float(size) * share) - F.col("full")) / (F.lit(all_w) - F.col("before"))
    stop = summed.withColumn("common", common).where(F.col("common") * F.col("w") <= F.col("limit")).agg(F.min(F.struct("full", "common"))).first()[0]
    target = F.col("limit") if stop is None else F.least("limit", F.lit(stop.common) * F.col("w"))
    return summed.select("source", "source_size", target.alias("target"))


def rate(most: float) -> Column:
    """The rate of a document from its size and its source's multiplier; null multiplier: the source is taken `most` times."""
    tilted = F.least(F.lit(float(most)), F.exp(F.col("m") * F.col("size")))
    return F.when(F.col("target") <= 0, F.lit(0.0)).otherwise(F.coalesce(tilted, F.lit(float(most))))


def balance(cells: DataFrame, goal: DataFrame, most: float = 2.0, tolerance: float = 1e-9, max_steps: int = 60) -> DataFrame:
    """(source, source_size, target, m): the multipliers by Newton's iterations on the dual.

    cells: (source, size, n). Every step sums by source over the cells, map-side first, the tilted sizes and the slope of
    that total, and moves each multiplier by the step on the total's logarithm. The root lies between 0 and what
    the smallest document alone would need; a step that would leave what is known to hold the root goes to its middle.
    It stops when no source is off by more than the tolerance, or its bracket has closed.
    A source whose target is `most` times its size has no finite multiplier: null. One without words gets 0.
    """
    goal = goal.join(cells.where("size > 0").groupBy("source").agg(F.min("size").alias("least")), "source", "left")
    ratio = F.try_divide("target", F.col("source_size").cast("double"))
    full = (F.col("target") > 0) & (ratio >= most * (1 - 1e-12))
    end = F.when(ratio > 1, F.lit(math.log(most))).otherwise(F.log(ratio)) / F.col("least")
    settled = F.coalesce((F.col("target") <= 0) | (F.col("source_size") <= 0) | full, F.lit(True))
    state = goal.select("source", "source_size", "target", F.when(full, None).otherwise(0.0).alias("m"), F.least(F.lit(0.0), end).alias("low"), F.greatest(F.lit(0.0), end).alias("high"), settled.alias("done"))
    state = cut(state, "dual")
    for _ in range(max_steps):
        if state.where("not done").isEmpty():
            break
        open_ = state.where("not done").select("source", "m")
        r = F.exp(F.col("m") * F.col("size"))
        slope = F.when(r < most, F.col("n") * F.col("size") * F.col("size") * r).otherwise(F.lit(0.0))
        sums = cells.join(open_, "source").groupBy("source").agg(F.sum(F.col("n") * F.col("size") * F.least(r, F.lit(float(most)))).alias("total"), F.sum(slope).alias("slope"))
        moved = state.join(sums, "source", "left")
        above = F.col("total") > F.col("target")
        low, high = F.when(above, F.col("low")).otherwise(F.col("m")), F.when(above, F.col("m")).otherwise(F.col("high"))
        newton = F.col("m") - F.log(F.col("total") / F.col("target")) * F.try_divide("total", "slope")
        inside = F.coalesce((newton > F.col("lo")) & (newton < F.col("hi")), F.lit(False))
        near = (F.abs(F.col("total") / F.col("target") - 1) <= tolerance) | (F.col("hi") - F.col("lo") <= F.abs("m") * 1e-14)
        moved = moved.withColumn("lo", low).withColumn("hi", high).withColumn("next", F.when(near, F.col("m")).when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2))
        keep = lambda old, new: F.when(F.col("done"), F.col(old)).otherwise(new).alias(old)
        state = cut(moved.select("source", "source_size", "target", keep("m", F.col("next")), keep("low", F.col("lo")), keep("high", F.col("hi")), (F.col("done") | near).alias("done")), "dual")
    # Rounded, so that the order in which Spark adds cannot show.
    return state.select("source", "source_size", "target", F.bround("m", 13).alias("m"))


def plan_copies(cells: DataFrame, rates: DataFrame, rounds: int | None = None) -> DataFrame:
    """(source, size, n, total): how many copies the documents of each cell get together; rates: source, m, target.

    Rounding is cumulative over the sizes of a source, longest first, so errors don't add up. What is left at the end
    (half a long document at most) is then made up, pass by pass: the cells that fit, longest first, together give or
    take all their room up to a running sum of what is left, and the first cell beyond that as many copies as fit.
    Passes go on until no cell fits, or for `rounds`. A cell of n documents keeps between 0 and 2n copies, so no
    document exceeds two.
    """
    joined = cells.join(rates.select("source", "m", "target"), "source").withColumn("rate", rate(2.0))
    down = W.partitionBy("source").orderBy(F.desc("size"))
    wish = F.col("n") * F.col("rate")
    part = wish - F.floor(wish + 1e-9)
    up_to = F.sum(F.greatest(part, F.lit(0.0))).over(down.rowsBetween(W.unboundedPreceding, 0))
    before = F.coalesce(F.sum(F.greatest(part, F.lit(0.0))).over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    state = cut(joined.select("source", "size", "n", "target", F.least(F.col("n") * 2, F.floor(wish + 1e-9) + F.floor(up_to + 0.5) - F.floor(before + 0.5)).cast("long").alias("total")), "cells")
    done = 0
    while rounds is None or done < rounds:
        done += 1
        # "away" is what the source still lacks (or has too much, below 0); each pass that moves anything makes it smaller.
        have = state.groupBy("source").agg((F.max("target") - F.sum(F.col("total") * F.col("size"))).alias("away"))
        room = F.when(F.col("away") > 0, F.col("n") * 2 - F.col("total")).otherwise(F.col("total"))
        fits = state.join(have, "source").where("size > 0 and abs(away) >= size").withColumn("room", room).where("room > 0")
        earlier = F.coalesce(F.sum(F.col("room") * F.col("size")).over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        moves = F.least(F.col("room"), F.floor((F.abs("away") - earlier) / F.col("size")))
        moved = fits.withColumn("most", moves).where("most > 0").select("source", "size", (F.signum("away") * F.col("most")).cast("long").alias("moves"))
        moved = cut(moved, "moves")
        if moved.isEmpty():
            break
        state = cut(state.join(moved, ["source", "size"], "left").select("source", "size", "n", "target", (F.col("total") + F.coalesce("moves", F.lit(0))).alias("total")), "cells")
    return state.select("source", "size", "n", "total")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, text: str = "text", source: str = "source") -> DataFrame:
    """Adds (size, source_size, target, rate, copies, taken) to every row, under the prefix __mix_; all columns are kept.

    copies: how often the mix takes the document, 0 to 2; taken = copies * size. Documents of one source and size are
    interchangeable; which of them get the odd copies is settled by a hash of id and text, so reruns agree. Their ranks
    come from counts by salt and ranks inside each salt: a size that a third of all documents share is dealt to 64 tasks.
    Null text: size 0, copied at its source's rate, takes no words. Null source: a source of its own, the last one.
    Repeated rows count each. Ties by hash hold equal rows. Empty table: no rows. `most` must be 2 or less.
    """
    own = docs.withColumn(PRE + "source", named(source)).withColumn(PRE + "size", size(text))
    narrow = own.select(F.col(PRE + "source").alias("source"), F.col(PRE + "size").alias("size"))
    cells = cut(narrow.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    goal = cut(targets(cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).cast("long").alias("source_size")), weights, share, most), "targets")
    rates = balance(cells, goal, most)
    copies = plan_copies(cells, rates)
    plan = copies.join(rates, "source").withColumn("rate", F.bround(rate(most), 9)).drop("m")
    plan = cut(plan.select(*[F.col(c).alias(PRE + "p_" + c) for c in plan.columns]), "plan")
    h = F.xxhash64(F.col("doc_id").cast("string"), F.col(text).cast("string"))
    salted = own.withColumn(PRE + "h", h).withColumn(PRE + "salt", F.pmod(F.col(PRE + "h"), F.lit(SALTS)).cast("int"))
    keys = [PRE + "source", PRE + "size"]
    by_salt = salted.groupBy(*keys, PRE + "salt").agg(F.count("*").alias(PRE + "n"))
    earlier = by_salt.select(
        *keys,
        PRE + "salt",
        F.coalesce(F.sum(PRE + "n").over(W.partitionBy(*keys).orderBy(PRE + "salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(PRE + "earlier"),
    )
    offsets = earlier.join(plan.withColumnsRenamed({PRE + "p_source": keys[0], PRE + "p_size": keys[1]}), keys)
    inner = salted.withColumn(PRE + "rank", F.row_number().over(W.partitionBy(*keys, PRE + "salt").orderBy(PRE + "h", "doc_id")))
    out = inner.join(offsets, [*keys, PRE + "salt"])
    base, odd = F.floor(F.col(PRE + "p_total") / F.col(PRE + "p_n")), F.col(PRE + "p_total") % F.col(PRE + "p_n")
    taken = (base + F.when(F.col(PRE + "earlier") + F.col(PRE + "rank") <= odd, 1).otherwise(0)).cast("long")
    return out.select(
        *[F.col(c) for c in docs.columns],
        F.col(PRE + "size"),
        F.col(PRE + "p_source_size").alias(PRE + "source_size"),
        F.col(PRE + "p_target").alias(PRE + "target"),
        F.col(PRE + "p_rate").alias(PRE + "rate"),
        taken.alias(PRE + "copies"),
        (taken * F.col(PRE + "size")).alias(PRE + "taken"),
    )


def repeat(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each document as often as the mix takes it, with the given columns."""
    return mixed.where(F.col(PRE + "copies") > 0).withColumn(PRE + "copy", F.explode(F.sequence(F.lit(1), F.col(PRE + "copies").cast("int")))).select(*columns)
