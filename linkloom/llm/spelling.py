"""Spelling variants by reduced-alphabet generation.

Letters are hashed to a few symbols. Every reduced word generates its one-edit neighbourhood as keys, the keys are
joined to the reduced vocabulary, and what meets is verified on the original strings. Two words that differ by one edit
have reduced words that differ by one edit or not at all, so no pair is missed; reduced words are few symbols wide, so a
neighbourhood is small where that over the letters themselves would not be.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.textops import mix
from linkloom.session import cut

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Longer words travel as a digest: a word meets as many keys as it is long, and each carries it.
CARRIED = 64
#: Numbers in a temporary array.
CELLS = 1 << 21
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)


def runs(docs: DataFrame, shortest: int = 7, text: str = "text") -> DataFrame:
    """Adds `run`: a row for each maximal run of at least `shortest` letters, A-Z lower-cased. Null texts have none."""
    found = docs.withColumn("run", F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))))
    return found.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")))


def vocabulary(words: DataFrame, shortest: int = 7, least: int = 2) -> DataFrame:
    """(word, n) of the words of at least `shortest` code points that occur at least `least` times."""
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def alphabet(n_words: int, shortest: int = 7) -> int:
    """How many symbols: enough for one reduced word of the shortest length to every eight words, 4 at least, 26 at most.

    Only the cost depends on it, not the result.
    """
    return min(26, max(4, math.ceil((n_words / 8) ** (1 / shortest))))


def symbols(points: np.ndarray, size: int) -> np.ndarray:
    """A symbol from 1 to `size` for each code point."""
    return (mix(points.astype(np.uint64) + np.uint64(BASE)) >> np.uint64(20)) % np.uint64(size) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(max(n - 1, 0), BASE, np.uint64)])[:n]


def by_length(words: list[str], size: int):
    """(rows, matrix of symbols) for words of equal length, in parts of bounded size."""
    lengths = np.array([len(w) for w in words], np.int64)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        step = max(1, CELLS // max(1, int(n) * size))
        for i in range(0, len(rows), step):
            some = rows[i : i + step]
            points = np.frombuffer("".join(words[k] for k in some).encode("utf-32-le", "surrogatepass"), "<u4")
            yield some, symbols(points, size).reshape(len(some), int(n))


def _key(value: np.ndarray, n: int) -> np.ndarray:
    return mix(value + np.uint64(n * BASE % (1 << 64)))


def own_keys(words: list[str], size: int) -> np.ndarray:
    """The key of each reduced word: a polynomial over its symbols and its length, mixed."""
    out = np.zeros(len(words), np.uint64)
    for rows, s in by_length(words, size):
        out[rows] = _key((s * _powers(s.shape[1])).sum(axis=1, dtype=np.uint64), s.shape[1])
    return out


def neighbourhoods(words: list[str], size: int):
    """(rows, counts, keys): keys of the reduced words one edit away from each word's, in parts.

    All deletions, and those replacements whose key is above the word's own. What is left of the full neighbourhood
    (insertions, the other replacements) is what the words at its other end generate, so each pair of reduced words meets once.
    """
    for rows, s in by_length(words, size):
        n = s.shape[1]
        power = _powers(n)
        term = s * power
        total = term.sum(axis=1, dtype=np.uint64)[:, None]
        own = _key(total, n)
        # Of a run of equal symbols one deletion stands for all.
        first = np.ones(s.shape, bool)
        first[:, 1:] = s[:, 1:] != s[:, :-1]
        before = np.cumsum(term, axis=1, dtype=np.uint64) - term
        gone = _key(before + (total - before - term) * np.uint64(BACK), n - 1)
        yield rows, first.sum(axis=1), gone[first]
        step = max(1, CELLS // (len(rows) * size))
        for at in range(0, n, step):
            part, weight = s[:, at : at + step, None], power[at : at + step, None]
            other = np.arange(1, size + 1, dtype=np.uint64)
            keys = _key(total[:, :, None] + (other - part) * weight, n)
            wanted = (other != part) & (keys > own[:, :, None])
            yield rows, wanted.sum(axis=(1, 2)), keys[wanted]


def with_keys(vocab: DataFrame, size: int) -> DataFrame:
    def run(batches):
        for b in batches:
            keys = own_keys(b.column("word").to_pylist(), size)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys.view(np.int64))], [*b.schema.names, "key"])

    return vocab.mapInArrow(run, "word string, n long, key long")


def with_neighbours(vocab: DataFrame, size: int) -> DataFrame:
    """(name, n, key): one row for each key of each word's neighbourhood."""

    def run(batches):
        for b in batches:
            names, n = b.column("name"), b.column("n")
            for rows, counts, keys in neighbourhoods(b.column("word").to_pylist(), size):
                at = pa.array(rows)
                near = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([names.take(at), n.take(at), near], ["name", "n", "near"])

    return vocab.select("word", "name", "n").mapInArrow(run, "name string, n long, near array<long>").select("name", "n", F.explode("near").alias("key"))


def near_pairs(vocab: DataFrame, size: int) -> DataFrame:
    """(a, a_n, b, b_n): each two words of `vocab` (word, n; distinct) that one inserted, deleted or replaced code point parts, once."""
    long = F.length("word") > CARRIED
    keyed = cut(with_keys(vocab.select("word", "n"), size).withColumn("name", F.when(long, F.sha2("word", 256)).otherwise(F.col("word"))), "keyed")
    apart = with_neighbours(keyed, size).select("key", F.col("name").alias("a"), F.col("n").alias("a_n"), F.lit(False).alias("same"))
    same = keyed.select("key", F.col("name").alias("a"), F.col("n").alias("a_n"), F.lit(True).alias("same"))
    met = apart.unionByName(same).join(keyed.select("key", F.col("name").alias("b"), F.col("n").alias("b_n")), "key")
    # Digests are as long as the longest carried word; a word of letters has no digit.
    digest = [F.col(c).rlike("[0-9]") & (F.length(c) == CARRIED) for c in ("a", "b")]
    one = F.levenshtein(F.col("a"), F.col("b"), 1) == 1
    met = met.where(~F.col("same") | (F.col("a") < F.col("b"))).where(digest[0] | digest[1] | one).select("a", "a_n", "b", "b_n")
    met = cut(met, "near")
    words = keyed.where(long).select("name", F.col("word").alias("__word"))
    rest = met.where(digest[0] | digest[1])
    for c in ("a", "b"):
        rest = rest.join(words.withColumnRenamed("name", c), c, "left").withColumn(c, F.coalesce("__word", c)).drop("__word")
    return met.where(~digest[0] & ~digest[1]).unionByName(rest.where(one).select(*met.columns))


def forms(vocab: DataFrame, ratio: int = 10, size: int | None = None) -> DataFrame:
    """Each word with its form: (word, form, root, n, n_near, form_n).

    vocab: word, n. Two words are near if one inserted, deleted or replaced code point parts them. A word's form is its
    near word of largest n (ties: the smallest in code-point order) if that n is at least `ratio` times its own, else null;
    root is what forms lead to. Every pair of near words is found. Words given twice count once with their n added up;
    a null word takes no part; an empty table gives no rows; words may be of any length.
    """
    if ratio < 2:
        raise ValueError("forms lead upwards only for a ratio of 2 or more")
    vocab = cut(vocab.where("word is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n")), "vocabulary")
    facts = vocab.agg(F.count("*").alias("words"), F.max("n").alias("most"), F.min(F.length("word")).alias("shortest")).first()
    near = near_pairs(vocab, size or alphabet(facts.words, max(1, facts.shortest or 1)))
    ways = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")),
    )
    best = near.select(F.explode(ways).alias("x")).select("x.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    enough = -F.col("best.m") >= ratio * F.col("n")
    found = cut(vocab.join(best, "word", "left").select("word", F.when(enough, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, -F.col("best.m")).alias("form_n")), "forms")
    # Each step multiplies n by the ratio, so a chain has at most so many steps; each round doubles what it has followed.
    steps = math.ceil(math.log(max(facts.most or 1, 1), ratio)) + 1
    hops = found.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(steps, 1))))):
        on = hops.select(F.col("word").alias("root"), F.col("root").alias("__on"))
        hops = cut(hops.join(on, "root", "left").select("word", F.coalesce("__on", "root").alias("root")), "hops")
    return found.join(hops, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
