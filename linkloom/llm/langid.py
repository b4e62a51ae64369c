"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection."""

from __future__ import annotations

import typing
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.textops import PIECE, mix

UNKNOWN = "und"
ORDERS = (1, 2, 3)
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def subwords(text: str, bits: int) -> typing.Iterator[np.ndarray]:
    """Hashed buckets of the 1- to 3-grams inside each word and over its edges, one array per stretch of text.

    Text is lower-cased, every non-letter is a word edge. Stretches bound the memory of very long texts; they
    overlap by the longest gram less one, so that each gram is counted once.
    """
    longest, shift = max(ORDERS), np.uint64(64 - bits)
    for at in range(0, max(1, len(text)), PIECE // 4):
        part = text[max(0, at - longest + 1) : at + PIECE // 4].lower()
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(letters()[codes], codes, 0).astype(np.uint64)
        if at == 0:
            codes = np.r_[np.zeros(1, np.uint64), codes]
        inner = codes != 0
        out = []
        for n in ORDERS:
            m = len(codes) - n + 1
            if m <= 0:
                continue
            # Letters throughout, but for the first and last place of grams that may show a word's edge.
            ok = inner[:m].copy() if n == 1 else np.ones(m, bool)
            for j in range(1, n - 1):
                ok &= inner[j : m + j]
            if n == 2:
                ok &= inner[:m] | inner[1 : m + 1]
            fresh = 0 if at == 0 else longest - n  # what the stretch before has counted
            ok[:fresh] = False
            where = np.flatnonzero(ok)
            h = np.full(len(where), n, np.uint64)
            for j in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + codes[where + j]
            out.append((mix(h) >> shift).astype(np.int32))
        yield np.concatenate(out) if out else np.zeros(0, np.int32)


@dataclass
class Model:
    """languages; table: a row of language scores per bucket (embeddings times output weights); the calibration."""

    languages: list[str]
    bits: int
    table: np.ndarray
    bias: np.ndarray
    heat: float
    least: float

    def logits(self, text: str) -> np.ndarray | None:
        """Scores of a whole text, None without a letter."""
        total, n = np.zeros(len(self.languages)), 0
        for grams in subwords(text, self.bits):
            total += self.table[grams].sum(axis=0, dtype=np.float64)
            n += len(grams)
        return total / n + self.bias if n else None

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, rejected)."""
        z = self.logits(text) if text and self.languages else None
        if z is None:
            return UNKNOWN, 0.0, True
        p = np.exp(self.heat * (z - z.max()))
        p /= p.sum()
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.least)


def held_out(doc_id: str = "doc_id", folds: int = 3):
    """Whether crc32 of the id as text leaves 1; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 1


def train(rows: list[tuple[str, str]], bits: int = 15, width: int = 16, epochs: int = 12, rate: float = 0.5, seed: int = 7, lose: float = 0.005) -> Model:
    """Fit on (text, language) rows: embeddings are averaged over a text's grams, scored by a linear softmax.

    Stochastic gradient descent in numpy; buckets that training never meets keep a zero embedding, so foreign
    text scores near the bias alone. One row in five is left out of the descent: on those the softmax is tempered
    (one scale, least log loss), and the rejection bound is set where 19 in 20 short texts of random grams fall below it, or
    lower where more than `lose` of the correctly named rows would too.
    """
    languages = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(seed)
    seen = []
    for text, lang in rows:
        counts = np.zeros(1 << bits, np.float32)
        n = 0
        for grams in subwords(text, bits):
            counts += np.bincount(grams, minlength=1 << bits)
            n += len(grams)
        if n:
            where = np.flatnonzero(counts)
            seen.append((where, counts[where] / np.float32(n), languages.index(lang)))
    if not seen:
        return Model([], bits, np.zeros((1 << bits, 0), np.float32), np.zeros(0), 1.0, 0.0)
    order = rng.permutation(len(seen))
    hold, fit = order[: len(order) // 5], order[len(order) // 5 :]
    embed = np.zeros((1 << bits, width), np.float32)
    for i in fit:
        embed[seen[i][0]] = 1
    embed *= rng.uniform(-1, 1, embed.shape).astype(np.float32) / width
    out = np.zeros((width, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps, at = epochs * len(fit), 0
    for _ in range(epochs):
        for i in rng.permutation(fit):
            where, share, lang = seen[i]
            pace = np.float32(rate * (1 - at / steps))
            at += 1
            mean = share @ embed[where]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[lang] -= 1
            back = out @ p
            out -= pace * np.outer(mean, p)
            bias -= np.float32(0.1) * pace * p
            embed[where] -= (pace * len(where) ** 0.5) * np.outer(share, back)
    table = embed @ out
    model = Model(languages, bits, table, bias.astype(np.float64), 1.0, 0.0)
    hold = hold if len(hold) else fit
    z = np.array([(seen[i][1] @ table[seen[i][0]]) + bias for i in hold], np.float64)
    true = np.array([seen[i][2] for i in hold])

    def loss(heat: float) -> float:
        s = heat * z
        s -= s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), true]))

    model.heat = float(min(np.geomspace(0.25, 16, 49), key=loss))
    s = np.exp(model.heat * (z - z.max(axis=1, keepdims=True)))
    s /= s.sum(axis=1, keepdims=True)
    right = s.max(axis=1)[s.argmax(axis=1) == true]
    # Texts of 20 grams that fall into any bucket, as those of a foreign language do.
    noise = table[rng.integers(0, 1 << bits, (2000, 20))].mean(axis=1, dtype=np.float64) + bias
    blank = np.exp(model.heat * (noise - noise.max(axis=1, keepdims=True)))
    blank = blank.max(axis=1) / blank.sum(axis=1)
    model.least = float(min(np.quantile(blank, 0.95), np.quantile(right, lose))) if len(right) else 0.0
    return model


def fit(docs: DataFrame, sample: int = 3000, longest: int = 20_000, folds: int = 3, **how) -> Model:
    """Train on at most `sample` labelled rows outside the held-out fold, picked by hash of the id.

    The bounds are parameters of the fit alone: `sample` whole texts of at most `longest` characters come to the
    driver (60 million characters at most). Rows are counted first, so that only about as many as are wanted leave
    the tasks. Prediction reads every text whole. Rows with null text or language are not used.
    """
    pool = docs.where(~held_out(folds=folds)).where("text is not null and lang is not null").where(F.length("text") <= longest)
    picked = pool.select(F.col("text").alias("t"), F.col("lang").alias("l"), F.xxhash64(F.col("doc_id").cast("string")).alias("h"))
    share = min(1.0, 1.3 * sample / max(1, pool.count()))
    some = picked.where(F.shiftrightunsigned("h", 11) <= int(share * (1 << 53)))
    rows = some.orderBy("h", "l", "t").limit(sample).collect()
    return train([(r.t, r.l) for r in rows], **how)


def identify(docs: DataFrame, model: Model, text: str = "text", into: str = "language") -> DataFrame:
    """Adds a struct (lang_pred, score, rejected) read from the whole text; every other column is kept, but one named as `into` is replaced.

    Null text or text without a letter: `und`, score 0, rejected. The model (half a megabyte per language) is
    broadcast once. Map-only; repeated rows and ties get the same answer (first language by name). Very long texts are read
    in pieces. Empty table: no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def read(texts: typing.Iterator[pd.Series]) -> typing.Iterator[pd.DataFrame]:
        known = sent.value
        for batch in texts:
            yield pd.DataFrame([known.predict(x) for x in batch], columns=["lang_pred", "score", "rejected"])

    return docs.withColumn(into, F.pandas_udf(read, "lang_pred string, score double, rejected boolean")(F.col(text).cast("string")))
