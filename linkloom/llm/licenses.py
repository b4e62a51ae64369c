"""Licence scans: Aho-Corasick finds tags and notice phrases, a shunting-yard parser evaluates expressions."""

from __future__ import annotations

import re
import typing

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.textops import utf8

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases, as words, and their labels.
NOTICES = {
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "cc by 4 0": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "creative commons zero": "cc0",
    "creative commons attribution": "cc-by",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
}
TAG = "spdx license identifier"
#: Words that make a phrase a statement about the text itself.
LEADS = ("licensed under", "released under", "distributed under", "available under", "terms of the")
#: How much each family asks of a user, from 0 (nothing) to 5 (no grant at all).
DUTIES = {
    "cc0": 0, "public-domain": 0, "unlicense": 0, "mit": 1, "isc": 1, "bsd": 1, "bsl": 1, "zlib": 1, "apache": 1, "cc-by": 1,
    "mpl": 2, "epl": 2, "lgpl": 2, "cc-by-sa": 3, "gpl": 3, "agpl": 4, "cc-by-nc": 4, "cc-by-nd": 4, "proprietary": 5,
}
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_TAG_AT = re.compile(r"spdx-license-identifier\s*:\s*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
_RANK = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str:
    """Label of a licence identifier: its longest known head, else the identifier itself."""
    name = identifier.lower().rstrip("+")
    for known in sorted(DUTIES, key=len, reverse=True):
        if name == known or name.startswith(known + "-"):
            return known
    return name


def postfix(expression: str) -> list[str] | None:
    """The expression in postfix order by the shunting-yard rule (with > and > or), or None if it is malformed."""
    out: list[str] = []
    held: list[str] = []
    operand = True  # whether a name or "(" must come next
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if token == "(":
            if not operand:
                return None
            held.append(token)
        elif token == ")":
            if operand:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif low in _RANK:
            if operand:
                return None
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[low]:
                out.append(held.pop())
            held.append(low)
            operand = True
        else:
            if not operand:
                break  # free text behind a complete expression
            out.append(token)
            operand = False
    if operand or "(" in held:
        return None
    return out + held[::-1]


def evaluate(expression: str) -> tuple[frozenset[str], int] | None:
    """(labels, duty): `or` leaves the lighter duty, `and` the heavier, `with` names an exception and lightens by one."""
    stack: list[tuple[frozenset[str], int]] = []
    for token in postfix(expression) or ():
        if token in _RANK:
            if len(stack) < 2:
                return None
            (rl, rd), (ll, ld) = stack.pop(), stack.pop()
            stack.append((ll, max(0, ld - 1)) if token == "with" else (ll | rl, min(ld, rd) if token == "or" else max(ld, rd)))
        else:
            label = family(token)
            stack.append((frozenset([label]), DUTIES.get(label, 3)))
    return stack[0] if len(stack) == 1 else None


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", {TAG: ""}), ("lead", dict.fromkeys(LEADS, ""))):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (kind, phrase, label))
    found.make_automaton()
    return found


def scan_text(text: str | None, found) -> dict:
    raw = utf8(text)
    words = raw.translate(_WORDS).split()
    plain = b" " + b" ".join(words) + b" "
    starts, base, labels, weight, leads = [], set(), set(), 1.0, False
    duty, expressions, tagged = 0, [], False
    blanks, upto = 0, 0  # blanks before place `upto`: matches come in order of their ends, so the text is counted once
    for end, (kind, phrase, label) in found.iter(plain.decode("latin-1")):
        if kind == "base":
            blanks, upto = blanks + plain.count(b" ", upto, end + 1), end + 1
            starts.append(blanks - phrase.count(" ") - 2)
            base.add(label)
        elif kind == "notice":
            labels.add(label)
            weight *= 0.4
        elif kind == "tag":
            tagged = True
        else:
            leads = True
    if tagged:
        for m in _TAG_AT.finditer(text or ""):
            if result := evaluate(m[1]):
                labels |= result[0]
                duty = max(duty, result[1])
                expressions.append(" ".join(postfix(m[1])))
                weight *= 0.05
    if starts:
        weight *= 0.4 ** len(base)
    if leads and (base or labels):
        weight *= 0.25
    labels |= base
    if not expressions:
        duty = max((DUTIES.get(x, 3) for x in labels), default=0)
    return {
        "n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": 1.0 - weight if labels else 0.0,
        "duty": duty if labels else None, "expressions": "; ".join(expressions),
    }


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, duty int, expressions string"


def scan(docs: DataFrame, text: str = "text", into: str = "licence") -> DataFrame:
    """Adds a struct column `into` with the licence findings of each text; every other column is kept, but one
    named as `into` is replaced.

    labels: base phrases, further notices and identifiers of tag expressions; score: how sure it is that the
    text states a licence; duty: what the licence asks (0 to 5), expressions decide where there are any.
    Null text: as the empty text (no words, no labels, score 0). Ties and repeated rows: each row on its own.
    Malformed expressions are ignored. Very long texts: one at a time, in linear time. Empty table: no rows. Map-only, one
    automaton per task.
    """

    def find(texts: typing.Iterator[pd.Series]) -> typing.Iterator[pd.DataFrame]:
        found = automaton()
        for batch in texts:
            out = pd.DataFrame([scan_text(x, found) for x in batch], columns=[c.split()[0] for c in SCHEMA.split(", ")])
            yield out.astype({"n_words": "int64", "n_base": "int64", "first_word": "Int64", "last_word": "Int64", "duty": "Int32", "score": "float64"})

    return docs.withColumn(into, F.pandas_udf(find, SCHEMA)(F.col(text).cast("string")))
