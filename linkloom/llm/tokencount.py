"""Edit-aware token counts: a balanced segment tree over runs of pre-tokens per document, updated where edits touch it."""

from __future__ import annotations

import re
import typing

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.packing import encoder, ranks_path

LEAF = 400
FAN = 8
#: A place behind such a character and before a blank or line end is a pre-token boundary, whatever stands elsewhere.
SAFE = re.compile(r"[0-9A-Za-zÀ-ɏ.,;:!?](?=[ \n])")


class Node:
    """A leaf holds a run of whole pre-tokens, an inner node its children; both know their characters and tokens."""

    __slots__ = ("chars", "kids", "text", "tokens")

    def __init__(self, text: str | None, kids: list[Node] | None, chars: int, tokens: int):
        self.text, self.kids, self.chars, self.tokens = text, kids, chars, tokens


def above(kids: list[Node]) -> list[Node]:
    """Parents over a row of nodes, evenly filled, FAN children each at most."""
    n = -(-len(kids) // FAN)
    parts = [kids[len(kids) * i // n : len(kids) * (i + 1) // n] for i in range(n)]
    return [Node(None, x, sum(k.chars for k in x), sum(k.tokens for k in x)) for x in parts]


class TokenTree:
    """Subtree sums of characters and tokens; every leaf is about LEAF characters, or as long as its text has no safe place."""

    def __init__(self, text: str, count: typing.Callable[[str], int]):
        self.count = count
        row = self.cut(text)
        while len(row) > 1:
            row = above(row)
        self.root = row[0]
        self.encoded = 0

    def cut(self, text: str) -> list[Node]:
        """Leaves of a text, at least one; a rest of under LEAF stays with the leaf before."""
        out, at = [], 0
        while True:
            m = SAFE.search(text, at + LEAF) if len(text) - at > 2 * LEAF else None
            part = text[at : m.end()] if m else text[at:]
            out.append(Node(part, None, len(part), self.count(part) if part else 0))
            if not m:
                return out
            at = m.end()

    @property
    def tokens(self) -> int:
        return self.root.tokens

    @property
    def chars(self) -> int:
        return self.root.chars

    def leaves(self) -> list[Node]:
        row = [self.root]
        while row[0].kids is not None:
            row = [k for x in row for k in x.kids]
        return row

    def text(self) -> str:
        return "".join(x.text for x in self.leaves())

    def leaf_at(self, place: int) -> tuple[Node, int]:
        """(leaf, its first character) of the character at `place`."""
        node, begin = self.root, 0
        while node.kids is not None:
            for kid in node.kids:
                if place < begin + kid.chars:
                    break
                begin += kid.chars
            node = kid
        return node, begin

    def edit(self, start: int, cut: int, put: str) -> None:
        """Replace `cut` characters from `start` by `put`; places beyond the text are moved to its end.

        Encoded anew are the leaves from the one that holds the character before the edit to the one that holds the
        character behind it: their outer boundaries have both neighbours unchanged, so they stay boundaries. What
        has grown beyond twice a leaf is cut at safe places again, so no leaf grows with the number of edits.
        """
        start = min(max(start, 0), self.chars)
        end = min(start + max(cut, 0), self.chars)
        if not self.chars:
            row = new = self.cut(put)
        else:
            begin = self.leaf_at(max(start - 1, 0))[1]
            last, at = self.leaf_at(min(end, self.chars - 1))
            old = "".join(self.between(self.root, 0, begin, at + last.chars))
            new = self.cut(old[: start - begin] + put + old[end - begin :])
            row = self.splice([self.root], 0, begin, at + last.chars, [x for x in new if x.chars])
            row = row or self.cut("")
        self.encoded += sum(x.chars for x in new)
        while len(row) > 1:
            row = above(row)
        self.root = row[0]
        while self.root.kids is not None and len(self.root.kids) == 1:
            self.root = self.root.kids[0]

    def between(self, node: Node, begin: int, a: int, b: int) -> typing.Iterator[str]:
        """Texts of the leaves inside [a, b)."""
        if node.kids is None:
            yield node.text
            return
        for kid in node.kids:
            if begin < b and begin + kid.chars > a:
                yield from self.between(kid, begin, a, b)
            begin += kid.chars

    def splice(self, row: list[Node], begin: int, a: int, b: int, new: list[Node]) -> list[Node]:
        """The row of nodes (its first character is `begin`) with the leaves of [a, b) replaced; other nodes stay as they are.

        Children of the touched nodes are dealt out to parents anew, with those of a neighbour if they are few.
        """
        if row[0].kids is None:
            at, kept = begin, []
            for i, x in enumerate(row):
                if at >= b:
                    return kept + new + row[i:]
                if at + x.chars <= a:
                    kept.append(x)
                at += x.chars
            return kept + new
        first, at = 0, begin
        while at + row[first].chars <= a:
            at += row[first].chars
            first += 1
        last, end = first, at + row[first].chars
        while end < b:
            last += 1
            end += row[last].chars
        if first and len(row[first].kids) <= FAN // 2:
            first -= 1
            at -= row[first].chars
        kids = self.splice([k for x in row[first : last + 1] for k in x.kids], at, a, b, new)
        return row[:first] + (above(kids) if kids else []) + row[last + 1 :]


SCHEMA = "tokens_before long, tokens_after long, chars_after long, chars_encoded_again long, n_leaves long"


def counts(docs: DataFrame, edits: str, text: str = "text", into: str = "counts", vocabulary: str | None = None) -> DataFrame:
    """Adds a struct: token counts before and after each row's edits, and how much was encoded again.

    edits: an array of (start, cut, put) in characters, applied in order to the text as it then is.
    Null text: as empty. Null edits: none; a null put: nothing put in; null places: 0. Repeated rows: each on its own.
    Edits at one place apply one after the other. Very long texts: one tree in memory at a time. Empty table: no rows.
    Map-only; every other column is kept, but one named as `into` is replaced.
    """
    path = vocabulary or ranks_path()

    def read(cols: typing.Iterator[tuple[pd.Series, pd.Series]]) -> typing.Iterator[pd.DataFrame]:
        enc = encoder(path, {"<|endoftext|>": 50256})
        count = lambda x: len(enc.encode_to_numpy(x, allowed_special="all"))
        for texts, lists in cols:
            rows = []
            for body, todo in zip(texts, lists):
                tree = TokenTree(body or "", count)
                before = tree.tokens
                for e in todo if todo is not None else ():
                    tree.edit(e["start"] or 0, e["cut"] or 0, e["put"] or "")
                rows.append((before, tree.tokens, tree.chars, tree.encoded, len(tree.leaves())))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.withColumn(into, F.pandas_udf(read, SCHEMA)(F.col(text).cast("string"), F.col(edits)))


def own_edits(text: str = "text", doc_id: str = "doc_id", n: int = 3) -> Column:
    """Edits derived from a row itself: in each of n equal parts a few characters make way for others of the text."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    part = F.floor(F.length(body) / n)
    draw = lambda k, j: F.crc32(F.concat_ws("/", F.col(doc_id).cast("string"), F.lit(k), F.lit(j)).cast("binary"))
    one = lambda k: F.struct(
        (part * k + draw(k, 0) % F.greatest(part, F.lit(1))).cast("int").alias("start"),
        (draw(k, 1) % 12).cast("int").alias("cut"),
        F.substring(body, (draw(k, 2) % F.greatest(F.length(body), F.lit(1)) + 1).cast("int"), (draw(k, 3) % 20).cast("int")).alias("put"),
    )
    return F.array(*[one(k) for k in range(n)])
