"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints that differ in at most d bits agree on at least two of d+2 blocks. That shared masked pattern is
the uppermost node of the index and the key by which fingerprints are dealt out. Inside a node members are
sorted by Gray rank and consecutive ones are factored into nodes that hold the bits all of them share; two nodes
whose shared bits already differ in more than d places are pruned together.
"""

from __future__ import annotations

import typing
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.textops import LOWER, utf8
from linkloom.operators.components import components
from linkloom.session import cut

BITS = 64
FAN = 8


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """Majority bits over the XXH64 of each `width`-word shingle, repeats included; 0 if the text has no word."""
    words = utf8(text).translate(LOWER).split()
    if not words:
        return 0
    line = memoryview(b" ".join(words))
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    width = min(width, len(words))
    n = len(words) - width + 1
    counts = np.zeros(BITS, np.int64)
    begin = 0
    for lo in range(0, n, 1 << 15):
        hashes = []
        for e in ends[lo + width - 1 : min(n, lo + (1 << 15)) + width - 1]:
            hashes.append(xxhash.xxh64_intdigest(line[begin:e], seed))
            begin = ends[len(hashes) + lo - 1] + 1
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint as 16 hex digits; every other column is kept, but one named as `into` is replaced.

    Null and wordless texts: zeros. Repeated rows: each on its own. Empty table: no rows.
    """

    def read(texts: pd.Series) -> pd.Series:
        return pd.Series([f"{fingerprint(x):016x}" for x in texts])

    return docs.withColumn(into, F.pandas_udf(read, "string")(F.col(text).cast("string")))


def signed(digits: str) -> Column:
    """16 hex digits as the bigint of the same bits."""
    return F.conv(F.col(digits), 16, -10).cast("long")


def block_spans(differ: int) -> list[tuple[int, int]]:
    """(shift, width) of differ + 2 blocks that tile the 64 bits."""
    n = differ + 2
    widths = [BITS // n + (i < BITS % n) for i in range(n)]
    return [(BITS - end, w) for end, w in zip(accumulate(widths), widths)]


def _block(f: Column, span: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(f, span[0]).bitwiseAND(F.lit((1 << span[1]) - 1).cast("long"))


def node_keys(f: Column, differ: int) -> Column:
    """One key for each pair of blocks: the pair's number and its masked bits."""
    spans = block_spans(differ)
    out = []
    for t, (i, j) in enumerate(combinations(range(len(spans)), 2)):
        bits = F.shiftleft(_block(f, spans[i]), spans[j][1]).bitwiseOR(_block(f, spans[j]))
        out.append(F.lit(t << 40).cast("long").bitwiseOR(bits))
    return F.array(*out)


def finer_keys(f: Column, key: Column, differ: int, turn: int = 0) -> Column:
    """Keys for members of a crowded node: its key with one block of a further tiling of the bits, differ + 1 blocks.

    At most `differ` of the blocks can hold a difference, so two linked members still share one of these keys. Every turn
    tiles the bits from another place on.
    """
    n, by = differ + 1, 5 * turn % BITS
    turned = F.shiftleft(f, by).bitwiseOR(F.shiftrightunsigned(f, BITS - by)) if by else f
    widths = [BITS // n + (i < BITS % n) for i in range(n)]
    spans = [(BITS - end, w) for end, w in zip(accumulate(widths), widths)]
    return F.array(*[F.xxhash64(key, F.lit(turn), F.lit(i), _block(turned, s)) for i, s in enumerate(spans)])


def gray_rank(f: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray order."""
    for s in (1, 2, 4, 8, 16, 32):
        f = f ^ (f >> np.uint64(s))
    return f


def _cross(a, b, first, count):
    """All child pairs of node pairs (a, b); of a node with itself each unordered pair once."""
    na, nb = count[a], count[b]
    total = na * nb
    pair = np.repeat(np.arange(len(a)), total)
    step = np.arange(int(total.sum())) - np.repeat(np.cumsum(total) - total, total)
    ca, cb = first[a][pair] + step // nb[pair], first[b][pair] + step % nb[pair]
    keep = (a[pair] != b[pair]) | (ca <= cb)
    return ca[keep], cb[keep]


def close_pairs(run: np.ndarray, f: np.ndarray, differ: int) -> typing.Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows in the same run at most `differ` bits apart. Rows are sorted by (run, Gray rank).

    Builds the levels bottom-up over all runs at once, then walks node pairs from the roots; differences on the
    bits both nodes share only grow towards the leaves, so a pair beyond `differ` is dropped with all below it.
    """
    levels = [(f, f, run, None, None)]
    while True:
        low, high, owner = levels[-1][:3]
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        if len(starts) == len(owner):
            break
        place = np.arange(len(owner)) - np.repeat(starts, np.diff(np.append(starts, len(owner))))
        first = np.flatnonzero(place % FAN == 0)
        count = np.diff(np.append(first, len(owner)))
        levels.append((np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first), owner[first], first, count))
    roots = np.arange(len(levels[-1][0]))
    todo = [(len(levels) - 1, roots[i : i + 8192], roots[i : i + 8192]) for i in range(0, len(roots), 8192)]
    while todo:
        level, a, b = todo.pop()
        if level == 0:
            distinct = a != b
            a, b = a[distinct], b[distinct]
            if len(a):
                yield a, b
            continue
        ca, cb = _cross(a, b, levels[level][3], levels[level][4])
        low, high = levels[level - 1][:2]
        shared = ~(low ^ high)
        apart = np.bitwise_count((low[ca] ^ low[cb]) & shared[ca] & shared[cb])
        near = apart <= differ
        ca, cb = ca[near], cb[near]
        todo += [(level - 1, ca[i : i + 8192], cb[i : i + 8192]) for i in range(0, len(ca), 8192)]


def local_roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """Smallest row reachable from each of n rows over pairs (a, b) and earlier roots."""
    root = np.arange(n) if root is None else root
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = np.minimum(new, new[new])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links(routed: DataFrame, differ: int) -> DataFrame:
    """(a, b) links that span, inside each node, what its members' close pairs connect.

    routed: key, f (bigint bits), rep. A node's members come sorted by key and are handled as whole runs; of each
    run only a spanning forest leaves the task.
    """

    def run(batches):
        held = None

        def emit(part: pd.DataFrame):
            key, f, rep = part["key"].to_numpy(), part["f"].to_numpy().view(np.uint64), part["rep"].to_numpy()
            order = np.lexsort((gray_rank(f), key))
            key, f, rep = key[order], f[order], rep[order]
            new = np.r_[True, key[1:] != key[:-1]]
            alone = new & np.r_[new[1:], True]
            key, f, rep = key[~alone], f[~alone], rep[~alone]
            if not len(key):
                return
            root, some = np.arange(len(key)), False
            for a, b in close_pairs(np.cumsum(np.r_[True, key[1:] != key[:-1]]), f, differ):
                root, some = local_roots(len(key), a, b, root), True
            if some:
                own = np.flatnonzero(root != np.arange(len(root)))
                yield pd.DataFrame({"a": rep[own], "b": rep[root[own]]})

        for batch in batches:
            if held is not None and len(held):
                batch = pd.concat([held, batch], ignore_index=True)
            if not len(batch):
                continue
            last = batch["key"].to_numpy()
            open_from = int(np.searchsorted(last, last[-1], "left"))
            held = batch.iloc[open_from:]
            if open_from:
                yield from emit(batch.iloc[:open_from])
        if held is not None and len(held):
            yield from emit(held)

    return routed.repartition("key").sortWithinPartitions("key").mapInPandas(run, "a long, b long")


def crowded(reps: DataFrame, differ: int, most: int) -> DataFrame | None:
    """Keys of nodes with over `most` members, or None if no node can have as many.

    A node is at most as large as either of its blocks; those counts are few (about 12,000 for six blocks), whatever
    the input. Only members whose blocks are all that large are counted by node.
    """
    spans = block_spans(differ)
    blocks = reps.select(F.explode(F.array(*[F.lit(i << 40).cast("long").bitwiseOR(_block(F.col("f"), s)) for i, s in enumerate(spans)])).alias("block"))
    large = {r[0] for r in blocks.groupBy("block").count().where(F.col("count") > most).select("block").collect()}
    per_span = [sorted(x & ((1 << 40) - 1) for x in large if x >> 40 == i) for i in range(len(spans))]
    pairs = [(t, i, j) for t, (i, j) in enumerate(combinations(range(len(spans)), 2)) if per_span[i] and per_span[j]]
    if not pairs:
        return None
    keys = node_keys(F.col("f"), differ)
    some = [F.when(_block(F.col("f"), spans[i]).isin(per_span[i]) & _block(F.col("f"), spans[j]).isin(per_span[j]), keys[t]) for t, i, j in pairs]
    found = reps.select(F.explode(F.filter(F.array(*some), lambda x: x.isNotNull())).alias("key")).groupBy("key").count().where(F.col("count") > most)
    found = cut(found.select("key"), "crowded")
    return None if found.isEmpty() else found


def divided(routed: DataFrame, many: DataFrame | None, differ: int, most: int, turns: int = 6) -> DataFrame:
    """(key, f, rep) with the nodes in `many` divided by further blocks, and those again, until none has over `most` members.

    Every turn fixes some 13 more of the bits that members share. Even where all members lie around one text, each new
    node holds less than half of them, so the largest shrinks faster than the number of keys grows.
    """
    small = []
    for turn in range(turns):
        if many is None:
            break
        small.append(routed.join(many, "key", "left_anti"))
        inside = routed.join(many, "key", "left_semi")
        routed = cut(inside.select(F.explode(finer_keys(F.col("f"), F.col("key"), differ, turn)).alias("key"), "f", "rep"), "inside")
        found = cut(routed.groupBy("key").count().where(F.col("count") > most).select("key"), "crowded")
        many = None if found.isEmpty() else found
    for x in small:
        routed = routed.unionByName(x)
    return routed


def near_duplicates(docs: DataFrame, differ: int = 4, most: int = 50_000) -> DataFrame:
    """Each document's fingerprint and group: (doc_id, fingerprint, component_id).

    Documents whose fingerprints are at most `differ` bits apart are linked; a group is what links reach and is
    named by its smallest doc_id. Exact: no link between different fingerprints is missed. Documents with one
    fingerprint are collapsed before any search, so thousands of copies cost one member. Nodes of the index with
    over `most` members are divided by further blocks (again without losing a link).
    Null text: as empty, fingerprint zero, linked like any other. Repeated rows and ids: each row is returned.
    Null doc_id: returned, never names a group unless all ids in it are null (then null). Empty table: no rows.
    """
    marked = cut(with_fingerprint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).select("doc_id", "fingerprint"), "marked")
    reps = cut(marked.withColumn("f", signed("fingerprint")).groupBy("f").agg(F.min("doc_id").alias("rep")), "reps")
    named = reps.where("rep is not null")
    routed = divided(named.select(F.explode(node_keys(F.col("f"), differ)).alias("key"), "f", "rep"), crowded(named, differ, most), differ, most)
    grouped = components(links(routed, differ))
    final = reps.join(grouped, reps.rep == grouped.node, "left").select("f", F.coalesce("component", "rep").alias("component_id"))
    return marked.withColumn("f", signed("fingerprint")).join(final, "f").select("doc_id", "fingerprint", "component_id")
