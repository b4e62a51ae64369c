"""Repeated passages by column-wise multi-document suffix sorting.

Every string of `length` bytes contains an anchor that its own bytes choose (the least k-gram hash in it), so equal
strings choose equal anchors at equal places. Stretches around the anchors that occur twice or more are dealt out by
anchor and set side by side, aligned at it. From the last column to the first, one symbol of each stretch is inserted
per round: the order of all suffixes and the common prefixes of neighbours (the collection's positional
Burrows-Wheeler transform and its LCP array) follow from those of the round before. Suffixes whose common prefix
with a neighbour reaches `length` are repeats.
"""

from __future__ import annotations

import hashlib
import typing

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from linkloom.llm.textops import groups, mix, utf8
from linkloom.session import cut

GRAM = 32
PIECE = 1 << 17
SHORT_PERIOD = 16
ABSENT = 256


def _gram_hashes(a: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-grams, by doubling."""
    h, n = a.astype(np.uint64) + np.uint64(1), 1
    while n < GRAM:
        h = h[:-n] * np.uint64(pow(0x9E3779B97F4A7C15, n, 1 << 64)) + h[n:]
        n *= 2
    return mix(h)


def _periods(a: np.ndarray) -> list[int]:
    """Periods up to SHORT_PERIOD that some stretch of 136 bytes or more may have: 8 bytes in each 64 are compared."""
    at = np.arange(SHORT_PERIOD, len(a) - 7, 64)
    if len(at) < 2:
        return []
    near = np.lib.stride_tricks.sliding_window_view(a, SHORT_PERIOD + 8)[at - SHORT_PERIOD]
    back = np.lib.stride_tricks.sliding_window_view(near, 8, axis=1)[:, :SHORT_PERIOD]
    same = (back == near[:, None, SHORT_PERIOD:]).all(axis=2)
    return [SHORT_PERIOD - int(q) for q in np.flatnonzero((same[1:] & same[:-1]).any(axis=0))]


def _sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    n = 1
    while 2 * n <= w:
        v = np.minimum(v[:-n], v[n:])
        n *= 2
    return np.minimum(v[: len(v) - (w - n)], v[w - n :]) if w > n else v


def _periodic(a: np.ndarray, length: int) -> np.ndarray | None:
    """Starts j whose `length` bytes equal those at j - p for a short period p, so they repeat inside the text itself.

    They need no anchor: the first such stretch has its own and stands for them. None if there is no such start.
    """
    out = None
    for p in _periods(a):
        differ = np.r_[0, np.cumsum(a[p:] != a[:-p])]
        j = np.arange(p, len(a) - length + 1)
        hit = differ[j - p + length] == differ[j - p]
        if hit.any():
            out = np.zeros(len(a), bool) if out is None else out
            out[j[hit]] = True
    return out


def anchors(data: list[bytes], length: int) -> typing.Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, places, hashes, first, last) of each text's anchors; first and last: the starts of the strings that chose it.

    Texts are joined up to a piece; a longer one is read in pieces that share length - 1 bytes.
    """
    w = length - GRAM + 1
    jobs: list[list[tuple[int, int, bytes]]] = []
    for a, b in groups([len(x) for x in data], PIECE):
        if len(data[a]) > PIECE:
            jobs += [[(a, at, data[a][at : at + PIECE + length - 1])] for at in range(0, len(data[a]) - length + 1, PIECE)]
        else:
            jobs.append([(i, 0, data[i]) for i in range(a, b) if len(data[i]) >= length])
    for job in jobs:
        if not job:
            continue
        flat = np.frombuffer(b"".join(x for _, _, x in job), np.uint8)
        if len(flat) < length:
            continue
        size = np.array([len(x) for _, _, x in job])
        begin = np.cumsum(size) - size
        h = _gram_hashes(flat)
        # Least hash of each string's grams; of equal ones the last. The low bits carry the place.
        low = np.uint64((1 << 22) - 1)
        v = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
        least = _sliding_least(v, w)
        ok = np.zeros(len(least), bool)
        for s, n in zip(begin, size):
            ok[s : s + n - length + 1] = True
        again = _periodic(flat, length)
        if again is not None:
            for s in begin:  # the string a period earlier must lie in the same text
                again[s : s + SHORT_PERIOD] = False
            ok &= ~again[: len(ok)]
        starts = np.flatnonzero(ok)
        if not len(starts):
            continue
        place = (low - (least[starts] & low)).astype(np.int64)
        fresh = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        place, first, last = place[fresh], starts[fresh], starts[np.append(fresh[1:], len(starts)) - 1]
        owner = np.searchsorted(begin, place, "right") - 1
        for k in np.unique(owner):
            mine = owner == k
            row, at, _ = job[k]
            shift = at - begin[k]
            yield row, place[mine] + shift, h[place[mine]].view(np.int64), first[mine] + shift, last[mine] + shift


def text_key(text: str = "text") -> Column:
    """128 bits of the text's SHA-256: equal keys are equal texts at any size of collection.

    Spark must know that it is never null, or it filters nulls before one of two joins and shuffles the texts twice.
    """
    digest = F.unhex(F.substring(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256), 1, 32))
    return F.coalesce(digest, F.lit(bytearray(16)))


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """key: what texts are told apart by (text_key); null texts count as empty."""
    return docs.select(text_key(text).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))


def _anchor_rows(keyed: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            data = [utf8(x) for x in batch.column(1).to_pylist()]
            keys = batch.column(0)
            for row, place, h, _, _ in anchors(data, length):
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.repeat(keys[row], len(h)), pa.array(place)], ["anchor", "key", "at"])

    def merged(batches):
        """Few larger batches."""
        held, n = [], 0
        for x in run(batches):
            held.append(x)
            n += len(x)
            if n > 50_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return keyed.mapInArrow(merged, "anchor long, key binary, at long")


def repeats_in_columns(owner: np.ndarray, symbols: np.ndarray, length: int) -> np.ndarray:
    """Which suffixes of aligned stretches share at least `length` symbols with another stretch of the same owner.

    owner: group of each row, ascending. symbols: (columns, rows), ABSENT outside a stretch. Returns (columns, rows).
    """
    columns, rows = symbols.shape
    out = np.zeros((columns, rows), bool)
    order = np.arange(rows)
    group = owner.astype(np.int64) * 512
    common = np.zeros(rows, np.int32)
    for c in range(columns - 1, -1, -1):
        symbol = symbols[c][order]
        key = group[order] + symbol
        if (key[1:] < key[:-1]).any():
            moved = np.argsort(key, kind="stable")
            order, key, symbol = order[moved], key[moved], symbol[moved]
            same = np.r_[False, key[1:] == key[:-1]] & (symbol != ABSENT)
            new = np.zeros(rows, np.int32)
            near = same.copy()
            near[1:] &= moved[1:] == moved[:-1] + 1
            new[near] = common[moved[near]] + 1
            far = np.flatnonzero(same & ~near)
            if len(far):
                # Neighbours now that others stood between before: the least common prefix over the gap.
                bounds = np.stack([moved[far - 1] + 1, moved[far] + 1], axis=1).ravel()
                padded = np.append(common, np.int32(0))
                new[far] = np.minimum.reduceat(padded, bounds)[::2] + 1
            common = new
        else:
            same = np.r_[False, key[1:] == key[:-1]] & (symbol != ABSENT)
            common = np.where(same, common + 1, 0)
        hit = common >= length
        hit[:-1] |= hit[1:].copy()
        if hit.any():
            out[c, order[hit]] = True
    return out


def _matched(stretches: DataFrame, length: int, batch_rows: int = 4096) -> DataFrame:
    """(key, start, end) of the bytes covered by repeats; stretches: anchor, key, at, first, bytes."""
    reach = length - GRAM  # starts lie this far before the anchor at most
    columns = reach + length

    def emit(part: list[tuple]) -> pa.RecordBatch | None:
        anchor = np.array([x[0] for x in part], np.int64)
        owner = np.cumsum(np.r_[0, anchor[1:] != anchor[:-1]])
        grid = np.full((len(part), columns), ABSENT, np.uint16)
        for i, (_, _, at, first, data) in enumerate(part):
            col = first - at + reach
            grid[i, col : col + len(data)] = np.frombuffer(data, np.uint8)
        hit = repeats_in_columns(owner, np.ascontiguousarray(grid.T), length)[: reach + 1].T
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, begin = np.nonzero(edge == 1)
        end = np.nonzero(edge == -1)[1]
        if not len(row):
            return None
        at = np.array([x[2] for x in part], np.int64)[row] - reach
        key = [part[i][1] for i in row]
        return pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(at + begin), pa.array(at + end - 1 + length)], ["key", "start", "end"])

    def run(batches):
        part: list[tuple] = []
        whole = 0  # rows of part before the run that may go on
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if part and part[-1][0] != row[0]:
                    whole = len(part)
                    if whole >= batch_rows:
                        if (found := emit(part)) is not None:
                            yield found
                        part, whole = [], 0
                part.append(row)
        if part and (found := emit(part)) is not None:
            yield found

    return stretches.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "key binary, start long, end long")


def _matched_by_string(strings: DataFrame) -> DataFrame:
    """For crowded anchors: (key, start, end) of strings that occur twice; strings: anchor, place, digest, key, start, end.

    Counts are added up map-side, so an anchor in a third of all documents never meets in one task.
    """
    twice = strings.groupBy("anchor", "place", "digest").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return strings.join(twice, ["anchor", "place", "digest"], "left_semi").select("key", "start", "end")


def covered(docs: DataFrame, text: str = "text", length: int = 200, most: int = 60_000) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): distinct texts (key, body, copies) and their bytes covered by repeated strings (key, start, end)."""
    keyed = _keyed(docs, text)
    texts = keyed.groupBy("key").agg(F.first("body").alias("body"), F.count("*").alias("copies"))
    rows = cut(_anchor_rows(keyed, length), "rows")
    often = cut(rows.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    places = rows.join(often, "anchor").select("key", F.struct("at", (F.col("n") > most).alias("many")).alias("p")).groupBy("key").agg(F.collect_set("p").alias("places"))

    def stretch(batches):
        for batch in batches:
            out: list[tuple] = []
            keys, bodies, chosen = (batch.column(i) for i in range(3))
            data = [utf8(x) for x in bodies.to_pylist()]
            wanted = [{p["at"]: p["many"] for p in x} for x in chosen.to_pylist()]
            keys = keys.to_pylist()
            for row, place, h, first, last in anchors(data, length):
                for at, hash_, lo, hi in zip(place.tolist(), h.tolist(), first.tolist(), last.tolist()):
                    many = wanted[row].get(at)
                    if many is False:
                        out.append((hash_, keys[row], at, lo, data[row][lo : hi + length], None))
                    elif many:
                        for j in range(lo, hi + 1):
                            out.append((hash_, keys[row], at, j, None, hashlib.md5(data[row][j : j + length]).digest()))
                if len(out) > 20_000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], ["anchor", "key", "at", "first", "data", "digest"])

    # All columns of texts, so that this join and the one that ends the work read one shuffle of the texts.
    found = texts.join(places, "key").select("key", "body", "places", "copies").mapInArrow(stretch, "anchor long, key binary, at long, first long, data binary, digest binary")
    spans = _matched(found.where("data is not null").select("anchor", "key", "at", "first", "data"), length)
    if not often.where(F.col("n") > most).isEmpty():
        strings = found.where("digest is not null").select("anchor", (F.col("at") - F.col("first")).alias("place"), "digest", "key", F.col("first").alias("start"), (F.col("first") + length).alias("end"))
        spans = spans.unionByName(_matched_by_string(strings))
    return texts, spans


def _own_repeats(data: bytes, length: int) -> list[tuple[int, int]]:
    """Bytes of strings that equal one a short period earlier, with that one."""
    out = []
    a = np.frombuffer(data, np.uint8)
    for lo in range(0, max(0, len(a) - length), PIECE):
        part = a[max(0, lo - SHORT_PERIOD) : lo + PIECE + length]
        if len(part) <= length:
            continue
        for p in _periods(part):
            equal = np.r_[False, part[p:] == part[:-p], False]
            edge = np.flatnonzero(equal[1:] != equal[:-1])
            for s, e in zip(edge[::2], edge[1::2]):
                if e - s >= length:
                    off = max(0, lo - SHORT_PERIOD)
                    out.append((off + int(s), off + int(e) + p))
    return out


def _kept(data: bytes, copies: int, found: list | None, length: int) -> tuple[int, int, int, bytes]:
    """(bytes, removed bytes, removed runs, the remaining bytes) of a text with the spans that others share."""
    pieces = [(s["start"], s["end"]) for s in found or []] + _own_repeats(data, length)
    if copies > 1 and len(data) >= length:
        pieces = [(0, len(data))]
    kept, removed, runs = [], 0, 0
    end = None
    for s, e in sorted(pieces):
        if end is None or s > end:
            kept.append(data[end or 0 : s])
            runs += 1
            removed += e - s
            end = e
        elif e > end:
            removed += e - end
            end = e
    kept.append(data[end or 0 :])
    return len(data), removed, runs, b"".join(kept)


def _with_spans(docs: DataFrame, text: str, length: int, most: int) -> DataFrame:
    """(key, body, copies, spans) of every distinct text, dealt by key."""
    texts, spans = covered(docs, text, length, most)
    return texts.join(spans.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "key", "left").select("key", "body", "copies", "spans")


def strip_repeats(docs: DataFrame, text: str = "text", length: int = 200, most: int = 60_000, texts_too: bool = True) -> DataFrame:
    """Per distinct text: (key, n_bytes, n_removed, n_spans, kept, kept_sha256).

    kept: the text without the removed bytes; of characters that are cut the rest goes too (null unless texts_too).
    kept_sha256 is that of the remaining bytes as they are.

    Removed is every byte covered by a string of `length` bytes that starts anywhere else too, in the same text or
    another; overlapping strings count, and all are judged on the input. Join on `text_key`.
    Null text: as empty, nothing removed. Exact copies are handled once; if there are two or more and they are long
    enough, all their bytes go. Anchors with over `most` occurrences are compared string by string through counts
    that are added up before they are moved. Very long texts are read in pieces. Repeated rows: one row a distinct
    text. Strings that tie in their anchor's hash take the last place, in every copy alike. Empty table: no rows. Other
    columns are not read.
    """
    def run(batches):
        for batch in batches:
            rows = [(key, *_kept(utf8(body), copies, found, length)) for key, body, copies, found in zip(*(batch.column(i).to_pylist() for i in range(4)))]
            rows = [(*r[:4], r[4].decode("utf-8", "ignore") if texts_too else None, hashlib.sha256(r[4]).hexdigest()) for r in rows]
            if rows:
                kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["key", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return _with_spans(docs, text, length, most).mapInArrow(run, "key binary, n_bytes long, n_removed long, n_spans long, kept string, kept_sha256 string")


def stripped(docs: DataFrame, text: str = "text", length: int = 200, most: int = 60_000) -> DataFrame:
    """docs with each text without its removed bytes (see strip_repeats); a null text stays null, other columns stay as they are.

    The other columns come to the texts, before these are cut: what is kept is not moved again. Repeated rows: each is returned.
    """
    others = [F.col(c) for c in docs.columns if c != text]
    rest = docs.select(text_key(text).alias("key"), F.struct(F.col(text).isNull().alias("__null"), *others).alias("row"))
    joined = _with_spans(docs, text, length, most).join(rest, "key").select("body", "copies", "spans", "row")

    def run(batches):
        for batch in batches:
            left = [_kept(utf8(body), copies, found, length)[3].decode("utf-8", "ignore") for body, copies, found in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(left, pa.string())], ["row", "kept"])

    schema = StructType([joined.schema["row"], StructField("kept", StringType())])
    cut_ = joined.mapInArrow(run, schema)
    return cut_.select(*[F.when(~F.col("row.__null"), F.col("kept")).alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def report(docs: DataFrame, text: str = "text", length: int = 200, most: int = 60_000) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of docs; see strip_repeats."""
    found = strip_repeats(docs, text, length, most, texts_too=False).drop("kept")
    return docs.select("doc_id", text_key(text).alias("key")).join(found, "key").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
