"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Counts of words and word pairs are gathered from all training texts. A gram of count c is entered once for each
quantised level up to that of c; its count is read back by probing level after level until one is absent. The
filters hold every gram, so they grow with the input; they are written in slices, and those are the model. Where they are
small enough they are broadcast and texts are scored where they lie; else the distinct grams of each block of texts are sent to
their slices, probed there, and their levels sent back. The table that the model is learnt from is scored in the same pass:
its grams are at the slices already. There words also bring their exact counts, from which the base follows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.langid import held_out
from linkloom.llm.textops import groups, mix, utf8, word_hashes
from linkloom.session import cut, folder

END = np.uint64(0x6A09E667F3BCC909)
START = np.uint64(0xBB67AE8584CAA73B)
#: Pairs are told apart by 48 bits, far below the filter's own error; words, which are counted exactly, by 64.
PAIR_MASK = np.uint64(0xFFFFFFFFFFFF0000)
BLOCK = 512
PROBES = 4
BITS_PER_ENTRY = 8
#: Bytes of text in a block, tokens in a packed row of texts, bytes of text whose grams may fall to one slice.
TEXT_BLOCK = 1 << 24
TEXT_ROW = 1 << 16
PER_SLICE = 400_000_000
SENT = "place int, block long, part int, keys binary, counts binary, ids array<long>, held array<boolean>, n array<long>"
BACK = "block long, part int, a binary, b binary, c binary, stats array<long>, ids array<long>, held array<boolean>, n array<long>, filter binary, filter_blocks long"
#: A model whose filters have fewer bytes is broadcast.
BROADCAST = 200_000_000
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _bounds() -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 61:
        out.append(max(out[-1] + 1, -(-out[-1] * 5 // 4)))
    return np.array(out, np.int64)


#: Least count of each level; steps of one quarter.
BOUNDS = _bounds()
#: What a level stands for: the middle of its counts; level 0 for 0.
VALUES = np.r_[0.0, (BOUNDS[:-1] + BOUNDS[1:] - 1) / 2, float(BOUNDS[-1])]


def level(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(BOUNDS, counts, "right")


@dataclass(frozen=True)
class Slices:
    """How grams are dealt out: pairs and words by the leading bits of their hashes; behind both come what a block's ranks mean, then its texts."""

    pair_bits: int = 12
    word_bits: int = 10

    @property
    def pairs(self) -> int:
        return 1 << self.pair_bits

    @property
    def grams(self) -> int:
        return self.pairs + (1 << self.word_bits)

    @property
    def text_block(self) -> int:
        """Bytes of text in a block: more, up to four times, where there are more slices for its grams to spread over."""
        return TEXT_BLOCK << min(2, max(0, self.pair_bits - 12) // 3)

    @property
    def ranks(self) -> int:
        return self.grams

    @property
    def texts(self) -> int:
        return self.grams + 1


def planned(n_bytes: int) -> Slices:
    """Slices for that much text: 4,096 of pairs up to 1.6 TB, then more, so that none outgrows a task's memory."""
    more = max(0, (max(1, n_bytes) // PER_SLICE).bit_length() - 12)
    return Slices(min(24, 12 + more), min(22, 10 + more))


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, compressed."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T), codec="zstd", asbytes=True)


def _unplanes(data: bytes, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    plane = np.frombuffer(pa.decompress(data, decompressed_size=width * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(plane.reshape(width, n).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, bytes of equal weight together: their common zeros compress away in the shuffle."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    plane = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, len(data) // 8).T)
    return np.cumsum(plane.view("<u8").ravel(), dtype=np.uint64)


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts in a row, an end behind each, and the number of each text's tokens."""
    parts, n = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = word_hashes(utf8(text))
        parts += [words, np.array([END])]
        n[i] = len(words) + 1
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), n


def before(grams: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The token before each one; a start at the head of each text."""
    out = np.empty_like(grams)
    out[1:] = grams[:-1]
    out[np.cumsum(n) - n] = START
    return out


def pairs(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context * np.uint64(0x9E3779B97F4A7C15) + word) & PAIR_MASK


def positions(keys: np.ndarray, at: int, blocks: int | np.ndarray) -> np.ndarray:
    """Bit places of level `at` inside the key's slice: (keys, probes), all in one block."""
    x = mix(keys ^ np.uint64((at * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
    y = mix(x)
    base = ((x >> np.uint64(20)) % np.asarray(blocks, np.uint64)) * np.uint64(BLOCK)
    return np.stack([base + ((y >> np.uint64(9 * i)) & np.uint64(BLOCK - 1)) for i in range(PROBES)], axis=1)


class LogFrequencyFilter:
    """The filter of one slice, with BITS_PER_ENTRY bits for each level that a key is entered at."""

    def __init__(self, keys: np.ndarray, own: np.ndarray):
        """Enter each key at every level from the first to its own."""
        keys, own = keys[own > 0], own[own > 0]
        self.blocks = max(1, -(-int(own.sum()) * BITS_PER_ENTRY // BLOCK))
        self.bits = np.zeros(self.blocks * BLOCK, bool)
        for at in range(1, int(own.max(initial=0)) + 1):
            keys, own = keys[own >= at], own[own >= at]
            self.bits[positions(keys, at, self.blocks)] = True

    def packed(self) -> bytes:
        return np.packbits(self.bits, bitorder="little").tobytes()

    @classmethod
    def unpacked(cls, blocks: int, bits: bytes) -> LogFrequencyFilter:
        out = cls.__new__(cls)
        out.blocks, out.bits = blocks, np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)
        return out

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """Quantised level of each key, 0 where the lowest probe fails; never too low."""
        out = np.zeros(len(keys), np.int64)
        alive, at = np.arange(len(keys)), 1
        while len(alive) and at < len(VALUES):
            alive = alive[self.bits[positions(keys[alive], at, self.blocks)].all(axis=1)]
            out[alive] = at
            at += 1
        return out


class FilterSet:
    """The filters of all slices side by side, for tasks that score texts where they lie."""

    def __init__(self, dealt: Slices, rows: list[tuple[int, int, bytes]]):
        """rows: slice, blocks, packed bits; a slice that no gram fell to has none."""
        self.dealt = dealt
        self.blocks, self.begin = np.zeros(dealt.grams, np.int64), np.zeros(dealt.grams, np.int64)
        at = 0
        for place, blocks, _ in rows:
            self.blocks[place], self.begin[place] = blocks, at
            at += blocks * BLOCK
        self.bits = np.frombuffer(b"".join(bits for *_, bits in rows), np.uint8)

    def probe(self, keys: np.ndarray, words: bool) -> np.ndarray:
        """Quantised level of each pair or word, as LogFrequencyFilter.probe has it."""
        bits, first = (self.dealt.word_bits, self.dealt.pairs) if words else (self.dealt.pair_bits, 0)
        place = (keys >> np.uint64(64 - bits)).astype(np.int64) + first
        out = np.zeros(len(keys), np.int64)
        alive, at = np.flatnonzero(self.blocks[place] > 0), 1
        while len(alive) and at < len(VALUES):
            where = self.begin[place[alive]][:, None] + positions(keys[alive], at, self.blocks[place[alive]].astype(np.uint64)).astype(np.int64)
            alive = alive[(self.bits[where >> 3] >> (where & 7).astype(np.uint8) & 1).all(axis=1)]
            out[alive] = at
            at += 1
        return out


@dataclass(frozen=True)
class Model:
    """total, kinds, texts: N, V and the number of training texts; pull: the weight of the word model."""

    total: int
    kinds: int
    texts: int
    pull: float = 1.0

    def chance(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.total + 0.5 * (self.kinds + 1))

    def smoothed(self, both: np.ndarray, context: np.ndarray, own: np.ndarray, alone: np.ndarray) -> np.ndarray:
        """log10 probability from the counts of pair, context and word, and the word's own chance."""
        both = np.minimum(both, np.minimum(context, own))
        return np.log10((both + self.pull * alone) / (context + self.pull))


def pull(mass: list[tuple[float, float]], singles: int, total: int) -> float:
    """The weight at which the share of tokens left to the word model equals the share of pairs seen once.

    mass: (count, tokens) of words by level. The share is the Turing estimate of meeting a new pair; both sides cover all
    training data.
    """
    if not total:
        return 1.0
    share = min(0.999, max(0.001, singles / total))
    low, high = 1e-3, 1e12
    for _ in range(100):
        mid = (low * high) ** 0.5
        if sum(m * mid / (c + mid) for c, m in mass) / total < share:
            low = mid
        else:
            high = mid
    return (low * high) ** 0.5


def _rows(schema: pa.Schema, n: int, /, **columns) -> pa.RecordBatch:
    """n rows of the schema; columns that are not given are null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def send(marked: DataFrame, dealt: Slices) -> DataFrame:
    """Of each block of texts: its distinct pairs and words by slice, with training counts (0 if only held-out texts
    have them); which word each rank by frequency is; and the texts as ranks.
    """
    schema = _arrow(SENT)

    def grams_by_slice(block: int, keys: np.ndarray, counts: np.ndarray, bits: int, first: int) -> pa.RecordBatch:
        place = (keys >> np.uint64(64 - bits)).astype(np.int32) + np.int32(first)
        begin = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        ends = np.append(begin[1:], len(keys))
        packed = [pack_keys(keys[a:b]) for a, b in zip(begin, ends)]
        return _rows(schema, len(begin), place=place[begin], part=place[begin], block=np.full(len(begin), block), keys=packed, counts=[_planes(counts[a:b].astype("<u4")) for a, b in zip(begin, ends)])

    def run(batches):
        task = TaskContext.get().partitionId() << 33
        block = 0
        for batch in batches:
            ids, texts, held = batch.column(0), batch.column(1), batch.column(2)
            for a, b in groups([len(x or b"") for x in texts.cast(pa.binary()).to_pylist()], dealt.text_block):
                grams, n = tokens(texts.slice(a, b - a).to_pylist())
                mine, own_ids = held.slice(a, b - a).to_numpy(zero_copy_only=False).astype(bool), ids.slice(a, b - a)
                train = np.repeat(~mine, n)
                words, own = np.unique(grams, return_inverse=True)
                links, code = np.unique(pairs(before(grams, n), grams), return_inverse=True)
                by_rank = np.argsort(-np.bincount(own), kind="stable")
                rank = np.empty_like(by_rank)
                rank[by_rank] = np.arange(len(words))
                where = task + block
                block += 1
                yield grams_by_slice(where, links, np.bincount(code[train], minlength=len(links)), dealt.pair_bits, 0)
                yield grams_by_slice(where, words, np.bincount(own[train], minlength=len(words)), dealt.word_bits, dealt.pairs)
                yield _rows(schema, 1, place=[where % dealt.grams], part=[dealt.ranks], block=[where], keys=[_planes(by_rank.astype("<u4"))], n=[[len(words)]])
                ranks, at = rank[own].astype("<u4"), np.append(0, np.cumsum(n))
                for k, (i, j) in enumerate(groups(n.tolist(), TEXT_ROW)):
                    yield _rows(schema, 1, place=[(where + k) % dealt.grams], part=[dealt.texts], block=[where], keys=[_planes(ranks[at[i] : at[j]])], ids=[own_ids.slice(i, j - i).to_pylist()], held=[mine[i:j].tolist()], n=[n[i:j].tolist()])

    return marked.select("doc_id", "text", "held_out").mapInArrow(run, SENT)


#: Places in the stats of a slice: pairs seen once; tokens, words and ends in training; then words and tokens by level.
SINGLES, TOTAL, KINDS, ENDS, LEVELS = 0, 1, 2, 3, 4


def slices(sent: DataFrame, dealt: Slices, filters: DataFrame | None = None) -> DataFrame:
    """What `send` sent, with the levels of grams in their place: each slice's filter is built from all its training
    counts, at eight bits an entry, kept in the slice's first row, and probed once for each gram that any block has. Words keep
    their keys, from which those of pairs follow, and their exact counts. A task holds one slice at a time.

    filters (part, blocks, bits): the filters of a model. Then those are probed, counts are not read, and words have the
    counts that their levels stand for.
    """
    schema, saved = _arrow(BACK), filters is not None
    if filters is not None:
        none = F.lit(None)
        given = filters.select(F.col("part").alias("place"), F.lit(-1).cast("long").alias("block"), "part", F.col("bits").alias("keys"), none.cast("binary").alias("counts"), none.cast("array<long>").alias("ids"), none.cast("array<boolean>").alias("held"), F.array(F.col("blocks").cast("long")).alias("n"))
        sent = sent.unionByName(given)

    def probed(held: list[tuple]) -> pa.RecordBatch | None:
        """The levels of a slice's grams by the model's filter, which comes first; without one no gram is known."""
        own = LogFrequencyFilter.unpacked(held[0][4][0], held[0][2]) if held[0][0] < 0 else None
        held = held[1:] if own else held
        if not held:
            return None
        grams = [unpack_keys(x[2]) for x in held]
        levels = [(own.probe(k) if own else np.zeros(len(k), np.int64)).astype(np.uint8) for k in grams]
        words, n = held[0][1] >= dealt.pairs, len(held)
        return _rows(
            schema, n, block=[x[0] for x in held], part=[x[1] for x in held], a=[pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in levels], b=[x[2] if words else None for x in held],
            c=[_planes(np.rint(VALUES[x]).astype(np.int64)) for x in levels] if words else [None] * n, n=[[len(k)] for k in grams],
        )

    def flush(held: list[tuple]) -> pa.RecordBatch | None:
        if saved:
            return probed(held)
        held = [x[:4] for x in held]
        grams = [unpack_keys(k) for *_, k, _ in held]
        keys, at = np.unique(np.concatenate(grams), return_inverse=True)
        given = np.concatenate([_unplanes(c, len(k), "<u4") for k, (*_, c) in zip(grams, held)])
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, at, given.astype(np.int64))
        own = level(counts)
        filled = LogFrequencyFilter(keys, own)
        read = filled.probe(keys).astype(np.uint8)[at]
        cuts = np.cumsum([len(k) for k in grams])[:-1]
        words, n = held[0][1] >= dealt.pairs, len(held)
        if words:
            ends = int(counts[keys == END].sum())
            stats = [0, int(counts.sum()), int((counts > 0).sum()), ends, *np.bincount(own, minlength=len(VALUES)).tolist(), *np.bincount(own, weights=counts, minlength=len(VALUES)).astype(np.int64).tolist()]
        else:
            stats = [int((counts == 1).sum())]
        return _rows(
            schema, n, block=[x[0] for x in held], part=[x[1] for x in held], a=[pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in np.split(read, cuts)], b=[x[2] if words else None for x in held],
            c=[_planes(x) for x in np.split(counts[at], cuts)] if words else [None] * n, stats=[stats] + [None] * (n - 1), n=[[len(k)] for k in grams],
            filter=[filled.packed()] + [None] * (n - 1), filter_blocks=[filled.blocks] + [None] * (n - 1),
        )

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            part = batch.column("part").to_numpy()
            rest = batch.filter(pa.array(part >= dealt.grams))
            if rest.num_rows:
                yield pa.RecordBatch.from_arrays([rest.column("keys" if f.name == "a" else f.name) if f.name in ("a", "block", "part", "ids", "held", "n") else pa.nulls(rest.num_rows, f.type) for f in schema], schema=schema)
            for x in zip(*(batch.filter(pa.array(part < dealt.grams)).column(c).to_pylist() for c in ("block", "part", "keys", "counts", "n"))):
                if held and held[0][1] != x[1]:
                    if (out := flush(held)) is not None:
                        yield out
                    held = []
                held.append(x)
        if held and (out := flush(held)) is not None:
            yield out

    by = ["place", "part"] + (["block"] if saved else [])
    return sent.repartition("place").sortWithinPartitions(*by).mapInArrow(run, BACK)


def learnt(back: DataFrame) -> Model:
    """N, V, the number of training texts and the weight, added up over the slices: some 400 numbers."""
    sums = {r.at: r.n for r in back.where("stats is not null").select(F.posexplode("stats").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("n")).collect()}
    number = lambda at: int(sums.get(at, 0))
    held = [(number(LEVELS + j), number(LEVELS + len(VALUES) + j)) for j in range(len(VALUES))]
    model = Model(number(TOTAL), number(KINDS), number(ENDS))
    return replace(model, pull=pull([(m / n, m) for n, m in held if n and m], number(SINGLES), model.total))


def gather(back: DataFrame, model: Model, dealt: Slices) -> DataFrame:
    """The texts with their scores: a block's levels come first, in the order of its grams, then its texts."""
    schema = _arrow(SCHEMA)

    def run(batches):
        block = None
        read: tuple[list, list] = ([], [])
        keys, exact, texts, ranks = [], [], [], None

        def flush() -> pa.RecordBatch:
            both, count = (VALUES[np.frombuffer(b"".join(x), np.uint8)] for x in read)
            words, counts = np.concatenate(keys), np.concatenate(exact)
            n = np.concatenate([np.array(x[2], np.int64) for x in texts])
            own = ranks[np.concatenate([_unplanes(a, sum(m), "<u4") for a, _, m, _ in texts])]
            at = np.cumsum(n) - n
            context = np.empty_like(own)
            context[1:], context[at] = own[:-1], len(words)
            grams = words[own]
            links, code = np.unique(pairs(before(grams, n), grams), return_inverse=True)
            if not len(links) == len(both) or not len(ranks) == len(words) == len(count) == len(counts):
                raise ValueError(f"block {block}: {len(both)} pairs and {len(count)} words came back")
            chances = model.smoothed(both[code], np.append(count, model.texts)[context], count[own], model.chance(count)[own])
            return _rows(
                schema, len(n), doc_id=[i for x in texts for i in x[1]], held_out=[h for x in texts for h in x[3]], n_tokens=n, n_known=np.add.reduceat((counts > 0).astype(np.int64)[own], at),
                base_score=np.add.reduceat(np.log10(model.chance(counts))[own], at), score=np.add.reduceat(chances, at),
            )

        for batch in batches:
            for where, part, a, b, c, ids, held, n in zip(*(batch.column(x).to_pylist() for x in ("block", "part", "a", "b", "c", "ids", "held", "n"))):
                if where != block:
                    if texts:
                        yield flush()
                    block, read, keys, exact, texts = where, ([], []), [], [], []
                if part < dealt.grams:
                    read[part >= dealt.pairs].append(pa.decompress(a, decompressed_size=n[0], codec="zstd", asbytes=True))
                    if part >= dealt.pairs:
                        keys.append(unpack_keys(b))
                        exact.append(_unplanes(c, n[0], "<i8"))
                elif part == dealt.ranks:
                    ranks = _unplanes(a, n[0], "<u4")
                else:
                    texts.append((a, ids, n, held))
        if texts:
            yield flush()

    return back.drop("stats", "filter", "filter_blocks").repartition("block").sortWithinPartitions("block", "part").mapInArrow(run, SCHEMA)


@dataclass(frozen=True)
class Fitted:
    """A model on disk: its numbers, how grams are dealt out, and the folder of its filters (part, blocks, bits)."""

    model: Model
    dealt: Slices
    path: str

    def save(self, spark, path: str) -> Fitted:
        """The model in a folder of its own: filters and one row of numbers."""
        spark.read.parquet(self.path).where("filter is not null").select("part", F.col("filter_blocks").alias("blocks"), F.col("filter").alias("bits")).write.parquet(f"{path}/filters")
        m = self.model
        spark.createDataFrame([(m.total, m.kinds, m.texts, float(m.pull), self.dealt.pair_bits, self.dealt.word_bits)], "total long, kinds long, texts long, pull double, pair_bits int, word_bits int").coalesce(1).write.parquet(f"{path}/numbers")
        return replace(self, path=f"{path}/filters")

    @staticmethod
    def load(spark, path: str) -> Fitted:
        r = spark.read.parquet(f"{path}/numbers").first()
        return Fitted(Model(r.total, r.kinds, r.texts, r.pull), Slices(r.pair_bits, r.word_bits), f"{path}/filters")

    def score(self, docs: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
        """(doc_id, n_tokens, n_known, score) of any table's whole texts, from the saved filters alone.

        Filters of up to `broadcast` bytes (their sizes are added up first) go to every task, which scores texts where they lie; larger ones
        stay in slices and grams are sent to them. Both give the same rows. n_known counts tokens that the filter knows.
        Null text: empty, one end token. Repeated rows: each is scored. Empty table: no rows.
        """
        spark, model, dealt = docs.sparkSession, self.model, self.dealt
        filters = spark.read.parquet(self.path)
        given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        size = filters.agg(F.coalesce(F.sum(F.octet_length("bits")), F.lit(0)).alias("n")).first().n
        if size > broadcast:
            back = cut(slices(send(given.withColumn("held_out", F.lit(True)), dealt), dealt, filters), "levels")
            return gather(back, model, dealt).select("doc_id", "n_tokens", "n_known", "score")
        sent = spark.sparkContext.broadcast([tuple(r) for r in filters.select("part", "blocks", "bits").collect()])

        def run(batches):
            known = FilterSet(dealt, sent.value)
            for batch in batches:
                for a, b in groups([len(x or b"") for x in batch.column(1).cast(pa.binary()).to_pylist()], 1 << 20):
                    grams, n = tokens(batch.column(1).slice(a, b - a).to_pylist())
                    at = np.cumsum(n) - n
                    words, own = np.unique(grams, return_inverse=True)
                    links, code = np.unique(pairs(before(grams, n), grams), return_inverse=True)
                    count, both = VALUES[known.probe(words, True)], VALUES[known.probe(links, False)]
                    context = np.empty(len(own), np.float64)
                    context[1:], context[at] = count[own][:-1], model.texts
                    chances = model.smoothed(both[code], context, count[own], model.chance(count)[own])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(np.add.reduceat((count > 0).astype(np.int64)[own], at)), pa.array(np.add.reduceat(chances, at))], ["doc_id", "n_tokens", "n_known", "score"])

        return given.mapInArrow(run, "doc_id long, n_tokens long, n_known long, score double")


def _fitted(docs: DataFrame, folds: int) -> tuple[Fitted, DataFrame]:
    """The model learnt from docs outside the held-out fold, and what scoring docs themselves still takes."""
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out(folds=folds))
    n_bytes = marked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    dealt = planned(n_bytes)
    path = f"{folder(docs.sparkSession)}/levels-{uuid.uuid4().hex}"
    slices(send(marked, dealt), dealt).write.option("compression", "zstd").parquet(path)
    back = docs.sparkSession.read.schema(BACK).parquet(path)
    return Fitted(learnt(back), dealt, path), back


def fit(docs: DataFrame, path: str, folds: int = 5) -> Fitted:
    """Learn from the texts outside the held-out fold and save the model at path; see Fitted.score and Fitted.load."""
    return _fitted(docs, folds)[0].save(docs.sparkSession, path)


def score(docs: DataFrame, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document, whole texts.

    score: log10 probability under the pair model, learnt from every text outside the held-out fold; its filters hold
    every gram whatever the input. base_score and n_known use exact counts. The tables are cut into blocks of about 16 MB
    of text; a longer text is a block of its own, held by one task as 8 bytes a token.
    Null text: empty, one end token. Null doc_id: in the training part, held_out false. Repeated rows: each is
    counted and scored. Texts that tie have equal scores. No training text: every probability is the smoothing's.
    Empty table: no rows. Other columns are not read.
    """
    made, back = _fitted(docs, folds)
    scored = gather(back, made.model, made.dealt)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(made.model.total).cast("long").alias("train_tokens"), "base_score", "score")
