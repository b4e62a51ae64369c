"""The operators against plain Python, and their edge cases: nulls, empty and long texts, ties, repeated rows, no rows."""

import hashlib
import io
import math
import random
import re
import wave
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from linkloom.llm import langid, licenses, lm, media, mixing, packing, quality, simhash, textops, tokencount

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FRAME = "doc_id long, text string, lang string, source string, n_chars long, size int, score string, key string, copies string"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def corpus(n=120, seed=3):
    r = random.Random(seed)
    bits = {"en": "the tion ing er ed th nd st", "fr": "é eau ou è que ment ç ai", "de": "sch ung ö ä ch ei ß ver"}
    rows = []
    for i in range(n):
        lang = r.choice(sorted(bits))
        make = lambda: "".join(r.choice(bits[lang].split()) for _ in range(r.randint(1, 4)))  # noqa: B023, E731
        rows.append((i, " ".join(make() for _ in range(r.randint(1, 90))), lang, f"s{r.choice('AAAABC')}"))
    return rows


def odd():
    long = "word " * 30_000
    return [(900, None, None, None), (901, "", "en", ""), (902, " \n\t\x0b", None, "sA"), (903, long, "en", "sB"), (903, long, "en", "sB"), (None, "no id é", "fr", None), (904, "x" * 70_000, None, "sC"), (905, "<|endoftext|> IT'S  two", "en", "sA")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, s, len(t or ""), 1, "clash", "clash", "clash") for i, t, lang, s in corpus() + odd()]
    return spark.createDataFrame(rows, FRAME).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], FRAME)


# --- word hashes ---------------------------------------------------------------------------------------------------


def test_word_hashes_do_not_depend_on_pieces():
    data = ("Ab cDé " * 500 + "y" * 3000 + " z").encode()
    whole = textops.word_hashes(data)
    assert (textops.word_hashes(data, piece=64) == whole).all() and len(whole) == 1002
    assert whole[0] == textops.word_hashes(b"aB")[0] != whole[1]


# --- 1 language ----------------------------------------------------------------------------------------------------


def test_languages_are_told_apart_and_others_rejected(docs):
    model = langid.fit(docs)
    rows = langid.identify(docs, model).select("doc_id", "lang", "text", "language.*", langid.held_out().alias("held")).collect()
    for r in rows:
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in ("de", "en", "fr") and 0 <= r.score <= 1
        if r.doc_id is not None:
            assert r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    known = [r for r in rows if r.doc_id is not None and r.doc_id < 900 and r.held]
    assert sum(r.lang == r.lang_pred for r in known) >= 0.95 * len(known)
    assert model.predict("привет как дела сегодня хорошо")[2] or model.predict("привет как дела сегодня хорошо")[1] < 0.9


def test_held_out_labels_teach_nothing(docs):
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    a, b = langid.fit(docs), langid.fit(other)
    assert a.languages == b.languages and (a.table == b.table).all()


def test_subwords_of_long_texts_count_each_gram_once(monkeypatch):
    text = "abc déf ghi " * 40
    whole = np.sort(np.concatenate(list(langid.subwords(text, 15))))
    monkeypatch.setattr(langid, "PIECE", 64)
    assert (np.sort(np.concatenate(list(langid.subwords(text, 15)))) == whole).all()


def test_language_without_labels(none, docs):
    from pyspark.sql import functions as F

    model = langid.fit(none)
    assert langid.identify(none, model).count() == 0
    unlabelled = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.identify(docs, unlabelled).select("language.*").collect()} == {"und"}


# --- 2 near copies -------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = WORD.findall(low(text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, differ=4):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= differ:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_near_duplicates_against_all_pairs(spark):
    rows = [(i, t) for i, t, *_ in corpus(60)]
    rows += [(100 + i, t + f" {i}") for i, t in rows[:40]] + [(200 + i, t) for i, t in rows[:10]] + [(300, None), (301, ""), (302, "  "), (303, "One"), (304, "oNE"), (305, "É É"), (306, "é é")]
    prints = [plain_fingerprint(t) for _, t in rows]
    expect = {rows[i][0]: (f"{prints[i]:016x}", rows[c][0]) for i, c in enumerate(plain_components(prints))}
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == expect and len(got) == len(rows)


def clustered(n=700, seed=4):
    r = random.Random(seed)
    seeds = [r.getrandbits(64) for _ in range(25)]
    out = set()
    while len(out) < n:
        f = r.choice(seeds)
        for _ in range(r.randint(0, 7)):
            f ^= 1 << r.randrange(64)
        out.add(f)
    return sorted(out)


@pytest.mark.parametrize("most", [50_000, 8])
def test_index_loses_no_link(spark, most):
    from pyspark.sql import functions as F

    prints = clustered()
    reps = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(prints)], "rep long, f long")
    routed = reps.select(F.explode(simhash.node_keys(F.col("f"), 4)).alias("key"), "f", "rep")
    many = simhash.crowded(reps, 4, most)
    assert (many is None) == (most == 50_000)
    routed = simhash.divided(routed, many, 4, most)
    assert routed.groupBy("key").count().agg({"count": "max"}).first()[0] <= max(most, 20)
    parent = list(range(len(prints)))
    rows = simhash.links(routed, 4).collect()
    for _ in range(30):
        for a, b in rows:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert parent == plain_components(prints)


def test_close_pairs_equal_all_pairs():
    prints = np.array(clustered(), np.uint64)
    run = np.arange(len(prints)) % 3
    order = np.lexsort((simhash.gray_rank(prints), run))
    f, run = prints[order], run[order]
    found = {(int(x), int(y)) for a, b in simhash.close_pairs(run, f, 4) for x, y in zip(np.minimum(a, b), np.maximum(a, b))}
    assert found == {(i, j) for j in range(len(f)) for i in range(j) if run[i] == run[j] and int(f[i] ^ f[j]).bit_count() <= 4}


def test_columns_named_as_a_result_are_replaced_and_others_kept(spark):
    rows = [(1, "mit license one", "a", "b", "c", "d", 7), (None, None, "a", "b", "c", "d", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, language string, licence string, fingerprint string, media string, n_bytes int")
    model = langid.train([("the one", "en"), ("el uno", "es")])
    for out, new in ((langid.identify(docs, model), {"language"}), (licenses.scan(docs), {"licence"}), (simhash.with_fingerprint(docs), {"fingerprint"}), (media.store_texts(docs), {"media", "n_bytes"})):
        assert out.columns == docs.columns and out.count() == 2
        first = out.where("doc_id = 1").first()
        assert all((first[c] == rows[0][i]) == (c not in new) for i, c in enumerate(docs.columns))
    wide = docs.select("*", *[docs.text.alias(c) for c in ("size", "rate", "key", "copies", "kept", "spans", "h", "n", "row")])
    assert mixing.mix(wide, source="language").columns[: len(wide.columns)] == wide.columns and lm.score(wide).count() == simhash.near_duplicates(wide).count() == 2


def test_near_duplicates_odd_rows(docs, none):
    got = simhash.near_duplicates(docs)
    assert got.count() == docs.count() and got.columns == ["doc_id", "fingerprint", "component_id"]
    assert simhash.near_duplicates(none).count() == 0


# --- 3 language model ----------------------------------------------------------------------------------------------


def test_base_scores_are_exact_and_the_model_is_better_on_new_text(docs):
    rows = docs.select("doc_id", "text").collect()
    tokens = [WORD.findall(low(t or "")) + [None] for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows]
    count = Counter(x for t, h in zip(tokens, held) if not h for x in t)
    N, V = sum(count.values()), len(count)
    expect = sorted((str(d), len(t), sum(count[x] > 0 for x in t), N, h, round(sum(math.log10((count[x] + 0.5) / (N + 0.5 * (V + 1))) for x in t), 5)) for (d, _), t, h in zip(rows, tokens, held))
    got = lm.score(docs).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.held_out, round(r.base_score, 5)) for r in got) == expect
    assert all(r.score < 0 for r in got)
    new = [r for r in got if r.held_out]
    assert sum(r.score for r in new) > sum(r.base_score for r in new)


def test_filter_counts_are_never_too_low():
    keys = textops.mix(np.arange(1, 3001, dtype=np.uint64))
    counts = (np.arange(3000) % 50 + 1).astype(np.int64)
    own = lm.LogFrequencyFilter(keys, lm.level(counts))
    read = own.probe(keys)
    assert (read >= lm.level(counts)).all() and (read == lm.level(counts)).mean() > 0.9
    assert (own.probe(textops.mix(np.arange(10_000, 20_000, dtype=np.uint64))) > 0).mean() < 0.1
    assert len(own.bits) <= lm.BITS_PER_ENTRY * lm.level(counts).sum() + lm.BLOCK


def test_language_model_without_rows(none, spark):
    assert lm.score(none).count() == 0
    (row,) = lm.score(spark.createDataFrame([(1, "a")], "doc_id long, text string")).collect()
    assert row.held_out == (zlib.crc32(b"1") % 5 == 1) and row.n_tokens == 2


# --- 4 mixing ------------------------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    rest, open_, out = share * sum(sizes.values()), set(sizes), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if rest * w[s] / total > most * sizes[s]]
        if not over:
            return out | {s: rest * w[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
        rest -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


def test_mix_meets_targets_and_repeats(docs):
    rows = docs.select("doc_id", "text", "source").collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    expect = plain_targets(sizes)
    mixed = mixing.mix(docs)
    assert mixed.columns[: len(docs.columns)] == docs.columns
    out = mixed.select("doc_id", "source", *[mixing.PRE + c for c in ("size", "source_size", "target", "taken", "copies")]).toDF("doc_id", "source", "words", "source_size", "target", "taken", "times").collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(expect[r.source]) and 0 <= r.taken <= 2 * r.words and r.taken == r.times * r.words
    for s in sizes:
        mine = [r for r in out if r.source == s]
        # What single copies of the documents at hand cannot make up stays.
        assert abs(sum(r.taken for r in mine) - expect[s]) <= max((r.words for r in mine), default=0) / 2 + 1
    again = mixing.mix(docs.repartition(7)).select("doc_id", mixing.PRE + "taken").collect()
    assert sorted(map(str, again)) == sorted(str(x) for x in mixed.select("doc_id", mixing.PRE + "taken").collect())


def test_mix_of_equal_documents_is_dealt_by_salt(spark):
    same = spark.createDataFrame([(i, "a b c", "x") for i in range(500)] + [(900 + i, "d " * (i + 1), "y") for i in range(20)], "doc_id long, text string, source string")
    mixed = mixing.mix(same)
    for s, t in plain_targets({"x": 1500, "y": 210}).items():
        assert abs(mixed.where(mixed.source == s).agg({mixing.PRE + "taken": "sum"}).first()[0] - t) <= 3
    kept = mixing.repeat(mixed, same.columns)
    assert kept.columns == same.columns and kept.count() == mixed.agg({mixing.PRE + "copies": "sum"}).first()[0]


def test_mix_of_nothing(none, spark):
    assert mixing.mix(none).count() == 0
    blank = mixing.mix(spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string"))
    assert [r[mixing.PRE + "taken"] for r in blank.collect()] == [0, 0]


# --- 5 packing -----------------------------------------------------------------------------------------------------


def test_pieces_cover_each_document_once(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = docs.where("doc_id is null or doc_id != 903").select("doc_id", "text").collect()
    packed = packing.pack(docs.where("doc_id is null or doc_id != 903")).collect()
    for d, t in rows:
        ids = model.encode(t or "", add_special_tokens=False).ids + [0]
        mine = sorted((p for p in packed if p.doc_id == d), key=lambda p: p.start)
        assert np.frombuffer(b"".join(p.ids for p in mine), "<u4").tolist() == ids
        assert [p.start for p in mine] == [sum(p.length for p in mine[:k]) for k in range(len(mine))]
        assert all(p.doc_tokens == len(ids) and p.offset == 0 and p.length == 1 << p.bucket and p.length <= 1024 for p in mine)
    assert len({p.sequence_id for p in packed}) == len(packed)


def test_packing_of_repeated_rows_and_of_nothing(docs, none):
    twice = packing.pack(docs.where("doc_id = 903")).collect()
    assert len(twice) == 2 * len({p.start for p in twice}) and len({p.sequence_id for p in twice}) == len(twice)
    assert packing.pack(none).count() == 0
    assert [packing.piece_lengths(n, 8) for n in (0, 1, 7, 8, 21)] == [[], [1], [4, 2, 1], [8], [8, 8, 4, 1]]
    assert packing.sequences(packing.pack(docs)).count() <= 11


# --- 7 token counts ------------------------------------------------------------------------------------------------


def test_edits_count_as_a_full_count_would(docs):
    enc = packing.encoder(packing.ranks_path(), {"<|endoftext|>": 50256})
    count = lambda x: len(enc.encode_to_numpy(x, allowed_special="all"))
    r = random.Random(11)
    texts = [t or "" for _, t, *_ in corpus(25) + odd()[:3]] + ["don't  stop\n\n  now " * 60, "x" * 3000, " " * 900, "end. Next\n" * 90]
    for text in texts:
        tree, now = tokencount.TokenTree(text, count), text
        assert tree.tokens == count(text) and tree.text() == text
        for _ in range(12):
            start, cut = r.randrange(len(now) + 3), r.choice((0, 1, 3, 500))
            put = r.choice(("", " ", "a", "\n", " '", "s ", "word two", now[:30]))
            start = min(start, len(now))
            now = now[:start] + put + now[start + cut :]
            tree.edit(start, cut, put)
            assert (tree.text(), tree.tokens, tree.chars) == (now, count(now), len(now))


def test_leaves_stay_short_and_the_tree_flat():
    count = lambda x: len(x.split())
    r, now = random.Random(2), "some words here " * 50
    tree = tokencount.TokenTree(now, count)
    for k in range(400):
        at, cut, put = (400, 0, " more new words of some length for one place " * 5) if k < 200 else (r.randrange(len(now)), r.choice((0, 5, 900)), " tail")
        now = now[:at] + put + now[at + cut :]
        before = tree.encoded
        tree.edit(at, cut, put)
        assert tree.encoded - before <= len(put) + 8 * tokencount.LEAF
        assert tree.chars == len(now)
    assert tree.text() == now and tree.tokens == sum(count(x.text) for x in tree.leaves())
    assert max(x.chars for x in tree.leaves()) <= 3 * tokencount.LEAF

    def deep(node):
        return 1 + max(map(deep, node.kids)) if node.kids else 1

    assert deep(tree.root) <= 2 + math.log(len(tree.leaves()), tokencount.FAN / 4)
    tree.edit(0, len(now), "")
    assert (tree.chars, tree.tokens, tree.text()) == (0, 0, "")
    tree.edit(5, 9, "new start")
    assert tree.text() == "new start"


def test_only_touched_leaves_are_encoded(docs, none):
    from pyspark.sql import functions as F

    enc = packing.encoder(packing.ranks_path(), {"<|endoftext|>": 50256})
    count = lambda x: len(enc.encode_to_numpy(x, allowed_special="all"))
    tree = tokencount.TokenTree("some words here " * 5000, count)
    tree.edit(40_000, 2, "zz")
    assert tree.encoded < 2000
    rows = tokencount.counts(docs.withColumn("e", tokencount.own_edits()), "e").select("text", "e", "counts.*").collect()
    for r in rows:
        now = r.text or ""
        for e in r.e:
            at = min(e.start, len(now))
            now = now[:at] + e.put + now[at + e.cut :]
        assert r.tokens_after == count(now) and r.tokens_before == count(r.text or "")
    nothing = tokencount.counts(docs.withColumn("e", F.lit(None).cast("array<struct<start:int,cut:int,put:string>>")), "e").select("counts.*").collect()
    assert all(r.tokens_before == r.tokens_after and r.chars_encoded_again == 0 for r in nothing)
    assert tokencount.counts(none.withColumn("e", tokencount.own_edits()), "e").count() == 0


# --- 8 quality -----------------------------------------------------------------------------------------------------


def plain_statistics(t):
    t = t or ""
    words, seen, dup = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, cover = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            cover.update(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


def test_statistics_against_plain_python(spark, docs):
    texts = [t for _, t, *_ in corpus(40) + odd()] + ["a b c d e f a b c d e", "x\nx\n\n \nx y\nx", "one " * 12, "#|# <é>𝒳 " * 3, "a b c d e a b c d e a b c d e f"]
    rows = quality.statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_statistics(texts[r.doc_id])


def labelled(spark, n=400):
    r = random.Random(2)
    rows, marks = [], []
    for i in range(n):
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(r.randint(20, 60))]
        kind = r.random()
        if kind < 0.15:
            words = [w.upper() + "!!" for w in words]
        elif kind < 0.25:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words)))
        if i % 2:
            marks.append((i, int(kind >= 0.25)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int"), dict(marks)


def test_rules_find_bad_documents_and_spare_the_rest(spark):
    docs, labels, marks = labelled(spark)
    out = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert len(out) == 400 and all(out[i].kept == bool(q) for i, q in marks.items())
    assert not any(r.base_failed for r in out.values())
    assert {r.rule for r in out.values() if r.kept} == {0}


def test_rules_without_labels_and_without_rows(spark, docs, none):
    nothing = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.judge(docs, nothing).collect()
    assert len(out) == docs.count()
    for r in out:
        n, *_, repeated = (r.n_words, r.n_repeat_words)
        assert r.base_failed == (n < 10 or 100 * repeated > 20 * n) and r.kept == (not r.base_failed) and r.rule == 0
    assert quality.judge(none, nothing).count() == 0


# --- 9 licences ----------------------------------------------------------------------------------------------------


def plain_licences(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text or ""))
    hits = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


def test_licence_phrases_against_plain_python(spark):
    texts = [None, "", "Released under the MIT License.", "mit license mit-license MIT\nLicense", "emit license, apache licensed, Apache_License; the Lesser General Public License", "éMIT License MIT Licenseé", "general public license " * 3, "CC BY-NC 4.0", "x" * 100_000 + " mit license"]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "licence.*").collect()
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_licences(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    by = {r.doc_id: r for r in rows}
    assert by[7].labels == "cc-by-nc" and by[4].labels == "apache,gpl,lgpl" and by[1].score == 0 and by[2].score > 0.8


def test_licence_expressions():
    assert licenses.postfix("MIT OR (GPL-2.0-only WITH Classpath-exception-2.0 AND ISC)") == ["MIT", "GPL-2.0-only", "Classpath-exception-2.0", "with", "ISC", "and", "or"]
    assert licenses.evaluate("MIT OR GPL-3.0-only") == (frozenset({"mit", "gpl"}), 1)
    assert licenses.evaluate("MIT AND GPL-3.0-only")[1] == 3 and licenses.evaluate("GPL-2.0 WITH x")[1] == 2
    for bad in ("", "AND MIT", "MIT OR", "(MIT", "MIT)", "()"):
        assert licenses.evaluate(bad) is None
    row = licenses.scan_text("// SPDX-License-Identifier: (Apache-2.0 OR MIT)\nint x;", licenses.automaton())
    assert row["labels"] == "apache,mit" and row["duty"] == 1 and row["expressions"] == "Apache-2.0 MIT or"


def test_licences_keep_other_columns(docs, none):
    assert licenses.scan(docs).columns == [*docs.columns, "licence"] and licenses.scan(none).count() == 0


# --- 10 media ------------------------------------------------------------------------------------------------------


def test_texts_survive_the_store(docs, none):
    rows = media.read_back(media.store_texts(docs)).select("text", "media", "n_bytes", "samples.*").collect()
    for r in rows:
        raw = (r.text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        with wave.open(io.BytesIO(r.media)) as f:
            assert (f.getsampwidth(), f.getnchannels()) == (1, 1) and f.readframes(f.getnframes()) == payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest()) and r.feature.startswith("text/plain;min=")
    assert media.store_texts(none).count() == 0


def pdf(body=b"1 0 obj\n<<>>\nendobj\n"):
    head = b"%PDF-1.4\n" + body
    return head + b"xref\n0 1\n0000000000 65535 f \ntrailer\n<<>>\nstartxref\n" + str(len(head)).encode() + b"\n%%EOF"


def flac(frames=3, total=None):
    """Frames of 192 zero samples, 8 bits, one channel: constant subframes."""

    def crc(data, poly, bits):
        out = 0
        for x in data:
            out ^= x << bits - 8
            for _ in range(8):
                out = (out << 1 ^ poly if out >> bits - 1 else out << 1) & (1 << bits) - 1
        return out.to_bytes(bits // 8, "big")

    n = frames * 192 if total is None else total
    out = b"fLaC" + bytes([0x80, 0, 0, 34]) + b"\0\xc0\0\xc0" + bytes(6) + ((8000 << 44) | (7 << 36) | n).to_bytes(8, "big") + bytes(16)
    for k in range(frames):
        frame = bytes([0xFF, 0xF8, 0x14, 0x02, k])
        frame += crc(frame, 7, 8) + bytes([0, k])
        out += frame + crc(frame, 0x8005, 16)
    return out


def files():
    import gzip
    import struct
    import zipfile

    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("a.txt", "hello")
    bmp = b"BM" + struct.pack("<IIII", 58, 0, 54, 40) + bytes(40)
    return {"image/png": png, "image/gif": gif, "application/zip": box.getvalue(), "audio/wav": media.wav(b"abcd"), "application/gzip": gzip.compress(b"x" * 99), "image/bmp": bmp, "application/pdf": pdf()}


def test_types_are_corrected_and_content_carved(spark):
    known = files()
    rows = [(k, bytearray(v), "image/jpeg") for k, v in known.items()] + [("none", None, None), ("junk", bytearray(b"BM RIFF GIF89a PK\x03\x04"), "text/plain")]
    rows.append(("mixed", bytearray(b"ab" + known["image/png"] + b"--" + known["image/gif"] + b"zz"), "image/png"))
    out = {r.name: r.media for r in media.identify(spark.createDataFrame(rows, "name string, content binary, said string"), declared="said").collect()}
    for kind, data in known.items():
        assert out[kind].type == kind and out[kind].corrected and [(x.start, x.length) for x in out[kind].items] == [(0, len(data))]
    assert out["none"].type is None and out["junk"].type == "application/octet-stream" and not out["junk"].items
    found = out["mixed"]["items"]
    assert [(x.type, x.sha256) for x in found] == [(k, hashlib.sha256(known[k]).hexdigest()) for k in ("image/png", "image/gif")]


def test_items_end_where_their_format_says():
    known, found = files(), media.automaton()
    for total in (None, 0):
        data = b"xx" + flac(total=total) + known["audio/wav"] + b"fLaC" + flac()[4:30] + known["image/png"]
        assert [x[2] for x in media.sniff(data, found)] == ["audio/flac", "audio/wav", "image/png"]
        assert media.sniff(data, found)[0][:2] == (2, len(flac()))
    assert not media.sniff(flac()[:-3] + b"zzz", found)
    # A wrong head before a right file, a file inside another, two in a row.
    data = b"%PDF-1.7 not one " + pdf() + b"PK\x03\x04" + known["application/zip"] + pdf(b"1 0 obj\n" + known["image/gif"] + b"\nendobj\n")
    assert [x[2] for x in media.sniff(data, found)] == ["application/pdf", "application/zip", "application/pdf"]
    assert media.sniff(b"%PDF-1.7 not one " + pdf(), found) == [(17, len(pdf()), "application/pdf")]


@pytest.mark.parametrize("part", [b"%PDF-1 ", b"GIF89a!! ,;x" * 3 + b"!!  ", b"PK\x03\x04 PK\x05\x06" + bytes(18), b"RIFF    WAVE", b"BM  \0\0 \0\0\0", b"\xff\xd8\xff\xda\0\2 ", b"\x1f\x8b\x08 ", b"OggS\0\2" + bytes(20) + b"\1 ", b"fLaC\0\0\0\x22" + b"\0" * 34, b"startxref 12 %%EOF xref %PDF-1"])
def test_repeated_magic_bytes_take_linear_time(part):
    import time

    data, found = part * (1_000_000 // len(part)), media.automaton()
    began = time.process_time()
    media.sniff(data, found)
    assert time.process_time() - began < 10


def chained(kind: str, n: int) -> bytes:
    """Heads that each lead to one shared chain."""
    import struct
    import zlib as z

    if kind == "wav":
        heads, tail = n // 64, b"junk\0\0\0\0" * (n // 16)
        total = heads * 32 + len(tail)
        return b"".join(b"RIFF" + struct.pack("<I", total - 32 * i - 8) + b"WAVEjunk" + struct.pack("<I", 32 * (heads - i) - 20) + b"\0" * 8 for i in range(heads)) + tail
    if kind == "png":
        head = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + (ihdr := b"IHDR" + b"\0" * 13) + struct.pack(">I", z.crc32(ihdr))
        size, heads = len(head) + 8, n // 2 // (len(head) + 8)
        total = heads * size + n // 2
        return b"".join(head + struct.pack(">I", total - i * size - len(head) - 12) + b"IDAT" for i in range(heads)) + b"x" * (n // 2)
    head = b"\x1f\x8b\x08\0\0\0\0\0\0\0"
    heads = min(n // 2 // 15, 65_000 // 15)
    block = lambda m: b"\0" + struct.pack("<HH", m, m ^ 0xFFFF)
    return b"".join(head + block(15 * (heads - i) - 15) for i in range(heads)) + block(0) * (n // 10)


@pytest.mark.parametrize("kind", ["wav", "png", "gzip"])
def test_heads_of_one_chain_take_linear_time(kind):
    import time

    data, found = chained(kind, 1_000_000), media.automaton()
    began = time.process_time()
    assert media.sniff(data, found) == []
    assert time.process_time() - began < 10


def test_sums_of_ranges_and_gzip_items():
    import gzip
    import zlib as z

    rng = random.Random(3)
    data = rng.randbytes(20_000)
    buffer = media.Buffer(data)
    for _ in range(50):
        a, b = sorted((rng.randrange(20_001), rng.randrange(20_001)))
        assert buffer.crc32(a, b) == z.crc32(data[a:b])
    found = media.automaton()
    for level in (0, 1, 9):
        for body in (b"", b"a", b"text " * 4000, rng.randbytes(200_000)):
            item = gzip.compress(body, level)
            named = item[:3] + b"\x08" + item[4:10] + b"name\0" + item[10:]
            for one in (item, named):
                assert media.sniff(b"xx" + one + b"yy", found)[:1] == [(2, len(one), "application/gzip")]
                broken = one[:-6] + bytes([one[-6] ^ 1]) + one[-5:]
                assert (2, len(one), "application/gzip") not in media.sniff(b"xx" + broken, found)
    # A stored block, then coded ones that repeat it.
    c = z.compressobj(9, z.DEFLATED, -15)
    body = rng.randbytes(500)
    stored = b"\0" + len(body).to_bytes(2, "little") + (len(body) ^ 0xFFFF).to_bytes(2, "little") + body
    d = z.compressobj(9, z.DEFLATED, -15, zdict=body)
    coded = d.compress(body * 3) + d.flush()
    whole = b"\x1f\x8b\x08\0\0\0\0\0\0\0" + stored + coded + z.crc32(body * 4).to_bytes(4, "little") + (len(body) * 4).to_bytes(4, "little")
    assert c and media.sniff(whole, found) == [(0, len(whole), "application/gzip")]


def test_licence_places_equal_brute_force():
    rng, found = random.Random(5), licenses.automaton()
    for _ in range(500):
        words = [rng.choice("mit license apache general public x é foo 3".split()) for _ in range(rng.randint(0, 30))]
        want = [i for p in licenses.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        got = licenses.scan_text(", ".join(words), found)
        assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"]) == (len(words), len(want), min(want, default=None), max(want, default=None))


def test_token_counts_and_packing_read_special_tokens_alike(spark):
    docs = spark.createDataFrame([(1, "One two.  <|endoftext|> three" + " and more words" * 300 + " <|endoftext|>")], "doc_id long, text string")
    counted = tokencount.counts(docs.withColumn("e", tokencount.own_edits()), "e").select("counts.tokens_before").first()[0]
    assert counted + 1 == packing.pack(docs).agg({"length": "sum"}).first()[0]
