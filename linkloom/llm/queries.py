"""The registered queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import langid, licenses, lm, media, mixing, negatives, packing, quality, sharding, simhash, spelling, suffixes, tokencount
from linkloom.session import table


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs)
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "language.lang_pred", "language.score", "language.rejected")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", *[F.col(mixing.PRE + c).alias(c) for c in ("size", "source_size", "target", "taken", "copies", "rate")])


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(table(spark, sf_dir, "documents"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("edits", tokencount.own_edits())
    return tokencount.counts(docs, "edits").select("doc_id", "counts.*")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "licence.*")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return media.read_back(stored).select("doc_id", "n_bytes", "samples.*")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    given, step = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    label = F.when(step % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    # floor() of a double beyond a long would not fit one; rounding down by rint keeps the double.
    whole = F.transform("embedding", lambda x: F.rint(256 * x.cast("double")) - (F.rint(256 * x.cast("double")) > 256 * x.cast("double")).cast("double"))
    return negatives.mine(given.select(step.alias("id"), label.alias("label"), whole.alias("vector"), (step % 50 == 0).alias("anchor")))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    narrow = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    dealt = sharding.assign(narrow, shards=16, order=["doc_id", "text_crc32", "size"])
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.runs(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "run")
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (h % F.length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = found.select(F.when(h % 31 == 0, less).otherwise(F.col("run")).alias("word"))
    return spelling.forms(spelling.vocabulary(words))


QUERIES = {f.__name__: f for f in (op1_langid, op2_simhash, op3_lm, op4_mixing, op5_packing, op6_suffixes, op7_tokens, op8_quality, op9_licenses, op10_media, op11_negatives, op12_sharding, op13_spelling)}
#: Every 200-byte string of every text, counted; the bytes of those that occur twice go.
SUFFIXES_SQL = """with h as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as x from documents),
st as (select r, i, md5(substr(x, 2 * i + 1, 400)) as k from (select r, x, unnest(range(0, greatest(length(x) // 2 - 199, 0))) as i from h)),
dup as (select k from st group by k having count(*) > 1),
ds as (select r, i, i > lag(i) over (partition by r order by i) + 200 as gap from st semi join dup using (k)),
isl as (select r, i, sum(coalesce(gap, true)::int) over (partition by r order by i) as g from ds),
sp as (select r, g, min(i) as a, max(i) + 200 as e from isl group by r, g),
n as (select r, cast(sum(e - a) as bigint) as n_removed, count(*) as n_spans, max(e) as e from sp group by r),
p as (select r, coalesce(lag(e) over (partition by r order by a), 0) as s, a as t from sp union all select h.r, coalesce(n.e, 0), length(x) // 2 from h left join n using (r)),
k as (select r, string_agg(substr(x, 2 * s + 1, 2 * (t - s)), '' order by s) as kept from p join h using (r) group by r)
select doc_id, length(x) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(kept)) as kept_sha256 from h left join n using (r) join k using (r)"""
#: All anchors against all rows.
NEGATIVES_SQL = """with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
 where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as a, b.vec_id as b, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as s from r a join r b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
p as (select * from s where same qualify row_number() over (partition by a order by s desc, b) <= 5),
n as (select p.a, p.b as pb, p.s as ps, s.b as nb, s.s as ns, row_number() over (partition by p.a, p.b order by s.s desc, s.b) as k from p join s on s.a = p.a and not s.same and 50 * p.s <= 100 * s.s and 100 * s.s <= 95 * p.s)
select a as anchor_id, pb as positive_id, cast(k as integer) as rank, nb as negative_id, ps as positive_score, ns as negative_score from n where k <= 3"""
#: CRC-32 of the byte lists in a column, from its polynomial.
CRC_TABLE = "select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t"


def crc32_sql(hexed: str, table: str) -> str:
    """The checksum of bytes given as hex digits."""
    octets = f"list_transform(range(length({hexed}) // 2), lambda i: cast('0x' || substr({hexed}, 2 * i + 1, 2) as bigint))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, {table}[1 + (xor(c, b) & 255)])))"


def permutation_sql(x: str, half: str) -> str:
    """sharding.permute without the walk, rounds folded over a packed pair of halves."""
    mask = f"((1 << {half}) - 1)"
    r = f"((xor(s & {mask}, k) * {sharding.M1} & 1099511627775) >> 11) * {sharding.M2} >> 17"
    return f"list_reduce(list_prepend({x}, {sharding.keys(0)}::bigint[]), lambda s, k: ((s & {mask}) << {half}) | xor(s >> {half}, ({r}) & {mask}))"


SHARDING_SQL = f"""with recursive t as ({CRC_TABLE}),
d as (select doc_id, cast(length(h) // 2 + 1 as bigint) as size, cast({crc32_sql('h', 't.t')} as bigint) as text_crc32 from (select doc_id, hex(encode(coalesce(text, ''))) as h from documents), t),
n as (select count(*) as n, cast(ceil(greatest(1, length(bin(greatest(count(*), 2) - 1))) / 2) as bigint) as h from d),
r as (select *, row_number() over (order by doc_id nulls first, text_crc32, size) - 1 as row from d),
w as (select row, {permutation_sql('row', 'n.h')} as y from r, n union all select row, {permutation_sql('y', 'n.h')} from w, n where y >= n.n)
select doc_id, size, text_crc32, 'rows' as law, cast(y % 16 as integer) as shard, cast(y // 16 as bigint) as slot, cast(null as integer) as grown_shard from r join w using (row), n where y < n.n"""
#: Words that share a string reached by at most one deletion are the only ones that can be near.
SPELLING_SQL = f"""with recursive t as ({CRC_TABLE}),
o as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from documents where text is not null),
l as (select coalesce(cast(doc_id as varchar), '') as d, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n from o where length(run) >= 7 group by all),
c as (select run, n, {crc32_sql('h', 't.t')} as crc from (select *, hex(encode(d || ':' || run)) as h from l), t),
v as (select case when crc % 31 = 0 then substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) else run end as word, cast(sum(n) as bigint) as n from c group by 1 having length(word) >= 7 and sum(n) >= 2),
k as (select distinct word, n, case when i = 0 then word else substr(word, 1, i - 1) || substr(word, i + 1) end as k from (select word, n, unnest(range(length(word) + 1)) as i from v)),
p as (select distinct a.word, a.n, b.word as near, b.n as near_n from k a join k b using (k) where a.word <> b.word and
 (length(a.word) <> length(b.word) or len(list_filter(range(length(a.word)), lambda i: substr(a.word, i + 1, 1) <> substr(b.word, i + 1, 1))) = 1)),
q as (select *, count(*) over (partition by word) as n_near, row_number() over (partition by word order by near_n desc, encode(near)) as r from p),
f as (select v.word, case when near_n >= 10 * v.n then near end as form, v.n, coalesce(n_near, 0) as n_near, case when near_n >= 10 * v.n then near_n end as form_n from v left join (select * from q where r = 1) q using (word)),
g as (select word, form as root from f where form is not null union all select g.word, f.form from g join f on f.word = g.root where f.form is not null),
e as (select g.word, root from g join f on f.word = g.root where f.form is null)
select f.word, f.form, coalesce(e.root, f.word) as root, f.n, cast(f.n_near as bigint) as n_near, cast(f.form_n as bigint) as form_n from f left join e using (word)"""
ORACLES: dict[str, str] = {"op6_suffixes": SUFFIXES_SQL, "op11_negatives": NEGATIVES_SQL, "op12_sharding": SHARDING_SQL, "op13_spelling": SPELLING_SQL}
