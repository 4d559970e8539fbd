"""One query per operator, over whole tables, and their SQL where there is any."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, merkle, mixing, mpeg_audio, near_dedup, periodic_runs, quality, secret_scan, sharding, substring_dedup, topk, toxicity
from .common import table


def op1_secret_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    verdict = lambda v: F.size(F.filter("spans", lambda s: s["verdict"] == v)).cast("long")
    return found.select(
        "doc_id",
        kind("assign").alias("n_assign"), kind("access").alias("n_access"), kind("hex").alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "live")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        verdict("live").alias("n_owner_specific"), verdict("example").alias("n_widely_copied"),
    )


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_media_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    media = docs.select("doc_id", mpeg_audio.store(F.col("text")).alias("media"))
    parsed = media.withColumn("p", mpeg_audio.read(F.col("media")))
    payload = F.col("p.payload")
    return parsed.select(
        "doc_id",
        F.col("p.n_bytes").alias("n_bytes"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        mpeg_audio.feature(F.col("p")).alias("feature"),
        (F.col("p.samples") / F.col("p.rate")).alias("duration_s"),
        F.col("p.offsets").alias("frame_offsets"),
    )


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id with the digests of its ids and of the decoded bytes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return bpe.encode(rows, path, finish=bpe.digests(path), schema="doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_byte_bpe(spark: SparkSession, sf_dir: str, path: str = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), path)


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op7_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_groups(table(spark, sf_dir, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(mixing.mix(table(spark, sf_dir, "documents")))


def op9_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = rows.unionByName(probe).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    made = turns.select("conv_id", chat_format.layout_records(F.col("turns")).alias("payload")).withColumn("f", chat_format.format_records(F.col("payload")))
    back = made.withColumn("b", chat_format.read_back(F.col("f.formatted"), F.col("f.loss_spans")))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return back.select(
        "conv_id",
        F.size("b.turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("b.turns", line), ""), 256).alias("turns_sha256"),
        F.length("b.loss_text").cast("long").alias("loss_chars"),
        F.sha2("b.loss_text", 256).alias("loss_sha256"),
        F.length("f.formatted").cast("long").alias("formatted_chars"),
        F.col("f.fingerprint").alias("fingerprint"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapsed_runs(table(spark, sf_dir, "documents"), plant=True)
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    # by length / period exactly: a greater product wins, on ties the earlier run, then the smaller period, as the runs are in that order
    better = lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a)
    best = F.aggregate("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), better)
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.verified_documents(table(spark, sf_dir, "documents"))
    siblings = F.array_join(F.transform(F.filter("proof", lambda s: s.isNotNull()), lambda s: s["hash"]), "")
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", "verified")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP6_SQL = """
with base as (
  select row_number() over () as n, vec_id, list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint)) as v
  from embeddings where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.n, q.vec_id as query_id, c.vec_id as vec_id,
    cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from base q join base c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0),
ranked as (
  select *, cast(row_number() over (partition by n order by score desc, vec_id) as int) as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""

#: CRC-32 of a string of ASCII characters, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({0}, ''), lambda c: ascii(c)::bigint)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)))"""
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP11_SQL = f"""
with split as (
  select row_number() over () as rid, doc_id, {_WORDS} as w, {_CRC.format("cast(doc_id as varchar)")} as h from documents),
sized as (select *, cast(len(w) as bigint) as n, h // 10 as g from split),
cut as (select *, case when h % 10 = 0 and n > 0 then g % n end as a from sized),
moved as (select *, case when a is not null then 1 + (n - a) // (3 + g % 8) end as p from cut),
texts as (
  select rid, doc_id, n, case when a is null then w
    else list_transform(range(n), lambda i: w[cast(case when i >= a then a + (i - a) % p else i end as bigint) + 1]) end as w from moved),
words as (select rid, n, unnest(range(n)) as i, unnest(w) as word from texts where n > 0),
grams as (  -- a run's words equal those a period on at five places running or more
  select rid, n, i, hash(word, lead(word, 1) over follow, lead(word, 2) over follow, lead(word, 3) over follow, lead(word, 4) over follow) as five
  from words window follow as (partition by rid order by i) qualify i + 5 <= n),
pairs as (
  select x.rid, x.i, y.i - x.i as q from grams x join grams y on x.rid = y.rid and x.five = y.five and y.i > x.i and 4 * (y.i - x.i) <= x.n),
stretches as (
  select rid, q, min(i) as start, max(i) - min(i) + 5 + q as length
  from (select *, i - row_number() over (partition by rid, q order by i) as island from pairs) group by rid, q, island),
runs as (
  select rid, start, length, min(q) as period from stretches where length >= greatest(6, 4 * q) group by rid, start, length),
gone as (
  select distinct r.rid, w.i from runs r join words w on r.rid = w.rid and w.i >= r.start + r.period and w.i < r.start + r.length),
kept as (
  select w.rid, string_agg(w.word, ' ' order by w.i) as t from words w anti join gone g on w.rid = g.rid and w.i = g.i group by w.rid),
told as (
  select rid, count(*) as n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' order by start, period) as lines,
    arg_min(r, rk) as best
  from (select rid, start, length, period, {{'start': start, 'length': length, 'period': period}} as r,
      row_number() over (partition by rid order by cast(length as double) / period desc, start, period) as rk from runs) group by rid)
select t.doc_id, coalesce(b.n_runs, 0) as n_runs, b.best.start as start, cast(b.best.length as bigint) as length, b.best.period as period,
  cast(1000 * b.best.length // b.best.period as bigint) as exponent_milli, sha256(coalesce(b.lines, '')) as runs_sha256,
  sha256(coalesce(k.t, '')) as collapsed_sha256
from texts t left join told b on t.rid = b.rid left join kept k on t.rid = k.rid
"""

_FIELD = "case when {0} is null then '-' else concat(strlen(cast({0} as varchar)), ':', {0}) end"
_LEAF = "sha256(concat(" + ", ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{0}", "text")) + "))"
_FOLD = """list_reduce(list_prepend({0}, proof), lambda x, s: case when s = '' then sha256(x) when s[1] = '<' then sha256(concat(s[2:], x)) else sha256(concat(x, s[2:])) end)"""

OP12_SQL = f"""
with recursive rows as (
  select row_number() over () as rid, doc_id, lang, {_LEAF.format("n_chars")} as leaf,
    {_LEAF.format(f"(n_chars + case when {_CRC.format('cast(doc_id as varchar)')} % 7 = 0 then 1 else 0 end)")} as claim
  from documents),
placed as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf, rid) - 1 as pos from rows),
sizes as (select lang, count(*) as n, row_number() over (order by lang nulls first) - 1 as place from placed group by lang),
-- a node knows its run's other: '<' or '>' says where it stands, '' that there is none
nodes as (
  select s.place, 0 as level, p.pos, s.n as m, p.leaf as h from placed p join sizes s on p.lang is not distinct from s.lang
  union all
  select place, level + 1, pos // 2, (m + 1) // 2, sha256(string_agg(h, '' order by pos)) from nodes where m > 1
  group by place, level, m, pos // 2),
others as (
  select a.place, a.level, a.pos, a.h, a.m, case when a.m = 1 then null when b.h is null then '' when b.pos < a.pos then '<' || b.h else '>' || b.h end as other
  from nodes a left join nodes b on a.place = b.place and a.level = b.level and b.pos = xor(a.pos, 1)),
tops as (
  select 0 as level, o.place as pos, (select count(*) from sizes) as m, o.h from others o where o.m = 1
  union all
  select level + 1, pos // 2, (m + 1) // 2, sha256(string_agg(h, '' order by pos)) from tops where m > 1 group by level, m, pos // 2),
above as (
  select a.level, a.pos, case when b.h is null then '' when b.pos < a.pos then '<' || b.h else '>' || b.h end as other
  from tops a left join tops b on a.level = b.level and b.pos = xor(a.pos, 1) where a.m > 1),
trees as (
  select s.lang, s.place, (select h from tops where m = 1) as root, (select o.h from others o where o.m = 1 and o.place = s.place) as subroot,
    coalesce((select list(b.other order by b.level) from above b where b.pos = s.place >> b.level), []) as upper
  from sizes s),
proofs as (
  select p.rid, list(o.other order by o.level) filter (o.other is not null) as lower
  from placed p join sizes s on p.lang is not distinct from s.lang
    join others o on o.place = s.place and o.pos = p.pos >> o.level group by p.rid),
whole as (
  select p.*, t.root, t.subroot, list_concat(coalesce(q.lower, []), t.upper) as proof
  from placed p join trees t on p.lang is not distinct from t.lang join proofs q on p.rid = q.rid)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(list_filter(proof, lambda s: s <> ''), lambda s: s[2:]), '')) as proof_sha256,
  {_FOLD.format("claim")} as folded_root, {_FOLD.format("claim")} = root as verified
from whole
"""

OP13_SQL = f"""
with split as (
  select row_number() over () as rid, doc_id, coalesce(doc_id, 9223372036854775807) as o, {_WORDS} as w from documents),
words as (select rid, o, len(w) as n, unnest(range(len(w))) as i, unnest(w) as word from split where len(w) > 0),
windows as (
  select rid, o, i, string_agg(word, ' ') over (partition by rid order by i rows between current row and 19 following) as s
  from words qualify i + 20 <= n),
placed as (select rid, i, {{'o': o, 'i': i}} as place, min({{'o': o, 'i': i}}) over (partition by s) as first from windows),
repeats as (select rid, i from placed where place > first),
marked as (
  select w.rid, w.i, w.word, max(r.i) over (partition by w.rid order by w.i rows between 19 preceding and current row) is not null as gone
  from words w left join repeats r on w.rid = r.rid and w.i = r.i),
kept as (
  select rid, count(*) filter (gone) as n_removed, string_agg(word, ' ' order by i) filter (not gone) as t from marked group by rid)
select s.doc_id, cast(len(s.w) as bigint) as n_words, coalesce(k.n_removed, 0) as n_removed, sha256(coalesce(k.t, '')) as kept_sha256
from split s left join kept k on s.rid = k.rid
"""

_QUERIES = [
    op1_secret_frequency, op2_near_dedup, op3_toxicity, op4_media_mpeg, op5_byte_bpe, op6_exact_topk,
    op7_lpt_sharding, op8_source_mix, op9_site_quality, op10_chat_format, op11_periodic_runs, op12_merkle_manifest,
    op13_substring_dedup,
]


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_topk": OP6_SQL, "op11_periodic_runs": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_substring_dedup": OP13_SQL}
