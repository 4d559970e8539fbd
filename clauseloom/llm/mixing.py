"""Mixing sources to target weights, with DataFrame functions only.

Sources in code point order (null last) weigh 5, 2, 1, repeating, and share
1.5 times all words; a target stops at twice its source's words and the excess
goes to the others by weight. Documents of a source, in a pseudorandom order,
are packed into blocks of ``BLOCK`` words. A source's slots are its whole
passes and the rest of its target; each output shard draws its count of slots
of every source (a multinomial draw given the totals), numbers them on from the
shard before it, and slot numbers go through the source's index permutation (its
blocks by a keyed hash, anew for each pass) to blocks, which are joined by index.
A pass uses every block once, so no document is taken more than twice, and a
source is taken to its rounded target exactly.

A word is a run of characters other than blank and U+0009 to U+000D. Null text
has no words; such documents are kept with ``taken`` 0. Equal rows are
interchangeable. Everything hangs on hashes of the rows, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checked_broadcast, prefix_offsets, salted_join, written

#: Words of a block.
BLOCK = 128
#: Output shards that draw their counts.
SHARDS = 64
#: Slots that one row is expanded to at once.
CHUNK = 4096
#: Documents that one task numbers at most, about.
PACK_ROWS = 20_000
#: Blocks that one task ranks at once, about.
RANKED = 8192


def _l(x: int) -> Column:
    return F.lit(x).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """Adds ``_size`` in words, the source's key ``_s`` and the row's hash ``_tie``."""
    return docs.select(
        "*",
        F.coalesce(F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), F.lit(0)).cast("long").alias("_size"),
        F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit(""))).alias("_s"),
        F.xxhash64("doc_id", "text", "source").alias("_tie"),
    )


def weighted(sizes: DataFrame, weights=(5, 2, 1)) -> DataFrame:
    """Adds ``_w``: the weights, repeating, by the source's place in code point order.
    Sources are ranked in ranges, so there may be any number of them."""
    rows = written(sizes.repartitionByRange(32, "_s").withColumn("_p", F.spark_partition_id()), "mix-sources")
    starts = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), _l(0))  # 32 ranges at most
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_p").orderBy("_s")) - 1
    rows = rows.join(F.broadcast(starts.select("_p", before.alias("_before"))), "_p")
    return rows.withColumn("_w", F.get(F.array(*map(F.lit, weights)), (place % len(weights)).cast("int")).cast("double")).select(*sizes.columns, "_w")


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(_s, source_size) with ``target``: weight times the level that water-filling
    reaches, ``most`` times the source's size at the most. The level is found by
    sums over all sources: it rises with each round that caps some more of them."""
    caps = written(weighted(sizes, weights).withColumn("_cap", most * F.col("source_size")), "mix-caps")
    level, capped = 0.0, -1
    while True:
        full = F.lit(level) * F.col("_w") >= F.col("_cap")
        row = caps.agg(F.sum("source_size"), F.count_if(full), F.sum(F.when(full, F.col("_cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("_w")))).first()
        if row[0] is None or row[1] == capped or not row[3]:
            break
        capped, level = row[1], (share * row[0] - row[2]) / row[3]
    return caps.select("_s", "source_size", F.least(F.col("_cap"), F.lit(level) * F.col("_w")).alias("target"))


def _plan(goals: DataFrame) -> DataFrame:
    """Slots of each source: whole passes, then the blocks of the rest."""
    size, words = F.col("source_size"), F.col("_words")
    out = goals.withColumn("_words", F.round("target").cast("long")).filter((size > 0) & (words > 0))
    out = out.withColumn("_full", F.floor(size / BLOCK)).withColumn("_blocks", F.ceil(size / BLOCK))
    out = out.withColumn("_passes", F.floor(words / size)).withColumn("_rest", words % size)
    return out.withColumn("_slots", F.col("_passes") * F.col("_blocks") + F.ceil(F.col("_rest") / BLOCK)).select("_s", "_full", "_blocks", "_passes", "_rest", "_slots")


def _expand(df: DataFrame, count: str, out: str, *keys: str) -> DataFrame:
    """A row for each number below ``count``, through chunks dealt over all tasks."""
    last = F.floor((F.col(count) - 1) / CHUNK)
    chunks = df.withColumn("_c", F.explode(F.sequence(_l(0), last))).repartition("_s", *keys, "_c")
    top = F.least((F.col("_c") + 1) * CHUNK, F.col(count)) - 1
    return chunks.withColumn(out, F.explode(F.sequence(F.col("_c") * CHUNK, top))).drop("_c")


def draws(plan: DataFrame) -> DataFrame:
    """(_s, _shard, _n, _at): the slots of each source that a shard draws, and the first one's number."""
    thrown = _expand(plan.select("_s", "_slots"), "_slots", "_j")
    counts = thrown.groupBy("_s", F.pmod(F.xxhash64(F.lit("draw"), "_s", "_j"), _l(SHARDS)).alias("_shard")).agg(F.count("*").alias("_n"))
    return prefix_offsets(counts, ["_s"], "_shard", "_n", "_at")


def permutations(plan: DataFrame) -> DataFrame:
    """(_s, _pass, _i, _block): the whole blocks of each source in the order of a keyed
    hash, another for each pass. Ranks are prefix sums over hash buckets, so a
    source of any size is spread over all tasks."""
    passes = plan.filter("_full > 0").withColumn("_pass", F.explode(F.sequence(_l(0), F.when(F.col("_rest") > 0, F.col("_passes")).otherwise(F.col("_passes") - 1))))
    rows = _expand(passes.select("_s", "_pass", "_full"), "_full", "_block", "_pass")
    key = F.xxhash64(F.lit("order"), "_s", "_pass", "_block")
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(key), F.greatest(_l(1), F.ceil(F.col("_full") / RANKED)))).withColumn("_key", key)
    starts = prefix_offsets(rows.groupBy("_s", "_pass", "_b").agg(F.count("*").alias("_n")), ["_s", "_pass"], "_b", "_n", "_before").drop("_n")
    w = Window.partitionBy("_s", "_pass", "_b").orderBy("_key", "_block")
    return rows.withColumn("_rn", F.row_number().over(w) - 1).join(starts.hint("merge"), ["_s", "_pass", "_b"]).select("_s", "_pass", (F.col("_before") + F.col("_rn")).alias("_i"), "_block")


def slots(plan: DataFrame) -> DataFrame:
    """(_s, _block, _shard, _pass, _limit): the block that each slot takes, and how many of its first words."""
    own = _expand(draws(plan), "_n", "_k").withColumn("_j", F.col("_at") + F.col("_k")).drop("_at", "_k", "_n")
    rows = own.join(checked_broadcast(plan), "_s").withColumn("_i", F.col("_j") % F.col("_blocks")).withColumn("_pass", F.floor(F.col("_j") / F.col("_blocks")))
    # what is expanded from a row per source looks small to the planner, so it must not choose a broadcast;
    # the last block, if it is not whole, keeps its place
    rows = rows.join(permutations(plan).hint("merge"), ["_s", "_pass", "_i"], "left")
    last = (F.col("_pass") == F.col("_passes")) & (F.col("_i") == F.ceil(F.col("_rest") / BLOCK) - 1)
    return rows.select("_s", "_shard", F.coalesce("_block", "_full").alias("_block"), "_pass", F.when(last, F.col("_rest") - F.col("_i") * BLOCK).otherwise(_l(BLOCK)).alias("_limit"))


def packed(rows: DataFrame, n: int) -> DataFrame:
    """Adds ``_start``: the words of the source before this document, in hash order."""
    rows = rows.withColumn("_b", F.pmod("_tie", _l(max(256, n // PACK_ROWS))))
    starts = prefix_offsets(rows.groupBy("_s", "_b").agg(F.sum("size").alias("_n")), ["_s"], "_b", "_n", "_before").drop("_n")
    w = Window.partitionBy("_s", "_b").orderBy("_tie", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(starts, ["_s", "_b"]).withColumn("_start", F.col("_before") + F.coalesce(F.sum("size").over(w), _l(0))).drop("_b", "_before")


def mix(docs: DataFrame) -> DataFrame:
    """Pieces of the mix: doc_id, _tie, _start, size, source_size, target, and for
    each piece taken _shard, _pass and the words [_from, _to) of the document
    (null where nothing of it is taken)."""
    rows = written(keyed(docs).select("doc_id", F.col("_size").alias("size"), "_s", "_tie"), "mix-rows")
    goals = written(targets(rows.groupBy("_s").agg(F.sum("size").alias("source_size"))), "mix-targets")
    # its files are small for what they hold, so their size must not decide on a broadcast
    uses = written(slots(_plan(goals)), "mix-slots")
    placed = written(packed(rows, rows.count()), "mix-placed")
    block = F.explode(F.sequence(F.floor(F.col("_start") / BLOCK), F.floor((F.col("_start") + F.col("size") - 1) / BLOCK)))
    parts = placed.filter("size > 0").withColumn("_block", block).join(uses.hint("merge"), ["_s", "_block"], "left")
    begin, end = F.greatest("_start", F.col("_block") * BLOCK), F.least(F.col("_start") + F.col("size"), F.col("_block") * BLOCK + F.col("_limit"))
    took = F.col("_limit").isNotNull() & (end > begin)
    parts = parts.select("doc_id", "_tie", "_s", "_start", "size", "_shard", "_pass", F.when(took, begin - F.col("_start")).alias("_from"), F.when(took, end - F.col("_start")).alias("_to"))
    none = placed.filter("size = 0").select("doc_id", "_tie", "_s", "_start", "size", *[F.lit(None).cast("long").alias(c) for c in ("_shard", "_pass", "_from", "_to")])
    return salted_join(parts.unionByName(none), goals, "_s", F.col("_tie"))


def taken_words(pieces: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken and ``shards``,
    the words of it that each output shard takes."""
    one = ["doc_id", "_tie", "_s", "_start", "size", "source_size", "target"]
    words = F.coalesce(F.sum(F.col("_to") - F.col("_from")), _l(0))
    per = pieces.groupBy(*one, F.when(F.col("_to").isNotNull(), F.col("_shard")).alias("_shard")).agg(words.alias("_words"))
    took = F.sort_array(F.collect_list(F.when(F.col("_words") > 0, F.struct(F.col("_shard").alias("shard"), F.col("_words").alias("words")))))
    return per.groupBy(*one).agg(F.sum("_words").alias("taken"), took.alias("shards")).select("doc_id", "size", "source_size", "target", "taken", "shards")


def mixed_texts(docs: DataFrame) -> DataFrame:
    """The mix as documents: one row for each document and pass that is taken; the
    columns are those of ``docs``. A text of which a pass takes every word stays as
    it is, another is cut to the words taken, without white space round them. A
    document without words has nothing to take and stays, once."""
    pieces = mix(docs).filter("_to is not null or size = 0")
    runs = pieces.groupBy("doc_id", "_tie", "_start", "size", "_pass").agg(F.sort_array(F.collect_list(F.when(F.col("_to").isNotNull(), F.struct("_from", "_to")))).alias("_runs"))
    # rows with equal texts are interchangeable: the nth place goes to the nth such row
    nth = Window.partitionBy("doc_id", "_tie")
    rows = keyed(docs)
    repeats = rows.groupBy("doc_id", "_tie").agg(F.count("*").alias("_c")).filter("_c > 1").limit(1)
    if repeats.isEmpty():
        runs, rows = runs.withColumn("_nth", F.lit(1)), rows.withColumn("_nth", F.lit(1))
    else:  # rows without words share their start, so they are numbered one by one
        runs = runs.withColumn("_nth", F.when(F.col("size") > 0, F.dense_rank().over(nth.orderBy("_start"))).otherwise(1))
        rows = rows.withColumn("_nth", F.when(F.col("_size") > 0, F.row_number().over(nth.orderBy("_size"))).otherwise(1))
    runs = runs.select(F.col("doc_id").alias("_d"), F.col("_tie").alias("_t"), F.col("_nth").alias("_m"), "size", "_runs").withColumnRenamed("size", "_n")
    both = rows.join(runs, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_tie") == F.col("_t")) & (F.col("_nth") == F.col("_m")))
    words = F.regexp_extract_all("text", F.lit(f"{WORD}[\\x20\\x09-\\x0D]*"), F.lit(0))
    cut = lambda w: F.transform("_runs", lambda r: F.slice(w, (r["_from"] + 1).cast("int"), (r["_to"] - r["_from"]).cast("int")))
    parts = F.get(F.transform(F.array(words), cut), F.lit(0))  # the array binds the words once
    whole = F.aggregate("_runs", _l(0), lambda n, r: n + r["_to"] - r["_from"]) == F.col("_n")
    made = both.withColumn("_text", F.when(whole, F.col("text")).otherwise(F.regexp_replace(F.array_join(F.flatten(parts), ""), "[\\x20\\x09-\\x0D]+$", "")))
    return made.select(*[F.length("_text").cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else F.col("_text").alias(c) if c == "text" else rows[c] for c in docs.columns])
