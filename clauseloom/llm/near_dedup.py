"""Near-duplicates by MinHash with tensored banding, confirmed on full sets.

A document's set holds its distinct shingles of five words (fewer words: the
whole sequence), hashed to 64 bits. Two collections of eight MinHash values
give, pair by pair, the keys of 64 tables: 16 hash functions do the work of
128. Equal sets are collapsed before any table is built.

Inside a table's bucket no pairs are enumerated. Members meet a few pivots;
pairs that pass a size and a signature test are confirmed on the full sets;
components are formed; members still apart meet a pivot of the bucket's largest
component. What then remains apart is compared with its bucket where that is
small, and by an exact prefix-filter join (rarest shingles first) where it is
large, so a bucket of documents that merely share a passage stays linear.

A pair at the threshold misses all tables with probability 2 * 0.25 ** 8 or
3e-5 and the signature test with 4e-5; every link reported is exact.

Sets and shingles are compared as hashes (128 and 64 bits): equal hashes count
as equal.

Documents without words or without doc_id are linked with nothing. Rows that
repeat a doc_id belong to one component, whatever their texts: each distinct
set is a node of its own, linked with the others of its doc_id (such nodes are
numbered down from 2 ** 63, where no doc_ids are expected). Null texts are
empty, very long ones are taken whole; an empty table gives none. Other columns
do not take part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, released, salted_join, written
from .graph import components

SIDE = 8
#: Equal MinHash values of 2 * SIDE that a pair needs before its full sets are read.
AGREE = 5
#: Buckets up to this size are compared row by row in the last round.
SMALL = 64
#: Shingles in more of the compared documents than this are hot.
RARE = 64
#: Nodes from here on stand for further sets of a doc_id that has several.
FURTHER = (1 << 63) - (1 << 46)
WORDS_HELD = 150_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_SEEDS = np.array([xxhash.xxh64_intdigest(b"minhash", seed=i) for i in range(2 * SIDE)], dtype=np.uint64)
_SETS = "doc_id long, n_shingles long, digest string"


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a limit."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < WORDS_HELD:
            self[word] = value
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _ODD[4]
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, words: WordHashes, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text."""
    parts = text.encode().lower().split() if text else []  # on bytes both act on ASCII alone
    if not parts:
        return np.empty(0, np.uint64)
    if len(parts) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), seed=len(parts))], np.uint64)
    h = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    n = len(h) - size + 1
    x = np.zeros(n, np.uint64)
    for i in range(size):
        x += h[i : i + n] * _ODD[i % 4]
        x = _mix(x)
    return np.unique(x)


def minhashes(s: np.ndarray) -> np.ndarray:
    out = np.full(2 * SIDE, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 1 << 16):
        y = s[None, at : at + (1 << 16)] ^ _SEEDS[:, None]
        y = _mix(y * _ODD[1])
        out = np.minimum(out, y.min(axis=1))
    return out


def _signatures(batches):
    words = WordHashes()
    for batch in batches:
        n, digests, sigs = [], [], []
        for text in batch.column("text").to_pylist():
            s = shingles(text, words)
            n.append(len(s))
            digests.append(hashlib.md5(s.tobytes()).hexdigest())
            sigs.append(minhashes(s).view(np.int64))
        flat = np.concatenate(sigs) if sigs else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 2 * SIDE), pa.int32()), pa.array(flat))
        yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.string()), lists], ["doc_id", "n_shingles", "digest", "sig"])


def _full_sets(batches):
    words = WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            sets = [shingles(t, words) for t in part.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            digests = [hashlib.md5(s.tobytes()).hexdigest() for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.record_batch([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.string()), lists], ["doc_id", "n_shingles", "digest", "shingles"])


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct()


class _Corpus:
    """The documents and their representatives: one for each distinct set, with its smallest doc_id."""

    def __init__(self, docs: DataFrame, reps: DataFrame):
        self.docs, self.reps = docs, reps
        self.further = written(reps.filter(F.col("rep") >= FURTHER).select("rep", "doc_id"), "dedup-further")

    def plausible(self, pairs: DataFrame) -> DataFrame:
        """Pairs that the sizes allow and the signatures support."""
        side = lambda c: self.reps.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sig").alias(f"s_{c}"))
        n, m = F.col("n_lo"), F.col("n_hi")
        same = F.size(F.filter(F.zip_with("s_lo", "s_hi", lambda x, y: x == y), lambda x: x))
        found = pairs.join(side("lo"), "lo").join(side("hi"), "hi")
        return found.filter((100 * F.least(n, m) >= 75 * F.greatest(n, m)) & (same >= AGREE)).select("lo", "hi")

    def sets(self, ids: DataFrame) -> DataFrame:
        """(rep, shingles) of the given representatives, from their texts."""
        ids = ids.select("rep").join(checked_broadcast(self.further), "rep", "left").select(F.coalesce("doc_id", "rep").alias("doc_id"))
        ids = written(ids, "dedup-ids")
        texts = self.docs.join(checked_broadcast(ids), "doc_id", "left_semi")
        made = texts.mapInArrow(released(_full_sets), _SETS + ", shingles array<long>")
        true = made.join(self.reps.select("rep", "doc_id", "digest"), ["doc_id", "digest"])
        return written(true.select("rep", "shingles").dropDuplicates(["rep"]), "dedup-sets")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Edges (u, v) of the pairs whose full sets are similar enough."""
        pairs = written(self.plausible(pairs), "dedup-pairs")
        ids = pairs.select(F.col("lo").alias("rep")).union(pairs.select("hi")).distinct()
        sets = self.sets(ids)
        side = lambda c: sets.select(F.col("rep").alias(c), F.col("shingles").alias(f"s_{c}"))
        both = F.size(F.array_intersect("s_lo", "s_hi"))
        found = pairs.join(side("lo"), "lo").join(side("hi"), "hi").withColumn("both", both)
        return written(
            found.filter(100 * F.col("both") >= 75 * (F.size("s_lo") + F.size("s_hi") - F.col("both"))).select(F.col("lo").alias("u"), F.col("hi").alias("v")),
            "dedup-links",
        )


def _candidates_left(sets: DataFrame) -> DataFrame:
    """``sets`` (rep, shingles, ...) without those that have more than a quarter of
    their shingles to themselves: no other set can hold three quarters of them.
    Counted without a join, so a shingle that all share costs partial sums only."""
    each = sets.select("rep", F.explode("shingles").alias("s"))
    alone = each.groupBy("s").agg(F.count("*").alias("f"), F.min("rep").alias("rep")).filter("f = 1").groupBy("rep").agg(F.count("*").alias("own"))
    left = sets.join(alone, "rep", "left").filter(4 * F.coalesce("own", F.lit(0)) <= F.size("shingles")).select(sets.columns)
    return written(left, "dedup-left")


def _by_prefix(corpus: _Corpus, rows: DataFrame) -> DataFrame:
    """Pairs (lo, hi) of an open row with any row of ``rows`` (rep, comp, open)
    that can be similar. Two sets with a Jaccard index of 0.75 share one of the
    first n - ceil(0.75 n) + 1 shingles of each in any common order. The order
    puts shingles in front that no open set shares with another, then goes by
    rarity. If their first common shingle is hot, all common ones are, so the hot
    shingles of each must suffice for the overlap: this keeps documents apart
    that share a passage and little else. And what either has left from that
    shingle on must suffice for the overlap. No link is lost."""
    ids = written(rows.groupBy("rep").agg(F.max("open").alias("open"), F.max("comp").alias("comp")), "dedup-open")
    sets = _candidates_left(_candidates_left(corpus.sets(ids.select("rep")).join(ids, "rep")))
    each = sets.select("rep", "open", F.explode("shingles").alias("s"))
    shared = each.groupBy("s").agg(F.count("*").alias("f"), F.max("open").alias("any")).filter("f > 1 and any").select("s", "f")
    found = each.select("rep", "s").join(shared, "s").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("t"))  # a document's own set
    ranked = sets.select("rep", "open", "comp", F.size("shingles").alias("n")).join(found, "rep").filter(4 * F.size("t") >= 3 * F.col("n"))
    keep = F.size("t") - F.ceil(F.col("n") * F.lit(0.75)) + 1  # of the prefix, behind what is shared with none
    ranked = ranked.withColumn("h", F.size(F.filter("t", lambda x: x["f"] > RARE)))
    heads = ranked.select("rep", "open", "comp", "n", "h", (F.col("n") - F.size("t")).alias("before"), F.posexplode(F.slice("t", F.lit(1), keep.cast("int"))).alias("i", "t"))
    heads = written(heads.select("rep", "open", "comp", "n", "h", (F.col("before") + F.col("i")).alias("i"), F.col("t.s").alias("s"), (F.col("t.f") > RARE).alias("hot")), "dedup-heads")
    a = heads.filter("open").select("s", "hot", F.col("rep").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("h").alias("ha"), (F.col("n") - F.col("i")).alias("la"))
    b = heads.select("s", F.col("rep").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("h").alias("hb"), (F.col("n") - F.col("i")).alias("lb"))
    near = "100 * least(na, nb) >= 75 * greatest(na, nb) and 7 * least(la, lb) >= 3 * (na + nb) and (not hot or 175 * least(ha, hb) >= 75 * (na + nb))"
    return _pairs(a.join(b, "s").filter(f"ca <> cb and {near}"), "a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sig = written(docs.mapInArrow(released(_signatures), _SETS + ", sig array<long>"), "dedup-signatures")
    full = sig.filter("n_shingles > 0 and doc_id is not null")
    repeated = full.groupBy("doc_id").agg(F.min("digest").alias("least"), F.max("digest").alias("other")).filter("least <> other").select("doc_id", "least")
    repeated = written(repeated, "dedup-repeated")
    reps = full.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "sig")).alias("r"), F.count("*").alias("rows"))
    reps = reps.select("digest", "rows", "r.doc_id", "r.n_shingles", "r.sig").join(checked_broadcast(repeated), "doc_id", "left")
    own = F.col("least").isNull() | (F.col("least") == F.col("digest"))
    node = F.when(own, F.col("doc_id")).otherwise(F.monotonically_increasing_id() + F.lit(FURTHER))
    reps = written(reps.select("digest", "rows", "doc_id", node.alias("rep"), "n_shingles", "sig"), "dedup-reps")
    corpus = _Corpus(docs, reps)

    tables = F.array(*[F.xxhash64(F.lit(i * SIDE + j), F.get("sig", F.lit(i)), F.get("sig", F.lit(SIDE + j))) for i in range(SIDE) for j in range(SIDE)])
    keys = reps.select("rep", F.explode(tables).alias("key"))
    mask = F.xxhash64(F.pmod(F.col("key"), F.lit(8)))  # eight orders of pivots
    buckets = keys.groupBy("key").agg(F.min(F.col("rep").bitwiseXOR(mask)).alias("first"), F.count("*").alias("size")).filter("size > 1")
    members = keys.join(buckets, "key").select("key", "rep", "size", F.col("first").bitwiseXOR(mask).alias("pivot"))
    members = written(members, "dedup-buckets")

    ids = reps.select("digest", "rep")
    several = full.select("doc_id", "digest").join(checked_broadcast(repeated), "doc_id").distinct()
    same_id = several.join(ids.withColumnRenamed("rep", "u"), "digest").join(ids.select(F.col("digest").alias("least"), F.col("rep").alias("v")), "least").select("u", "v")
    tested = members.select(F.col("pivot").alias("node")).distinct()
    edges = corpus.confirmed(_pairs(members, "rep", "pivot")).unionByName(same_id)
    labels = components(edges)

    for turn in (1, 2, 3):
        rows, found = _apart(members, _nodes(edges, labels, tested), turn)
        if rows.isEmpty():
            break
        if turn < 3:
            pairs = _pairs(rows, "rep", "pivot")
            tested = tested.unionByName(rows.select(F.col("pivot").alias("node"))).distinct()
        else:
            near = rows.filter(F.col("size") <= SMALL)
            pairs = _pairs(near.select("key", "rep", "comp").join(found.select("key", F.col("rep").alias("other"), F.col("comp").alias("theirs")), "key").filter("comp <> theirs"), "rep", "other")
            wide = rows.filter(F.col("size") > SMALL)
            if not wide.isEmpty():
                keyed = wide.select("key").distinct()
                everyone = found.join(keyed, "key", "left_semi").select("rep", "comp", F.lit(False).alias("open"))
                pairs = pairs.unionByName(_by_prefix(corpus, everyone.unionByName(wide.select("rep", "comp", F.lit(True).alias("open"))))).distinct()
        more = corpus.confirmed(pairs)
        if not more.isEmpty():
            edges = edges.unionByName(more)
            labels = components(labels.select(F.col("node").alias("u"), F.col("comp").alias("v")).unionByName(more))

    groups = reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "rows", "rep", F.coalesce("comp", "rep").alias("component_id"))
    groups = written(groups.filter("rows > 1 or component_id <> rep").select("digest", "component_id"), "dedup-groups")
    out = salted_join(sig.filter("n_shingles > 0").select("doc_id", "n_shingles", "digest"), groups, "digest", F.col("doc_id"), how="left")
    out = out.unionByName(sig.filter("n_shingles = 0").select("doc_id", "n_shingles", "digest", F.lit(None).cast("long").alias("component_id")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the one with the smallest
    doc_id. Here a row counts as a document of its own where its doc_id or its text
    is another, so unlike texts of one doc_id all stay; among alike ones of the same
    doc_id the one of the smallest hash stays, among rows equal in both the first by
    its other columns. Rows without words or without doc_id stay."""
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t"))
    several = keyed.filter("doc_id is not null").groupBy("doc_id").agg(F.min("t").alias("least"), F.count("*").alias("n")).filter("n > 1").select("doc_id", "least")
    several = written(several, "dedup-several")
    if several.isEmpty():  # the usual case: each row is a document as it is
        gone = near_duplicates(docs.select("doc_id", "text")).filter("not kept").select("doc_id")
        return docs.join(checked_broadcast(written(gone, "dedup-gone")), "doc_id", "left_anti").select(docs.columns)
    several = checked_broadcast(several)
    numbers = keyed.select("doc_id", "t").join(several, "doc_id").groupBy("doc_id", "t", "least").agg(F.count("*").alias("n"))
    own = F.when(F.col("t") == F.col("least"), F.col("doc_id")).otherwise(F.monotonically_increasing_id() + F.lit(FURTHER))
    numbers = written(numbers.select("doc_id", "t", "n", own.alias("id")), "dedup-numbers")
    numbered = keyed.join(checked_broadcast(numbers), ["doc_id", "t"], "left").withColumn("id", F.coalesce("id", "doc_id"))
    gone = near_duplicates(numbered.select(F.col("id").alias("doc_id"), "text")).filter("not kept").select(F.col("doc_id").alias("id")).distinct()
    left = numbered.join(checked_broadcast(written(gone, "dedup-gone")), "id", "left_anti")
    once = left.filter("coalesce(n, 1) = 1").select("row.*")
    first = left.filter("n > 1").groupBy("id").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return once.unionByName(first)


def _nodes(edges: DataFrame, labels: DataFrame, tested: DataFrame) -> DataFrame:
    """(node, comp, fresh, links): fresh where it was no pivot yet; links so far.
    A fresh node with many links lies in the middle of its family: it was
    similar to most pivots."""
    links = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).groupBy("node").agg(F.count("*").alias("links"))
    old = tested.withColumn("old", F.lit(True))
    return labels.join(links, "node", "left").join(old, "node", "left").select("node", "comp", F.col("old").isNull().alias("fresh"), F.coalesce("links", F.lit(0)).alias("links"))


def _apart(members: DataFrame, nodes: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Rows outside the largest component of their bucket, with a pivot inside it;
    and the rows of all buckets that hold more than one component."""
    rows = members.select("key", "rep", "size").join(nodes.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    mask = F.xxhash64(F.pmod(F.col("key"), F.lit(4)) + 8 * turn)
    best = F.struct(F.coalesce("fresh", F.lit(True)), F.coalesce("links", F.lit(0)), F.col("rep").bitwiseXOR(mask), F.col("rep").alias("pivot"))
    parts = rows.groupBy("key", "comp").agg(F.count("*").alias("n"), F.max(best).alias("best"))
    main = parts.groupBy("key").agg(F.max(F.struct("n", "comp", "best")).alias("m"), F.count("*").alias("parts")).filter("parts > 1")
    main = main.select("key", F.col("m.comp").alias("main"), F.col("m.best.pivot").alias("pivot"))
    found = written(rows.select("key", "rep", "size", "comp").join(main, "key"), "dedup-apart")
    return found.filter("comp <> main"), found
