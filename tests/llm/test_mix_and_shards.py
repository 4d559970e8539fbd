"""Mixing, sharding and exact search: properties, brute force and odd rows."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauseloom.llm import mixing, sharding, topk

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "clash", "clash") for i, t, s in rows], DOCS)


def brute_targets(sizes):
    """Reshares the excess by weight until no target is above twice its source."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total >= 2 * sizes[s]} if free else set()
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = 2 * sizes[s]
        left -= sum(2 * sizes[s] for s in over)
        free -= over


ODD = [(1, None, "a"), (2, "", "a"), (3, "x " * 30_000, "b"), (4, "one two", None), (4, "one two", None), (5, "p q r s t", "a"), (None, "u v", "c"), (6, "w\x0bw\x1cw", "é"), (7, "k " * 200, "z")] + [(100 + i, "same words here " * 9, "b") for i in range(50)]


@pytest.mark.parametrize("odd", [True, False])
def test_mix(spark, odd):
    docs = docs_of(spark, ODD) if odd else spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(map(tuple, mixing.taken_words(mixing.mix(docs)).collect()), key=str)
    assert got == sorted(map(tuple, mixing.taken_words(mixing.mix(docs.repartition(3))).collect()), key=str)
    words = [(r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.source) for r in docs.collect()]
    assert Counter((d, n) for d, n, _ in words) == Counter((d, n) for d, n, *_ in got)
    sizes = Counter()
    for _, n, s in words:
        sizes[s] += n
    want = brute_targets(sizes)
    assert {(n, round(t, 6)) for _, _, n, t, *_ in got} == {(sizes[s], round(want[s], 6)) for s in sizes}
    taken = defaultdict(int)
    for _, size, source_size, target, took, shards in got:
        assert 0 <= took <= 2 * size and sum(x.words for x in shards) == took
        taken[source_size, target] += took
    groups = Counter((sizes[s], want[s]) for s in sizes)
    for (n, target), took in taken.items():
        k = next(c for (m, t), c in groups.items() if m == n and abs(t - target) < 1e-6)
        assert abs(took - k * target) <= k


def test_draws_are_multinomial_and_reach_the_shards(spark):
    """Each source's slots fall on the shards like independent even draws, and the words taken by a shard are those of its slots."""
    plan = spark.createDataFrame([("0a", 0, 0, 0, 0, 64_000), ("0b", 0, 0, 0, 0, 6_400), ("0c", 0, 0, 0, 0, 1)], "_s string, _full long, _blocks long, _passes long, _rest long, _slots long")
    rows = mixing.draws(plan).collect()
    counts = {s: [r["_n"] for r in rows if r["_s"] == s] for s in ("0a", "0b", "0c")}
    assert [sum(counts[s]) for s in counts] == [64_000, 6_400, 1]
    for s, n in (("0a", 64_000), ("0b", 6_400)):
        each = n / mixing.SHARDS
        chi = sum((c - each) ** 2 / each for c in counts[s])
        assert 30 < chi < 110  # 63 degrees of freedom
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = mixing.mix(docs).filter("_to is not null").cache()
    by_shard = {r["_shard"]: r.n for r in pieces.groupBy("_shard").agg(F.sum(F.col("_to") - F.col("_from")).alias("n")).collect()}
    out = Counter()
    for r in mixing.taken_words(mixing.mix(docs)).select(F.explode("shards").alias("x")).select("x.*").collect():
        out[r.shard] += r.words
    assert out == by_shard and len(out) == mixing.SHARDS


def test_permutations_are_bijections(spark):
    sizes = {"0a": (1, 2), "0b": (7, 1), "0c": (20_000, 1), "1": (3, 0)}
    plan = spark.createDataFrame([(s, n, n, p, 1, 0) for s, (n, p) in sizes.items()], "_s string, _full long, _blocks long, _passes long, _rest long, _slots long")
    rows = mixing.permutations(plan).collect()
    for s, (n, passes) in sizes.items():
        orders = [sorted((r["_i"], r["_block"]) for r in rows if r["_s"] == s and r["_pass"] == e) for e in range(passes + 1)]
        for o in orders:
            assert [i for i, _ in o] == list(range(n)) and sorted(b for _, b in o) == list(range(n))
        if n > 100:
            steps = {b - a for (_, a), (_, b) in zip(orders[0], orders[0][1:], strict=False)}
            assert len(steps) > n / 3 and orders[0] != orders[1]


def test_targets_with_many_sources(spark):
    sizes = {f"s{i:04d}": (i * 37) % 101 + (5000 if i == 7 else 0) for i in range(700)} | {None: 40}
    rows = [((("0" + s) if s is not None else "1"), n) for s, n in sizes.items()]
    got = {r["_s"]: r.target for r in mixing.targets(spark.createDataFrame(rows, "_s string, source_size long")).collect()}
    want = brute_targets(sizes)
    assert all(abs(got["1" if s is None else "0" + s] - want[s]) < 1e-6 for s in sizes)


def test_mixed_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = mixing.mixed_texts(docs).cache()
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    taken = {r.doc_id: (r.taken, r["size"]) for r in mixing.taken_words(mixing.mix(docs)).collect()}
    texts, got, whole = {r.doc_id: r.text for r in docs.collect()}, Counter(), Counter()
    for r in out.collect():
        got[r.doc_id] += len(r.text.split())
        whole[r.doc_id] += r.text == texts[r.doc_id]
        assert r.n_chars == len(r.text) and r.text == r.text.strip()
    assert got == {d: n for d, (n, _) in taken.items() if n}
    assert all(whole[d] == n // size for d, (n, size) in taken.items() if n % size == 0)
    odd = docs_of(spark, ODD + [(8, " \n", "a"), (8, " \n", "a"), (9, "  p q \n", "zz")]).drop("size", "shard")
    rows = mixing.mixed_texts(odd).collect()
    blank = Counter((r.doc_id, r.text) for r in rows if not (r.text or "").split())
    assert blank == {(1, None): 1, (2, ""): 1, (8, " \n"): 2}
    assert {r.text for r in rows if r.doc_id == 9} <= {"  p q \n", "p", "q", "p q"}
    assert mixing.mixed_texts(odd.limit(0)).count() == 0


def test_mix_empty(spark):
    assert mixing.taken_words(mixing.mix(docs_of(spark, []))).count() == 0


@pytest.mark.parametrize("odd", [True, False])
def test_shards(spark, odd):
    docs = docs_of(spark, ODD) if odd else spark.read.parquet(f"{SF}/documents.parquet")
    n = 5 if odd else 40
    rows = sharding.shard_groups(docs, n).collect()
    texts = [r.text or "" for r in docs.collect()]
    assert Counter((len(t.encode()) + 16, zlib.crc32(t.encode())) for t in texts) == Counter((r["size"], r.text_crc32) for r in rows)
    where, slots, loads = {}, defaultdict(list), Counter()
    for r in rows:
        assert where.setdefault(r.text_crc32, r.shard) == r.shard and 0 <= r.shard < n
        slots[r.shard].append(r.slot)
        loads[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if not odd:
        assert max(loads.values()) - min(loads.values()) <= 0.01 * max(loads.values())
    assert sharding.shard_groups(docs.limit(0), n).count() == 0


def test_parcels_keep_groups_together(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GRAIN", 2)
    rows = sharding.shard_groups(spark.read.parquet(f"{SF}/documents.parquet"), 4).collect()
    where, loads = {}, Counter()
    for r in rows:
        assert where.setdefault(r.text_crc32, r.shard) == r.shard
        loads[r.shard] += r["size"]
    assert len(rows) == 1000 and max(loads.values()) < 1.5 * min(loads.values())


def test_longest_first():
    assert longest([7, 6, 5, 4, 3], 2) == [14, 11] and longest([8, 7, 6, 5, 4, 3, 2], 3) == [13, 11, 11]


def longest(sizes, shards):
    items = [(s, str(i)) for i, s in enumerate(sizes)]
    loads = Counter()
    for (s, name) in items:
        loads[sharding.longest_first(items, shards)[name]] += s
    return sorted(loads.values(), reverse=True)


def brute_top(rows, k=5):
    """Every row is a candidate, and every query row has its own results."""
    use = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in use:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in use if i != q and len(w) == len(v))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_topk(spark, monkeypatch):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    assert sorted(map(tuple, topk.top_k(table, F.col("vec_id") % 50 == 0).collect())) == brute_top(rows)
    monkeypatch.setattr(topk, "QUERY_CELLS", 300)  # several batches of queries
    again = table.repartition(7).unionByName(table.filter("vec_id % 25 = 0"))  # repeated rows
    assert sorted(map(tuple, topk.top_k(again, F.col("vec_id") % 50 == 0).collect())) == brute_top(rows + [x for x in rows if x[0] % 25 == 0])


def test_threshold_stops_early_and_keeps_ties():
    rng = np.random.default_rng(3)
    block = rng.integers(-4, 5, (400, 6)).astype(float)
    ids = rng.permutation(400)
    lists = np.argsort(block, axis=0, kind="stable").T
    for _ in range(50):
        query, own = rng.integers(-3, 4, 6).astype(float), int(rng.integers(0, 400))
        want = sorted((-int(s), int(i)) for s, i in zip(block @ query, ids, strict=True) if i != own)[:5]
        assert [tuple(map(int, x)) for x in topk.threshold_top(block, ids, lists, query, own, 5)] == want
        assert [tuple(map(int, x)) for x in topk.threshold_top(block, ids, lists, query, own, 5, (), -want[-1][0])] == want
        assert topk.threshold_top(block, ids, lists, query, own, 5, (), 10**9) == []


def test_topk_odd_rows(spark):
    rows = [(i, [float(i % 3), -1.0, 0.5], 0) for i in range(120)] + [(200, None, 0), (250, [1.0, None, 2.0], 0), (300, [float("nan"), 1.0, 1.0], 0), (350, [1.0], 0), (400, [], 0), (450, [0.0, 0.0, 0.0], 0), (None, [1.0, 1.0, 1.0], 0), (50, [9.0, 9.0, 9.0], 0), (500, [1e30, -1e30, 1.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = topk.top_k(table, F.col("vec_id") % 50 == 0).collect()
    clip = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    small = [r for r in rows if r[0] != 500]
    again = topk.top_k(table.filter("vec_id <> 500 or vec_id is null"), F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, again)) == brute_top([(i, v) for i, v, _ in small])
    assert {r.query_id for r in got} >= {0, 50, 100, 450, 500}
    assert topk.top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert clip(2**70) == 2**63 - 1
