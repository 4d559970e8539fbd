"""Periodic runs, Merkle multiproofs and repeated passages against brute force."""

import hashlib
import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from clauseloom.llm import common, merkle, periodic_runs, queries, substring_dedup, words
from clauseloom.llm.words import Block

SF = "/root/testdata/sf0.01"
CLASH = "doc_id long, text string, lang string, source string, n_chars long, o string, t string, h string, hs string, more string, start string, starts string, tree string, leaf string, pos string, at string, n string, runs string, level string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def docs_of(spark, rows):
    """Documents (doc_id, text, lang, source, n_chars) with columns whose names the operators use."""
    return spark.createDataFrame([(*r, *["x"] * 14) for r in rows], CLASH)


def as_files(spark, docs, path):
    docs.write.parquet(f"{path}/documents.parquet")
    return str(path)


# periodic runs


def brute_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(6, 4 * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_op11(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *told, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()


def test_runs_of_random_texts_equal_brute_force():
    rnd = random.Random(11)
    for _ in range(400):
        texts = []
        for _ in range(rnd.randint(0, 4)):
            k = rnd.choice([1, 2, 3, 9])
            words = [str(rnd.randrange(k)) for _ in range(rnd.randint(0, 50))]
            for _ in range(rnd.randint(0, 2)):
                unit = [str(rnd.randrange(k)) for _ in range(rnd.randint(1, 12))]
                words += (unit * 9)[: rnd.randint(1, 80)]
            texts.append([w.encode() for w in words])
        block = Block(0, texts)
        got = [tuple(map(int, r)) for r in periodic_runs.find_runs(block.ids()[0], block.row()).T]
        assert got == [(s + int(block.ends[i]), n, q) for i, words in enumerate(texts) for s, n, q in brute_runs(words)]


def test_long_periods_reach_all_levels():
    words = np.arange(1000) % 237
    assert periodic_runs.find_runs(words, np.zeros(1000, np.int64)).T.tolist() == [[0, 1000, 237]]
    assert periodic_runs.find_runs(words[: 4 * 237 - 1], np.zeros(4 * 237 - 1, np.int64)).size == 0
    assert periodic_runs.find_runs(np.zeros(300_000, np.int64), np.zeros(300_000, np.int64)).T.tolist() == [[0, 300_000, 1]]
    assert periodic_runs.find_runs(np.zeros(6, np.int64), np.array([0, 0, 0, 1, 1, 1])).size == 0  # runs end with their text


def test_op11_equals_brute_force(spark, tmp_path):
    planted = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 10 == 0)
    texts = [None, "", " \t\n", "a " * 5, "a " * 6, "a b " * 4, "a b " * 3 + "a", "x a b c " * 50, "é\x0bé é " * 9, "a " * 2000 + "b c " * 9, "a b a b a b a b c b c b c b c b"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    rows += [(planted, "one two three " * 20, None, None, None), (None, "a " * 9, None, None, None), (4, texts[4], "en", "s", 1), (4, "z " * 8, "en", "s", 1)]
    sf = as_files(spark, docs_of(spark, rows), tmp_path)
    got = sorted(map(repr, map(tuple, queries.op11_periodic_runs(spark, sf).collect())))
    assert got == sorted(repr(brute_op11(r[0], r[1])) for r in rows)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").filter("length(text) < 5000").collect()  # brute force takes the square
    got = {r.doc_id: tuple(r) for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert len(docs) > 800 and all(got[r[0]] == brute_op11(*r) for r in docs)
    assert periodic_runs.collapsed_runs(docs_of(spark, [])).count() == 0


# Merkle manifest


def brute_op12(rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more: sha("".join(map(part, (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1]))))

    def tree(nodes):
        """The root, and each leaf's way up: (left, hash), or None where it is alone."""
        ways, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            for k, members in enumerate(groups):
                for m in members:
                    ways[m].append((k % 2 == 1, nodes[k ^ 1]) if k ^ 1 < len(nodes) else None)
            nodes = [sha("".join(nodes[k : k + 2])) for k in range(0, len(nodes), 2)]
            groups = [sum(groups[k : k + 2], []) for k in range(0, len(groups), 2)]
        return nodes[0], ways

    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    made = {}
    for lang in langs:
        trees[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, 0)))
        made[lang] = tree([leaf(r, 0) for r in trees[lang]])
    root, above = tree([made[x][0] for x in langs])
    out = []
    for lang, up in zip(langs, above, strict=True):
        for r, way in zip(trees[lang], made[lang][1], strict=True):
            x = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for step in way + up:
                x = sha(x if step is None else step[1] + x if step[0] else x + step[1])
            siblings = "".join(s[1] for s in way + up if s)
            out.append((r[0], leaf(r, 0), made[lang][0], root, sha(siblings), x, x == root))
    return out


def test_missing_nodes_are_the_least_union():
    rnd = random.Random(12)
    for _ in range(200):
        n = rnd.randint(1, 40)
        leaves = [sha(str(i)) for i in range(n)]
        levels, nodes = [leaves], leaves
        while len(nodes) > 1:
            nodes = [sha("".join(nodes[k : k + 2])) for k in range(0, len(nodes), 2)]
            levels.append(nodes)
        places = sorted(rnd.sample(range(n), rnd.randint(1, n)))
        lacking = merkle.missing(places, n)
        under = lambda level, i: set(range(i << level, min(n, (i + 1) << level)))
        spans = [under(*c) for c in lacking]
        assert sum(map(len, spans)) + len(places) == n and set().union(places, *spans) == set(range(n))  # each leaf once: none can be spared
        assert all(not under(level, i ^ 1) <= set().union(*spans) for level, i in lacking)  # and no two could be one
        proofs, subroot = merkle.expanded(places, [leaves[p] for p in places], {c: levels[c[0]][c[1]] for c in lacking}, n)
        assert subroot == levels[-1][0] and all(merkle.folded(leaves[p], w) == subroot for p, w in zip(places, proofs, strict=True))


@pytest.mark.parametrize(("levels", "rows_broadcast"), [(2, 500_000), (3, 0), (12, 500_000)])
def test_op12_equals_brute_force(spark, levels, rows_broadcast, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows_broadcast)
    rows = [(i, f"text {i} é", ["en", "de", None, "", "zh-é"][i % 5 if i < 60 else 0], [None, "s"][i % 2], [None, 3][i % 3 > 0]) for i in range(83)]
    rows += [(None, None, None, None, None), (1, "other text", "de", "s", 5), (3, "text 3 é", "", "s", None), (99, "x" * 100_000, "alone", "s", 2)] + [(7, "same", "en", "s", 4)] * 9
    got = merkle.verified_documents(docs_of(spark, rows), levels).collect()
    proofs = [sha("".join(s.hash for s in r.proof if s)) for r in got]
    got = [(r.doc_id, r.leaf, r.subroot, r.root, p, r.folded_root, r.verified) for r, p in zip(got, proofs, strict=True)]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_op12(rows)))


def test_op12_on_the_tables_and_odd_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    assert sorted(map(tuple, queries.op12_merkle_manifest(spark, SF).collect())) == sorted(brute_op12([tuple(r) for r in docs]))
    assert merkle.verified_documents(docs_of(spark, [])).count() == 0
    (one,) = merkle.verified_documents(docs_of(spark, [(1, "a", None, None, 1)])).collect()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof == [] and one.verified


def test_proofs_of_some_leaves(spark):
    rows = [(i, f"t{i}", ["en", "de"][i % 3 == 0], "s", i) for i in range(50)]
    manifest = merkle.Manifest(common.written(merkle.document_leaves(docs_of(spark, rows)), "test-leaves"), ["doc_id", "leaf"], 2)
    got = merkle.proofs(manifest, manifest.leaves.filter("doc_id in (4, 17, 18, 49)")).collect()
    assert sorted(r.doc_id for r in got) == [4, 17, 18, 49] and {r.root for r in got} == {manifest.root()}


# repeated passages


def brute_op13(rows):
    first, texts = {}, [(r[0], (r[1] or "").encode().split()) for r in rows]
    order = lambda d: 2**63 - 1 if d is None else d
    for d, words in texts:
        for i in range(len(words) - 19):
            x = tuple(words[i : i + 20])
            first[x] = min(first.get(x, (order(d), i)), (order(d), i))
    out = []
    for d, words in texts:
        gone = {j for i in range(len(words) - 19) if first[tuple(words[i : i + 20])] < (order(d), i) for j in range(i, i + 20)}
        out.append((d, len(words), len(gone), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("rows_broadcast", [500_000, 0])
def test_op13_equals_brute_force(spark, tmp_path, rows_broadcast, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BROADCAST_ROWS", rows_broadcast)
    rnd = random.Random(13)
    word = lambda: rnd.choice("abcdefgh") + str(rnd.randrange(50))
    passages = [[word() for _ in range(n)] for n in (19, 20, 21, 33, 60)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rnd.randint(0, 4)):
            words += [word() for _ in range(rnd.randint(0, 30))] + rnd.choice(passages)
        rows.append((i, rnd.choice([" ", "\n", " \t"]).join(words), "en", "s", 1))
    long = " ".join(word() for _ in range(30_000))
    rows += [(200, long, "en", "s", 1), (201, "x " + long, "en", "s", 1), (202, "w " * 500, "en", "s", 1), (203, "w " * 19, "en", "s", 1), (204, None, None, None, None), (205, "", "", "", 0)]
    rows += [(9, rows[9][1], "en", "s", 1)] * 3 + [(8, rows[9][1], "en", "s", 1), (8, rows[10][1] + " " + rows[8][1], "en", "s", 1), (None, rows[5][1], None, None, None), (None, rows[5][1] + " " + long[:900], None, None, None)]
    rows += [(300 + i, " ".join(passages[4]), "en", "s", 1) for i in range(40)]
    sf = as_files(spark, docs_of(spark, rows).repartition(5), tmp_path)
    got = sorted(map(repr, map(tuple, queries.op13_substring_dedup(spark, sf).collect())))
    assert got == sorted(map(repr, brute_op13(rows)))


def test_op13_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, queries.op13_substring_dedup(spark, SF).collect())) == sorted(brute_op13(docs))
    assert substring_dedup.without_repeats(docs_of(spark, [])).count() == 0
    assert substring_dedup.without_repeats(docs_of(spark, [(1, None, None, None, None)])).collect()[0][1:] == (0, 0, "")


def test_blocks_cut_words_as_bytes_do():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab é\t\n\x0b\x0c\r\x1c\x1f\x85\xa0\u2003\u3000\0") for _ in range(rnd.randrange(40))) for _ in range(400)] + [None, "", " ", "x"]
    for given in (texts, pa.array(texts), pa.array(["y z", *texts]).slice(1)):
        got = list(words.blocks(given))
        assert [b.words[i:j] for b in got for i, j in zip(b.ends[:-1], b.ends[1:], strict=True)] == [words.split(t) for t in texts]
    assert list(words.blocks([])) == []


def test_op13_blocks_take_no_object_per_word():
    """A worker's memory for a block of 300,000 words; with an object for each word it took 128 bytes a word."""
    rnd = random.Random(4)
    text = [" ".join(f"{rnd.randrange(9000)}" for _ in range(3000)) for _ in range(100)]
    batch = pa.record_batch([pa.array(range(100)), pa.array(range(100)), pa.array(text)], ["o", "t", "text"])
    next(substring_dedup._anchors([batch.slice(0, 1)]))
    tracemalloc.start()
    list(substring_dedup._anchors([batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 80 * 300_000
