"""The pipeline against its parts by brute force, and the registered queries."""

from collections import Counter, defaultdict

import corpus_pipeline
from clauseloom.llm import quality, secret_scan
from tests.llm.test_formats import brute_components, check_bpe

SF = "/root/testdata/sf0.01"


def brute_secrets(rows):
    """A function that hides the secrets of a text: values of one or two owners, other than
    those that are base spans only because they look regular and are everywhere."""
    owners = defaultdict(set)
    found = {}
    for r in rows:
        found[r[1]] = secret_scan.find_hits(r[1])
        for _, _, _, value in found[r[1]]:
            owners[value].add(r[3])

    def hidden(text):
        out, at = [], 0
        for kind, start, end, value in found[text]:
            n = len(owners[value])
            live = n == 1 and secret_scan.entropy(value) >= secret_scan.RANDOM_BITS
            if n >= secret_scan.SPREAD or (kind == "live" and not live):
                continue
            if end > at:
                out += [text[at:start], "[SECRET]"] if start >= at else []
                at = end
        return "".join(out) + text[at:]

    return hidden


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [docs]
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(f(spark, steps[-1], SF), "test-stage")
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        steps.append(out)
    rows = [Counter(map(tuple, s.collect())) for s in steps]
    keep = {r.doc_id for r in quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("keep").collect()}
    assert rows[1] == Counter({r: n for r, n in rows[0].items() if r[0] in keep})
    kept = {d for (d, _, c, _) in brute_components([(r[0], r[1]) for r in rows[1]]) if d == c}
    assert rows[2] == Counter({r: n for r, n in rows[1].items() if r[0] in kept})
    assert {r[0] for r in rows[3]} == {r[0] for r in rows[2]}
    texts = {r[0]: r[1] for r in rows[2]}
    hidden = brute_secrets(rows[2])
    assert {r[0]: r[1] for r in rows[3]} == {d: hidden(t) for d, t in texts.items()}
    assert all(r[4] == len(r[1]) for r in rows[3]) and any("[SECRET]" in r[1] for r in rows[3])
    words = sum(len(r[1].split()) for r in rows[3])
    mixed = sum(len(r[1].split()) * n for r, n in rows[4].items())
    assert abs(mixed - 1.5 * words) <= 25
    check_bpe(spark, steps[4])


INSIDE = "kept _s _d _m _marks _tie _size _text others row t id n h sig rep".split()  # names that stages use themselves
ODD = "doc_id long, text string, lang string, source string, n_chars long, ids array<int>, facts map<string,int>, " + ", ".join(f"`{c}` string" for c in INSIDE)


def tables(spark, path, rows, labels=((1, 1, 0),)):
    spark.createDataFrame([(*r, [1], {"a": 1}, *["clash"] * len(INSIDE)) for r in rows], ODD).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return spark.read.parquet(str(path / "documents.parquet"))


def test_pipeline_odd_rows(spark, tmp_path):
    """Nulls, repeats, ties, a very long text and columns with clashing names, stage by stage."""
    six, long = "one two three four five six", "w%d " * 30_000 % tuple(range(30_000))
    rows = [(1, six, "en", "a", 27), (1, six, "en", "a", 27), (2, None, None, None, None), (3, "", "en", "b", 0), (None, "x y z", "en", "b", 5), (4, six, "en", "b", 27), (5, long, "en", "c", len(long)), (6, "token = qB7xLw93ZkPd02aa here", "en", "c", 29)]
    docs, sf = tables(spark, tmp_path, rows), str(tmp_path)
    good = corpus_pipeline.quality_classifier(spark, docs, sf)
    assert Counter(r.doc_id for r in good.collect()) == Counter(r[0] for r in rows)  # labels of one kind: all stay
    near = corpus_pipeline.minhash_near_dedup(spark, good, sf)
    assert Counter(r.doc_id for r in near.collect()) == {1: 1, 2: 1, 3: 1, None: 1, 5: 1, 6: 1}
    clean = corpus_pipeline.secret_scans(spark, near, sf)
    got = {r.doc_id: (r.text, r.n_chars) for r in clean.collect()}
    assert got == {1: (six, 27), 2: (None, None), 3: ("", 0), None: ("x y z", 5), 5: (long, len(long)), 6: ("[SECRET] here", 13)}
    mixed = corpus_pipeline.source_mix(spark, clean, sf)
    assert near.columns == clean.columns == mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len((r.text or "").split())
    assert words[2] == words[3] == 0 and {2, 3} <= set(words)
    assert all(n <= 2 * len((got[d][0] or "").split()) for d, n in words.items())
    check_bpe(spark, mixed)
    ends = corpus_pipeline.run(spark, sf)
    assert Counter(r.doc_id for r in ends.collect()) == Counter(r.doc_id for r in mixed.collect())


def test_pipeline_keeps_unlike_texts_of_one_id(spark, tmp_path):
    six, other = "one two three four five six", " ".join(map(str, range(40)))
    near = other + " x"
    rows = [(1, six, "en", "a", 27), (1, six, "en", "b", 27), (1, "seven eight nine", "en", "a", 16), (2, six, "en", "a", 27), (3, other, "en", "a", 9), (1, near, "en", "a", 9)]
    docs = tables(spark, tmp_path, rows)
    got = Counter((r.doc_id, r.text, r.source) for r in corpus_pipeline.minhash_near_dedup(spark, docs, str(tmp_path)).collect())
    texts = Counter((d, t) for d, t, _ in got.elements())
    assert texts[(1, six)] == texts[(1, "seven eight nine")] == 1 and texts[(2, six)] == 0
    assert texts[(1, near)] + texts[(3, other)] == 1 and sum(texts.values()) == 3
    again = Counter((r.doc_id, r.text, r.source) for r in corpus_pipeline.minhash_near_dedup(spark, docs.repartition(3), str(tmp_path)).collect())
    assert again == got


def test_pipeline_empty_tables(spark, tmp_path):
    docs = tables(spark, tmp_path, [(1, "a", "en", "a", 1)])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    (tmp_path / "bare").mkdir()
    bare = tables(spark, tmp_path / "bare", [(1, "a", "en", "a", 1)], labels=[(None, None, None)])
    assert corpus_pipeline.quality_classifier(spark, bare, str(tmp_path / "bare")).count() == 1  # without labels all stay
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 2  # one word, of which the mix takes one and a half, rounded
