"""Provenance, paths and step rules against plain loops over random input."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from clauseloom.operators import paths, provenance, step_rules


def loop_trace(blocks, ranges, marks):
    """{(doc, pos): source} by walking the blocks with the open bookmarks as state."""
    out = {}
    for doc in {b[0] for b in blocks}:
        active, of_id = [], {}
        spans = sorted((r[2], r[3], r[1]) for r in ranges if r[0] == doc and 0 <= r[2] <= r[3])
        for pos in sorted(b[1] for b in blocks if b[0] == doc):
            here = sorted(m for m in marks if m[0] == doc and m[1] == pos)
            starts = [m for m in here if not m[5]]
            if starts:
                active = [m[4] for m in starts]
            of_id.update({m[3]: m[4] for m in starts})
            hit = next((s for a, b, s in spans if a <= pos <= b), None)
            out[doc, pos] = hit or (active[-1] if active else None)
            for m in (m for m in here if m[5]):
                s = of_id.get(m[3])
                if s in active:
                    at = len(active) - 1 - active[::-1].index(s)
                    active.pop(at)
    return {k: v for k, v in out.items() if v}


def test_block_trace_equals_a_walk(spark):
    rnd = random.Random(1)
    blocks, ranges, marks = [], [], []
    for doc in range(30):
        n = rnd.randint(1, 160)
        blocks += [(doc, p, "table" if p % 5 == 0 else "paragraph", rnd.choice(["", "a", "hide"]), ["x", ""] if p % 10 else []) for p in range(n)]
        ranges += [(doc, f"r{k}", a := rnd.randint(-3, n), a + rnd.randint(-1, 90)) for k in range(rnd.randint(0, 3))]
        for p in range(n):
            for seq in range(rnd.choice([0, 0, 0, 1, 2, 4])):
                marks.append((doc, p, seq, f"i{rnd.randrange(6)}", f"s{rnd.randrange(4)}", rnd.random() < 0.6))
    marks = [(*m[:4], None if m[5] else m[4], m[5]) for m in marks]
    b = spark.createDataFrame(blocks, "doc_id long, pos long, kind string, line string, probes array<string>")
    r = spark.createDataFrame(ranges, "doc_id long, source string, first long, last long")
    m = spark.createDataFrame(marks, "doc_id long, pos long, seq int, id string, source string, is_end boolean")
    # ends of one block follow its starts, whatever their order
    want = loop_trace(blocks, ranges, [(d, p, s, i, x, e) for d, p, s, i, x, e in marks])
    sources = spark.createDataFrame([(f"s{i}", f"f{i}", "figure" if i == 1 else None, ["p"]) for i in range(4)], "source string, source_file string, content_type string, probes array<string>")
    got = provenance.block_trace(b, r, m, sources, hidden=("hide",)).collect()
    for x in got:
        assert x.source_id == want.get((x.doc_id, x.pos), "") and x.source_file == (x.source_id.replace("s", "f") if x.source_id[:1] == "s" else provenance.UNKNOWN)
    kinds = {(x.doc_id, x.pos): x.block_type for x in got}
    for d, p, kind, line, probes in blocks:
        shown = ("table" if "x" in probes else None) if kind == "table" else "paragraph" if line == "a" else "figure" if want.get((d, p)) == "s1" else None
        assert kinds.get((d, p)) == shown
    assert all([x.block_index for x in sorted(got, key=lambda x: x.pos) if x.doc_id == d] == list(range(sum(x.doc_id == d for x in got))) for d in range(30))
    assert {(x.doc_id, x.pos): x.source for x in provenance.open_sources(b, m).collect()} == loop_trace(blocks, [], marks)


def loop_score(a, b):
    if "table" in (a[0], b[0]):
        return sum(min(len(p), 80) for p in [p for p in a[3] if p.strip()][:12] if p in b[3]) if a[0] == b[0] else 0
    if a[1] and b[1] and a[1] == b[1]:
        return 200 + min(len(a[1]), 120)
    if a[1] and b[1] and len(a[1]) >= 18 and (a[1] in b[1] or b[1] in a[1]):
        return 80 + min(len(a[1]), len(b[1]), 80)
    return 40 + sum(min(len(p), 80) for p in a[3] if p and p in b[1]) if a[2] and b[2] else 0


def loop_placed(targets, fragments):
    cursor, out = 0, []
    for fragment in fragments:
        at, hits = cursor, []
        for block in fragment:
            best = None
            for i in range(at, len(targets)):
                s = loop_score(block, targets[i])
                if s > 0 and (best is None or s > best[0]):
                    best = (s, i)
                if s >= 200:
                    best = (s, i)
                    break
            if best is None:
                hits = []
                break
            hits.append(best[1])
            at = best[1] + 1
        out.append((hits[0], hits[-1]) if hits else None)
        cursor = at if hits else cursor
    return out


def test_fragments_are_placed_as_by_scoring_all_pairs():
    rnd = random.Random(3)
    hits = 0
    for _ in range(400):
        words = ["pump", "valve", "of", "x", "pressure", "limit", "a"]
        text = lambda: " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 3, 6, 9, 40])))
        block = lambda: (rnd.choice(["paragraph", "paragraph", "table", "drawing"]), text(), rnd.random() < 0.3, [rnd.choice([*words, text()]) for _ in range(rnd.randint(0, 15))])
        targets = [block() for _ in range(rnd.randint(0, 25))]
        part = lambda: [(t[0], rnd.choice([t[1], t[1], t[1][:20], t[1] + " end of it"]), t[2], t[3]) for t in rnd.sample(targets, min(len(targets), 2))] if rnd.random() < 0.7 else [block()]
        fragments = [part() for _ in range(rnd.randint(0, 4))]
        got = provenance.placed(targets, fragments)
        assert got == loop_placed(targets, fragments)
        hits += sum(x is not None for x in got)
    assert hits > 200


def test_registry_equals_a_replayed_log(spark):
    rnd = random.Random(2)
    log, want = [], {}
    for root in range(60):
        state = {}
        for seq in range(rnd.randint(0, 40)):
            path = lambda: "/".join(rnd.choice("ab") for _ in range(rnd.randint(0, 4)))
            op, p, q = rnd.choice(["record", "record", "rename", "remove"]), path(), path()
            log.append((root, root * 100 + seq, op, rnd.choice([p, f"/{p}/", p.replace("/", "//")]), q if op == "rename" else None, seq))
            under = [k for k in state if k == p or k.startswith(p + "/")]
            if op == "record" and p:
                state[p] = seq
            elif op == "remove" and p:
                for k in under:
                    del state[k]
            elif op == "rename" and p and q and p != q:
                state |= {q + k[len(p):]: state.pop(k) for k in under}
        want |= {(root, k): v for k, v in state.items()}
    rows = spark.createDataFrame(log, "root long, seq long, op string, path string, new_path string, value int").repartition(3)
    got = {(r.root, r.path): r.value for r in paths.registry(rows).collect()}
    assert got == want and len(want) > 60
    assert paths.registry(rows.limit(0)).count() == 0


@pytest.mark.parametrize("form", ["file", "folder"])
def test_free_names_equal_trying_one_after_another(spark, form):
    rnd = random.Random(4)
    name = {
        "file": lambda: rnd.choice(["a", "b.txt", ".a", "a.b.c", "a."]) if rnd.random() < 0.5 else rnd.choice(["a (1)", "a (2)", "a (1) (1)", "b (1).txt", "b (3).txt", "a (01)", "a.b (1).c", "a.b (1)", "b (2) (1).txt", "a (1)."]),
        "folder": lambda: rnd.choice(["a", "a_1", "a_2", "a_3", "a_2_2", "b_5", "b", "_2"]),
    }[form]
    asked, there, want = [], [], {}
    for folder in range(40):
        taken = {name() for _ in range(rnd.randint(0, 4))}
        there += [(folder, n) for n in taken]
        for seq in range(rnd.randint(0, 25)):
            n, k = name(), 1 if form == "file" else 2
            stem, ext = os.path.splitext(n) if form == "file" else (n, "")
            final = n
            while final in taken:
                final, k = (f"{stem} ({k}){ext}" if form == "file" else f"{n}_{k}"), k + 1
            taken.add(final)
            asked.append((folder, folder * 1000 + seq, n))
            want[folder, folder * 1000 + seq] = final
    asked = spark.createDataFrame(asked, "folder long, seq long, name string").repartition(3)
    got = {(r.folder, r.seq): r.final for r in paths.free_names(asked, spark.createDataFrame(there, "folder long, name string"), form).collect()}
    assert got == want
    simple = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "a (1)"), (1, 4, "a (3)"), (1, 5, "a"), (1, 6, "a")], "folder long, seq long, name string")
    if form == "file":
        assert [r.final for r in paths.free_names(simple, simple.limit(0)).orderBy("seq").collect()] == ["a", "a (1)", "a (1) (1)", "a (3)", "a (2)", "a (4)"]


def test_conflict_suffix_equals_the_rule(spark):
    rnd = random.Random(5)
    generic = set("a an and by for from ii iii information input inputs manufacturer of path section supplied system task td test the to ustar".split())
    tokens = lambda v, folder: [t for t in re.split("[^0-9a-z]+", v.lower()) if t and t not in generic and not t.isdigit() and t not in re.split("[^0-9a-z]+", folder.lower())]

    def rule(a, b, folder):
        a, b = a.split("/")[:-1], b.split("/")[:-1]
        for i in reversed(range(max(len(a), len(b)))):
            x, y = a[i] if i < len(a) else "", b[i] if i < len(b) else ""
            if (i >= min(len(a), len(b)) or x != y) and tokens(x, folder) and tokens(x, folder) != tokens(y, folder):
                return tokens(x, folder)[-1]
        return next((tokens(x, folder)[-1] for x in reversed(a) if tokens(x, folder)), None)

    part = lambda: rnd.choice(["TD 1", "Pump-A", "pump a", "valve", "Section 2", "2024", "Main_Report", "the test", "x.y"])
    way = lambda: "/".join([part() for _ in range(rnd.randint(0, 4))] + ["f.docx"])
    rows = [(i, way(), way(), rnd.choice(["Report", "pump", "x"])) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, a string, b string, folder string")
    got = {r.i: r.s for r in df.select("i", paths.conflict_suffix(F.col("a"), F.col("b"), F.col("folder")).alias("s")).collect()}
    assert got == {i: rule(a, b, f) for i, a, b, f in rows} and len(set(got.values())) > 5


def test_step_rules(spark):
    rules = {
        "x": [("required", ["f"], None, None, None), ("conditional", ["g", "h"], "gh", "flag", True), ("conditional", ["g"], None, "flag", "On"), ("composite", ["g", "h"], None, None, None), ("any", ["g", "h"], None, None, None)],
        "c": [("composite", ["g", "h"], "chapter_ref", None, None)],
        "e": [("conditional", ["g"], None, "continuous_extract", "true"), ("conditional", ["f"], None, "", "")],
    }
    steps = [
        ("x", {"f": " "}, {"required f", "composite g", "any g"}), ("x", {"f": "1", "g": "2", "flag": "On"}, {"conditional gh", "composite g"}), ("x", {"f": "1", "h": "2", "flag": "YES"}, {"conditional gh", "composite g"}),
        ("x", {"f": "1", "h": "2", "g": "3", "flag": "on"}, set()), ("y", {}, set()), (None, {}, set()),
        ("c", {"g": "1.2", "h": "Scope"}, set()), ("c", {"g": "Annex", "h": "Scope"}, {"composite chapter_ref"}), ("c", {"g": "1", "chapter_ref": "3. Use"}, set()), ("c", {"chapter_ref": "3."}, {"composite chapter_ref"}),
        ("c", {"chapter_ref": "see 3.1 there"}, set()), ("c", {"chapter_ref": None}, {"composite chapter_ref"}),
        ("e", {"continuous_end_ref": "4"}, {"conditional g"}), ("e", {"continuous_end_ref": "4", "continuous_extract": "no"}, set()), ("e", {}, set()),
    ]
    df = spark.createDataFrame([(1, i, t, v) for i, (t, v, _) in enumerate(steps)], "run_id long, step_no long, step_type string, values map<string,string>")
    got = {}
    for r in step_rules.broken_rules(df, step_rules.rule_table(spark, rules)).collect():
        got.setdefault(r.step_no, set()).add(f"{r.kind} {r.field}")
    assert got == {i: w for i, (_, _, w) in enumerate(steps) if w}


def test_free_names_need_no_python_call_a_family(spark, monkeypatch):
    """The families of taken numbers are walked in sorted partitions."""
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", None)
    asked = spark.createDataFrame([(f, s, "a") for f in range(300) for s in range(4)], "folder long, seq long, name string")
    there = spark.createDataFrame([(f, n) for f in range(300) for n in ("a", "a (2)")], "folder long, name string")
    got = {(r.folder, r.seq): r.final for r in paths.free_names(asked, there).collect()}
    assert got == {(f, s): f"a ({n})" for f in range(300) for s, n in enumerate((1, 3, 4, 5))}


def test_drawings_among_many_are_placed_as_by_scoring_all_pairs(monkeypatch):
    """Probes in parts of words, with blanks and long ones; drawings looked at one by one or found by word."""
    rnd = random.Random(9)
    words = ["pump", "valve", "of", "x", "pressure", "limit", "a", "electromagnetic-compatibility", "pum", "val ve"]
    text = lambda: " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 2, 3, 6, 9])))
    block = lambda: (rnd.choice(["paragraph"] * 3 + ["table"]), text(), rnd.random() < 0.6, [rnd.choice([*words, text()]) for _ in range(rnd.randint(0, 12))])
    for near in [0, 2, 32] * 50:
        monkeypatch.setattr(provenance, "NEAR", near)
        targets = [block() for _ in range(rnd.randint(0, 100))]
        part = lambda x: (x[0], rnd.choice([x[1], x[1], x[1][: rnd.randint(5, 30)], x[1][3:], "so " + x[1] + " end"]), x[2], x[3])
        fragments = [[part(x) for x in rnd.sample(targets, min(len(targets), rnd.randint(1, 2)))] for _ in range(rnd.randint(1, 5))]
        assert provenance.placed(targets, fragments) == loop_placed(targets, fragments)


def test_documents_are_walked_in_sorted_partitions(spark):
    """No Python call a document for placed fragments."""
    found = __spark_entry__.queries()["join_fragment_place"](spark, "/root/testdata/sf0.001")
    assert "FlatMapCoGroups" not in found._jdf.queryExecution().toString()
