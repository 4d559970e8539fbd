"""Contents lines, headings, captions, typed blocks, items, log errors and names by literals and loops."""

import base64
import json
import random
import re

from pyspark.sql import functions as F

from clauseloom.operators import contents as C
from clauseloom.operators import records as R
from clauseloom.operators.blocks import typed_blocks
from clauseloom.operators.paths import resolved_names


def test_contents_lines(spark):
    texts = ["1.2\tScope\t12", "3．4 Use 7", "Pump v2", "Annex 4 5", "2.\t a \t", "\t \n", None, "12", "x 1234567", "Table A1 of 3"]
    want = [("1.2", "Scope", "12"), ("3.4", "Use", "7"), ("", "Pump v", "2"), ("", "Annex 4", "5"), ("2", ". a", ""), ("", "", "12"), ("", "x 12", "34567"), ("", "Table A1 of", "3")]
    rows = spark.createDataFrame([(1, i, t, "TOC 1", None, None, None, None) for i, t in enumerate(texts)], "doc_id long, pos long, text string, style_name string, style_id string, field string, anchors array<string>, leaders array<string>")
    got = {r.pos: (r.number, r.title, r.page) for r in C.contents_rows(rows).collect()}
    want = dict(zip([0, 1, 2, 3, 4, 7, 8, 9], want, strict=True))
    del want[7]  # neither number nor title
    want[8] = ("", "x 1234567", "")  # the word holds other digits
    assert got == want


def test_contents_signals(spark):
    rows = [("My TOC", None, None, None, None), (None, None, "xtocx", None, None), (None, None, None, ["a", None, "_Toc9"], None), (None, None, None, None, ["dot"]), ("Body", "b", "", ["x_Toc"], ["dots", None]), (None,) * 5]
    df = spark.createDataFrame(rows, "style_name string, style_id string, field string, anchors array<string>, leaders array<string>")
    assert [r[0] for r in df.select(C.is_contents_line()).collect()] == [True, True, True, True, False, False]


def test_caption_accepted(spark):
    rows = [(None, "Caption"), ("x", " FigCaption"), ("a " * 100, "heading 1"), ("Fig. 3-1 " + "a " * 99, None), ("a" * 181, ""), ("a b " * 10, None), ("ab " * 21, None), ("a" * 121, None)]
    got = spark.createDataFrame(rows, "t string, s string").select(C.caption_accepted("t", "s").alias("c")).select("c.*").collect()
    assert [r.reason for r in got] == ["empty_text", "style_match", "style_match", "figure_number_prefix", "too_long", "short_standalone_line", "no_caption_signal", "no_caption_signal"]
    assert [r.accepted for r in got] == [False, True, True, True, False, True, False, False]


def test_headings_are_renumbered_as_by_a_loop(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for doc in range(12):
        counts = {}
        for pos in range(30):
            style = rng.choice(["Heading 1", "heading2", "My Heading  3 b", None, "Body"])
            line = rng.choice(["1 Scope", "2.1 Use of it", "7.8.9 Limits", "Plain text", "4 is used, so it is said here, in full.", "", " 3．2．  Pump "])
            rows.append((doc, pos, line, style))
            m = re.match(r"^\s*(\d+(?:[.．]\d+)*)[.．]?\s*(\S.*?)\s*$", line)
            named = re.search(r"heading([1-9])", (style or "").replace(" ", ""), re.I)
            level = None
            if m and named:
                level = int(named[1])
            elif m and line[0] != "4":
                level = len(re.split("[.．]", m[1]))
            if level is None:
                want[doc, pos] = (line, None)
                continue
            for k in range(1, level):
                counts[k] = counts.get(k) or 1
            counts = {k: v for k, v in counts.items() if k <= level}
            counts[level] = counts.get(level, 0) + 1
            number = ".".join(str(counts[k]) for k in range(1, level + 1))
            want[doc, pos] = (f"{number} {m[2]}", number)
    df = spark.createDataFrame(rows, "doc_id long, pos long, line string, style string").repartition(5)
    assert {(r.doc_id, r.pos): (r.line, r.number) for r in C.renumbered_headings(df).collect()} == want
    assert C.renumbered_headings(df.filter("doc_id < 0")).count() == 0


def test_typed_blocks(spark):
    long_cell, row = "a cell of twenty chars", "one two three four five six"
    rows = [
        (1, 0, "paragraph", "  a\tb ", None, None), (1, 1, "paragraph", None, None, True), (1, 2, "paragraph", "secret", None, True), (1, 3, "paragraph", "secret", None, False),
        (1, 4, "table", None, [[long_cell, "secret", None], None, row.split(), [long_cell]], True), (1, 5, "table", None, [["x"]], False), (1, 6, "table", None, None, None), (2, 0, "paragraph", "secret", None, None),
    ]
    parts = spark.createDataFrame(rows, "doc_id long, pos long, kind string, text string, cells array<array<string>>, has_drawing boolean")
    hide = spark.createDataFrame([(1, ["secret"])], "doc_id long, texts array<string>")
    got = {(r.doc_id, r.pos): (r.type, r.norm, r.probes, r.has_drawing) for r in typed_blocks(parts, hide, "figure", F.array(F.lit("p"))).collect()}
    assert got == {(1, 0): ("paragraph", "a b", ["a b"], False), (1, 1): ("figure", "", ["p"], True), (1, 2): ("figure", "", ["p"], True), (1, 4): ("table", "", [long_cell, row], False), (2, 0): ("paragraph", "secret", ["secret"], False)}
    assert typed_blocks(parts).filter("type = 'drawing' and size(probes) = 0").count() == 1


def test_batch_items(spark):
    token = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    tokens = [token({"kind": " TASK ", "task_id": 5}), "", "%%%", token([1]), token({"task_id": " a ", "scheme_id": "s"}), token({"kind": "flow", "task_id": "a"}), token({"kind": "mapping_scheme", "task_id": "é?>", "scheme_id": None}), token({"kind": "task"}), token({"task_id": "5"})]
    df = spark.createDataFrame([(" , ".join(tokens), "5, b,,b , a"), (None, None)], "tokens string, ids string")
    got = [[tuple(i) for i in r[0]] for r in df.select(R.batch_items("tokens", "ids")).collect()]
    assert got == [[("task", "5", ""), ("task", "a", "s"), ("mapping_scheme", "é?>", ""), ("task", "b", ""), ("task", "a", "")], []]


def test_log_errors(spark):
    messages = spark.createDataFrame([(1, 0, "WARN: a"), (1, 1, " WF_ERROR: b"), (1, 2, "ERROR: c"), (4, 0, None)], "log_id long, pos long, message string")
    runs = spark.createDataFrame([(1, 1, "error", "x"), (2, 2, "ok", " late "), (2, 1, "ok", None), (3, 1, " ERROR", ""), (5, 1, None, None)], "log_id long, run_no long, status string, error string")
    steps = spark.createDataFrame(
        [(2, 1, 2, "error", "e2", "A", None), (2, 1, 1, "error", "e1", "A", "D"), (2, 1, 0, "ok", "e0", None, None), (3, 1, 1, "error", " ", "A", "D"), (6, 1, 1, "ok", "said", None, None)],
        "log_id long, run_no long, step_no long, status string, error string, action string, detail string",
    )
    got = {r.log_id: (r.has_error, r.first_error) for r in R.log_errors(messages, runs, steps).collect()}
    assert got == {1: (True, "WF_ERROR: b"), 2: (True, "A :: D :: e1"), 3: (True, ""), 4: (False, ""), 5: (False, ""), 6: (True, "")}


def test_resolved_names(spark):
    files = spark.createDataFrame([(1, "A/b/One.docx"), (1, "A/c/one.DOCX"), (1, "A/b/alone.pdf"), (1, "A//b/two.doc"), (2, "one.docx"), (1, None)], "base long, path string")
    wanted = [(1, "ONE.docx"), (2, "one.docx"), (1, "a\\B/one.docx"), (1, "b/one.docx"), (1, "a/B"), (1, "b"), (1, "alone.pdf"), (1, " "), (1, None), (3, "one.docx"), (1, "A/c/one.docx/")]
    got = {(r.base, r.name): (r.state, r.path, r.n) for r in resolved_names(files, spark.createDataFrame(wanted, "base long, name string")).collect()}
    assert got == {
        (1, "ONE.docx"): ("ambiguous", None, 2), (2, "one.docx"): ("found", "one.docx", 1), (1, "a\\B/one.docx"): ("found", "A/b/One.docx", 1), (1, "b/one.docx"): ("not found", None, 0),
        (1, "a/B"): ("found", "A/b/One.docx", 2), (1, "b"): ("not found", None, 0), (1, "alone.pdf"): ("found", "A/b/alone.pdf", 1), (1, " "): ("unnamed", None, 0), (1, None): ("unnamed", None, 0),
        (3, "one.docx"): ("not found", None, 0), (1, "A/c/one.docx/"): ("found", "A/c/one.DOCX", 1),
    }
