"""Leases, retention, releases, pages, sections and hidden texts against plain loops."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from clauseloom.operators import leases, retention, structure
from clauseloom.operators.sequences import grant_leases


def test_leases():
    ops = ["acquire", "acquire", "acquire", "acquire", "refresh", "refresh", "release", "release", "takeover", "acquire", "refresh"]
    who, at = [1, 2, 1, 2, 2, 1, 1, 2, 3, 1, 3], [0, 1, 2, 70, 200, 201, 202, 203, 204, 205, 400]
    got = grant_leases(at, ops, who, 60)
    assert [x[0] for x in got] == ["granted", "denied", "extended", "granted", "granted", "denied", "denied", "released", "granted", "denied", "granted"]
    assert got[2][1:] == (1, 62) and got[7][1:] == (None, None) and got[-1][1:] == (3, 460)


def test_lease_logs_in_pieces_equal_whole_logs(spark):
    rnd = random.Random(7)
    rows, want, states = [], {}, {}
    for target in range(80):
        t, log = 0.0, []
        for seq in range(rnd.randint(0, 30)):
            t += rnd.choice([0, 1, 20, 59, 60, 61, 200])
            log.append((target, seq, t, rnd.choice(["acquire", "acquire", "refresh", "release", "takeover"]), rnd.choice("abc")))
        rows += log
        out = grant_leases([r[2] for r in log], [r[3] for r in log], [r[4] for r in log], 60)
        want |= {(target, r[1]): x for r, x in zip(log, out, strict=True)}
        past = [x for r, x in zip(log, out, strict=True) if r[2] <= 500]
        if past:
            states[target] = ("free" if past[-1][1] is None else "active" if past[-1][2] > 500 else "expired", past[-1][1])
    log = leases.lease_log(spark.createDataFrame(rows, "target int, seq int, at double, op string, actor string").repartition(4), 60)
    assert {(r.target, r.seq): (r.outcome, r.holder, r.until) for r in log.collect()} == want
    assert {r.target: (r.state, r.holder) for r in leases.lease_states(log, 500).collect()} == states and len(set(states.values())) > 4


def test_lease_pieces_are_walked_together(spark):
    """Thousands of pieces: no Python call each; requests without a time come last."""
    rows = [(t, s, float(s), ("takeover", "refresh")[s % 2], "ab"[s % 3 % 2]) for t in range(20) for s in range(400)] + [(0, 500, None, "acquire", "c"), (0, 501, None, "refresh", "d")]
    log = leases.lease_log(spark.createDataFrame(rows, "target int, seq int, at double, op string, actor string"), 60)
    want = grant_leases([float("nan") if r[2] is None else r[2] for r in rows if r[0] == 0], [r[3] for r in rows if r[0] == 0], [r[4] for r in rows if r[0] == 0], 60)
    got = sorted(log.filter("target = 0").collect(), key=lambda r: r.seq)
    assert [(r.outcome, r.holder) for r in got] == [x[:2] for x in want] and got[-1].until is None and got[-1].outcome == "denied"
    assert log.count() == len(rows) and "FlatMapGroups" not in log._jdf.queryExecution().toString()


def test_retention(spark):
    day = lambda n: datetime(2024, 1, n)
    rows = [(1, "done", day(1), day(1)), (2, "done", None, day(2)), (3, "open", day(1), day(1)), (4, "done", day(9), day(1)), (5, "done", None, None), (6, "done", day(5), day(1))]
    jobs = spark.createDataFrame(rows, "id long, status string, completed timestamp, created timestamp")
    old = retention.expired(jobs, 5, day(10), "completed", "created", ended=F.col("status") == "done")
    assert {r.id for r in old.collect()} == {1, 2} and {r.id for r in retention.expired(jobs, 5, day(10), "created").collect()} == {1, 2, 3, 4, 6}
    with pytest.raises(ValueError):
        retention.expired(jobs, 0, day(10), "created")
    links = [(i, i - 1) for i in range(101, 160)] + [(101, 1), (200, 201), (201, 200), (300, 4), (1, 159)]  # a chain, cycles
    ids = retention.with_children(old, spark.createDataFrame(links, "id long, parent long"))
    assert {r.id for r in ids.collect()} == {1, 2, *range(101, 160)}
    items = spark.createDataFrame([(1, "a"), (2, "b"), (150, "c"), (4, "d")], "job long, x string")
    kept, counts = retention.cleaned({"jobs": (jobs, "id"), "items": (items, "job")}, ids)
    assert {r.id for r in kept["jobs"].collect()} == {3, 4, 5, 6} and [r.x for r in kept["items"].collect()] == ["d"]
    assert sorted(map(tuple, counts.collect())) == [("items", 3, 3), ("jobs", 2, 2)]
    kept, counts = retention.cleaned({"jobs": (jobs, "id"), "items": (items, "job")}, ids, dry_run=True)
    assert kept["items"].count() == 4 and sorted(map(tuple, counts.collect())) == [("items", 3, 0), ("jobs", 2, 0)]


def test_one_release_is_active(spark):
    at = datetime(2024, 5, 6, 7, 8)
    rows = [("a", 1, "/x/1.xlsx", "1.xlsx", "u", "v1", "c", True, "failed", "e", None), ("a", 2, "/x/2.xlsx", "2.xlsx", None, "v2", None, False, "available", None, None), ("a", 3, "/x/2.xlsx", "2.xlsx", None, "v3", None, True, "available", None, None), ("b", 9, "/x/1.xlsx", "1.xlsx", None, "v", None, True, "available", None, None), ("d", 4, "p.xls", "p.xls", None, "v", None, True, "available", None, None)]
    old = spark.createDataFrame(rows, "owner string, id long, path string, file_name string, source_url string, version_label string, checksum string, is_active boolean, status string, error string, downloaded_at timestamp")
    new = spark.createDataFrame([("a", "/x/2.xlsx", "n", "", "k", at), ("b", "/y/3.XLSM", "", "L", None, at), ("c", "z.xls", "", None, "", at), ("d", "q.pdf", "", "", "", at)], "owner string, path string, source_url string, version_label string, checksum string, downloaded_at timestamp")
    got = {(r.owner, r.id): r for r in retention.activated(old, new).collect()}
    assert {k for k, r in got.items() if r.is_active} == {("a", 2), ("b", 10), ("c", 1), ("d", 4)} and len(got) == 7
    assert got["a", 2][4:7] == ("n", "20240506-0708", "k") and got["a", 1][4:10] == ("u", "v1", "c", False, "failed", "e")
    assert got["b", 10][2:7] == ("/y/3.XLSM", "3.XLSM", None, "L", None) and got["c", 1].version_label == "20240506-0708"


@pytest.mark.parametrize("near", [0, 30])
def test_pages_from_all_places(spark, near):
    rnd = random.Random(8)
    keys = [(rnd.choice([None, *range(9)]), i) for i in range(207)]
    rows = spark.createDataFrame(keys, "k int, i int").repartition(7)
    order = sorted(keys, key=lambda r: (r[0] is not None, -(r[0] or 0), r[1]), reverse=False)
    order = [r for r in order if r[0] is not None] + [r for r in order if r[0] is None]  # descending: nulls last
    for number in (1, 3, 11, 20, 21, 22, 99):
        got = retention.page(rows, ["-k", "i"], number, 10, near=near).orderBy(F.desc("k"), "i").collect()
        at = min(number, 21)
        assert [(r.k, r.i) for r in got] == order[(at - 1) * 10 : at * 10] and got[0].page == at and got[0].has_next == (at < 21)
    assert retention.page(rows, ["-k", "i"], 99, 10, clamp=False, near=near).count() == 0 == retention.page(rows.limit(0), ["i"], 5, 10, near=near).count()


def test_sections_and_subsections_equal_a_walk(spark):
    rnd = random.Random(9)
    lines, asked, want = [], [], {}
    for doc in range(60):
        rows = []
        for pos in range(rnd.randint(1, 30)):
            level = rnd.choice([None, None, 1, 2, 3, 9, 12])
            rows.append((doc, pos, f"{pos + 1}.{rnd.randint(1, 3)} Heading h{pos}z" if level else rnd.choice(["plain words", "text here"]), level))
        lines += rows
        for r in rows:
            if r[3] is None:
                continue
            number = r[2].split(" ")[0]
            later = [x for x in rows if x[1] > r[1] and x[3]]
            last = rnd.choice(["", rnd.choice(later)[2].split(" ")[0]]) if later else ""
            opens = next((x for x in rows if x[1] > r[1] and x[3] and x[2].split(" ")[0] == last), r)
            until = next((x[1] for x in rows if x[1] > opens[1] and x[3] and min(x[3], 9) <= min(opens[3], 9)), None)
            asked.append((doc, number, r[2].split(" ", 1)[1], last))
            want[doc, number, last] = (r[1], until)
    blocks = spark.createDataFrame(lines, "doc_id long, pos long, line string, level int")
    got = structure.section_ranges(blocks, spark.createDataFrame(asked, "doc_id long, number string, title string, last string")).collect()
    assert {(r.doc_id, r.number, r["last"]): (r.start, r.until) for r in got} == want
    kinds = [(d, p, rnd.choice(["", "a", "a", "b"]), rnd.choice([None, None, *(f"k{i}" for i in range(12))])) for d in range(20) for p in range(60)]
    got = structure.subsections(spark.createDataFrame(kinds, "doc_id long, pos long, line string, kind string"), "kind").collect()
    want = {}
    for d in range(20):
        rows = [r for r in kinds if r[0] == d and r[2]]
        body = [i + 1 < len(rows) and rows[i + 1][3] is None for i in range(len(rows))]
        for i, r in enumerate(rows):
            if r[3]:
                want[d, r[1]] = next((rows[j][1] for j in range(i + 1, len(rows)) if rows[j][3] == r[3] and body[j]), None)
    assert {(r.doc_id, r.pos): r.until for r in got} == want and len({r.kind for r in got}) == 12


def test_hidden_texts_leave_cells_a_block(spark):
    rows = [(1, 0, None, "go "), (1, 1, None, "stay"), (1, 2, 1, "go"), (1, 3, 1, " GO"), (1, 4, 1, "go"), (1, 5, 2, "go"), (1, 6, 2, " go  away"), (1, 7, 3, "go"), (1, 8, 3, "go"), (2, 0, 3, "stay")]
    blocks = spark.createDataFrame(rows, "doc_id long, pos long, cell long, line string")
    got = structure.without_hidden(blocks, spark.createDataFrame([("go",), ("go away",), ("",), (None,)], "line string")).collect()
    assert {(r.doc_id, r.pos): r.line for r in got} == {(1, 1): "stay", (1, 3): " GO", (1, 6): "", (1, 8): "", (2, 0): "stay"}
