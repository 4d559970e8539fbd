"""Literal fixtures and random sequences against plain loops."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from clauseloom.functions import mapping as P
from clauseloom.functions import standards as S
from clauseloom.functions import text as T
from clauseloom.operators import matching as M
from clauseloom.operators import sequences as Q
from clauseloom.plans import q_search, q_structure, q_tables
from clauseloom.streaming import jobs


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize(
    "f, text, want",
    [
        (S.match_key, "EN ISO 14971:2019/A11:2021", "14971"), (S.match_key, "IEC 60601-1-2:2014", "60601-1-2"), (S.latest_year, "ASTM F1140/F1140M-13(2025)", 2025),
        (S.latest_year, "IEC 60601-1:2005+AMD1:2012", 2012), (S.latest_year, "ASTM F88-85", 1985), (S.display_no, "BS EN 455-2：2015", "BS EN 455-2"),
        (S.regulation_key, "MEDDEV 2.7/1 revision 4", "MEDDEV271REV4"), (S.accepted_form, "EN IEC 60601", True), (S.amendment, "ISO 1:2000/Amd 2", "2"),
        (T.year_coerce, "1899", None), (T.norm_text, None, ""), (T.severity, "warn", 30), (T.safe_name, "con.txt", "_con.txt"), (T.path_norm, "a\\b//./c", "a/b/c"),
        (T.number_rest, "1.2 Scope", "Scope"), (q_tables.S.yes_no, "y", "YES"),
    ],
)
def test_literals(spark, f, text, want):
    assert one(spark, f(F.lit(text))) == want


def test_structs(spark):
    assert tuple(one(spark, S.level(F.lit("DIN EN ISO 11137-2:2015")))) == ("EN ISO", 4)
    assert tuple(one(spark, T.section_expr(F.lit("1.1 ～ 1.3 Scope of use")))) == ("1.1", "1.3", "Scope of use")
    assert tuple(one(spark, T.caption_label(F.lit("圖 3：架構")))) == ("figure", "3", "架構")
    assert one(spark, T.number_boundary(F.array(F.lit(2), F.lit(1)), F.array(F.lit(3), F.lit(1)), True)) is True
    got = one(spark, q_structure.affix_diff(F.lit("ISO 1"), F.lit("EN ISO 1")))
    assert [tuple(s) for s in got] == [("EN", True), (" ISO 1", False)]


CATALOG = "sheet string, row_no int, standard_no string, title string, relevance string"


def pick(spark, numbers, want):
    rows = [("ISO" if n.startswith("ISO") else "EN", i, n, "t", "是") for i, n in enumerate(numbers)] + [("ASTM", 90, "ASTM F1", "t", "是"), ("EN", 91, "EN 9", "t", "是"), ("ISO", 92, "ISO 9", "t", "是")]
    catalog = M.load_catalog(spark.createDataFrame(rows, CATALOG))
    asked = spark.createDataFrame([(0, 0, want)], "table_id int, row_no int, standards string")
    return M.ranked(M.key_candidates(asked, catalog)).filter("final_rank = 1").first().standard_no


def test_adopted_pick_goes_by_the_levels_of_all_candidates(spark):
    """A level compared by year is present, though not among the adopted ones: the newest adopted wins."""
    rows = [("s", "ISO_FAMILY", 0, 1, "BS EN 5", 2020, "BS EN", True, "NO"), ("s", "ISO_FAMILY", 0, 2, "BS ISO 5", 2001, "BS ISO", False, "YES"), ("s", "ISO_FAMILY", 0, 3, "ISO 5", 2010, "ISO", False, "YES")]
    cands = spark.createDataFrame(rows, "skey string, want_family string, sheet_order int, cat_row int, candidate_id string, year int, level string, by_year boolean, adopted string")
    got = M.picks(cands).first()
    assert (got.candidate_id, got.fallback) == ("ISO 5", True)
    assert M.picks(cands.filter("cat_row > 1")).first().candidate_id == "BS ISO 5"


def test_picks(spark):
    assert pick(spark, ["BS EN ISO 14971:2019", "EN ISO 14971:2021"], "ISO 14971:2019") == "EN ISO 14971:2021"
    assert pick(spark, ["EN ISO 14971:2021", "ISO 14971:2023"], "ISO 14971:2019") == "EN ISO 14971:2021"
    assert pick(spark, ["BS 7:2000", "ISO 7:2020"], "ISO 7") == "ISO 7:2020"


def test_missing_sheet(spark):
    with pytest.raises(ValueError, match="missing sheets"):
        M.load_catalog(spark.createDataFrame([("ISO", 1, "ISO 1", "t", "是")], CATALOG))


def test_required_sheets_among_many(spark):
    names = [f"S{i}" for i in range(2000)] + list(M.REQUIRED_SHEETS)
    assert M.load_catalog(spark.createDataFrame([(n, i, "ISO 1", "t", "是") for i, n in enumerate(names)], CATALOG)).count() == len(names)


def test_rollback(spark):
    asked = spark.createDataFrame([(0, 0, "EN ISO 1:2000", "2000", "YES", "t"), (0, 1, "EN ISO 1:2000", "2000", "NO", "t"), (0, 2, "ISO 5", "", "", "")], "table_id int, row_no int, standards string, issued_year string, harmonised string, title string")
    picked = spark.createDataFrame([(0, r, "EN ISO 1", "t", 2020, "NO", False, "EN") for r in (0, 1)], "table_id int, row_no int, display string, cat_title string, year int, adopted string, fallback boolean, sheet string")
    got = {r.row_no: (r.status, r.rolled_back) for r in M.classified(asked, picked).collect()}
    assert got == {0: ("SAME_NO_UPDATE", True), 1: ("UPDATED", False), 2: ("NOT_FOUND", False)}


def test_heading_numbers():
    assert Q.number_headings([2, None, 1, 3, 2]) == ["1.1", None, "2", "2.1.1", "2.2"]
    assert Q.number_headings([2, 1], fill=False) == ["0.1", "1"]


def test_list_labels():
    labels = Q.list_labels([0, 1, 1, 0, 1], ["decimal", "lowerLetter"], ["%1.", "%1.%2)"], [1, 1])
    assert labels == ["1.", "1.a)", "1.b)", "2.", "2.a)"]
    assert Q.letter(27) == "AA" and Q.roman(1994) == "MCMXCIV"


def test_captions():
    lines = ["Figure 7 a", "see Figure 7", "Figure 7 b", "see Figure 7", "head", "see Figure 7", "see Table 9"]
    assert Q.renumber_captions(lines, [False] * 4 + [True, False, False]) == ["Figure 1 a", "see Figure 1", "Figure 2 b", "see Figure 2", "head", "see Figure 1", "see Table 9"]


def test_sequences_random():
    random.seed(4)
    for _ in range(200):
        a, b = ([random.choice("abc") for _ in range(random.randint(0, 12))] for _ in range(2))
        at, want = -1, []
        for x in a:
            hit = next((i for i in range(at + 1, len(b)) if b[i] == x), None)
            want.append(hit)
            at = at if hit is None else hit
        assert Q.match_in_order(a, b) == want
    assert Q.token_diff("a b", "a new b") == [("a ", False), ("new", True), (" b", False)]


def test_pages(spark):
    rows = spark.range(45)
    last = q_search.page(rows, ["id"], 99, 20).collect()
    assert [r.id for r in last] == [40, 41, 42, 43, 44] and last[0].page == 3 and not last[0].has_next
    assert q_search.page(rows, ["id"], 99, 20, clamp=False).count() == 0


def test_chunk_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, "  "), (3, "x" * 10), (4, "abcdefghijkl")], "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in q_search.chunks(docs, 10, 4).orderBy("doc_id", "chunk").collect()]
    assert got == [(3, "x" * 10), (4, "abcdefghij"), (4, "ghijkl")]
    with pytest.raises(ValueError):
        q_search.chunks(docs, 5, 5)


def test_status_stream_equals_batch(spark):
    from clauseloom.plans import q_streams

    got = {r.job_id: r.status for r in q_streams.str_status_fold(spark, "/root/testdata/sf0.001").collect()}
    rows = q_streams.table(spark, "/root/testdata/sf0.001", "events").select("event_id", "ts", F.col("user_id").alias("job_id"), F.expr(q_streams._STATUS).alias("status")).orderBy("ts", "event_id").collect()
    want: dict = {}
    for r in rows:
        want[r.job_id] = Q.fold_status([r.status], want.get(r.job_id))
    assert got == want


def test_stream_in_many_batches(spark, tmp_path):
    events = [(i, f"2024-01-01 00:{i:02d}:00", i % 3, ("queued", "claimed", "completed", "running")[i // 3 % 4]) for i in range(36)]
    df = spark.createDataFrame(events, "event_id long, ts string, job_id long, status string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for k in range(3):
        df.filter(F.floor(F.col("event_id") / 12) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = jobs.drained(jobs.status_fold(jobs.read_stream(spark, str(tmp_path / "in"), 1)), "test-fold", "update")
    got = {r.job_id: r.status for r in rows.groupBy("job_id").agg(F.max_by("status", "batch").alias("status")).collect()}
    want: dict = {}
    for i, _, j, s in events:
        want[j] = Q.fold_status([s], want.get(j))
    assert got == want


def test_short_probes_are_found(spark):
    rng = random.Random(5)
    chars = "医疗器械生物学评价第一部分风险管理过程中的与试验😀é"
    run = lambda n: "".join(rng.choice(chars) for _ in range(n))
    items = [(1, run(300)), (2, "Figure 3 Cross section"), (3, "internationalisation " * 20), (4, "elevenchars"), (5, "a b c d e f g h i j k"), (6, run(20) + " " + run(90)), (7, None)]
    texts = [None, "", "x" + items[0][1] + "y", run(40) + items[0][1][:100], "see  theFigure 3\nCross sections", "re" + items[2][1], items[5][1][:60], "elevenchars", "Figure 3 Cross", "z b c d e f ga b c d e f g h i j k", run(30_000) + items[5][1]]
    norm = lambda t: " ".join((t or "").split())
    want = {}
    for item, text in items:
        text = norm(text)
        probes = {text} if len(text) <= 180 else set()
        probes |= {text[:n].strip() for n in (180, 120, 80, 48) if len(text) > n}
        for doc, t in enumerate(texts):
            found = sum(min(len(p), 120) for p in probes if len(p) >= 12 and p in norm(t))
            if found:
                want[doc, item] = found
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = q_structure.probe_scores(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.score for r in got} == want and {i for _, i in want} == {1, 2, 3, 5, 6}


def row_of(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_number_boundaries(spark):
    parts = lambda x: F.array(*map(F.lit, x))
    cases = [([2, 1], [2], False, False), ([2, 1], [3], False, True), ([2, 1], [2, 2], False, True), ([2, 1], [3, 1], False, False), ([2, 1], [3, 1], True, True), ([2, 1, 3], [3, 1], True, False), ([2, 1, 3], [2, 2], True, True), ([2], [2, 1], True, False), ([2], [2], True, False), ([2, 1], [], True, False)]
    row = row_of(spark, *[T.number_boundary(parts(s), parts(c).cast("array<int>"), x) for s, c, x, _ in cases])
    assert list(row) == [want for *_, want in cases]


def test_section_requests(spark):
    cases = {"1. 測試1.1": ("1", "", "測試1.1"), "1.1.1 - 1.1.3 測試標題": ("1.1.1", "1.1.3", "測試標題"), "1.1.1-1.1.3": ("1.1.1", "1.1.3", ""), "2.1至2.4 x": ("2.1", "2.4", "x"), "see 4.1 there": ("4.1", "", "see 4.1 there"), "Scope": ("", "", ""), "": ("", "", "")}
    row = row_of(spark, *[T.section_expr(F.lit(x)) for x in cases])
    assert [tuple(r) for r in row] == list(cases.values())


def test_heading_rules(spark):
    tests = lambda x: tuple(row_of(spark, T.heading_tests(F.lit(x)))[0])
    assert tests("2.1 Scope") == (True, True, False, False)  # a digit is no capital
    assert tests("Scope of the work") == (True, False, True, False)
    assert tests("scope of the work") == (True, False, False, False)
    assert tests("範圍") == (True, False, True, False)
    assert tests("Figure 3: a drawing") == (False, False, False, False)
    assert tests("It is done as the plan says it must be.") == (False, False, False, True)
    assert tests("Parts, bolts and nuts of it") == (True, False, True, True)
    assert tests("1 w")[1] is False and tests("1 W")[1] and tests("1 w x")[1]
    match = lambda x, n, t, r=False: row_of(spark, T.heading_match(F.lit(x), F.lit(n), F.lit(t), r))[0]
    assert match("2.1 Scope of work", "2.1", "Scope") and match("2．1 Scope", "2.1.", "Scope") and not match("2.11 Scope here", "2.1", "Scope")
    assert match("Scope", "2.1", "Scope") and not match("Scope", "2.1", "Scope", True) and not match("scope", "2.1", "Scope") and match("The Scope of it", "", "Scope") and not match("The Scope of it", "9", "Scope")


def test_names_and_slugs(spark):
    row = row_of(spark, T.name_tokens(F.lit("Test_Report of the Pump 12-pump"), F.lit("report folder")), T.slug(F.lit("1.1"), "Scope & aim"), T.slug(F.lit(""), "。"), T.slug(F.lit("x" * 70)))
    assert row[0] == ["pump", "pump"] and row[1:3] == ("sec_1_1_Scope_aim", "section") and row[3][:61] == "x" * 60 + "_" and len(row[3]) == 69


def test_mapping_cells(spark):
    kind = lambda cell, what="": P.item_type(F.lit(cell), F.lit(what))
    row = row_of(spark, kind("圖", "Figure 2"), kind("圖片", "Add Image"), kind(" Extract All "), kind("羅馬標題"), kind("tables"), P.action(F.lit("1.2 x"), F.lit("")), P.action(F.lit("x"), F.lit("copy_folder")))
    assert list(row) == ["figure", "add_image", "extract_all", "roman_heading", "", "Extract chapter", "Copy folder"]
    tail = lambda x: row_of(spark, P.option_tail(F.lit(x)))[0]
    assert tuple(tail('"a|b"|Title = "x = y"|index=2|other=1')) == ('"a|b"', {"title": "x = y", "index": "2"}, None)
    assert tuple(tail("core|index=1|odd|title=x")) == ("core", {"index": "1"}, "odd") and tuple(tail("")) == ("", {}, None)
    assert tuple(row_of(spark, P.include_title(F.lit("不 要")))[0]) == ("no", None) and tuple(row_of(spark, P.insert_mode(F.lit("up")))[0]) == ("insert_after", "up")


def test_publishers(spark):
    numbers = {"BS EN ISO 14971:2019/A11:2021": ("ISO_FAMILY", "BS EN ISO", "14971", 2021), "EN IEC 60601-1:2006": ("ISO_FAMILY", "EN", "IEC 60601-1", 2006), "DIN EN 455-2": ("ISO_FAMILY", "BS EN", "455-2", None), "IEC 60601-1:2005+AMD1:2012": ("IEC_FAMILY", "IEC", "60601-1", 2012), "ASTM F1980-16": ("ASTM", "OTHER", "ASTM F1980", 2016), "ASTM D1-99(2004)": ("ASTM", "OTHER", "ASTM D1", 2004), "ISOX 1": (None, "OTHER", "ISOX 1", None), "iso 9001 : 2015": ("ISO_FAMILY", "ISO", "9001", 2015)}
    for x, want in numbers.items():
        r = row_of(spark, S.family(F.lit(x)), S.level(F.lit(x))["name"], S.match_key(F.lit(x)), S.latest_year(F.lit(x)))
        assert tuple(r) == want, x


def test_year_segments(spark):
    show = lambda a, b: row_of(spark, q_structure.marked(q_structure.year_diff(F.lit(a), F.lit(b))))[0]
    assert (show("2019", "2021"), show("1998", "2003"), show("1995", "2005"), show("2019", "2019"), show("", "2019")) == ("20[21]", "[2003]", "[200]5", "2019", "[2019]")


def test_deep_headings():
    assert Q.number_headings([11, 12]) == ["1.1.1.1.1.1.1.1.1.1.1", "1.1.1.1.1.1.1.1.1.1.1.1"]


def test_block_pairs_meet_across_stretches_and_are_not_broadcast(spark):
    """Gaps, repeated places and negative ones; the rows within reach must not go to the driver."""
    places = [(d, p) for d in (1, 2) for p in (-3, 0, 1, 1, 60, 61, 63, 64, 66, 68, 127, 131, 132, 400)]
    rows = [(d, p, "paragraph", f"line {p}", False, ["x"]) for d, p in places] + [(None, 1, "paragraph", "a", False, ["x"]), (3, None, "paragraph", "a", False, ["x"])]
    frame = spark.createDataFrame(rows, "doc_id long, pos long, kind string, line string, has_drawing boolean, probes array<string>")
    found = q_structure.scored_pairs(frame, 3, 5)
    got = sorted((r.doc_id, r.pos, r.other, r.score) for r in found.collect())
    want = sorted((a, p, o, 200 + len(f"line {p}") if p == o else 0) for a, p in places for b, o in places if a == b and p - 3 <= o <= p + 5)
    assert got == want
    plan = __spark_entry__.queries()["txt_block_score"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Broadcast" not in plan


def test_neighbours_are_matched_in_order_without_a_call_each(spark):
    found = __spark_entry__.queries()["join_ordered_text"](spark, "/root/testdata/sf0.001")
    assert "FlatMapCoGroups" not in found._jdf.queryExecution().toString()
    own = {}
    for r in q_search.lines(spark, "/root/testdata/sf0.001").filter("line <> ''").orderBy("doc_id", "pos").collect():
        own.setdefault(r.doc_id, []).append((r.pos, r.line))
    want = []
    for d in (d for d in own if d % 2 == 0):
        source = own.get(d - 1, []) + [x for x in own[d] if x[0] % 2 == 0]
        hits = Q.match_in_order([t for _, t in own[d]], [t for _, t in source])
        want += [(d, pos, None if h is None else source[h][0]) for (pos, _), h in zip(own[d], hits, strict=True)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_numbers_are_read_once_per_text(spark):
    """Rows, also those without a text, keep their number; the plan of the rows reads none."""
    frame = spark.createDataFrame([(1, n, t) for n, t in enumerate(["ISO 1:2010", "ISO 1:2010", "iso 1", None, "ASTM F1-10"])], "table_id int, row_no int, standards string")
    rows = M.keyed(frame)
    assert [(r.row_no, r.skey) for r in rows.orderBy("row_no").collect()] == [(0, "ISO_FAMILY|ISO,EN|1"), (1, "ISO_FAMILY|ISO,EN|1"), (2, "ISO_FAMILY|ISO,EN|1"), (3, "||"), (4, "ASTM|ASTM|ASTM F1")]
    assert "regexp" not in rows._jdf.queryExecution().toString()


def test_all_pairs_of_a_search_come_from_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 3)
    frame = spark.createDataFrame([(n % 4, n, f"ISO {n % 3}") for n in range(60)], "table_id int, row_no int, standards string")
    found = M.keyed(frame).select("skey").distinct().crossJoin(spark.range(20).select(F.col("id").cast("string").alias("candidate_id"), (F.col("id") * 2).alias("year")))
    got, want = (sorted(map(tuple, f(frame, found).select("table_id", "row_no", "candidate_id", "year").collect())) for f in (M.pairs_for_rows, M.for_rows))
    assert got == want and len(got) == 60 * 20


def test_pairs_are_dealt_by_block_and_laid_out_in_two_steps(spark, monkeypatch):
    """All pairs belong to one search: blocks meet by their numbers, not by the search, and
    generated code ends between candidates and rows, so it keeps one candidate's pairs."""
    monkeypatch.setattr(M, "BLOCK", 5)
    frame = spark.createDataFrame([(n % 4, n, "ISO 1") for n in range(40)], "table_id int, row_no int, standards string")
    found = M.keyed(frame).select("skey").distinct().crossJoin(spark.range(30).select(F.col("id").cast("string").alias("candidate_id")))
    pairs = M.pairs_for_rows(frame, found)
    assert pairs.columns == ["table_id", "row_no", "candidate_id"]
    assert sorted(map(tuple, pairs.collect())) == sorted((n % 4, n, str(c)) for n in range(40) for c in range(30))
    last, first = (pairs._jdf.queryExecution().optimizedPlan().toString().split("Repartition ", 1) + [""])[:2]
    assert "inline(_rows" in last and "explode(_found" in first and first.split(", ", 1)[1].startswith("false")
    assert all(f"({x}#" in first.split("Join Inner, ", 1)[1].split("\n")[0] for x in ("skey", "_b", "_f"))
    most = max(r[0] for r in pairs.groupBy(F.spark_partition_id()).count().select("count").collect())
    assert most < 40 * 30  # one search does not land in one task


def test_shown_candidates_are_worked_out_once(spark):
    """Places in a list go by the levels present, which are read from the same rows; unknown levels come last."""
    rows = [("a", "BS", 2010, False, 0, 1), ("a", "EN", 1999, True, 1, 2), ("a", "EN", 2001, True, 1, 3), ("a", "x", 2020, False, 0, 4), ("b", "x", 2020, False, 0, 5), ("b", "ISO", 1990, False, 0, 6), ("b", "BS", 2015, False, 0, 7)]
    frame = spark.createDataFrame(rows, "skey string, level string, year int, by_year boolean, sheet_order int, cat_row int").withColumn("want_family", F.lit("ISO_FAMILY"))
    found = M.shown(frame)
    assert [r.cat_row for r in found.orderBy("skey", "shown").collect()] == [3, 2, 1, 4, 6, 7, 5]
    assert found.columns == [*frame.columns, "shown"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_option_tails_are_split_once(spark):
    """The optimized plan splits a cell at its bars once, whatever is asked of it."""
    found = __spark_entry__.queries()["fn_option_tail"](spark, "/root/testdata/sf0.001")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
