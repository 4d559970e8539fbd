"""Rules over the blocks of documents: captions, sections, boundaries, pages, matches.

Blocks are rows (doc_id, pos, line, ...). Windows run within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def in_document():
    return Window.partitionBy("doc_id").orderBy("pos")


def without_orphans(lines: DataFrame, kind: Column) -> DataFrame:
    """Lines without captions that have no drawing on them, before or behind; the rest
    with ``kind`` and the numbers of each kind closed up."""
    near = lambda f: F.coalesce(f("has_drawing").over(in_document()), F.lit(False))
    rows = lines.withColumn("kind", kind).withColumn("_near", F.col("has_drawing") | near(F.lag) | near(F.lead))
    kept = rows.filter(F.col("kind").isNull() | F.col("_near")).drop("_near")
    return kept.withColumn("number", F.when(F.col("kind").isNotNull(), F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("pos"))))


#: Heading levels of the document format; deeper ones count as the last.
LEVELS = 9


def section_ranges(blocks: DataFrame, requests: DataFrame) -> DataFrame:
    """Where the sections asked for (doc_id, number, title, last) start and end.

    A heading that fits opens a section; where none fits, a plain line that does. It
    ends before the next heading of the same or a higher level; a section that
    opens at a plain line ends at the next numbered line that bounds it. With
    ``last``, the number of the section to include, it ends where that one does.
    ``until`` is null where it runs to the document's end.

    Every block learns once, from one window over its document, where the next heading
    of each level or above stands; requests look that up at the block they open at, so
    only those that open at a plain line meet the numbered lines behind them.
    """
    ahead = in_document().rowsBetween(1, Window.unboundedFollowing)
    depth = F.when(F.col("level").isNotNull(), F.least("level", F.lit(LEVELS)))
    following = F.array(*[F.min(F.when(depth <= n, F.col("pos"))).over(ahead) for n in range(1, LEVELS + 1)])
    rows = blocks.select("doc_id", "pos", "line", "level", T.number_parts("line").alias("parts"), following.alias("following"))
    hits = requests.join(rows, "doc_id").filter(T.heading_match("line", "number", "title"))
    keys = ["doc_id", "number", "title", "last"]
    start = hits.groupBy(*keys).agg(F.min(F.struct(F.col("level").isNull().alias("plain"), "pos")).alias("s")).select(*keys, F.col("s.pos").alias("start"))
    wanted = F.when(F.col("last") != "", F.transform(F.split("last", r"\."), lambda x: x.cast("int")))
    named = rows.filter("parts is not null").select("doc_id", F.col("pos").alias("at"), F.col("parts").alias("wanted"))
    ends = start.withColumn("wanted", wanted).join(named, ["doc_id", "wanted"]).filter(F.col("at") > F.col("start")).groupBy(*keys).agg(F.min("at").alias("at"))
    opens = start.join(ends, keys, "left").withColumn("pos", F.coalesce("at", "start"))
    opens = opens.join(rows.select("doc_id", "pos", "level", "parts", "following"), ["doc_id", "pos"])
    headed = opens.filter("level is not null").select(*keys, "start", F.get("following", F.least("level", F.lit(LEVELS)).cast("int") - 1).alias("until"))
    plain = opens.filter("level is null").select(*keys, "start", F.col("pos").alias("_from"), F.col("parts").alias("_parts"))
    numbered = rows.filter("parts is not null").select("doc_id", F.col("pos").alias("at"), F.col("parts").alias("p"))
    closes = plain.join(numbered, "doc_id").filter((F.col("at") > F.col("_from")) & T.number_boundary("_parts", "p", True)).groupBy(*keys).agg(F.min("at").alias("until"))
    return headed.unionByName(plain.select(*keys, "start").join(closes, keys, "left"))


def subsections(blocks: DataFrame, kind: str) -> DataFrame:
    """Each subheading (a block with ``kind``) with ``until``: the next one of the same
    kind that body text follows, null at the end. Blocks without text do not count."""
    rows = blocks.filter(T.norm_text("line") != "").withColumn("_body", F.lead(kind).over(in_document()).isNull() & F.lead("pos").over(in_document()).isNotNull())
    ahead = Window.partitionBy("doc_id", kind).orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    until = F.min(F.when(F.col("_body"), F.col("pos"))).over(ahead)
    return rows.filter(F.col(kind).isNotNull()).withColumn("until", until).select("doc_id", "pos", kind, "until")


def without_hidden(blocks: DataFrame, hide: DataFrame) -> DataFrame:
    """``blocks`` (doc_id, pos, cell, line and others) without those whose normalised text
    is one of ``hide`` (line). A table's cell never loses its last block: where all of
    its blocks go, the last one stays with an empty text. ``cell`` is null outside tables."""
    key = T.norm_text("line")
    asked = hide.select(T.norm_text("line").alias("_key")).filter("_key <> ''").distinct().withColumn("_hit", F.lit(True))
    rows = blocks.withColumn("_key", key).join(asked, "_key", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    cell = Window.partitionBy("doc_id", "cell")
    whole = F.col("cell").isNotNull() & F.col("_hit") & (F.col("pos") == F.max("pos").over(cell)) & F.min("_hit").over(cell)
    kept = rows.withColumn("_whole", whole).filter(~F.col("_hit") | F.col("_whole"))
    return kept.withColumn("line", F.when(F.col("_whole"), "").otherwise(F.col("line"))).select(blocks.columns)


#: Blocks looked through for the body text that follows a heading.
LOOK_AHEAD = 6


def _signals(blocks: DataFrame) -> DataFrame:
    tests = T.heading_tests("line")
    rows = blocks.withColumn("_h", tests).withColumn("_parts", T.number_parts("line"))
    text = T.norm_text("line") != ""
    ahead = F.first(F.when(text, F.struct("subheading", F.col("_h.unstructured").alias("u"), F.col("_h.sentence").alias("s"), "bold")), ignorenulls=True).over(in_document().rowsBetween(1, LOOK_AHEAD))
    follows = ahead["subheading"].isNull() & ~ahead["u"] & (ahead["s"] | ~ahead["bold"])
    return rows.withColumn("_body", F.coalesce(follows, F.lit(False))).filter(text)


def _behind(blocks: DataFrame, starts: DataFrame) -> DataFrame:
    """Blocks behind the start of the section asked for, with that block's own values."""
    own = starts.select("doc_id", F.col("pos").alias("start"))
    at = blocks.select("doc_id", F.col("pos").alias("start"), F.col("level").alias("ref_depth"), F.col("style").alias("ref_style"), F.col("ilvl").alias("ref_ilvl"), T.number_parts("line").alias("ref_parts"))
    return _signals(blocks).join(own.join(at, ["doc_id", "start"]), "doc_id").filter(F.col("pos") > F.col("start"))


def boundary_scores(blocks: DataFrame, starts: DataFrame) -> DataFrame:
    """Blocks that may end the section opened at ``starts`` (doc_id, pos), with their
    score, 6 at least. Blocks have level, style, ilvl, bold, subheading (inline,
    styled_bold or null) and in_table. The points are fixed values."""
    c = F.col
    rows = _behind(blocks, starts)
    numbered, depth = F.coalesce(F.size("_parts") > 0, F.lit(False)), c("level").isNotNull()
    none = lambda *names: ~F.coalesce(*[c(n).cast("string") for n in names]).isNotNull()
    barred = c("in_table") | T.norm_text("line").rlike(T.CAPTION_LIKE) | c("_h.sentence") | (none("level", "style", "ilvl", "subheading") & ~numbered & (~c("_h.unstructured") | none("ref_style", "ref_ilvl")))
    points = [
        F.when(c("ref_depth").isNotNull() & depth & (c("level") <= c("ref_depth")) & c("_h.boundary"), 6).when(depth, 3),
        F.when(c("style") == c("ref_style"), 4),
        F.when(c("ilvl") == c("ref_ilvl"), 4).when(c("ilvl") < c("ref_ilvl"), 2),
        F.when(numbered & T.number_boundary("ref_parts", "_parts", True), 6).when(numbered, 1),
        F.when(c("subheading") == "inline", 5).when(c("subheading") == "styled_bold", 4).when(c("bold"), 2),
        F.when(c("_h.unstructured"), 2),
        F.when(T.words("line") <= 8, 1),
        F.when(c("_body"), 3).when(c("subheading").isNull() & ~numbered & ~depth, -3),
    ]
    score = F.lit(0)
    for p in points:
        score = score + F.coalesce(p, F.lit(0))
    return rows.filter(~barred).select("doc_id", "pos", score.alias("score")).filter("score >= 6")


def best_boundary(scores: DataFrame) -> DataFrame:
    """The highest score of each document, the earliest on ties."""
    return scores.groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("pos")).alias("p"))).alias("m")).select("doc_id", (-F.col("m.p")).alias("pos"), "m.score")


def boundary_candidates(blocks: DataFrame, starts: DataFrame, scan: int = 48, most: int = 18) -> DataFrame:
    """Up to ``most`` blocks within ``scan`` behind the start that carry any sign of a
    heading, in order, with the signs."""
    c = F.col
    rows = _behind(blocks, starts).filter(~c("in_table") & (c("pos") <= c("start") + scan))
    signs = c("level").isNotNull() | c("bold") | c("ilvl").isNotNull() | F.coalesce(F.size("_parts") > 0, F.lit(False)) | F.coalesce(c("style") == c("ref_style"), F.lit(False))
    rows = rows.filter(signs | (c("_h.boundary") & c("_h.unstructured"))).withColumn("place", F.row_number().over(in_document()))
    return rows.filter(c("place") <= most).select("doc_id", "pos", "place", c("level").alias("heading_depth"), "style", "ilvl", "bold", c("_h.boundary").alias("looks_heading_like"))


def page_clusters(scores: DataFrame, many: bool = True) -> DataFrame:
    """Pages (doc_id, page) from ``start`` on that show an object: the best one (highest
    score, lowest number) and, with ``many``, its neighbours without a gap that reach a
    third of its score. Pages are scored by ``primary`` probes, where those find
    nothing by ``fallback`` ones; where these find nothing either, it is the start page."""
    doc = Window.partitionBy("doc_id")
    rows = scores.filter(F.col("page") >= F.col("start"))
    rows = rows.withColumn("score", F.when(F.max("primary").over(doc) > 0, F.col("primary")).otherwise(F.col("fallback")))
    rows = rows.withColumn("top", F.max("score").over(doc))
    rows = rows.withColumn("best", F.min(F.when(F.col("score") == F.col("top"), F.col("page"))).over(doc))
    found = rows.filter((F.col("top") > 0) & (F.col("score") >= F.greatest(F.lit(1), F.ceil(F.col("top") / 3))))
    found = found.withColumn("_island", F.col("page") - F.row_number().over(Window.partitionBy("doc_id").orderBy("page")))
    found = found.withColumn("_own", F.max(F.when(F.col("page") == F.col("best"), F.col("_island"))).over(doc))
    keep = F.col("_island") == F.col("_own") if many else F.col("page") == F.col("best")
    lost = rows.filter("top <= 0").groupBy("doc_id").agg(F.min("start").alias("page"))
    return found.filter(keep).select("doc_id", "page").unionByName(lost.select("doc_id", "page"))


def separators(fragments: DataFrame) -> DataFrame:
    """Per fragment, whether an empty block must stand behind it: it ends with a table and the next one starts with one."""
    ends = fragments.groupBy("doc_id", "fragment").agg(F.min_by("is_table", "pos").alias("first"), F.max_by("is_table", "pos").alias("last"))
    after = F.lead("first").over(Window.partitionBy("doc_id").orderBy("fragment"))
    return ends.select("doc_id", "fragment", (F.col("last") & F.coalesce(after, F.lit(False))).alias("separator"))


def page_sources(blocks: DataFrame) -> DataFrame:
    """Sources of each page with their number of blocks, in the order they appear; the
    dominant one has most blocks, then the smallest name. Context rows do not count."""
    per = blocks.filter(~F.col("context")).groupBy("doc_id", "page", "source").agg(F.count("*").alias("n"), F.min("pos").alias("_at"))
    page = Window.partitionBy("doc_id", "page")
    shown, rank = F.row_number().over(page.orderBy("_at", "source")), F.row_number().over(page.orderBy(F.desc("n"), "source"))
    return per.select("doc_id", "page", "source", "n", shown.alias("shown"), (rank == 1).alias("dominant"))


def in_contents(toc: DataFrame, requests: DataFrame) -> DataFrame:
    """Contents rows (number, title) that a request asks for: number and title are equal once normalised."""
    number = lambda c: F.regexp_replace(F.translate(T.norm_text(c), "．", "."), r"\.+$", "")
    keyed = lambda rows: rows.withColumn("_n", number("number")).withColumn("_t", F.lower(T.norm_text("title")))
    return keyed(toc).join(keyed(requests).select("_n", "_t"), ["_n", "_t"], "left_semi").drop("_n", "_t")


def block_score(a: str, b: str) -> Column:
    """How well source block ``a`` matches target block ``b`` (structs of kind, line,
    has_drawing, probes). Tables: lengths of the first 12 source probes that the
    target has; equal texts 200 and up; containment 80 and up; two drawings 40 and
    the probes found in the target's text. The points are fixed values."""
    x, y = lambda n: F.col(f"{a}.{n}"), lambda n: F.col(f"{b}.{n}")
    total = lambda sizes: F.aggregate(sizes, F.lit(0), lambda s, v: s + v)
    size = lambda p: F.least(F.length(p), F.lit(80))
    shared = total(F.transform(F.filter(F.slice(x("probes"), F.lit(1), F.lit(12)), lambda p: (p != "") & F.array_contains(y("probes"), p)), size))
    s, t = T.norm_text(x("line")), T.norm_text(y("line"))
    inside = (F.length(s) >= 18) & (t != "") & (F.contains(t, s) | F.contains(s, t))
    drawn = F.lit(40) + total(F.transform(F.filter(x("probes"), lambda p: (T.norm_text(p) != "") & F.contains(t, T.norm_text(p))), lambda p: size(T.norm_text(p))))
    table = (x("kind") == "table") | (y("kind") == "table")
    return (
        F.when(table, F.when(x("kind") == y("kind"), shared).otherwise(0)).when((s != "") & (s == t), 200 + F.least(F.length(s), F.lit(120)))
        .when(inside, 80 + F.least(F.length(s), F.length(t), F.lit(80))).when(x("has_drawing") & y("has_drawing"), drawn).otherwise(0)
    )
