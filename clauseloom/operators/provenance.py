"""Where the blocks of a result come from: ranges, bookmarks and placed fragments."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .sequences import walk_groups

#: Blocks in one bin of a document: ranges and blocks meet by bin.
BIN = 64


def ranged(blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """(doc_id, pos, source) for blocks that a range (doc_id, source, first, last)
    covers: the first of them by start, then end, then source. Ranges that begin
    before 0 or end before they begin do not count. A range is dealt to the bins of
    its document that it touches, so a block meets the ranges of its bin alone."""
    ends = blocks.groupBy("doc_id").agg(F.max("pos").alias("_end"))
    sound = ranges.filter("first >= 0 and last >= first").join(ends, "doc_id").filter("first <= _end")
    bins = F.sequence(F.floor(F.col("first") / BIN), F.floor(F.least("last", "_end") / BIN))
    r = sound.select("doc_id", "source", "first", "last", F.explode(bins).alias("_bin"))
    met = blocks.select("doc_id", "pos", F.floor(F.col("pos") / BIN).alias("_bin")).join(r, ["doc_id", "_bin"]).filter(F.col("pos").between(F.col("first"), F.col("last")))
    return met.groupBy("doc_id", "pos").agg(F.min(F.struct("first", "last", "source")).alias("r")).select("doc_id", "pos", "r.source")


def open_sources(blocks: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, pos, source) for blocks under an open bookmark.

    ``marks`` (doc_id, pos, seq, id, source, is_end): bookmarks that start or end in a
    block, in the order of seq; an end names an id and closes the source that the id
    last stood for. A block that starts bookmarks closes all open ones first; the
    source of a block is the last one that is open, once its own starts are read and
    before its ends are. Everything is read off the events in order: ends learn
    their source from the last start of their id, events and blocks the last block
    that started any, and the n-th end of a source closes its n-th last start there.
    """
    at = ["pos", F.col("is_end").cast("int"), "seq"]
    known = F.last(F.when(~F.col("is_end"), F.col("source")), ignorenulls=True).over(Window.partitionBy("doc_id", "id").orderBy(*at))
    opened = F.last(F.when(~F.col("is_end"), F.col("pos")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy(*at))
    events = marks.withColumn("source", F.when(F.col("is_end"), known).otherwise(F.col("source"))).filter("source is not null").withColumn("opened", opened)
    same = Window.partitionBy("doc_id", "opened", "source")
    starts = events.filter("not is_end").withColumn("n", F.row_number().over(same.orderBy(F.desc("seq"))))
    ends = events.filter("is_end and opened is not null").withColumn("n", F.row_number().over(same.orderBy("pos", "seq")))
    ends = ends.select("doc_id", "opened", "source", "n", F.col("pos").alias("closed"))
    lives = starts.join(ends, ["doc_id", "opened", "source", "n"], "left").groupBy("doc_id", "opened")
    lives = lives.agg(F.sort_array(F.collect_list(F.struct("seq", "source", "closed")), asc=False).alias("lives"))  # the bookmarks of one block
    sweep = blocks.select("doc_id", "pos", F.lit(None).cast(lives.schema["lives"].dataType).alias("lives"))
    sweep = sweep.withColumn("is_block", F.lit(True)).unionByName(lives.select("doc_id", F.col("opened").alias("pos"), "lives", F.lit(False).alias("is_block")))
    carried = F.last("lives", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("pos", F.col("is_block").cast("int")))
    rows = sweep.withColumn("lives", carried).filter("is_block")
    alive = F.filter("lives", lambda x: x["closed"].isNull() | (x["closed"] >= F.col("pos")))
    return rows.select("doc_id", "pos", F.get(alive, F.lit(0))["source"].alias("source")).filter("source is not null")


#: What a block without a source is said to come from; a fixed value.
UNKNOWN = "未知來源"


def block_trace(blocks: DataFrame, ranges: DataFrame, marks: DataFrame, sources: DataFrame, hidden: tuple[str, ...] = ()) -> DataFrame:
    """The visible blocks of each result in order, with the source whose range covers
    them, else whose bookmark is open, else unknown.

    ``blocks``: doc_id, pos, kind (paragraph or table), line, probes. ``sources``: source,
    source_file, content_type, probes (of its first picture). A paragraph with text that
    is not hidden is shown; one without is shown as a picture if its source is one and has
    probes; a table is shown if it has probes.
    """
    src = F.coalesce("_range", "_open")
    found = blocks.join(ranged(blocks, ranges).withColumnRenamed("source", "_range"), ["doc_id", "pos"], "left")
    found = found.join(open_sources(blocks, marks).withColumnRenamed("source", "_open"), ["doc_id", "pos"], "left").withColumn("source", src)
    meta = sources.select("source", "source_file", "content_type", F.col("probes").alias("_pictures"))
    found = found.join(meta, "source", "left")
    text, table = T.norm_text("line"), F.col("kind") == "table"
    told = (text != "") & ~text.isin(*hidden) if hidden else text != ""
    solid = lambda p: F.filter(F.transform(F.coalesce(p, F.array().cast("array<string>")), T.norm_text), lambda x: x != "")
    picture = F.col("content_type").isin("figure", "pdf_image") & (F.size(solid(F.col("_pictures"))) > 0)
    kind = F.when(table, F.when(F.size(solid(F.col("probes"))) > 0, "table")).when(told, "paragraph").when(picture, F.col("content_type"))
    probes = F.when(table, solid(F.col("probes"))).when(told, F.array(text)).otherwise(solid(F.col("_pictures")))
    shown = found.withColumn("block_type", kind).filter("block_type is not null")
    given = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    return shown.select(
        "doc_id", "pos", (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1).alias("block_index"), "block_type",
        F.coalesce("source", F.lit("")).alias("source_id"), F.coalesce(given(F.col("source_file")), F.lit(UNKNOWN)).alias("source_file"),
        F.coalesce(given(F.col("content_type")), F.when(table, "table").otherwise("paragraph")).alias("content_type"),
        F.when(table | ~told, "").otherwise(F.col("line")).alias("text"), probes.alias("probe_texts"),
    )


# --- fragments placed in a result, one document at a time ---

#: Letters of the pieces by which texts that hold one another are found.
PIECE = 8
#: Most drawings that are looked at one by one before a full match.
NEAR = 32


class Targets:
    """The blocks of a result (kind, text, has_drawing, probes), found by equal text, by
    probe, by drawing and by contained text, so no block is scored against all others.
    Texts are indexed by every eighth piece, which all texts of 15 letters meet; only
    shorter ones are looked for in each distinct text. Probes are looked for in the
    distinct words of the drawings' texts, once each."""

    def __init__(self, blocks: list[tuple[str, str, bool, list[str]]]):
        self.blocks = blocks
        self.texts, self.short, self.heads, self.probes = (defaultdict(list) for _ in range(4))
        self.drawn, self.pieces, self.words, self.seen = [], None, None, {}
        for i, (kind, text, drawing, probes) in enumerate(blocks):
            if kind == "table":
                for p in set(probes):
                    self.probes[p].append(i)
                continue
            if drawing:
                self.drawn.append(i)
            if text:
                self.texts[text].append(i)
                (self.short if len(text) < PIECE else self.heads)[text[:PIECE]].append(i)
        self.sizes = sorted({len(t) for t in self.short})

    def holding(self, text: str) -> list[int]:
        """Blocks whose text contains ``text``: for each way it may lie to the pieces, those with its rarest one, looked at."""
        last = len(text) - PIECE
        if last < PIECE - 1:
            return [i for t, at in self.texts.items() if text in t for i in at]
        if self.pieces is None:
            self.pieces = defaultdict(list)
            for t, at in self.texts.items():
                for piece in {t[k : k + PIECE] for k in range(0, len(t) - PIECE + 1, PIECE)}:
                    self.pieces[piece].append((t, at))
        found = {}
        for r in range(PIECE):
            rarest = min((self.pieces.get(text[k : k + PIECE], ()) for k in range(r, last + 1, PIECE)), key=len)
            found.update((t, at) for t, at in rarest if text in t)
        return [i for at in found.values() for i in at]

    def within(self, text: str) -> set[int]:
        """Blocks whose text ``text`` contains."""
        out = {i for n in self.sizes for k in range(len(text) - n + 1) for i in self.short.get(text[k : k + n], ())}
        for k in range(len(text) - PIECE + 1):
            out.update(i for i in self.heads.get(text[k : k + PIECE], ()) if text.startswith(self.blocks[i][1], k))
        return out

    def drawings(self, probe: str) -> list[int]:
        """Drawings whose text contains ``probe``, in order."""
        if probe in self.seen:
            return self.seen[probe]
        if self.words is None:
            words = defaultdict(list)
            for i in self.drawn:
                for w in set(self.blocks[i][1].split(" ")):
                    words[w].append(i)
            self.words, self.all = list(words.values()), " ".join(words)
            self.starts = [0, *accumulate(len(w) + 1 for w in words)]
        if " " in probe:
            out = {i for i in self.drawn if probe in self.blocks[i][1]}
        else:
            out, k = set(), self.all.find(probe)
            while k >= 0:
                n = bisect_right(self.starts, k) - 1
                out.update(self.words[n])
                k = self.all.find(probe, self.starts[n + 1])
        self.seen[probe] = sorted(out)
        return self.seen[probe]

    def best(self, block: tuple[str, str, bool, list[str]], start: int) -> int | None:
        """The block from ``start`` on that ``block`` matches: the first with a score of 200, else
        the best, the first on ties. The points are fixed values."""
        kind, text, drawing, probes = block
        scores = defaultdict(int)
        full = None
        if kind == "table":
            for p in [p for p in probes if p.strip()][:12]:
                at = self.probes.get(p, ())
                for i in at[bisect_left(at, start) :] if at else ():
                    scores[i] += min(len(p), 80)
        else:
            same = self.texts.get(text, []) if text else []
            k = bisect_left(same, start)
            full = same[k] if k < len(same) else None  # 200 and more
            long = len(text) >= 18
            if drawing:
                lo, hi = bisect_left(self.drawn, start), len(self.drawn) if full is None else bisect_left(self.drawn, full)
                if lo < hi:
                    scores[self.drawn[lo]] = 40  # the first of those without a probe
                sizes = [(p, min(len(p), 80)) for p in probes if p]
                if hi - lo <= NEAR:
                    for i in self.drawn[lo:hi]:
                        if points := sum(n for p, n in sizes if p in self.blocks[i][1]):
                            scores[i] = 40 + points
                elif full is None or sum(n for _, n in sizes) >= 160:
                    for p, n in sizes:
                        at = self.drawings(p)
                        for i in at[bisect_left(at, start) : len(at) if full is None else bisect_left(at, full)]:
                            scores[i] = max(scores[i], 40) + n
            if full is not None:  # only a drawing before it with as many points could win, unless it scores as contained
                inside = lambda t: long and t != "" and (t in text or text in t)
                return min((i for i, s in scores.items() if s >= 200 and not inside(self.blocks[i][1])), default=full)
            if long:
                for i in {*self.holding(text), *self.within(text)}:
                    scores[i] = 80 + min(len(text), len(self.blocks[i][1]), 80)
        found = [(-s, i) for i, s in scores.items() if i >= start and s > 0]
        early = min((i for s, i in found if -s >= 200), default=None)
        if early is not None:
            return early
        return min(found)[1] if found else None


def placed(targets: list[tuple], fragments: list[list[tuple]]) -> list[tuple[int, int] | None]:
    """The first and last block that each fragment's blocks match, in order, behind those of
    the fragment before; none where a block matches nothing, which moves nothing on."""
    index, cursor, out = Targets(targets), 0, []
    for fragment in fragments:
        at, hits = cursor, []
        for block in fragment:
            hit = index.best(block, at)
            if hit is None:
                break
            hits.append(hit)
            at = hit + 1
        whole = bool(fragment) and len(hits) == len(fragment)
        out.append((hits[0], hits[-1]) if whole else None)
        cursor = hits[-1] + 1 if whole else cursor
    return out


def place_fragments(targets: DataFrame, fragments: DataFrame) -> DataFrame:
    """(doc_id, fragment, first, last): ranges of blocks of a result that hold its fragments, in
    order. Both have doc_id, pos, kind, text (normalised), has_drawing and probes; one
    document is one task's work, as each place depends on the one before."""
    used = F.when((F.col("kind") == "table") | F.col("has_drawing"), F.col("probes"))
    columns = ["pos", "kind", "text", "has_drawing", used.alias("probes")]
    both = targets.select("doc_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("fragment"), *columns)
    both = both.unionByName(fragments.select("doc_id", F.lit(1).alias("part"), F.col("fragment").cast("long").alias("fragment"), *columns))

    def f(rows):
        own, at, parts = [], [], defaultdict(list)
        for _, part, fragment, pos, kind, text, drawing, probes in rows:
            if part:
                parts[fragment].append((kind, text, bool(drawing), probes or []))
            else:
                own.append((kind, text, bool(drawing), probes or []))
                at.append(pos)
        if own and parts:
            spans = placed(own, list(parts.values()))
            yield from ((rows[0][0], n, at[s[0]], at[s[1]]) for n, s in zip(parts, spans, strict=True) if s)

    return walk_groups(both, ["doc_id"], ["part", "fragment", "pos"], f, dict.fromkeys(("doc_id", "fragment", "first", "last"), "long"))
