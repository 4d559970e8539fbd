"""Queries over document structure and provenance."""

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import contents as C
from ..operators import provenance as P
from ..operators import sequences as Q
from ..operators import structure as B
from ..sources.views import sql, table, view
from .book import Book
from .q_functions import norm
from .q_search import D_LINES, lines

book = Book()


def per_group(rows: DataFrame, keys: list[str], order: list[str], f, schema: str) -> DataFrame:
    """Runs ``f`` on each group's rows in order."""
    return rows.groupBy(*keys).applyInPandas(lambda pdf: f(pdf.sort_values(order)), schema)


# --- headings, lists, captions ---
HEADING_STYLE = "case when pos % 11 = 3 then 'Heading 2' when pos % 11 = 5 then ' heading3 x' when pos % 11 = 7 then 'Body' end"


@book.add("win_heading_numbers")
def win_heading_numbers(spark, d):
    """Numbers of headings by their place, written into their texts; other lines stay."""
    rows = view(spark, d, "heading_view").unionByName(view(spark, d, "toc_view").select((-1 - F.col("doc_id")).alias("doc_id"), "pos", "line"))
    return C.renumbered_headings(rows.withColumn("style", F.expr(HEADING_STYLE)))


@book.add("win_ordinal_heading")
def win_ordinal_heading(spark, d):
    f = lambda p: pd.DataFrame({"doc_id": p.doc_id, "pos": p.pos, "path": Q.number_headings(p.level.tolist(), fill=False)})
    rows = per_group(view(spark, d, "toc_view").select("doc_id", "pos", "level"), ["doc_id"], ["pos"], f, "doc_id long, pos long, path string")
    return rows.filter("path = '2.1'")


@book.add("win_list_numbers")
def win_list_numbers(spark, d):
    def f(p):
        labels = Q.list_labels((p.p_size % 3).tolist(), ["decimal", "lowerLetter", "upperRoman"], ["%1.", "%1.%2)", "%3"], [1, 1, 1])
        return pd.DataFrame({"list_id": p.list_id, "p_partkey": p.p_partkey, "label": labels})

    rows = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 30).alias("list_id"), "p_partkey", "p_size")
    return per_group(rows, ["list_id"], ["p_partkey"], f, "list_id long, p_partkey long, label string")


@book.add("win_caption_numbers")
def win_caption_numbers(spark, d):
    f = lambda p: pd.DataFrame({"doc_id": p.doc_id, "pos": p.pos, "line": Q.renumber_captions(p.line.tolist(), p.is_heading.tolist())})
    return per_group(view(spark, d, "caption_view").select("doc_id", "pos", "line", "is_heading"), ["doc_id"], ["pos"], f, "doc_id long, pos long, line string")


@book.add("win_orphan_captions", """with c as (select *, case when line like 'Figure %' then 'Figure' when line like 'Table %' then 'Table' end as kind from caption_view),
k as (select * from c where kind is null or exists (select 1 from c n where n.doc_id = c.doc_id and n.has_drawing and n.pos between c.pos - 1 and c.pos + 1))
select doc_id, pos, kind, case when kind is not null then (select count(*) from k m where m.doc_id = k.doc_id and m.kind = k.kind and m.pos <= k.pos) end as number from k""", "caption_view")
def win_orphan_captions(spark, d):
    kind = F.nullif(F.regexp_extract("line", "^(Figure|Table) ", 1), F.lit(""))
    return B.without_orphans(view(spark, d, "caption_view"), kind).select("doc_id", "pos", "kind", "number")


_ASKED = "select distinct doc_id, n.number, n.title, n.last from toc_view cross join (values ('2', 'Heading', ''), ('1.1', 'Heading', '3'), ('', 'is described here', ''), ('9', 'full.', ''), ('3', 'Heading', '3.1')) n(number, title, last)"


@book.add("win_section_range", f"""with asked as ({_ASKED}), t as (select *, regexp_extract(line, '^([0-9]+([.][0-9]+)*)', 1) as num from toc_view),
hit as (select a.*, t.pos, t.level from asked a join t on a.doc_id = t.doc_id and case when number = '' then contains(line, title) when t.num = number or starts_with(t.num, number || '.') then contains(line, title) else ends_with(line, title) end),
st as (select doc_id, number, title, last, arg_min(pos, (level is null, pos)) as start, arg_min(coalesce(level, 0), (level is null, pos)) as depth from hit group by all),
op as (select st.*, coalesce(l.pos, start) as opens, coalesce(l.level, depth) as d from st left join t l on l.doc_id = st.doc_id and l.num = st.last and l.num <> '' and l.pos > st.start)
select op.doc_id, number, title, last, start, min(t.pos) as until from op left join t on t.doc_id = op.doc_id and t.pos > opens and t.level <= d group by all""", "toc_view")
def win_section_range(spark, d):
    asked = sql(spark, d, _ASKED)
    return B.section_ranges(view(spark, d, "toc_view"), asked)


@book.add("win_subsection", """with n as (select *, row_number() over (partition by doc_id order by pos) as k from block_view where line <> ''),
b as (select n.*, m.k is not null and m.subheading is null as body from n left join n m on m.doc_id = n.doc_id and m.k = n.k + 1)
select a.doc_id, a.pos, a.subheading, min(z.pos) as until from b a left join b z on z.doc_id = a.doc_id and z.pos > a.pos and z.subheading = a.subheading and z.body where a.subheading is not null group by all""", "block_view")
def win_subsection(spark, d):
    return B.subsections(view(spark, d, "block_view"), "subheading")


_STARTS = "select doc_id, min(pos) as pos from block_view where level is not null and pos >= doc_id % 3 * 4 group by doc_id"
_LW = "list_filter(string_split(line, ' '), lambda w: w <> '')"
_CAP = "regexp_matches(line, '^(Figure|Table) [0-9]+:? ')"
_FINAL = "right(line, 1) = '.'"
_SIGN = f"""w as (select *, len({_LW}) as n, list_transform(string_split(nullif(regexp_extract(line, '^([0-9]+([.][0-9]+)*)', 1), ''), '.'), lambda x: x::int) as parts, {_CAP} as caption from block_view),
h as (select *, n between 1 and 28 and not caption and (n <= 6 or not {_FINAL}) as boundary, n between 2 and 20 and not caption and not {_FINAL} and regexp_matches(line, '^[A-Z]') as unstr, n >= 14 or (n >= 5 and {_FINAL}) or (n >= 6 and contains(line, ',')) as sent from w),
nx as (select a.doc_id, a.pos, min(b.pos) as at from h a join h b on b.doc_id = a.doc_id and b.pos between a.pos + 1 and a.pos + 6 and b.line <> '' group by all),
f as (select h.*, coalesce(m.subheading is null and not m.unstr and (m.sent or not m.bold), false) as body from h left join nx on nx.doc_id = h.doc_id and nx.pos = h.pos left join h m on m.doc_id = h.doc_id and m.pos = nx.at where h.line <> ''),
st as ({_STARTS}), r as (select st.doc_id, st.pos as start, level as rd, style as rs, ilvl as ri, parts as rp from st join h on h.doc_id = st.doc_id and h.pos = st.pos),
x as (select f.*, r.* exclude (doc_id) from f join r on f.doc_id = r.doc_id and f.pos > r.start)"""
_ENDS = "coalesce(len(parts) <= len(rp) and parts <> rp and (len(parts) = len(rp) or (parts[len(parts)] <> rp[len(parts)] and (len(parts) = 1 or parts[1] = rp[1]))), false)"
_POINTS = f"""case when level is null then 0 when level <= rd and boundary then 6 else 3 end + case when style = rs then 4 else 0 end + case when ilvl = ri then 4 when ilvl < ri then 2 else 0 end
 + case when parts is null then 0 when {_ENDS} then 6 else 1 end + case when subheading = 'inline' then 5 when subheading = 'styled_bold' then 4 when bold then 2 else 0 end
 + case when unstr then 2 else 0 end + case when n <= 8 then 1 else 0 end + case when body then 3 when subheading is null and parts is null and level is null then -3 else 0 end"""
_SC = f"""s as (select doc_id, pos, {_POINTS} as score from x where not in_table and not caption and not sent and not (level is null and style is null and ilvl is null and parts is null and subheading is null and (not unstr or (rs is null and ri is null))))"""


@book.add("win_boundary_score", f"with {_SIGN}, {_SC} select doc_id, arg_min(pos, (-score, pos)) as pos, max(score) as score from s where score >= 6 group by 1", "block_view")
def win_boundary_score(spark, d):
    return B.best_boundary(B.boundary_scores(view(spark, d, "block_view"), sql(spark, d, _STARTS)))


@book.add("win_boundary_candidates", f"""with {_SIGN}, c as (select *, row_number() over (partition by doc_id order by pos) as place from x where not in_table and pos <= start + 30 and (level is not null or bold or ilvl is not null or parts is not null or coalesce(style = rs, false) or (boundary and unstr)))
select doc_id, pos, place, level as heading_depth, style, ilvl, bold, boundary as looks_heading_like from c where place <= 12""", "block_view")
def win_boundary_candidates(spark, d):
    return B.boundary_candidates(view(spark, d, "block_view"), sql(spark, d, _STARTS), 30, 12)


_PAGES = "select doc_id, pos as page, doc_id % 3 as start, case when doc_id % 5 < 2 then 0 else length(line) * 7 % 23 end as primary_score, case when doc_id % 5 = 0 then 0 else pos % 4 end as fallback from toc_view"


@book.add("win_page_cluster", f"""with recursive p as (select * from ({_PAGES}) where page >= start), m as (select doc_id, min(start) as start, max(primary_score) as a, max(fallback) as b from p group by 1),
k as (select p.doc_id, page, case when a > 0 then primary_score else fallback end as score, greatest(a, case when a > 0 then 0 else b end) as top from p join m on p.doc_id = m.doc_id),
best as (select doc_id, min(page) as page from k where score = top and top > 0 group by 1),
up as (select * from best union all select k.doc_id, k.page from up join k on k.doc_id = up.doc_id and k.page = up.page + 1 and k.score * 3 >= k.top and k.score > 0),
down as (select * from best union all select k.doc_id, k.page from down join k on k.doc_id = down.doc_id and k.page = down.page - 1 and k.score * 3 >= k.top and k.score > 0)
select * from up union select * from down union select doc_id, start from m where a = 0 and b = 0""", "toc_view")
def win_page_cluster(spark, d):
    return B.page_clusters(sql(spark, d, _PAGES).withColumnRenamed("primary_score", "primary"))


@book.add("win_merge_separator", """with f as (select distinct doc_id, floor(pos / 10) as fragment from toc_view), t as (select *, floor(pos / 10) as fragment from toc_view)
select doc_id, fragment, (select has_drawing from t where t.doc_id = f.doc_id and t.fragment = f.fragment order by pos desc limit 1) and coalesce((select has_drawing from t where t.doc_id = f.doc_id and t.fragment > f.fragment order by pos limit 1), false) as separator from f""", "toc_view")
def win_merge_separator(spark, d):
    return B.separators(view(spark, d, "toc_view").select("doc_id", F.floor(F.col("pos") / 10).alias("fragment"), "pos", F.col("has_drawing").alias("is_table")))


def win_conflict_suffix(spark, d):
    """Suffix of a file name two sources share: the last path part in which they differ and that has a meaningful token."""
    paths = table(spark, d, "pages").select("page_id", F.regexp_replace("url", r"^https?://|[?#].*$", "").alias("path")).withColumn("k", F.floor(F.col("page_id") / 2))
    a, b = paths.filter("page_id % 2 = 0"), paths.filter("page_id % 2 = 1").select("k", F.col("path").alias("other"))
    words = lambda p: F.array_distinct(T.name_tokens(p, drop=("http", "https", "www", "com", "net", "org", "example", "m")))
    pairs = F.zip_with(F.reverse(F.split("path", "/")), F.reverse(F.split("other", "/")), lambda x, y: F.struct(x.alias("x"), (x.isNotNull() & ~x.eqNullSafe(y)).alias("d")))
    found = F.filter(pairs, lambda p: p["d"] & (F.size(words(p["x"])) > 0))
    return a.join(b, "k").select("page_id", F.array_join(words(F.get(found, F.lit(0))["x"]), "_").alias("suffix"))


# --- provenance ---
_RANGES = "select doc_id, pos as source, pos as first, pos + level * 5 as last from toc_view where level is not null"


@book.add("join_block_ranges", f"with r as ({_RANGES}) select b.doc_id, b.pos, arg_min(source, first * 1000 + last) as source from toc_view b join r on r.doc_id = b.doc_id and b.pos between first and last group by 1, 2", "toc_view")
def join_block_ranges(spark, d):
    return P.ranged(view(spark, d, "toc_view"), sql(spark, d, _RANGES))


@book.add("agg_page_sources", """with b as (select doc_id, floor(pos / 8) as page, coalesce(level, 0) + pos % 3 as source, pos from toc_view where not has_drawing), g as (select doc_id, page, source, count(*) as n, min(pos) as first from b group by all)
select doc_id, page, source, n, (select count(*) from g o where o.doc_id = g.doc_id and o.page = g.page and o.first <= g.first) as shown, not exists (select 1 from g o where o.doc_id = g.doc_id and o.page = g.page and (o.n > g.n or (o.n = g.n and o.source < g.source))) as dominant from g""", "toc_view")
def agg_page_sources(spark, d):
    source = F.coalesce("level", F.lit(0)) + F.col("pos") % 3
    return B.page_sources(view(spark, d, "toc_view").select("doc_id", F.floor(F.col("pos") / 8).alias("page"), source.alias("source"), "pos", F.col("has_drawing").alias("context")))


@book.add("join_toc_request", """select doc_id, pos from toc_view where level is not null and (regexp_extract(line, '^([0-9.]+)', 1), lower(trim(regexp_replace(line, '^[0-9.]+', '')))) in (select case when p_partkey % 16 = 0 then '1' else '2' end, lower('heading ' || p_name) from part)""", "toc_view")
def join_toc_request(spark, d):
    rows = view(spark, d, "toc_view").filter("level is not null")
    toc = rows.select("doc_id", "pos", F.regexp_extract("line", r"^([\d.]+)", 1).alias("number"), F.regexp_replace("line", r"^[\d.]+", "").alias("title"))
    asked = table(spark, d, "part").select(F.when(F.col("p_partkey") % 16 == 0, "1.").otherwise("2").alias("number"), F.concat(F.lit(" HEADING  "), F.upper("p_name")).alias("title"))
    return B.in_contents(toc, asked).select("doc_id", "pos")


@book.add("join_template_anchor", """with k as (select doc_id, lower(replace(line, ' ', '')) as k, min(pos) as pos from toc_view group by 1, 2), l as (select doc_id, max(pos) as last from toc_view group by 1),
q as (select doc_id, pos as req, case pos % 3 when 0 then lower(replace(line, ' ', '')) when 1 then 'missing' end as want from toc_view)
select q.doc_id, q.req, coalesce(k.pos, l.last) as anchor, q.want is not null and k.pos is null as error from q join l on q.doc_id = l.doc_id left join k on q.doc_id = k.doc_id and q.want = k.k""", "toc_view")
def join_template_anchor(spark, d):
    rows = view(spark, d, "toc_view").withColumn("k", F.lower(F.regexp_replace("line", " ", "")))
    first = rows.groupBy("doc_id", "k").agg(F.min("pos").alias("at"))
    last = rows.groupBy("doc_id").agg(F.max("pos").alias("last"))
    asked = rows.select("doc_id", F.col("pos").alias("req"), F.when(F.col("pos") % 3 == 0, F.col("k")).when(F.col("pos") % 3 == 1, "missing").alias("k"))
    both = asked.join(last, "doc_id").join(first, ["doc_id", "k"], "left")
    return both.select("doc_id", "req", F.coalesce("at", "last").alias("anchor"), (F.col("k").isNotNull() & F.col("at").isNull()).alias("error"))


LABELS = ("trash", "quelle", "token")


@book.add("join_label_hits", """with p as (select doc_id, lab, unnest(string_split(text, lab)) as part, generate_subscripts(string_split(text, lab), 1) as idx, len(string_split(text, lab)) as n from documents, (values ('trash'), ('quelle'), ('token')) l(lab)),
s as (select *, sum(length(part)) over (partition by doc_id, lab order by idx) + (idx - 1) * length(lab) as place from p)
select doc_id, lab as label, cast(place as bigint) as place from s where idx < n""")
def join_label_hits(spark, d):
    """All positions of every label in a text, from the lengths of the pieces between them."""
    rows = table(spark, d, "documents").select("doc_id", "text", F.explode(F.array(*map(F.lit, LABELS))).alias("label")).filter(F.contains("text", "label"))
    parts = rows.withColumn("_row", F.monotonically_increasing_id()).select("_row", "doc_id", "label", F.posexplode(F.transform(F.split("text", F.col("label")), lambda x: F.length(x))).alias("i", "n"))
    text = Window.partitionBy("_row").orderBy("i")
    placed = parts.withColumn("place", F.sum("n").over(text) + F.col("i") * F.length("label")).withColumn("more", F.lead("i").over(text).isNotNull())
    return placed.filter("more").select("doc_id", "label", F.col("place").cast("long").alias("place"))


@book.add("join_label_fill", """with p as (select page_id, case when page_id % 3 = 0 then null else 'src' || (page_id % 7) end as source from pages), l as (select doc_id as page_id, min('lab' || (doc_id % 4)) as label from documents where contains(text, 'the') group by 1)
select p.page_id, coalesce(source, label) as dominant, source is null and label is not null as filled from p left join l using (page_id)""")
def join_label_fill(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("src"), (F.col("page_id") % 7).cast("string"))).alias("source"))
    labels = table(spark, d, "documents").filter(F.contains("text", F.lit("the"))).groupBy(F.col("doc_id").alias("page_id")).agg(F.min(F.concat(F.lit("lab"), (F.col("doc_id") % 4).cast("string"))).alias("label"))
    return pages.join(labels, "page_id", "left").select("page_id", F.coalesce("source", "label").alias("dominant"), (F.col("source").isNull() & F.col("label").isNotNull()).alias("filled"))


@book.add("join_probe_contains", f"""with pr as (select item_id, unnest(list_distinct(list_filter([trim(substring({norm('text')}, 1, 180)), trim(substring({norm('text')}, 1, 120)), trim(substring({norm('text')}, 1, 80)), trim(substring({norm('text')}, 1, 48))], lambda x: length(x) >= 12))) as probe from benchmark),
t as (select doc_id, {norm('text')} as t from documents)
select doc_id, item_id, cast(sum(least(length(probe), 120)) as bigint) as score from t join pr on contains(t, probe) group by 1, 2""")
def join_probe_contains(spark, d):
    return probe_scores(table(spark, d, "documents"), table(spark, d, "benchmark"))


#: Most short probes' keys that are broadcast.
BROADCAST_KEYS = 500_000


def probe_scores(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Score of each item for each document: the lengths (at most 120) of its probes
    that the text contains. Probes of five or more words are found by the words two
    to four, which are whole in any text that contains them; shorter ones by their
    first 12 characters, which may stand anywhere. Containment is then exact."""
    probes = items.select("item_id", F.explode(T.probe_prefixes("text")).alias("probe")).withColumn("w", F.split("probe", " "))
    short = F.size("w") < 5
    key = F.when(short, F.xxhash64(F.substring("probe", 1, 12))).otherwise(F.xxhash64(F.array_join(F.slice("w", F.lit(2), F.lit(3)), " ")))
    probes = probes.select("item_id", "probe", short.alias("short"), key.alias("k"))
    texts = docs.select("doc_id", T.norm_text("text").alias("t"))
    shingled = lambda w: F.transform(w, lambda x, i: F.xxhash64(F.array_join(F.slice(w, i + 1, F.lit(3)), " ")))
    grams = F.array_distinct(F.get(F.transform(F.array(F.split("t", " ")), shingled), F.lit(0)))  # the array binds the split once
    keys = probes.filter("not short").select("k").distinct()
    hits = texts.select("doc_id", F.explode(grams).alias("k")).join(keys, "k", "left_semi").select("doc_id", "k")
    keys = probes.filter("short").select("k").distinct()
    if n := keys.count():
        grams = F.array_distinct(F.transform(F.regexp_extract_all("t", F.lit("(?s)(?=(.{12}))"), F.lit(1)), lambda x: F.xxhash64(x)))
        keys = F.broadcast(keys) if n <= BROADCAST_KEYS else keys
        hits = hits.union(texts.select("doc_id", F.explode(grams).alias("k")).join(keys, "k", "left_semi").select("doc_id", "k"))
    pairs = hits.distinct().join(probes, "k").select("doc_id", "item_id", "probe").distinct()
    found = pairs.join(texts, "doc_id").filter(F.contains("t", "probe"))
    return found.groupBy("doc_id", "item_id").agg(F.sum(F.least(F.length("probe"), F.lit(120))).alias("score"))


@book.add("join_ordered_text")
def join_ordered_text(spark, d):
    """Paragraphs of each document matched in order to those of its neighbour."""
    rows = lines(spark, d).filter("line <> ''")
    half = lambda n: F.floor(n / 2).alias("k")
    merged, source = F.col("doc_id") % 2 == 0, (F.col("pos") % 2 == 0) | (F.col("doc_id") % 2 == 1)
    part = lambda n, k: F.struct(F.lit(n).alias("part"), k)
    parts = F.array_compact(F.array(F.when(source, part(0, half(F.col("doc_id") + F.col("doc_id") % 2))), F.when(merged, part(1, half(F.col("doc_id"))))))
    both = rows.select("doc_id", "pos", "line", F.explode(parts).alias("p")).select("p.k", "p.part", "doc_id", "pos", "line")

    def f(group):
        b, a = ([r for r in group if r[1] == n] for n in (0, 1))
        hits = Q.match_in_order([r[4] for r in a], [r[4] for r in b])
        yield from ((r[2], r[3], None if h is None else b[h][3]) for r, h in zip(a, hits, strict=True))

    return Q.walk_groups(both, ["k"], ["part", "doc_id", "pos"], f, {"doc_id": "long", "pos": "int", "source_pos": "long"})


def join_fragment_place(spark, d):
    """Fragments (runs of three lines) placed in order in their own document."""
    blocks = lines(spark, d).filter("line <> ''")
    fragments = blocks.filter("pos % 7 < 3").select(F.col("doc_id").alias("of"), F.col("pos").alias("at"), F.col("line").alias("text"), F.floor(F.col("pos") / 7).alias("fragment"))

    def f(a, b):
        a, b = a.sort_values("pos"), b.sort_values(["fragment", "at"])
        names = b.fragment.drop_duplicates().tolist()
        found = Q.place_fragments(a.line.tolist(), [b[b.fragment == n].text.tolist() for n in names])
        at = a.pos.tolist()
        rows = [(a.doc_id.iloc[0], n, at[r[0]], at[r[1]]) for n, r in zip(names, found, strict=True) if r and len(a)]
        return pd.DataFrame(rows, columns=["doc_id", "fragment", "first", "last"])

    return blocks.groupBy("doc_id").cogroup(fragments.groupBy("of")).applyInPandas(f, "doc_id long, fragment long, first int, last int")


# --- text differences ---
def affix_diff(old, new):
    """Array of (text, marked): one plain text if equal; a marked prefix if the old text
    ends the new one; else common prefix, marked middle, common suffix."""
    a, b = F.coalesce(T.col(old), F.lit("")), F.coalesce(T.col(new), F.lit(""))
    span = lambda n: F.sequence(F.lit(0), n)
    prefix = F.array_max(F.filter(span(F.least(F.length(a), F.length(b))), lambda i: F.left(a, i) == F.left(b, i)))
    suffix = F.array_max(F.filter(span(F.least(F.length(a), F.length(b)) - prefix), lambda i: F.right(a, i) == F.right(b, i)))
    seg = lambda t, m: F.struct(t.alias("text"), F.lit(m).alias("marked"))
    head = F.left(b, F.length(b) - F.length(a))
    core = F.rtrim(head)
    ends = F.array(seg(core, True), seg(F.concat(F.substr(head, F.length(core) + 1), a), False))
    middle = F.array(seg(F.left(b, prefix), False), seg(F.substr(b, prefix + 1, F.length(b) - prefix - suffix), True), seg(F.right(b, suffix), False))
    kept = F.filter(F.when((a != "") & b.endswith(a), ends).otherwise(middle), lambda s: s["text"] != "")
    return F.when(a == b, F.array(seg(b, False))).otherwise(kept)


def marked(segments):
    return F.array_join(F.transform(segments, lambda s: F.when(s["marked"], F.concat(F.lit("["), s["text"], F.lit("]"))).otherwise(s["text"])), "")


@book.add("txt_affix_diff", """with p as (select p_partkey, p_name as o, case p_partkey % 3 when 0 then 'new ' || p_name when 1 then p_brand || substring(p_name, 4) else p_name end as n from part),
x as (select *, list_max(list_filter(range(0, least(length(o), length(n)) + 1), lambda i: left(o, i) = left(n, i))) as pre from p), y as (select *, list_max(list_filter(range(0, least(length(o), length(n)) - pre + 1), lambda i: right(o, i) = right(n, i))) as suf from x)
select p_partkey, case when o = n then n when ends_with(n, o) then '[' || rtrim(left(n, length(n) - length(o))) || ']' || substring(n, length(rtrim(left(n, length(n) - length(o)))) + 1)
else left(n, pre) || case when length(n) - pre - suf > 0 then '[' || substring(n, pre + 1, length(n) - pre - suf) || ']' else '' end || right(n, suf) end as diff from y""")
def txt_affix_diff(spark, d):
    new = F.expr("case p_partkey % 3 when 0 then 'new ' || p_name when 1 then p_brand || substring(p_name, 4) else p_name end")
    return table(spark, d, "part").select("p_partkey", marked(affix_diff("p_name", new)).alias("diff"))


def year_diff(old, new):
    """Segments of a year change: in one century only the last two digits are marked; else as any text."""
    o, n = T.norm_text(old), T.norm_text(new)
    year = r"^(19|20)\d{2}$"
    seg = lambda t, m: F.struct(t.alias("text"), F.lit(m).alias("marked"))
    near = o.rlike(year) & n.rlike(year) & (o != n) & (F.left(o, F.lit(2)) == F.left(n, F.lit(2)))
    return F.when(near, F.array(seg(F.left(n, F.lit(2)), False), seg(F.substr(n, F.lit(3)), True))).otherwise(affix_diff(o, n))


def replaced(old, new, keep: bool = False):
    """Segments of a plain replacement, or (with ``keep``) of the old text with the new one behind it."""
    o, n = T.norm_text(old), T.norm_text(new)
    seg = lambda t, m: F.struct(t.alias("text"), F.lit(m).alias("marked"))
    both = F.when((o != "") & (n != ""), F.array(seg(F.concat(o, F.lit(" ")), False), seg(n, True))).when(n != "", F.array(seg(n, True))).otherwise(F.array(seg(o, False)))
    return F.when(o == n, F.array(seg(n, False))).otherwise(both if keep else F.array(seg(n, True)))


_OLD_YEAR = "case when p_size % 17 = 0 then '' else cast(1985 + p_size % 40 as string) end"


@book.add("txt_year_diff", f"""with p as (select p_partkey, {_OLD_YEAR} as o, cast(1996 + p_partkey % 28 as varchar) as n from part), x as (select *, case when o = '' then 0 when right(o, 3) = right(n, 3) then 3 when right(o, 2) = right(n, 2) then 2 when right(o, 1) = right(n, 1) then 1 else 0 end as k from p)
select p_partkey, case when o = n then n when left(o, 2) = left(n, 2) then left(n, 2) || '[' || right(n, 2) || ']' else '[' || left(n, 4 - k) || ']' || case when k = 0 then '' else right(n, k) end end as year_diff,
case when o = n then n else '[' || n || ']' end as plain, case when o = n then n when o = '' then '[' || n || ']' else o || ' [' || n || ']' end as kept from x""")
def txt_year_diff(spark, d):
    o, n = F.expr(_OLD_YEAR), F.expr("cast(1996 + p_partkey % 28 as string)")
    return table(spark, d, "part").select("p_partkey", marked(year_diff(o, n)).alias("year_diff"), marked(replaced(o, n)).alias("plain"), marked(replaced(o, n, True)).alias("kept"))


@book.add("txt_token_diff")
def txt_token_diff(spark, d):
    diff = F.pandas_udf(Q.token_diffs, "array<struct<text:string,marked:boolean>>")
    new = F.expr("case when p_partkey % 2 = 0 then replace(p_name, ' ', ' new ') else p_brand || ' ' || p_name end")
    return table(spark, d, "part").select("p_partkey", marked(diff("p_name", new)).alias("diff"))


def scored_pairs(blocks: DataFrame, before: int, behind: int) -> DataFrame:
    """(doc_id, pos, other, score) of each block with those of its document at most
    ``before`` places before and ``behind`` places behind it. Blocks meet in stretches of
    64 places, to which the few around them are copied, so none is sent to all tasks."""
    blocks = blocks.filter("doc_id is not null and pos is not null").withColumn("a", F.struct(*[c for c in blocks.columns if c not in ("doc_id", "pos")]))
    stretch = lambda shift: F.floor((F.col("pos") + shift) / 64)
    dealt = blocks.select("doc_id", "pos", "a", F.explode(F.array_distinct(F.array(stretch(0), stretch(before), stretch(-behind)))).alias("stretch"))
    near = Window.partitionBy("doc_id", "stretch").orderBy("pos").rangeBetween(-before, behind)
    pairs = dealt.withColumn("near", F.collect_list(F.struct(F.col("pos").alias("other"), F.col("a").alias("b"))).over(near)).filter(F.col("stretch") == stretch(0))
    return pairs.select("doc_id", "pos", "a", F.explode("near").alias("n")).select("doc_id", "pos", "n.other", "a", "n.b").select("doc_id", "pos", "other", B.block_score("a", "b").alias("score"))


@book.add("txt_block_score", """with p as (select a.doc_id, a.pos, b.pos as other, a.kind as ka, b.kind as kb, a.line as s, b.line as t, a.has_drawing and b.has_drawing as drawn, a.probes as pa, b.probes as pb from block_view a join block_view b on a.doc_id = b.doc_id and b.pos between a.pos - 3 and a.pos + 5)
select doc_id, pos, other, cast(case when ka = 'table' and kb = 'table' then coalesce(list_sum(list_transform(list_filter(pa[1:12], lambda x: list_contains(pb, x)), lambda x: least(length(x), 80))), 0) when ka = 'table' or kb = 'table' then 0
when s = t and s <> '' then 200 + least(length(s), 120) when length(s) >= 18 and t <> '' and (contains(s, t) or contains(t, s)) then 80 + least(length(s), length(t), 80)
when drawn then 40 + coalesce(list_sum(list_transform(list_filter(pa, lambda x: contains(t, x)), lambda x: least(length(x), 80))), 0) else 0 end as int) as score from p""", "block_view")
def txt_block_score(spark, d):
    return scored_pairs(view(spark, d, "block_view").select("doc_id", "pos", "kind", "line", "has_drawing", "probes"), 3, 5)
