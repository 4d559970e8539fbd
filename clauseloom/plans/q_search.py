"""Searches, filters, sorting, paging and set operations over logs and records."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import contents as C
from ..operators import records as R
from ..operators import structure as B
from ..operators.blocks import typed_blocks
from ..operators.retention import page
from ..sources.views import sql, table, view
from .book import Book

book = Book()


def contains_any(q: str, *columns: str):
    """Case-insensitive search for a text in any column."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(q.lower()), F.lit(False))
    return hit


def day_range(column: str, first: str, last: str, half_open: bool = True):
    """Rows of whole days: before the next midnight, or up to 23:59:59. As plain bounds it pushes down."""
    lo = F.col(column) >= F.lit(first).cast("timestamp_ntz")
    day = F.lit(last).cast("timestamp_ntz")
    return lo & (F.col(column) < day + F.expr("interval 1 day") if half_open else F.col(column) <= day + F.expr("interval '23:59:59' hour to second"))


@book.add("flt_audit_search", """with r as (select event_id, ts, event_type from events where contains(event_type, 'ic') and (contains(lower(event_type), 'click') or contains(lower(cast(user_id as varchar)), 'click') or contains(lower(props), 'click'))
  and ts >= timestamp '2024-01-01' and ts <= timestamp '2030-12-31 23:59:59')
select * from r order by ts desc, event_id desc limit 25 offset 50""")
def flt_audit_search(spark, d):
    rows = table(spark, d, "events").filter(F.col("event_type").contains("ic") & contains_any("CLICK", "event_type", "user_id", "props") & day_range("ts", "2024-01-01", "2030-12-31", False))
    return rows.select("event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).offset(50).limit(25)


@book.add("flt_error_search", """select event_id, event_type, user_id from events where contains(lower(event_type), 'view') or contains(lower(props), 'view') or contains(cast(user_id as varchar), 'view')""")
def flt_error_search(spark, d):
    return table(spark, d, "events").filter(contains_any("View", "event_type", "props", "user_id")).select("event_id", "event_type", "user_id")


@book.add("flt_scheme_search", """select o_orderkey, o_orderdate from orders where o_orderstatus = 'O' and contains(lower(o_orderpriority), 'high') order by o_orderdate desc, o_orderkey desc limit 30 offset 30""")
def flt_scheme_search(spark, d):
    rows = table(spark, d, "orders").filter((F.col("o_orderstatus") == "O") & contains_any("high", "o_orderpriority"))
    return rows.select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(30).limit(30)


@book.add("flt_run_search", "select o_orderkey from orders where o_orderdate >= timestamp '1996-03-01' and o_orderdate < timestamp '1997-04-01' and o_orderstatus = 'F'")
def flt_run_search(spark, d):
    return table(spark, d, "orders").filter(day_range("o_orderdate", "1996-03-01", "1997-03-31") & (F.col("o_orderstatus") == "F")).select("o_orderkey")


_PAY = """select event_id as job_id, event_type as job_type, ts as created_at, case when event_id % 3 = 0 then ts end as started_at, status, payload from (select *,
  case event_id % 5 when 0 then 'failed' when 1 then 'queued' when 2 then 'running' when 3 then 'claimed' else 'completed' end as status,
  case event_id % 4 when 0 then '{"action":"run_cached","scheme":"s' || cast(event_id % 9 as string) || '","name":"N_' || cast(event_id as string) || '"}' when 1 then '{"action":"check","names":{"main":"x"}}' when 2 then 'not json' else '{"action":"check_extract"}' end as payload from events) e"""
_DPAY = _PAY.replace(" as string)", " as varchar)")


@book.add("flt_run_history", f"""with j as ({_DPAY}) select job_id, coalesce(started_at, created_at) as started, payload->>'$.name' as name from j
where job_type in ('click', 'view') and (case when json_valid(payload) then payload end)->>'$.action' = 'run_cached' and contains((case when json_valid(payload) then payload end)->>'$.name', '_4')""")
def flt_run_history(spark, d):
    """Literal substring search (an underscore is no wildcard) over names taken from the payload."""
    rows = sql(spark, d, _PAY).withColumn("name", F.coalesce(T.payload_text("payload", "name"), T.payload_text("payload", "names.main")))
    rows = rows.filter(F.col("job_type").isin("click", "view") & (T.payload_text("payload", "action") == "run_cached") & F.col("name").contains("_4"))
    return rows.select("job_id", F.coalesce("started_at", "created_at").alias("started"), "name")


@book.add("flt_severity", "select event_id from events where case upper(case event_id % 4 when 0 then 'debug' when 1 then 'warn' when 2 then 'x' else 'info' end) when 'DEBUG' then 10 when 'INFO' then 20 when 'WARN' then 30 else 40 end >= 30")
def flt_severity(spark, d):
    rows = table(spark, d, "events").withColumn("level", F.expr("case event_id % 4 when 0 then 'debug' when 1 then 'warn' when 2 then 'x' else 'info' end"))
    return rows.filter(T.severity("level") >= T.severity(F.lit("WARN"))).select("event_id")


@book.add("flt_keywords_all", "select p_partkey, p_name from part where contains(lower(p_name), 'a') and contains(lower(p_name), 'e')")
def flt_keywords_all(spark, d):
    words = F.array(F.lit("A"), F.lit(""), F.lit("e"))
    return table(spark, d, "part").filter(F.forall(words, lambda w: F.contains(F.lower("p_name"), F.lower(w)))).select("p_partkey", "p_name")


D_LINES = "lines as (select doc_id, cast(i as int) as pos, trim(regexp_replace(l, '[\\s\\p{Z}]+', ' ', 'g')) as line from (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents))"


def lines(spark, d) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.select("doc_id", "pos", T.norm_text("line").alias("line"))


_CELL = "case when doc_id % 3 > 0 then cast(floor(pos / 3) as bigint) end"


@book.add("flt_hide_texts", f"""with {D_LINES}, hide as (select line from lines where line <> '' group by line having count(distinct doc_id) >= 5),
b as (select doc_id, pos, {_CELL} as cell, line in (select line from hide) as hit from lines where line <> ''),
c as (select *, cell is not null and hit and bool_and(hit) over (partition by doc_id, cell) and pos = max(pos) over (partition by doc_id, cell) as last from b)
select doc_id, pos, cell, last as emptied from c where not hit or last""")
def flt_hide_texts(spark, d):
    """Lines of five documents or more go; three lines are a cell in two thirds of the documents."""
    rows = lines(spark, d).filter("line <> ''")
    hide = rows.groupBy("line").agg(F.countDistinct("doc_id").alias("n")).filter("n >= 5")
    kept = B.without_hidden(rows.select("doc_id", "pos", F.expr(_CELL).alias("cell"), "line"), hide)
    return kept.select("doc_id", "pos", "cell", (F.col("line") == "").alias("emptied"))


D_TOC = """(contains(upper(coalesce(style_id, '') || ' ' || coalesce(style_name, '')), 'TOC') or contains(coalesce(style_name, ''), '目錄') or contains(upper(coalesce(field, '')), 'TOC')
  or regexp_matches(coalesce(anchor_list, ''), '(^| )_Toc') or regexp_matches(coalesce(leader_list, ''), '(^| )(dot|middleDot)($| )'))"""


def contents(spark, d) -> DataFrame:
    listed = lambda c: F.split(c, " ")
    return view(spark, d, "contents_view").withColumns({"anchors": listed("anchor_list"), "leaders": listed("leader_list")})


@book.add("flt_toc", f"select doc_id, pos from contents_view where not {D_TOC}", "contents_view")
def flt_toc(spark, d):
    return contents(spark, d).filter(~C.is_contents_line()).select("doc_id", "pos")


@book.add("flt_active_roots", "select s_suppkey, s_name from supplier where s_nationkey % 2 = 0 and s_suppkey % 3 <> 2")
def flt_active_roots(spark, d):
    rows = table(spark, d, "supplier").withColumn("active", F.when(F.col("s_suppkey") % 3 == 1, True).when(F.col("s_suppkey") % 3 == 2, False))
    return R.active_roots(rows, F.col("s_nationkey") % 2 == 0, "active").select("s_suppkey", "s_name")




@book.add("flt_payload_action", f"with j as ({_DPAY}) select job_id from j where status = 'failed' and (case when json_valid(payload) then payload end)->>'$.action' in ('check', 'check_extract')")
def flt_payload_action(spark, d):
    return sql(spark, d, _PAY).filter((F.col("status") == "failed") & T.payload_text("payload", "action").isin("check", "check_extract")).select("job_id")


@book.add("srt_page", """with t as (select count(*) as n from orders), p as (select unnest([3, n // 40 + 1, cast(ceil(n / 20.0) as bigint)]) as page, n from t)
select distinct o_orderkey, cast(page as int) as page, n as total, true as has_prev, page < ceil(n / 20.0) as has_next
from (select *, row_number() over (order by o_orderdate desc, o_orderkey desc) as rn from orders) join p on rn > (page - 1) * 20 and rn <= page * 20""")
def srt_page(spark, d):
    """A page near the start, the one in the middle and the last one."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    middle = rows.count() // 40 + 1
    pages = [page(rows, ["-o_orderdate", "-o_orderkey"], n, 20, near=100) for n in (3, middle, 10**6)]
    return pages[0].unionByName(pages[1]).unionByName(pages[2]).drop("o_orderdate")


@book.add("srt_queue_top", "select o_orderkey, o_orderpriority, o_orderdate from orders where o_orderstatus = 'P' and o_custkey % 3 in (0, 1) order by o_orderpriority desc, o_orderdate, o_orderkey limit 20")
def srt_queue_top(spark, d):
    fits = (F.col("o_orderstatus") == "P") & (F.col("o_custkey") % 3).isin(0, 1)
    return R.queue_head(table(spark, d, "orders"), fits, "o_orderpriority", "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderpriority", "o_orderdate")




@book.add("srt_pinned", "select c_custkey, row_number() over (order by case c_custkey when 40 then 1 when 7 then 2 when 99 then 3 else 9 end, c_custkey) as place from customer")
def srt_pinned(spark, d):
    """Pinned ids first, in their order. The rest keeps its order through range partitioning:
    a place is the offset of the row's range plus its number inside it."""
    pins = [40, 7, 99]
    rows = table(spark, d, "customer").select("c_custkey")
    at = F.array_position(F.array(*[F.lit(p).cast("long") for p in pins]), F.col("c_custkey"))
    rows = rows.withColumn("pin", F.when(at > 0, at).otherwise(len(pins) + 1)).withColumn("part", F.floor(F.col("c_custkey") / 65536))
    counts = rows.groupBy("pin", "part").agg(F.count("*").alias("n"))
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("pin", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("pin", "part").orderBy("c_custkey")
    return rows.join(starts, ["pin", "part"]).select("c_custkey", (F.col("start") + F.row_number().over(w)).alias("place"))


@book.add("srt_input_history", "select a.o_custkey, a.o_orderkey, (select count(*) from orders b where b.o_custkey = a.o_custkey and (b.o_orderdate > a.o_orderdate or (b.o_orderdate = a.o_orderdate and (b.o_orderstatus <> 'O', b.o_orderkey) <= (a.o_orderstatus <> 'O', a.o_orderkey)))) as place from orders a")
def srt_input_history(spark, d):
    return R.input_history(table(spark, d, "orders"), "o_custkey", "o_orderdate", F.col("o_orderstatus") == "O", "o_orderkey").select("o_custkey", "o_orderkey", "place")


@book.add("srt_ci_list", "select distinct name from (select p_brand as name from part union all select p_type from part) u")
def srt_ci_list(spark, d):
    part = table(spark, d, "part")
    return R.names_ignoring_case(part.select("p_brand"), part.select("p_type"))




@book.add("set_active_union", "select event_id, case event_type when 'signup' then 'scheme' else 'run' end as kind, event_type as state from events where event_type in ('view', 'click') and event_id % 2 = 0 or event_type = 'signup' and event_id % 2 = 1")
def set_active_union(spark, d):
    events = table(spark, d, "events")
    runs = events.filter(F.col("event_type").isin("view", "click") & (F.col("event_id") % 2 == 0))
    return R.active_union(runs, events.filter("event_type = 'signup' and event_id % 2 = 1"), "event_id", "event_type")


@book.add("set_history_union", "select event_id, 'flow' as kind, value, null::varchar as props from events where event_type = 'purchase' union all select event_id, 'mapping', null, props from events where event_type = 'view'")
def set_history_union(spark, d):
    events = table(spark, d, "events")
    flows = events.filter("event_type = 'purchase'").select("event_id", F.lit("flow").alias("kind"), "value")
    maps = events.filter("event_type = 'view'").select("event_id", F.lit("mapping").alias("kind"), "props")
    return flows.unionByName(maps, allowMissingColumns=True)


@book.add("set_output_union", "select o_custkey % 500 as path from orders where o_orderstatus = 'F' union select o_custkey % 700 from orders where o_orderstatus = 'P'")
def set_output_union(spark, d):
    orders = table(spark, d, "orders")
    outputs = orders.filter("o_orderstatus = 'F'").select((F.col("o_custkey") % 500).alias("path")).distinct()
    copied = orders.filter("o_orderstatus = 'P'").select((F.col("o_custkey") % 700).alias("path")).distinct()
    return outputs.unionByName(copied.join(outputs, "path", "left_anti"))


# --- sources ---
@book.add("src_blocks", """with b as (select doc_id, pos, kind, trim(regexp_replace(line, '\\s+', ' ', 'g')) as norm, has_drawing, probes from block_view),
h as (select doc_id, list(norm) as hidden from b where doc_id % 2 = 0 and pos % 7 < 3 group by 1), x as (select b.*, coalesce(hidden, []) as hidden from b left join h on h.doc_id = b.doc_id),
c as (select *, list_filter([norm, array_to_string(probes, ' ')], lambda v: v <> '' and not list_contains(hidden, v)) as r1, list_filter(probes, lambda v: v <> '' and not list_contains(hidden, v)) as r2 from x),
t as (select *, list_distinct(list_filter(r1, lambda v: length(v) >= 20) || list_filter(r2, lambda v: length(v) >= 20) || list_filter([array_to_string(r1, ' '), array_to_string(r2, ' ')], lambda v: length(v) >= 24)) as cells from c),
k as (select *, case when kind = 'table' then 'table' when norm <> '' and not list_contains(hidden, norm) then 'paragraph' when has_drawing then 'figure' end as type from t),
p as (select *, case type when 'table' then cells when 'paragraph' then [norm] else ['a figure'] end as found from k where type is not null and (type <> 'table' or len(cells) > 0))
select doc_id, pos, type, case when type = 'paragraph' then norm else '' end as norm, len(found) as n, md5(array_to_string(list_sort(found), '|')) as h, has_drawing and type <> 'table' as has_drawing from p""", "block_view")
def src_blocks(spark, d):
    """Paragraphs, figures and tables with the texts they are found by."""
    rows = view(spark, d, "block_view").select("doc_id", "pos", "kind", F.col("line").alias("text"), "has_drawing", F.array(F.array("line", F.array_join("probes", " ")), "probes").alias("cells"))
    hide = rows.filter("doc_id % 2 = 0 and pos % 7 < 3").groupBy("doc_id").agg(F.collect_list(T.norm_text("text")).alias("texts"))
    out = typed_blocks(rows, hide, "figure", F.array(F.lit("a figure")))
    return out.select("doc_id", "pos", "type", "norm", F.size("probes").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("probes"), "|")).alias("h"), "has_drawing")


@book.add("src_text_lines", f"with {D_LINES} select doc_id, pos, line as norm, length(line) as n from lines where line <> ''")
def src_text_lines(spark, d):
    return lines(spark, d).filter("line <> ''").select("doc_id", "pos", F.col("line").alias("norm"), F.length("line").cast("long").alias("n"))


def chunks(docs: DataFrame, size: int = 4000, overlap: int = 200) -> DataFrame:
    """Windows of ``size`` characters, each starting ``overlap`` before the last one's end."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the size")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")
    step, n = size - overlap, F.length("_t")
    count = F.when(n <= size, F.lit(1)).otherwise(1 + F.ceil((n - size) / step)).cast("int")
    rows = docs.select("doc_id", text.alias("_t")).filter("_t <> ''").withColumn("chunk", F.explode(F.sequence(F.lit(0), count - 1)))
    return rows.select("doc_id", "chunk", F.substr("_t", F.col("chunk") * step + 1, F.lit(size)).alias("text"))


@book.add("src_chunks", """with t as (select doc_id, regexp_replace(regexp_replace(text, '^[\\s\\p{Z}]+', ''), '[\\s\\p{Z}]+$', '') as t from documents where text is not null),
c as (select doc_id, t, unnest(generate_series(0, cast(case when length(t) <= 4000 then 0 else ceil((length(t) - 4000) / 3800.0) end as int))) as chunk from t where t <> '')
select doc_id, chunk, md5(substring(t, chunk * 3800 + 1, 4000)) as h from c""")
def src_chunks(spark, d):
    return chunks(table(spark, d, "documents")).select("doc_id", "chunk", F.md5("text").alias("h"))


@book.add("src_toc_rows", f"""with r as (select *, list_filter(list_transform(string_split(replace(replace(text, chr(13), ''), chr(10), ' '), chr(9)), lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))), lambda x: x <> '') as c from contents_view where {D_TOC}),
m as (select *, array_to_string(c, ' ') as merged, len(c) >= 2 and regexp_full_match(coalesce(list_extract(c, -1), ''), '[0-9]+') as tabbed from r), e as (select *, regexp_extract(merged, '^(.*?)([0-9]{{1,5}})$', 1) as head, regexp_extract(merged, '^(.*?)([0-9]{{1,5}})$', 2) as tail from m),
g as (select *, tail <> '' and not regexp_matches(list_extract(string_split(head, ' '), -1), '[0-9]') as ended from e),
t as (select *, case when tabbed then array_to_string(list_slice(c, 1, len(c) - 1), ' ') when ended then trim(head) else merged end as line, case when tabbed then list_extract(c, -1) when ended then tail else '' end as page from g),
n as (select *, replace(regexp_extract(line, '^([0-9]+([.．][0-9]+)*)', 1), '．', '.') as number, trim(regexp_replace(line, '^[0-9]+([.．][0-9]+)*', '')) as title from t)
select doc_id, pos, number, title, page, coalesce(try_cast(nullif(regexp_extract(style_name, '(?i)TOC\\s*([0-9]+)', 1), '') as int), try_cast(nullif(regexp_extract(style_id, '(?i)TOC\\s*([0-9]+)', 1), '') as int), case when number <> '' then len(string_split(number, '.')) end) as level from n where number <> '' or title <> ''""", "contents_view")
def src_toc_rows(spark, d):
    return C.contents_rows(contents(spark, d))


@book.add("src_json_payload", f"with j as ({_DPAY}) select job_id, case when json_valid(payload) then payload->>'$.action' end as action, json_valid(payload) as good from j")
def src_json_payload(spark, d):
    rows = sql(spark, d, _PAY)
    return rows.select("job_id", T.payload_text("payload", "action").alias("action"), F.get_json_object("payload", "$").isNotNull().alias("good"))


@book.add("src_audit_union", "select event_id, event_type, 'table' as origin, null::varchar as label from events where event_id % 10 <> 3 union all select event_id, event_type, 'file', 'user ' || user_id from events where event_id % 10 = 3")
def src_audit_union(spark, d):
    """The primary table with the rows that only reached the JSON-lines fallback."""
    events = table(spark, d, "events")
    primary = events.filter("event_id % 10 <> 3").select("event_id", "event_type", F.lit("table").alias("origin"))
    lines_ = events.filter("event_id % 10 = 3").select(F.to_json(F.struct("event_id", "event_type", F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("label"))).alias("line"))
    fallback = lines_.select(F.from_json("line", "event_id long, event_type string, label string").alias("r")).select("r.*", F.lit("file").alias("origin"))
    return primary.unionByName(fallback, allowMissingColumns=True)


@book.add("src_file_inventory", """with p as (select page_id, regexp_replace(string_split(url, '?')[1], '#.*$', '') || case page_id % 5 when 0 then '.DOCX' when 1 then '.pdf' when 2 then '.zip' when 3 then '.png' else '.tmp' end as path from pages)
select path, case lower(regexp_extract(path, '[.]([A-Za-z0-9]+)$', 1)) when 'docx' then 'docx' when 'pdf' then 'pdf' when 'zip' then 'zip' when 'png' then 'image' end as kind from (select distinct path from p) where not ends_with(path, '.tmp')""")
def src_file_inventory(spark, d):
    suffix = F.expr("case page_id % 5 when 0 then '.DOCX' when 1 then '.pdf' when 2 then '.zip' when 3 then '.png' else '.tmp' end")
    paths = table(spark, d, "pages").select(F.concat(F.regexp_replace("url", r"[?#].*$", ""), suffix).alias("path")).distinct()
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(ext.isin("docx", "pdf", "zip"), ext).when(ext.isin("png", "jpg", "jpeg", "gif", "bmp"), "image")
    name = F.element_at(F.split("path", "/"), -1)
    return paths.select("path", kind.alias("kind")).filter(kind.isNotNull() & ~name.startswith("~$"))


@book.add("src_url_parts", """select page_id, list_extract(string_split(regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/$', ''), '/'), -1) as uuid, coalesce(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), ''), 'download.xlsx') as filename from pages""")
def src_url_parts(spark, d):
    path = F.regexp_replace(F.expr("try_parse_url(url, 'PATH')"), "/$", "")
    return table(spark, d, "pages").select("page_id", F.element_at(F.split(path, "/"), -1).alias("uuid"), F.coalesce(F.expr("try_url_decode(try_parse_url(url, 'QUERY', 'page'))"), F.lit("download.xlsx")).alias("filename"))


_ANCHOR = r"(?is)<a\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))(?:[^>\"']|\"[^\"]*\"|'[^']*')*>(.*?)</a\s*>"


def absolute(link, base):
    """A link on a page as a full address: other hosts, the page's host, its folder, or the page itself."""
    link, base = F.trim(T.col(link)), F.regexp_replace(T.col(base), "[?#].*$", "")
    host, scheme = F.regexp_extract(base, r"^(\w+://[^/]*)", 1), F.regexp_extract(base, r"^(\w+:)", 1)
    folder = F.when(F.regexp_replace(base, r"^\w+://[^/]*", "").contains("/"), F.regexp_replace(base, "[^/]*$", "")).otherwise(F.concat(host, F.lit("/")))
    joined = F.concat(folder, F.regexp_replace(link, r"^(?:\./)+", ""))
    up = F.regexp_replace(F.regexp_replace(joined, r"/(?!\.\./)[^/?#]+/\.\./", "/"), r"/\./", "/")
    return F.when(link.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(host, link)).when(link.rlike("^[?#]"), F.concat(base, link)).when(link == "", T.col(base)).otherwise(up)


def page_links(pages: DataFrame, wanted: str) -> DataFrame:
    """The first anchor of every page whose text (tags taken out) holds the wanted one, in
    any case: page_id, link and found (a page without one is an error to its caller)."""
    groups = [F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(i)) for i in (1, 2, 3, 4)]
    found = F.zip_with(F.zip_with(F.zip_with(groups[0], groups[1], lambda a, b: F.concat(a, b)), groups[2], lambda a, b: F.concat(a, b)), groups[3], lambda href, text: F.struct(href.alias("href"), T.norm_text(F.regexp_replace(text, "<[^>]*>", " ")).alias("text")))
    first = F.get(F.filter(found, lambda a: F.lower(a["text"]).contains(wanted.lower())), F.lit(0))["href"]
    return pages.select("page_id", absolute(F.regexp_replace(first, "&amp;", "&"), F.col("url")).alias("link"), first.isNotNull().alias("found"))


_HTML = "case page_id % 5 when 0 then replace(html, '<a href=\"', '<A class=\"x > y\" HREF = \"') when 1 then replace(html, 'href=\"/', 'rel=nofollow href=\"https://other.example/') when 2 then replace(html, 'href=\"/', 'href=\"') when 3 then replace(html, 'href=\"/', 'href=\"//cdn.example/') else html end"


@book.add("src_page_links", f"""with p as (select page_id, regexp_replace(url, '[?#].*$', '') as url, replace(replace({_HTML}, '<A class="x > y" HREF = "', '<a href="'), 'rel=nofollow ', '') as html from pages),
a as (select *, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) as hrefs, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) as texts from p),
x as (select page_id, url, unnest(hrefs) as href, unnest(texts) as t, unnest(range(len(hrefs))) as pos from a), f as (select page_id, arg_min(href, pos) as href from x where contains(lower(t), 'th') group by 1)
select p.page_id, f.href is not null as found, case when contains(href, ':') then href when starts_with(href, '//') then regexp_extract(url, '^(https?:)', 1) || href when starts_with(href, '/') then regexp_extract(url, '^(https?://[^/]*)', 1) || href else regexp_replace(url, '[^/]*$', '') || href end as link from p left join f on p.page_id = f.page_id""")
def src_page_links(spark, d):
    return page_links(table(spark, d, "pages").withColumn("html", F.expr(_HTML)), "th")


@book.add("src_nested_batch", "select o_custkey as batch, 'T' || o_orderkey as task, l_linenumber as flow, coalesce(case when l_linenumber % 2 = 0 then null else 'p' || l_linenumber end, 'T' || o_orderkey || '/' || l_linenumber) as path from orders join lineitem on l_orderkey = o_orderkey")
def src_nested_batch(spark, d):
    """Batch JSON with results and their flows, one row per flow; missing paths are filled."""
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("flow"), F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("p"), F.col("l_linenumber").cast("string"))).alias("path"))).alias("flows"))
    results = table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", F.struct(F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("task"), "flows").alias("r"))
    batches = results.groupBy("o_custkey").agg(F.to_json(F.struct(F.collect_list("r").alias("results"))).alias("json"))
    schema = "results array<struct<task:string,flows:array<struct<flow:int,path:string>>>>"
    rows = batches.select(F.col("o_custkey").alias("batch"), F.from_json("json", schema).alias("b")).select("batch", F.inline_outer("b.results")).select("batch", "task", F.inline_outer("flows"))
    return rows.select("batch", "task", "flow", F.coalesce("path", F.concat_ws("/", "task", F.col("flow").cast("string"))).alias("path"))


@book.add("src_step_log", """select run_id, step_no, step_type, array_to_string(list_slice(string_split(source_path, '/'), -3, -1), '/') as label, first_block, last_block from step_view where step_type <> 'copy'""", "step_view")
def src_step_log(spark, d):
    """Log steps that carry provenance, from each run's JSON log."""
    own = F.struct("step_no", "step_type", F.when(F.col("step_type") != "copy", F.struct("source_path", "first_block", "last_block")).alias("provenance"))
    logs = view(spark, d, "step_view").groupBy("run_id").agg(F.to_json(F.collect_list(own)).alias("log"))
    schema = "array<struct<step_no:int,step_type:string,provenance:struct<source_path:string,first_block:int,last_block:int>>>"
    rows = logs.select("run_id", F.inline(F.from_json("log", schema))).filter("provenance is not null")
    parts = F.split("provenance.source_path", "/")
    label = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.lit(3)), "/")
    return rows.select("run_id", "step_no", "step_type", label.alias("label"), "provenance.first_block", "provenance.last_block")
