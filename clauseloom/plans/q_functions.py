"""Queries of the scalar functions."""

from pyspark.sql import functions as F

from ..functions import mapping as P
from ..functions import standards as S
from ..functions import text as T
from ..operators import contents as C
from ..sources.views import view
from .book import Book

book = Book()

# DuckDB spellings.
def norm(x):
    return f"trim(regexp_replace(coalesce({x}, ''), '[\\s\\p{{Z}}]+', ' ', 'g'))"


def key(x):
    return f"regexp_replace(translate(upper({norm(x)}), '–—：／', '--:/'), '\\s*([()])\\s*', '\\1', 'g')"


def ident(x):
    return f"trim(regexp_replace(upper(translate({norm(x)}, '：／＋', ':/+')), '\\s*([:/+()-])\\s*', '\\1', 'g'))"


def publishers(x):
    """The publishers in front, each once, with a blank behind."""
    return f"array_to_string(regexp_extract_all(regexp_extract({key(x)}, '^((BS|DIN|EN|ISO|IEC)( |[0-9]))+', 0), '[A-Z]+'), ' ') || ' '"


def family(x):
    p = publishers(x)
    return f"case when contains({key(x)}, 'ASTM') then 'ASTM' when starts_with({p}, 'IEC ') then 'IEC_FAMILY' when starts_with({p}, 'DIN EN ') or starts_with({p}, 'BS ') or starts_with({p}, 'EN ') or starts_with({p}, 'ISO ') then 'ISO_FAMILY' end"


def cut(x, pattern):
    return f"trim(regexp_replace({x}, '{pattern}', ''))"


YEAR_TAIL = ":\\s*(19\\d{2}|20\\d{2}).*$"


def match_key(x):
    k = key(x)
    iso = f"regexp_extract({k}, '^((BS|DIN|EN|ISO) )*([^:/]+)', 3)"
    iec = f"regexp_extract({k}, '^IEC ([^:]+)', 1)"
    astm = cut(k, "\\s*-\\s*\\d{2}[A-Z]?$")
    return f"case {family(x)} when 'IEC_FAMILY' then {iec} when 'ISO_FAMILY' then {iso} when 'ASTM' then {astm} else {cut(k, YEAR_TAIL)} end"


def latest_year(x):
    parts = f"list_filter(regexp_split_to_array({norm(x)}, '[^0-9]+'), lambda y: regexp_matches(y, '^(19|20)[0-9]{{2}}$'))"
    two = f"list_transform(regexp_extract_all({key(x)}, '-([0-9]{{2}})[A-Z]?', 1), lambda y: case when y::int <= 49 then 2000 + y::int else 1900 + y::int end)"
    iec = f"list_max(list_transform(regexp_extract_all({key(x)}, ':\\s*(19\\d{{2}}|20\\d{{2}})', 1), lambda y: y::int))"
    return f"case {family(x)} when 'ASTM' then list_max({two}) when 'IEC_FAMILY' then {iec} else list_max(list_transform({parts}, lambda y: y::int)) end"


def level(x):
    known = (("BS EN ISO", "BS EN ISO", 7), ("DIN EN ISO", "EN ISO", 4), ("EN ISO", "EN ISO", 4), ("BS EN", "BS EN", 6), ("DIN EN", "BS EN", 6), ("EN", "EN", 5), ("BS ISO", "BS ISO", 3), ("ISO", "ISO", 2), ("BS", "BS", 1), ("IEC", "IEC", 1))
    p = publishers(x)
    name = "case " + " ".join(f"when starts_with({p}, '{words} ') then '{to}'" for words, to, _ in known) + " else 'OTHER' end"
    return name, f"coalesce(map {{{', '.join(f'{k!r}: {v}' for k, v in dict((to, r) for _, to, r in known).items())}}}[{name}], 0)"


def regulation_key(x):
    return f"regexp_replace(regexp_replace(upper({norm(x)}), '\\bREVISION\\b', 'REV', 'g'), '[^A-Z0-9]+', '', 'g')"


def q(name, view_name, keys, columns, oracle_columns, base=False):
    """Registers a projection of a view: keys as they are, named columns by both engines.
    ``columns`` is a function, so that registering needs no session."""
    sql = f"select {', '.join([*keys, *(f'{e} as {n}' for n, e in oracle_columns.items())])} from {view_name}"

    def run(spark, sf_dir):
        return view(spark, sf_dir, view_name).select(*keys, *[c.alias(n) for n, c in columns().items()])

    book.add(name, sql, *([] if base else [view_name]))(run)


q("fn_norm_text", "documents", ["doc_id"], lambda: {"norm": T.norm_text("text")}, {"norm": norm("text")}, base=True)
q("fn_norm_identifier", "catalog_view", ["row_no"], lambda: {"ident": S.identifier("standard_no")}, {"ident": ident("standard_no")})
q("fn_norm_search_key", "catalog_view", ["row_no"], lambda: {"skey": S.search_key("standard_no"), "compact": S.compact_key("standard_no")}, {"skey": key("standard_no"), "compact": f"regexp_replace({key('standard_no')}, '[^A-Z0-9]+', '', 'g')"})
q("fn_yes_no", "requirement_view", ["row_no"], lambda: {"yn": S.yes_no("harmonised")}, {"yn": f"case when upper({norm('harmonised')}) in ('Y','YES') then 'YES' when upper({norm('harmonised')}) in ('N','NO') then 'NO' else upper({norm('harmonised')}) end"})
q("fn_year_coerce", "requirement_view", ["row_no"], lambda: {"y": T.year_coerce("issued_year"), "none": T.year_coerce("standards")}, {"y": f"case when regexp_matches({norm('issued_year')}, '^(19|20)[0-9]{{2}}$') then {norm('issued_year')}::int end", "none": "null::int"})
q("fn_family", "catalog_view", ["row_no"], lambda: {"family": S.family("standard_no")}, {"family": family("standard_no")})
q("fn_level", "catalog_view", ["row_no"], lambda: {"level": S.level("standard_no")["name"], "rank": S.level("standard_no")["rank"]}, dict(zip(("level", "rank"), level("standard_no"), strict=True)))
q("fn_sheet_route", "catalog_view", ["row_no"], lambda: {"sheets": F.array_join(S.sheets("standard_no"), ",")}, {"sheets": f"case {family('standard_no')} when 'ISO_FAMILY' then 'ISO,EN' when 'IEC_FAMILY' then 'IEC' when 'ASTM' then 'ASTM' end"})
q("fn_match_key", "catalog_view", ["row_no"], lambda: {"mkey": S.match_key("standard_no")}, {"mkey": match_key("standard_no")})
q("fn_display_no", "catalog_view", ["row_no"], lambda: {"display": S.display_no("standard_no")}, {"display": f"case {family('standard_no')} when 'ASTM' then {cut(norm('standard_no'), '-[0-9]{2}[A-Z]?$')} else {cut(norm('standard_no'), YEAR_TAIL)} end"})
q("fn_latest_year", "catalog_view", ["row_no"], lambda: {"year": S.latest_year("standard_no")}, {"year": latest_year("standard_no")})
q("fn_amend_title", "catalog_view", ["row_no"], lambda: {"n": S.amendment("standard_no"), "t": S.title_with_amendment("title", "standard_no")}, {"n": "regexp_extract(standard_no, '/A([0-9]+)', 1)", "t": f"case when regexp_extract(standard_no, '/A([0-9]+)', 1) = '' then {norm('title')} else {norm('title')} || ' - Amendment ' || regexp_extract(standard_no, '/A([0-9]+)', 1) end"})
q("fn_reg_key", "register_view", ["row_no"], lambda: {"rkey": S.regulation_key("key_text"), "target": S.is_regulation("key_text"), "year": T.years_max("date_text")}, {"rkey": regulation_key("key_text"), "target": f"regexp_matches({regulation_key('key_text')}, '^(MEDDEV|MDCG)')", "year": "list_max(list_transform(list_filter(regexp_split_to_array(date_text, '[^0-9]+'), lambda y: length(y) = 4), lambda y: y::int))"})
q("fn_accepted_form", "catalog_view", ["row_no"], lambda: {"accepted": S.accepted_form("standard_no")}, {"accepted": f"regexp_matches({key('standard_no')}, '^(BS\\s+EN\\s+ISO|EN\\s+ISO|EN\\s+IEC)\\b')"})
q("fn_number_parts", "toc_view", ["doc_id", "pos"], lambda: {"parts": F.array_join(T.number_parts("line"), "."), "rest": T.number_rest("line")}, {"parts": f"nullif(regexp_extract({norm('line')}, '^([0-9]+([.][0-9]+)*)', 1), '')", "rest": f"trim(regexp_replace({norm('line')}, '^[0-9]+([.][0-9]+)*[.):]*\\s*', ''))"})
_t = norm("line")
_words = f"list_filter(string_split({_t}, ' '), lambda w: w <> '')"
_n = f"len({_words})"
_stop = f"right({_t}, 1) in ('.', '。', ';', '；')"
_caption = f"regexp_matches({_t}, '(?i)^(figure|table)\\s+[0-9]+([.:][0-9]+)*[.:]?(\\s|$)')"
_numbered = f"regexp_matches({_t}, '^[0-9]+')"
_rest = f"trim(regexp_replace({_t}, '^[0-9]+([.][0-9]+)*', ''))"
_cjk = "regexp_matches({}, '[\u3400-\u9fff]')"
_cap = lambda x: f"(regexp_matches({x}, '^\\p{{Lu}}') or (upper(string_split({x}, ' ')[1]) = string_split({x}, ' ')[1] and lower(string_split({x}, ' ')[1]) <> string_split({x}, ' ')[1]))"
_boundary = f"({_n} between 1 and 28 and not {_caption} and ({_n} <= 6 or not {_stop}))"
_sep = "[0-9]+([.][0-9]+)*"
q("fn_heading_tests", "heading_view", ["doc_id", "pos"], lambda: {k: T.heading_tests("line")[k] for k in ("boundary", "plain", "unstructured", "sentence")}, {
    "boundary": _boundary,
    "plain": f"({_boundary} and {_numbered} and ({_rest} = '' or len(string_split({_rest}, ' ')) > 1 or {_cap(_rest)} or {_cjk.format(_rest)}))",
    "unstructured": f"({_n} between 1 and 20 and not {_caption} and not {_stop} and right({_t}, 1) <> ':' and ({_cjk.format(_t)} or ({_n} >= 2 and {_cap(_t)})))",
    "sentence": f"({_n} >= 14 or ({_n} >= 5 and {_stop}) or ({_n} >= 6 and (contains({_t}, ',') or contains({_t}, '，'))))"})
_cand = f"list_transform(string_split(nullif(regexp_extract({_t}, '^({_sep})', 1), ''), '.'), lambda x: x::int)"


def boundary_sql(start: list[int], cross: bool) -> str:
    """A number ends a section: written out by the depth of the candidate."""
    same_depth = f"len({_cand}) = {len(start)} and {_cand} <> {start}" + ("" if cross else f" and list_slice({_cand}, 1, {len(start) - 1}) = list_slice({start}::int[], 1, {len(start) - 1})")
    upper = [f"len({_cand}) = {k} and list_slice({_cand}, 1, {k - 1}) = {start[: k - 1]}::int[] and {_cand}[{k}] <> {start[k - 1]}" for k in range(1, len(start))]
    return "coalesce(" + " or ".join(f"({x})" for x in [same_depth, *upper]) + ", false)"


_START = lambda *parts: F.array(*map(F.lit, parts))
q("fn_number_boundary", "heading_view", ["doc_id", "pos"], lambda: {"ends": T.number_boundary(_START(2, 1), T.number_parts("line")), "crossed": T.number_boundary(_START(2, 1), T.number_parts("line"), True), "deep": T.number_boundary(_START(2, 1, 3), T.number_parts("line"), True)},
  {"ends": boundary_sql([2, 1], False), "crossed": boundary_sql([2, 1], True), "deep": boundary_sql([2, 1, 3], True)})
q("fn_heading_match", "heading_view", ["doc_id", "pos"], lambda: {"hit": T.heading_match("line", F.lit("2."), F.lit("Heading")), "strict": T.heading_match("line", F.lit("2.1"), F.lit("Heading"), True), "titled": T.heading_match("line", F.lit(""), F.lit("Heading")), "ended": T.heading_match("line", F.lit("9.9"), F.lit("described here."))}, {
    "hit": f"case when regexp_matches({_t}, '^2($|[^0-9])') then contains({_t}, 'Heading') else ends_with({_t}, 'Heading') end",
    "strict": f"(regexp_matches({_t}, '^2[.]1($|[^0-9])') and contains({_t}, 'Heading'))", "titled": f"contains({_t}, 'Heading')", "ended": f"ends_with({_t}, 'described here.')"})
_EXPR = "case pos % 5 when 0 then '1.2 - 1.4. ' || line when 1 then line when 2 then '3.1~3.2' when 3 then 'see 4.1.2 of it' else '2. ' || line end"
_DEXPR = f"({_EXPR})"
_RANGE = "'^([0-9]+([.][0-9]+)*[.]?)(\\s*[-~～至到]\\s*([0-9]+([.][0-9]+)*[.]?))?(\\s+(.+))?$'"
_inline = f"regexp_extract({_DEXPR}, '(^|[^0-9A-Za-z_])([0-9]+([.][0-9]+)*)($|[^0-9A-Za-z_])', 2)"
_fits = f"regexp_matches({_DEXPR}, {_RANGE})"
q("fn_section_expr", "heading_view", ["doc_id", "pos"], lambda: {k: T.section_expr(F.expr(_EXPR))[k] for k in ("first", "last", "title")}, {
    "first": f"case when {_fits} then rtrim(regexp_extract({_DEXPR}, {_RANGE}, 1), '.') else {_inline} end",
    "last": f"case when {_fits} then rtrim(regexp_extract({_DEXPR}, {_RANGE}, 4), '.') else '' end",
    "title": f"case when {_fits} then trim(regexp_extract({_DEXPR}, {_RANGE}, 7)) when {_inline} <> '' then {_DEXPR} else '' end"})
_pre = f"list_filter([case when length({norm('text')}) <= 180 then {norm('text')} end, trim(substring({norm('text')}, 1, 180)), trim(substring({norm('text')}, 1, 120)), trim(substring({norm('text')}, 1, 80)), trim(substring({norm('text')}, 1, 48))], lambda x: length(x) >= 12)"
q("fn_probe_prefixes", "documents", ["doc_id"], lambda: {"n": F.size(T.probe_prefixes("text")).cast("long"), "longest": F.array_max(F.transform(T.probe_prefixes("text"), F.length)).cast("long")}, {"n": f"len(list_distinct({_pre}))", "longest": f"list_max(list_transform({_pre}, lambda x: length(x)))"}, base=True)
_cap = "'(?i)^(figure|fig|table)[.]?\\s*([0-9]+([-.][0-9]+)*)\\s*[.:]?\\s*(.*)$'"
q("fn_caption_label", "caption_view", ["doc_id", "pos"], lambda: {k: T.caption_label("line")[k] for k in ("kind", "number", "rest")}, {"kind": f"case when lower(regexp_extract({_t}, {_cap}, 1)) in ('figure','fig') then 'figure' when lower(regexp_extract({_t}, {_cap}, 1)) = 'table' then 'table' end", "number": f"nullif(regexp_extract({_t}, {_cap}, 2), '')", "rest": f"case when regexp_matches({_t}, {_cap}) then regexp_extract({_t}, {_cap}, 4) end"})
_long = "repeat(line || ' ', cast(pos % 9 as int))"
_style = "case pos % 7 when 0 then ' Caption ' when 1 then 'Heading 2' when 2 then 'FigCaption' else null end"
_why = f"""case when {_long} = '' then 'empty_text' when pos % 7 < 3 then 'style_match' when regexp_matches({_long}, '(?i)^(figure|fig[.]?) +[0-9]+( *[-.:])? *[^ ]+') then 'figure_number_prefix'
  when length(trim({_long})) > 180 then 'too_long' when length(trim({_long})) <= 120 and len(string_split(trim({_long}), ' ')) <= 20 then 'short_standalone_line' else 'no_caption_signal' end"""
q("fn_caption_accepted", "caption_view", ["doc_id", "pos"], lambda: {k: C.caption_accepted(F.expr(_long), F.expr(_style))[k] for k in ("accepted", "reason")}, {"accepted": f"{_why} in ('style_match', 'figure_number_prefix', 'short_standalone_line')", "reason": _why})
q("fn_path_norm", "pages", ["page_id"], lambda: {"p": T.path_norm("url"), "safe": T.safe_name("url")}, {"p": "array_to_string(list_filter(list_transform(string_split(replace(url, '\\', '/'), '/'), lambda x: trim(x)), lambda x: x not in ('', '.')), '/')", "safe": "regexp_replace(trim(url), '[<>:\"/\\\\|?*\\x00-\\x1f]', '_', 'g')"}, base=True)
_slug = "regexp_replace(regexp_replace(replace(regexp_replace('7 ' || trim(url), '[^0-9A-Za-z_ ]+', '_', 'g'), ' ', '_'), '_+', '_', 'g'), '^_+|_+$', '', 'g')"
_generic = ", ".join(f"'{w}'" for w in T.GENERIC_WORDS)
q("fn_name_tokens", "pages", ["page_id"], lambda: {"tokens": F.array_join(T.name_tokens("url", F.lit("https www")), " "), "slug": T.slug(F.lit("7"), F.col("url")), "empty": T.slug(F.lit(" "), F.lit("。"))}, {
    "tokens": f"array_to_string(list_filter(regexp_split_to_array(lower(url), '[^a-z0-9]+'), lambda x: x <> '' and not regexp_matches(x, '^[0-9]+$') and x not in ('https', 'www', {_generic})), ' ')",
    "slug": f"case when length('sec_' || {_slug}) <= 60 then 'sec_' || {_slug} else substring('sec_' || {_slug}, 1, 60) || '_' || substring(md5('sec_' || {_slug}), 1, 8) end", "empty": "'section'"}, base=True)

_LEVELS = "case event_id % 7 when 0 then 'debug' when 1 then 'Info' when 2 then 'WARN' when 3 then 'warning' when 4 then 'critical' when 5 then 'odd' else 'ERROR' end"
_VALUE = f"case upper({_LEVELS}) when 'DEBUG' then 10 when 'INFO' then 20 when 'WARN' then 30 when 'WARNING' then 30 when 'CRITICAL' then 50 else 40 end"
q("fn_severity", "events", ["event_id"], lambda: {"v": T.severity(F.expr(_LEVELS))}, {"v": _VALUE}, base=True)
_ERR = "case event_id % 6 when 0 then 'SQL Server gone' when 1 then 'LDAP bind failed' when 2 then 'smtp refused' when 3 then 'URLError x' when 4 then 'Permission denied' else event_type end"
q("fn_error_class", "events", ["event_id"], lambda: {"c": T.error_class(F.expr(_ERR))}, {"c": "case event_id % 6 when 0 then 'database' when 1 then 'ldap' when 2 then 'smtp' when 3 then 'download' when 4 then 'storage' else 'unknown' end"}, base=True)
q("fn_content_hash", "orders", ["o_orderkey"], lambda: {"h": T.content_hash("o_orderkey", "o_custkey", "o_orderstatus")}, {"h": """sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}')"""}, base=True)
_DATE = "case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') when 1 then strftime(o_orderdate, '%Y/%m/%d') when 2 then strftime(o_orderdate, '%Y-%m-%d') else 'n/a' end"
_SDATE = "case o_orderkey % 4 when 0 then date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') when 1 then date_format(o_orderdate, 'yyyy/MM/dd') when 2 then date_format(o_orderdate, 'yyyy-MM-dd') else 'n/a' end"
q("fn_datetime_parse", "orders", ["o_orderkey"], lambda: {"t": T.parse_time(F.expr(_SDATE)), "until": T.end_of_day(F.expr(_SDATE))}, {"t": "case when o_orderkey % 4 = 0 then date_trunc('second', o_orderdate) when o_orderkey % 4 in (1, 2) then date_trunc('day', o_orderdate)::timestamp end", "until": "case when o_orderkey % 4 <> 3 then date_trunc('day', o_orderdate)::timestamp + interval 1 day end"}, base=True)

_CELL = "case row_no % 17 when 0 then '圖片' when 1 then ' Figure' when 2 then 'TABLE ' when 3 then 'extract all' when 4 then 'figure table' when 5 then 'copy file' when 6 then 'copy dir' when 7 then 'text' when 8 then 'Arabic Heading' when 9 then 'roman heading' when 10 then 'bullet heading' when 11 then 'pdf_img' when 12 then 'image' when 13 then '圖' when 14 then 'odd' else '' end"
_OPER = "case when row_no % 3 = 0 then 'add image' when row_no % 7 = 0 then '' else operation end"
_KIND = """case row_no % 17 when 0 then pic when 13 then pic when 1 then 'figure' when 2 then 'table' when 3 then 'extract_all' when 4 then 'figure_table' when 5 then 'copy_file' when 6 then 'copy_folder' when 7 then 'add_text'
  when 8 then 'numbered_heading' when 9 then 'roman_heading' when 10 then 'bulleted_heading' when 11 then 'pdf_image' when 12 then 'add_image' else '' end"""


@book.add("fn_item_type", f"""with c as (select row_no, {_OPER} as o from mapping_view), p as (select *, case when o = '' or o = 'add image' then 'add_image' else 'figure' end as pic from c), k as (select *, {_KIND} as kind from p)
select row_no, kind, case when kind in ('figure', 'figure_table') then 'Extract figure' when kind = 'table' then 'Extract table' when kind = 'extract_all' then 'Extract all' when kind = 'copy_file' then 'Copy file' when kind = 'copy_folder' then 'Copy folder'
  when kind = 'add_text' then 'Append text' when ends_with(kind, 'heading') then 'Append heading' when kind = 'pdf_image' then 'Extract PDF images' when kind = 'add_image' then 'Add Image' when regexp_matches(o, '^[0-9]') then 'Extract chapter' else 'Mapping' end as action from k""", "mapping_view")
def fn_item_type(spark, sf_dir):
    rows = view(spark, sf_dir, "mapping_view").select("row_no", F.expr(_OPER).alias("operation"), F.expr(_CELL).alias("cell"))
    rows = rows.withColumn("kind", P.item_type("cell", "operation"))
    return rows.select("row_no", "kind", P.action("operation", "kind").alias("action"))


_TAIL = """case row_no % 5 when 0 then operation || '|Title="a|b"|index = 3' when 1 then operation || '|container=x|odd|index=9' when 2 then operation || '||colour=red|title=''q'' ' when 3 then operation else '' end"""
_YESNO = "case row_no % 4 when 0 then ' Yes' when 1 then '不要' when 2 then '' else 'maybe' end"


@book.add("fn_option_tail", """select row_no, case when row_no % 5 = 4 then '' else string_split(operation, '|')[1] end as core,
  case row_no % 5 when 0 then 'a|b' when 2 then 'q' end as title, case row_no % 5 when 0 then '3' end as idx, case row_no % 5 when 1 then case when contains(operation, '|') then null else 'x' end end as container,
  case when row_no % 5 = 1 then 'odd' end as error, case when row_no % 4 = 1 then 'no' else 'yes' end as include_title, case when row_no % 4 = 3 then 'maybe' end as flag_error,
  case when mode = 'replace' then 'replace' else 'insert_after' end as insert_mode, case when mode = 'maybe' then 'maybe' end as mode_error
  from (select row_no, mode, replace(operation, '|include title=yes', '') as operation from mapping_view)""", "mapping_view")
def fn_option_tail(spark, sf_dir):
    rows = view(spark, sf_dir, "mapping_view").withColumn("operation", F.regexp_replace("operation", r"\|include title=yes", ""))
    rows = rows.select("row_no", P.option_tail(F.expr(_TAIL)).alias("o"), P.include_title(F.expr(_YESNO)).alias("f"), P.insert_mode("mode").alias("m"))
    option = lambda k: F.try_element_at("o.options", F.lit(k))
    return rows.select("row_no", "o.core", option("title").alias("title"), option("index").alias("idx"), option("container").alias("container"), "o.error", F.col("f.value").alias("include_title"), F.col("f.error").alias("flag_error"), F.col("m.value").alias("insert_mode"), F.col("m.error").alias("mode_error"))
