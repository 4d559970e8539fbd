"""Queries over the provenance of outputs, paths and the rules of steps."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import paths, step_rules
from ..operators import provenance as P
from ..sources.views import sql, table, view
from .book import Book
from .q_search import lines

book = Book()

_RANGES = "select doc_id, 's' || cast(pos % 3 as string) as source, pos as first, pos + level * 2 as last from toc_view where level is not null and pos % 3 <> 1"
_SOURCES = """select distinct 's' || cast(p_size % 4 as string) as source, case p_size % 4 when 1 then '' else 'file' || cast(p_size % 4 as string) || '.docx' end as source_file,
case p_size % 4 when 0 then 'figure' when 1 then 'chapter' when 2 then 'pdf_image' end as content_type from part"""


@book.add("txt_block_trace", f"""with r as ({_RANGES}), src as ({_SOURCES}),
k as (select m.*, case when m.is_end then (select arg_max(s.source, s.pos * 10 + s.seq) from marks_view s where s.doc_id = m.doc_id and s.id = m.id and not s.is_end and s.pos <= m.pos) else m.source end as src from marks_view m),
b as (select b.*, (select max(s.pos) from marks_view s where s.doc_id = b.doc_id and not s.is_end and s.pos <= b.pos) as opened from block_view b),
alive as (select b.doc_id, b.pos, s.src, s.seq from b join k s on s.doc_id = b.doc_id and s.pos = b.opened and not s.is_end
  where (select count(*) from k e where e.doc_id = b.doc_id and e.is_end and e.src = s.src and e.pos >= b.opened and e.pos < b.pos) < (select count(*) from k o where o.doc_id = s.doc_id and o.pos = s.pos and not o.is_end and o.src = s.src and o.seq >= s.seq)),
op as (select doc_id, pos, arg_max(src, seq) as src from alive group by 1, 2),
rg as (select b.doc_id, b.pos, arg_min(source, first * 1000 + last) as src from b join r on r.doc_id = b.doc_id and b.pos between first and last group by 1, 2),
f as (select b.*, coalesce(rg.src, op.src, '') as source_id, nullif(src.source_file, '') as source_file, nullif(src.content_type, '') as content_type from b
  left join op on op.doc_id = b.doc_id and op.pos = b.pos left join rg on rg.doc_id = b.doc_id and rg.pos = b.pos left join src on src.source = coalesce(rg.src, op.src)),
t as (select *, case when kind = 'table' then 'table' when line <> '' and not starts_with(line, 'Table ') then 'paragraph' when content_type in ('figure', 'pdf_image') then content_type end as block_type from f)
select doc_id, pos, row_number() over (partition by doc_id order by pos) - 1 as block_index, block_type, source_id, coalesce(source_file, '未知來源') as source_file,
  coalesce(content_type, case when kind = 'table' then 'table' else 'paragraph' end) as content_type, case when block_type = 'paragraph' then line else '' end as text,
  case block_type when 'table' then array_to_string(probes, '|') when 'paragraph' then line else source_id || ' seen' end as probes
from t where block_type is not null""", "block_view", "toc_view", "marks_view")
def txt_block_trace(spark, d):
    """Captions of tables count as hidden texts."""
    blocks = view(spark, d, "block_view")
    blocks = blocks.withColumn("line", F.when(F.col("line").startswith("Table "), "").otherwise(F.col("line")))
    sources = sql(spark, d, _SOURCES).withColumn("probes", F.array(F.concat("source", F.lit(" seen"))))
    found = P.block_trace(blocks, sql(spark, d, _RANGES), view(spark, d, "marks_view"), sources)
    return found.withColumn("probes", F.array_join("probe_texts", "|")).drop("probe_texts")


@book.add("join_fragment_place")
def join_fragment_place(spark, d):
    """Fragments (runs of up to four lines, some cut short, some of the next document) placed
    by score in their own document."""
    blocks = lines(spark, d).filter("line <> ''").select("doc_id", F.col("pos").cast("long").alias("pos"), T.norm_text("line").alias("text"))
    kind = F.when(F.col("pos") % 9 == 4, "table").otherwise("paragraph")
    shaped = lambda rows: rows.select("*", kind.alias("kind"), (F.col("pos") % 5 == 2).alias("has_drawing"), F.slice(F.split("text", " "), F.lit(1), F.lit(20)).alias("probes"))
    cut = F.when(F.col("pos") % 4 == 1, F.left("text", F.lit(40))).otherwise(F.col("text"))
    parts = blocks.filter("pos % 7 < 4").withColumn("text", cut).withColumn("fragment", F.floor(F.col("pos") / 7))
    return P.place_fragments(shaped(blocks), shaped(parts))


@book.add("chg_registry", """with recursive log as (select root, seq, op, replace(trim(path, '/'), '//', '/') as path, trim(new_path, '/') as new_path, value, row_number() over (partition by root order by seq) as k from registry_view),
state as (select distinct root, 0::bigint as k, '' as path, null::bigint as value from log
union all select root, k, x.path, x.value from (
  select s.root, o.k, unnest(case when s.path = '' then case when o.op = 'record' then [{'path': '', 'value': null::bigint, 'new': false}, {'path': o.path, 'value': o.value, 'new': true}] else [{'path': '', 'value': null::bigint, 'new': false}] end
    when (s.path = o.path or starts_with(s.path, o.path || '/')) and o.op = 'remove' then []
    when (s.path = o.path or starts_with(s.path, o.path || '/')) and o.op = 'rename' and o.path <> o.new_path then [{'path': o.new_path || s.path[length(o.path) + 1:], 'value': s.value, 'new': true}]
    else [{'path': s.path, 'value': s.value, 'new': false}] end) as x
  from state s join log o on o.root = s.root and o.k = s.k + 1) qualify row_number() over (partition by root, k, x.path order by x.new desc) = 1)
select root, path, value from state s where path <> '' and k = (select max(k) from log l where l.root = s.root)""", "registry_view")
def chg_registry(spark, d):
    return paths.registry(view(spark, d, "registry_view"))


_ASKED = """select cast(floor(p_partkey / 50) as bigint) as folder, cast(p_partkey as bigint) as seq, 'f' || cast(p_size % 4 as string) ||
case p_partkey % 6 when 0 then ' (1)' when 1 then ' (' || cast(p_size % 5 as string) || ')' when 2 then ' (1) (1)' else '' end || case p_partkey % 4 when 0 then '.docx' when 1 then '.a.txt' else '' end as name from part"""
_TAKEN = "select distinct cast(floor(s_suppkey / 5) as bigint) as folder, 'f' || cast(s_suppkey % 4 as string) || case s_suppkey % 3 when 0 then '' when 1 then ' (2)' else ' (1).docx' end as name from supplier"


@book.add("win_dedup_names", f"""with recursive asked as (select *, row_number() over (partition by folder order by seq) as i,
  case when regexp_matches(name, '^[.]*[^.].*[.][^.]*$') then regexp_extract(name, '([.][^.]*)$', 1) else '' end as ext from ({_ASKED})),
state as (select folder, 0::bigint as i, null::bigint as seq, '' as name, '' as final, coalesce(t.names, []) as names from (select distinct folder from asked) left join (select folder, list(name) as names from ({_TAKEN}) group by 1) t using (folder)
union all select folder, i, seq, name, final, list_append(names, final) from (
  select a.folder, a.i, a.seq, a.name, s.names, list_filter(list_transform(range(len(s.names) + 2), lambda k: case when k = 0 then a.name else concat(a.name[1:length(a.name) - length(a.ext)], ' (', k, ')', a.ext) end), lambda n: not list_contains(s.names, n))[1] as final
  from state s join asked a on a.folder = s.folder and a.i = s.i + 1))
select folder, seq, name, final from state where i > 0""")
def win_dedup_names(spark, d):
    return paths.free_names(sql(spark, d, _ASKED), sql(spark, d, _TAKEN))


#: Written out here as fixed values, not taken from the code under test.
_GENERIC = "'a', 'an', 'and', 'by', 'for', 'from', 'ii', 'iii', 'information', 'input', 'inputs', 'manufacturer', 'of', 'path', 'section', 'supplied', 'system', 'task', 'td', 'test', 'the', 'to', 'ustar'"


@book.add("win_conflict_suffix", f"""with p as (select page_id, page_id // 2 as k, list_filter(string_split(regexp_replace(url, '^https?://|[?#].*$', '', 'g'), '/'), lambda x: x <> '') as parts from pages),
c as (select page_id, k, list_transform(parts[1:len(parts) - 1], lambda x: {{'x': x, 't': list_filter(regexp_split_to_array(lower(x), '[^0-9a-z]+'), lambda t: t <> '' and not regexp_full_match(t, '[0-9]+') and t not in ({_GENERIC}) and t not in ('example', 'com'))}}) as w from p),
j as (select a.page_id, a.w, b.w as o, list_filter(range(1, len(a.w) + 1), lambda i: len(a.w[i].t) > 0 and (i > len(b.w) or (a.w[i].x <> b.w[i].x and a.w[i].t <> b.w[i].t))) as apart, list_filter(range(1, len(a.w) + 1), lambda i: len(a.w[i].t) > 0) as near
  from c a join c b on a.k = b.k and a.page_id <> b.page_id)
select page_id, coalesce(w[apart[-1]].t[-1], w[near[-1]].t[-1]) as suffix from j""")
def win_conflict_suffix(spark, d):
    """Pages that go to one folder in pairs, told apart by the way to them."""
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace("url", r"^https?://|[?#].*$", "").alias("path")).withColumn("k", F.floor(F.col("page_id") / 2))
    others = pages.select("k", F.col("page_id").alias("other_id"), F.col("path").alias("other"))
    pairs = pages.join(others, "k").filter("page_id <> other_id")
    return pairs.select("page_id", paths.conflict_suffix(F.col("path"), F.col("other"), F.lit("example com")).alias("suffix"))


_FIELDS = """input_file text target_chapter_section target_chapter_title chapter_ref use_chapter_title target_subtitle continuous_extract explicit_end_number explicit_end_title
continuous_end_ref target_caption_label target_figure_title target_figure_index target_table_title target_table_index""".split()
_NONE = lambda *names: " and ".join(f"trim(coalesce({n}, '')) = ''" for n in names)


@book.add("dq_step_rules", f"""with s as (select *, not ({_NONE("target_chapter_section")}) and not ({_NONE("target_chapter_title")}) as both,
  case when not ({_NONE("target_chapter_section")}) and not ({_NONE("target_chapter_title")}) then trim(target_chapter_section || ' ' || target_chapter_title) else trim(coalesce(chapter_ref, '')) end as ref,
  case when coalesce(continuous_extract, '') <> '' then continuous_extract when {_NONE("explicit_end_number", "explicit_end_title", "continuous_end_ref")} then 'false' else 'true' end as cont from flow_step_view),
e as (select *, unnest(list_filter([
  case when step_type like 'extract%' and {_NONE("input_file")} then {{'kind': 'required', 'field': 'input_file'}} end,
  case when step_type = 'insert_text' and {_NONE("text")} then {{'kind': 'required', 'field': 'text'}} end,
  case when step_type in ('extract_word_chapter', 'extract_specific_figure_from_word', 'extract_specific_table_from_word')
    and not (regexp_matches(ref, '^[0-9]+([.][0-9]+)*[.]?\\s+\\S') or (not regexp_matches(ref, '^[0-9]+([.][0-9]+)*[.]?(\\s+.+)?$') and regexp_matches(ref, '\\b[0-9]+([.][0-9]+)*\\b'))) then {{'kind': 'composite', 'field': 'chapter_ref'}} end,
  case when step_type in ('extract_word_chapter', 'extract_specific_figure_from_word', 'extract_specific_table_from_word') and use_chapter_title = 'true' and {_NONE("target_subtitle")} then {{'kind': 'conditional', 'field': 'target_subtitle'}} end,
  case when step_type = 'extract_word_chapter' and cont = 'true' and (({_NONE("explicit_end_number")}) or ({_NONE("explicit_end_title")})) then {{'kind': 'conditional', 'field': 'continuous_end_ref'}} end,
  case when step_type = 'extract_specific_figure_from_word' and {_NONE("target_caption_label", "target_figure_title", "target_figure_index")} then {{'kind': 'any', 'field': 'target_caption_label'}} end,
  case when step_type = 'extract_specific_table_from_word' and {_NONE("target_caption_label", "target_table_title", "target_table_index")} then {{'kind': 'any', 'field': 'target_caption_label'}} end
], lambda x: x is not null)) as r from s)
select run_id, step_no, step_type, r.kind as kind, r.field as field from e""", "flow_step_view")
def dq_step_rules(spark, d):
    steps = view(spark, d, "flow_step_view")
    values = F.map_from_arrays(F.array(*map(F.lit, _FIELDS)), F.array(*_FIELDS))
    return step_rules.broken_rules(steps.select("run_id", "step_no", "step_type", values.alias("values")), step_rules.rule_table(spark))
