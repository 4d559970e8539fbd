"""Stand-in views over the test tables, in SQL that Spark and DuckDB share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "catalog_view": """
select p_partkey as row_no, p_name as title,
  case when p_size % 7 = 0 then 'no' else '是' end as relevance,
  case when p_partkey % 10 = 8 then 'ASTM' when p_partkey % 10 = 9 then 'IEC'
       when cast(floor(p_partkey / 20) as bigint) % 8 = 5 then 'ISO' else 'EN' end as sheet,
  case when p_partkey % 10 = 8 then 'ASTM F' || cast(1000 + p_partkey % 50 as string) || '-' || cast(10 + p_size % 15 as string)
       when p_partkey % 10 = 9 then 'IEC ' || cast(10000 + p_partkey % 50 as string) || ':' || cast(1995 + p_size % 30 as string)
       else case cast(floor(p_partkey / 20) as bigint) % 8 when 0 then 'BS EN ISO ' when 1 then 'BS EN ' when 2 then 'EN ' when 3 then 'EN ISO '
              when 4 then 'BS ISO ' when 5 then 'ISO ' when 6 then 'BS ' else 'DIN EN ' end
            || cast(10000 + p_partkey % 50 as string) || ':' || cast(1995 + p_size % 30 as string)
            || case when p_size % 11 = 0 then '/A1:2021' else '' end end as standard_no
from part""",
    "requirement_view": """
select o_custkey % 20 as table_id, o_orderkey as row_no,
  case o_custkey % 4 when 0 then 'ISO ' || cast(10000 + o_orderkey % 60 as string)
    when 1 then 'EN ISO ' || cast(10000 + o_orderkey % 60 as string) || ':2010'
    when 2 then 'ASTM F' || cast(1000 + o_orderkey % 60 as string)
    else 'IEC ' || cast(10000 + o_orderkey % 60 as string) end as standards,
  cast(1995 + o_orderkey % 30 as string) as issued_year,
  case when o_orderkey % 3 = 0 then 'Yes' else 'NO' end as harmonised,
  o_orderpriority as title
from orders""",
    "adoption_view": """
select p_partkey as row_no,
  'EN ISO ' || cast(10000 + p_partkey % 50 as string) || ':' || cast(1995 + p_size % 30 as string) || chr(10) || p_name as reference
from part where p_size % 3 = 0""",
    "register_view": """
select s_suppkey + 4 as row_no, 'MEDDEV 2.7/' || cast(s_suppkey % 7 as string) || ' Rev. 4' as key_text,
  s_name as title, cast(2000 + s_suppkey % 20 as string) || '/06' as date_text
from supplier""",
    "job_event_view": """
select event_id, ts, user_id as job_id,
  case event_type when 'signup' then 'queued' when 'view' then 'claimed' when 'click' then 'running'
    when 'purchase' then 'completed' else 'failed' end as status, props as payload_json
from events""",
    "toc_view": """
select cast(floor(p_partkey / 40) as bigint) as doc_id, p_partkey % 40 as pos,
  case when p_partkey % 4 = 0 then cast(1 + cast(floor((p_partkey % 40) / 8) as bigint) as string)
         || case when p_partkey % 8 = 4 then '.1' else '' end || ' Heading ' || p_name
       else p_name || ', as delivered, is described here in full.' end as line,
  case when p_partkey % 8 = 0 then 1 when p_partkey % 8 = 4 then 2 else null end as level,
  p_size % 6 = 0 as has_drawing
from part""",
    "contents_view": """
select cast(floor(p_partkey / 40) as bigint) as doc_id, p_partkey % 40 as pos,
  case p_partkey % 9 when 0 then '1.2' || chr(9) || p_name || chr(9) || cast(p_size as string) when 1 then '3．4 ' || p_name || ' ' || cast(p_size as string)
    when 2 then p_name || ' v' || cast(p_size as string) when 3 then 'Annex A1' || cast(p_size as string) when 4 then '2.1.' || chr(9) || ' ' || p_name || chr(13) || chr(10) || 'end  7 '
    when 5 then ' ' || chr(9) || ' ' when 6 then cast(p_size as string) when 7 then p_name || ' 1234' || cast(10 + p_size as string) else '4 5' || chr(9) || cast(p_size as string) end as text,
  case p_partkey % 7 when 0 then 'toc 2' when 1 then 'TOC Heading' when 2 then '目錄 1' when 3 then 'Heading 1' else null end as style_name,
  case p_partkey % 5 when 0 then 'TOC3' when 1 then 'Body' else null end as style_id,
  case when p_size % 6 = 0 then 'HYPERLINK x' when p_size % 6 = 1 then ' toc o ' else null end as field,
  case when p_size % 4 = 0 then 'mark _Toc12' when p_size % 4 = 1 then 'x_Toc' else null end as anchor_list,
  case when p_size % 8 = 3 then 'none dot' when p_size % 8 = 5 then 'middleDot' when p_size % 8 = 6 then 'dots' else null end as leader_list
from part""",
    "heading_view": """
select cast(floor(p_partkey / 40) as bigint) as doc_id, p_partkey % 40 as pos,
  case p_partkey % 13 when 0 then '1 Heading ' || p_name when 1 then '2.1 Heading' when 2 then '2.' || cast(p_size % 5 as string) || '.' || cast(p_size % 4 as string) || ' ' || p_name
    when 3 then cast(p_size % 4 as string) || '.1 scope' when 4 then 'Figure ' || cast(p_size as string) || ': ' || p_name when 5 then 'Scope of ' || p_name
    when 6 then p_name || ', as delivered, is described here.' when 7 then upper(p_name) when 8 then '範圍 ' || p_name when 9 then 'Heading'
    when 10 then cast(p_size as string) when 11 then p_name || ' ' || p_name || ' ' || p_name || ' ' || p_name else 'Note that it is so.' end as line
from part""",
    "block_view": """
select cast(floor(p_partkey / 40) as bigint) as doc_id, p_partkey % 40 as pos,
  case when p_partkey % 4 = 0 then cast(1 + cast(floor((p_partkey % 40) / 8) as bigint) as string) || case when p_partkey % 8 = 4 then '.1' else '' end || ' Heading ' || p_name
    when p_partkey % 9 = 1 then 'Scope of ' || p_name when p_partkey % 9 = 2 then 'Table ' || cast(p_size as string) || ': ' || p_name when p_partkey % 9 = 3 then ''
    when p_partkey % 9 = 4 then p_name when p_partkey % 9 = 5 then cast(p_size % 6 as string) || '.2 ' || p_brand
    else p_name || ', as delivered, is described here in full.' end as line,
  case when p_partkey % 8 = 0 then 1 when p_partkey % 8 = 4 then 2 else null end as level,
  case when p_partkey % 4 = 0 then 'Heading' when p_partkey % 5 = 1 then 'Body' else null end as style,
  case when p_partkey % 4 = 0 then 1 when p_partkey % 7 = 1 then 0 when p_partkey % 7 = 2 then 2 else null end as ilvl,
  p_size % 5 = 0 as bold, case when p_partkey % 4 = 0 then null when p_size % 11 = 0 then 'inline' when p_size % 7 = 0 then 'styled_bold' else null end as subheading,
  p_size % 13 = 0 as in_table, p_size % 6 = 0 as has_drawing, case when p_size % 9 = 0 then 'table' else 'paragraph' end as kind, split(p_name, ' ') as probes
from part""",
    "caption_view": """
select cast(floor(p_partkey / 20) as bigint) as doc_id, p_partkey % 20 as pos,
  case when p_partkey % 5 = 0 then 'Figure ' || cast(1 + (p_partkey * 7) % 9 as string) || ': ' || p_name
       when p_partkey % 5 = 2 then 'Table ' || cast(1 + (p_partkey * 3) % 9 as string) || ' ' || p_name
       when p_partkey % 5 = 3 then p_name || ' see Figure ' || cast(1 + ((p_partkey - 3) * 7) % 9 as string) || ' there'
       else p_name end as line,
  p_size % 3 = 0 as has_drawing, p_partkey % 20 = 11 as is_heading
from part""",
    "mapping_view": """
select l_orderkey as output_no, l_orderkey * 10 + l_linenumber as row_no,
  case when l_linenumber % 7 = 0 then '' else 'file' || cast(l_partkey % 40 as string) || '.docx' end as source,
  case l_suppkey % 6 when 0 then '1.' || cast(l_linenumber as string) || ' scope' when 1 then 'Figure 2' when 2 then 'Table 3|include title=yes'
    when 3 then 'all' when 4 then '' else 'Insert text' end as operation,
  case when l_orderkey % 9 = 0 then '' when l_orderkey % 11 = 0 then 'out' || cast(l_orderkey % 50 as string) || '.pdf'
    else 'out' || cast(l_orderkey % 50 as string) || '.docx' end as output,
  case when l_linenumber % 3 = 0 then 'tpl_b.docx' else 'tpl_a.docx' end as template,
  l_partkey % 12 as insert_at, case when l_returnflag = 'R' then 'replace' when l_returnflag = 'A' then 'insert_after' else 'maybe' end as mode
from lineitem""",
    "cells_view": """
select o_custkey % 20 as table_id, 0 as row_no, 0 as col_no, 'Standards' as cell from orders group by 1
union all select o_custkey % 20, 0, 1, case when o_custkey % 20 % 5 = 4 then 'Year' else 'Issued Year' end from orders group by 1, 4
union all select o_custkey % 20, 0, 2, 'EU Harmonised Standards (YES/NO)' from orders group by 1
union all select o_custkey % 20, 0, 3, case when o_custkey % 20 % 7 = 6 then 'Remarks' else 'Title' end from orders group by 1, 4
union all select o_custkey % 20, o_orderkey + 1, 0, case when o_orderkey % 10 = 0 then 'Category ' || cast(o_orderkey as string) else 'ISO ' || cast(10000 + o_orderkey % 60 as string) end from orders
union all select o_custkey % 20, o_orderkey + 1, 1, cast(1995 + o_orderkey % 30 as string) from orders where o_orderkey % 10 <> 0
union all select o_custkey % 20, o_orderkey + 1, 2, case when o_orderkey % 3 = 0 then 'Yes' else 'NO' end from orders where o_orderkey % 10 <> 0
union all select o_custkey % 20, o_orderkey + 1, 3, o_orderpriority from orders where o_orderkey % 10 <> 0""",
    "marks_view": """
select cast(floor(p_partkey / 40) as bigint) as doc_id, p_partkey % 40 as pos, 1 as seq, cast(p_partkey % 40 as string) as id, 's' || cast(p_size % 4 as string) as source, false as is_end from part where p_partkey % 5 = 1
union all select cast(floor(p_partkey / 40) as bigint), p_partkey % 40, 2, 'b' || cast(p_size % 6 as string), 's' || cast(p_size % 3 as string), false from part where p_partkey % 10 = 1
union all select cast(floor(p_partkey / 40) as bigint), p_partkey % 40, 3, cast(p_partkey % 40 - p_size % 6 as string), null, true from part where p_partkey % 3 = 1
union all select cast(floor(p_partkey / 40) as bigint), p_partkey % 40, 4, 'b' || cast(p_size % 6 as string), null, true from part where p_partkey % 4 = 2""",
    "registry_view": """
select cast(floor(event_id / 50) as bigint) as root, event_id as seq,
  case when event_id % 7 = 3 then 'rename' when event_id % 9 = 4 then 'remove' else 'record' end as op,
  case when event_id % 7 = 3 or event_id % 9 = 4 then case user_id % 4 when 0 then 'd' || cast(user_id % 3 as string) when 1 then 'd' || cast(user_id % 3 as string) || '/e' || cast(event_id % 2 as string) when 2 then 'd0/e1/f' || cast(user_id % 3 as string) else 'm/e' || cast(event_id % 2 as string) end
    else 'd' || cast(user_id % 3 as string) || '/e' || cast(event_id % 2 as string) || '//f' || cast(event_id % 5 as string) end as path,
  case user_id % 5 when 0 then 'm' when 1 then 'm/e1' when 2 then 'd1' when 3 then 'd2/e0/' else 'd0/e1/f2' end as new_path, event_id * 3 as value
from events""",
    "flow_step_view": """
select l_orderkey as run_id, l_linenumber as step_no,
  case l_suppkey % 6 when 0 then 'extract_word_all_content' when 1 then 'extract_word_chapter' when 2 then 'extract_specific_figure_from_word' when 3 then 'extract_specific_table_from_word' when 4 then 'insert_text' else 'template_merge' end as step_type,
  case when l_partkey % 7 = 0 then ' ' when l_partkey % 7 = 1 then null else 'in' || cast(l_partkey as string) || '.docx' end as input_file, case when l_partkey % 5 = 0 then '' else 'Text' end as text,
  case when l_partkey % 4 = 0 then null else '1.' || cast(l_partkey % 9 as string) end as target_chapter_section, case l_partkey % 6 when 0 then '' when 1 then null else 'Scope' end as target_chapter_title,
  case l_partkey % 8 when 0 then '2.1 Scope' when 1 then '2.1' when 2 then 'Annex 4 of it' when 3 then 'Annex' when 4 then '3. Use ' when 5 then '3x Use' else null end as chapter_ref,
  case when l_discount >= 0.05 then 'true' when l_discount >= 0.03 then 'yes' else '' end as use_chapter_title, case when l_partkey % 3 = 0 then 'Sub' else ' ' end as target_subtitle,
  case when l_tax >= 0.06 then 'true' when l_tax >= 0.04 then 'false' else null end as continuous_extract, case when l_partkey % 11 < 4 then '4' else null end as explicit_end_number, case when l_partkey % 11 in (1, 5) then 'End' else '' end as explicit_end_title,
  case when l_partkey % 13 = 1 then '4 End' else null end as continuous_end_ref, case when l_partkey % 10 = 0 then 'Figure 1' else null end as target_caption_label,
  case when l_partkey % 10 = 1 then 'Pump' else '' end as target_figure_title, case when l_partkey % 10 = 2 then '2' else null end as target_figure_index, case when l_partkey % 10 = 3 then 'Limits' else null end as target_table_title, case when l_partkey % 10 = 4 then '1' else '' end as target_table_index
from lineitem""",
    "step_view": """
select l_orderkey as run_id, l_linenumber as step_no, l_partkey % 15 as source_no,
  'dir' || cast(l_partkey % 4 as string) || '/sub' || cast(l_partkey % 3 as string) || '/file' || cast(l_partkey % 15 as string) || '.docx' as source_path,
  case l_suppkey % 4 when 0 then 'chapter' when 1 then 'figure' when 2 then 'table' else 'copy' end as step_type,
  case when l_discount >= 0.09 then 'error' else 'ok' end as status,
  case when l_discount >= 0.09 then 'step failed on ' || cast(l_partkey as string) else '' end as message,
  l_linenumber * 10 as first_block, l_linenumber * 10 + l_suppkey % 12 as last_block,
  case when l_suppkey % 5 = 0 then null else 'Title ' || cast(l_partkey % 8 as string) end as title
from lineitem""",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str, **frames: DataFrame) -> DataFrame:
    """Spark SQL over the tables, views and frames that it names after from or join."""
    def resolve(m):
        name = m[2]
        if name in frames:
            return f"{m[1]} {{{name}}}"
        if name in VIEWS or name in TABLES:
            used[name] = view(spark, sf_dir, name)
            return f"{m[1]} {{{name}}}"
        return m[0]

    used: dict[str, DataFrame] = {}
    text = re.sub(r"\b(from|join)\s+(\w+)", resolve, text.replace("{", "{{").replace("}", "}}"))
    return spark.sql(text, **used, **frames)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return table(spark, sf_dir, name)
    return sql(spark, sf_dir, VIEWS[name])


def oracle(text: str, *views: str) -> str:
    """DuckDB SQL with the named views in front."""
    ctes = ", ".join(f"{v} as ({VIEWS[v]})" for v in views)
    text = text.strip()
    if not ctes:
        return text
    head = next((h for h in ("with recursive ", "with ") if text.lower().startswith(h)), None)
    return f"{head}{ctes}, {text[len(head):]}" if head else f"with {ctes} {text}"
