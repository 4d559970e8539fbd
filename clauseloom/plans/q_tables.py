"""Queries over requirement tables, mapping sheets and step logs."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import standards as S
from ..functions import text as T
from ..operators import records as R
from ..sources.views import sql, table, view
from .book import Book
from .q_functions import norm

book = Book()

#: Required headers and the word subset that also names them; fixed values.
HEADERS = {"standards": ("standards",), "issued_year": ("issued", "year"), "harmonised": ("harmonised",), "title": ("title",)}
MINIMUM = ("standards", "issued_year")


def header_cells(cells: DataFrame) -> DataFrame:
    """(table_id, field, col_no) for each required header found in the first row: the
    first column whose words contain the header's words."""
    words = F.split(F.lower(F.regexp_replace(T.norm_text("cell"), r"[^A-Za-z0-9]+", " ")), " ")
    hits = F.array_compact(F.array(*[F.when(F.size(F.array_except(F.array(*map(F.lit, ws)), F.col("_w"))) == 0, F.lit(f)) for f, ws in HEADERS.items()]))
    rows = cells.filter("row_no = 0").withColumn("_w", words).select("table_id", "col_no", F.explode(hits).alias("field"))
    return rows.groupBy("table_id", "field").agg(F.min("col_no").alias("col_no"))


def resolved(found: DataFrame) -> DataFrame:
    """Tables in which every required header was found."""
    return found.groupBy("table_id").agg(F.count("*").alias("n")).filter(F.col("n") == len(HEADERS)).select("table_id")


D_HEAD = """hc as (select table_id, 'standards' as field, min(col_no) as col_no from cells_view where row_no = 0 and contains(lower(cell), 'standards') group by 1
union all select table_id, 'issued_year', min(col_no) from cells_view where row_no = 0 and lower(cell) = 'issued year' group by 1
union all select table_id, 'harmonised', min(col_no) from cells_view where row_no = 0 and contains(lower(cell), 'harmonised') group by 1
union all select table_id, 'title', min(col_no) from cells_view where row_no = 0 and lower(cell) = 'title' group by 1),
okt as (select table_id from hc group by 1 having count(*) = 4)"""


@book.add("src_header_resolve", f"with {D_HEAD} select hc.* from hc join okt using (table_id)", "cells_view")
def src_header_resolve(spark, d):
    found = header_cells(view(spark, d, "cells_view"))
    return found.join(resolved(found), "table_id", "left_semi")


def manual(spark) -> DataFrame:
    return spark.sql("select * from values (4L, 'issued_year', 'YEAR'), (9L, 'issued_year', ' year '), (9L, 'colour', 'x') as t(table_id, field, actual)")


@book.add("src_header_manual", f"with {D_HEAD}, m as (select table_id, 'issued_year' as field, min(col_no) as col_no from cells_view where row_no = 0 and table_id in (4, 9) and upper(trim(cell)) = 'YEAR' group by 1) select coalesce(m.table_id, hc.table_id) as table_id, coalesce(m.field, hc.field) as field, coalesce(m.col_no, hc.col_no) as col_no from hc full outer join m on m.table_id = hc.table_id and m.field = hc.field", "cells_view")
def src_header_manual(spark, d):
    """A user's mapping of a field to a header's text wins over what was detected."""
    cells = view(spark, d, "cells_view")
    chosen = F.broadcast(manual(spark).filter(F.col("field").isin(*HEADERS)))  # what one user typed
    mine = cells.filter("row_no = 0").join(chosen, "table_id").filter((S.search_key("cell") == S.search_key("actual")) | (S.compact_key("cell") == S.compact_key("actual")))
    mine = mine.groupBy("table_id", "field").agg(F.min("col_no").alias("mine"))
    return header_cells(cells).join(mine, ["table_id", "field"], "full_outer").select("table_id", "field", F.coalesce("mine", "col_no").alias("col_no"))


@book.add("src_header_inspect", f"with {D_HEAD}, t as (select distinct table_id from cells_view) select t.table_id, count(hc.field) as matched, case when count(hc.field) = 4 then 'full' when count(hc.field) = 0 then 'ignored' else 'partial' end as status, count_if(hc.field in ('standards','issued_year')) < 2 as lacks_minimum from t left join hc using (table_id) group by 1", "cells_view")
def src_header_inspect(spark, d):
    cells = view(spark, d, "cells_view")
    rows = cells.select("table_id").distinct().join(header_cells(cells), "table_id", "left")
    n = F.count("field")
    return rows.groupBy("table_id").agg(n.alias("matched"), F.when(n == len(HEADERS), "full").when(n == 0, "ignored").otherwise("partial").alias("status"), (F.count_if(F.col("field").isin(*MINIMUM)) < len(MINIMUM)).alias("lacks_minimum"))


@book.add("agg_unmapped_any", f"with {D_HEAD}, t as (select distinct table_id from cells_view) select bool_or(n < 2) as unmapped from (select t.table_id, count_if(hc.field in ('standards','issued_year')) as n from t left join hc using (table_id) group by 1)", "cells_view")
def agg_unmapped_any(spark, d):
    return src_header_inspect(spark, d).agg(F.bool_or("lacks_minimum").alias("unmapped"))


@book.add("src_requirement_rows", f"""with {D_HEAD}, w as (select table_id, row_no, max(case when col_no = 0 then cell end) as standards, max(case when col_no = 1 then cell end) as issued_year, count(*) as n from cells_view where row_no > 0 group by 1, 2),
c as (select *, last_value(case when n = 1 then standards end ignore nulls) over (partition by table_id order by row_no rows between unbounded preceding and current row) as category from w)
select table_id, row_no, standards, issued_year, category from c join okt using (table_id) where n > 1 and standards <> ''""", "cells_view")
def src_requirement_rows(spark, d):
    """Requirement rows with the category in force; one-cell rows set it."""
    cells = view(spark, d, "cells_view")
    found = header_cells(cells)
    rows = cells.filter("row_no > 0").join(resolved(found), "table_id", "left_semi").join(found, ["table_id", "col_no"], "left")
    wide = rows.groupBy("table_id", "row_no").agg(*[F.max(F.when(F.col("field") == f, F.col("cell"))).alias(f) for f in ("standards", "issued_year")], F.count_if(T.norm_text("cell") != "").alias("n"), F.min_by("cell", "col_no").alias("first"))
    w = Window.partitionBy("table_id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    filled = wide.withColumn("category", F.last(F.when(F.col("n") <= 1, F.col("first")), ignorenulls=True).over(w))
    return filled.filter("n > 1 and standards <> ''").select("table_id", "row_no", "standards", "issued_year", "category")


@book.add("src_table_probes", """with p as (select table_id, row_no, col_no, trim(cell) as probe from cells_view where length(trim(cell)) >= 20
union all select table_id, row_no, -1, string_agg(trim(cell), ' ' order by col_no) from cells_view group by 1, 2 having length(string_agg(trim(cell), ' ' order by col_no)) >= 24)
select table_id, probe, first_row from (select table_id, probe, row_no as first_row, row_number() over (partition by table_id, probe order by row_no, col_no) as rn from p) where rn = 1""", "cells_view")
def src_table_probes(spark, d):
    """Distinct probe texts of a table: long cells, and whole rows, with the row they come from first."""
    cells = view(spark, d, "cells_view").withColumn("probe", T.norm_text("cell"))
    long_cells = cells.filter(F.length("probe") >= 20).select("table_id", "row_no", "col_no", "probe")
    whole = cells.groupBy("table_id", "row_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col_no", "probe"))), lambda x: x["probe"]), " ").alias("probe"))
    whole = whole.filter(F.length("probe") >= 24).select("table_id", "row_no", F.lit(-1).alias("col_no"), "probe")
    return long_cells.unionByName(whole).groupBy("table_id", "probe").agg(F.min("row_no").alias("first_row"))


# --- mapping sheets ---
D_ERR = """case when operation = '' then 'operation missing' when output = '' then 'output missing' when not ends_with(output, '.docx') then 'output suffix' when source = '' and operation <> 'Insert text' then 'input missing' when mode not in ('replace', 'insert_after') then 'bad mode' end"""


def row_errors(rows: DataFrame) -> DataFrame:
    """Adds ``error`` (the first check that fails, in order) and ``warnings``."""
    empty = lambda c: T.norm_text(c) == ""
    error = (
        F.when(empty("operation"), "operation missing").when(empty("output"), "output missing").when(~F.lower("output").endswith(".docx"), "output suffix")
        .when(empty("source") & (F.col("operation") != "Insert text"), "input missing").when(~F.col("mode").isin("replace", "insert_after"), "bad mode")
    )
    warnings = F.array_compact(F.array(F.when(F.col("operation") == "all", F.when(F.col("template") != "", F.lit("template ignored")))))
    return rows.withColumn("error", error).withColumn("warnings", warnings)


@book.add("dq_mapping_rows", f"select row_no, {D_ERR} as error, case when operation = 'all' and template <> '' then 'template ignored' else '' end as warnings from mapping_view", "mapping_view")
def dq_mapping_rows(spark, d):
    return row_errors(view(spark, d, "mapping_view")).select("row_no", "error", F.array_join("warnings", ",").alias("warnings"))


@book.add("agg_template_conflict", f"with g as (select *, {D_ERR} as error from mapping_view), f as (select *, first_value(template) over (partition by output order by row_no, template) as first from g where error is null) select row_no, template <> first as conflict from f", "mapping_view")
def agg_template_conflict(spark, d):
    return conflicts(spark, d).select("row_no", "conflict")


def conflicts(spark, d) -> DataFrame:
    """Sound mapping rows; ``conflict`` where the template differs from the output's first row."""
    rows = row_errors(view(spark, d, "mapping_view")).filter("error is null")
    first = rows.groupBy("output").agg(F.min(F.struct("row_no", "template"))["template"].alias("first"))
    return rows.join(first, "output").withColumn("conflict", F.col("template") != F.col("first"))


def step_lists(rows: DataFrame) -> DataFrame:
    """Ordered step lists by (output, template)."""
    return rows.groupBy("output", "template").agg(F.sort_array(F.collect_list(F.struct("row_no", "operation", "source"))).alias("steps"))


@book.add("agg_steps_per_output", f"with g as (select *, {D_ERR} as error from mapping_view), f as (select *, first_value(template) over (partition by output order by row_no, template) as first from g where error is null) select output, template, count(*) as n, md5(string_agg(row_no || ':' || operation, ';' order by row_no, operation, source)) as h from f where template = first group by 1, 2", "mapping_view")
def agg_steps_per_output(spark, d):
    lists = step_lists(conflicts(spark, d).filter("not conflict"))
    text = F.array_join(F.transform("steps", lambda s: F.concat_ws(":", s["row_no"].cast("string"), s["operation"])), ";")
    return lists.select("output", "template", F.size("steps").cast("long").alias("n"), F.md5(text).alias("h"))


@book.add("snk_grouped_outputs", f"with g as (select *, {D_ERR} as error from mapping_view), f as (select *, first_value(template) over (partition by output order by row_no, template) as first from g where error is null) select output, count(*) as rows from f where template = first group by 1", "mapping_view")
def snk_grouped_outputs(spark, d):
    """Writes one folder per output (dynamic partition overwrite) and reads the row counts back."""
    from ..sources.shared import shared_path

    path = shared_path(spark, "outputs")
    rows = conflicts(spark, d).filter("not conflict").select("output", "template", "row_no", "operation")
    rows.repartition("output").write.partitionBy("output").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    return spark.read.parquet(path).groupBy("output").agg(F.count("*").alias("rows"))


@book.add("snk_run_log", "select run_id, count(*) as steps, 1 as documents from step_view group by 1", "step_view")
def snk_run_log(spark, d):
    """One JSON document per run with its ordered step log, written and read back."""
    from ..sources.shared import shared_path

    path = shared_path(spark, "run-log")
    logs = view(spark, d, "step_view").groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("step_no", "step_type", "status", "message"))).alias("steps"))
    logs.write.mode("overwrite").json(path)
    back = spark.read.schema("run_id long, steps array<struct<step_no:int,step_type:string,status:string,message:string>>").json(path)
    return back.select("run_id", F.size("steps").alias("steps"), F.count_if(F.lit(True)).over(Window.partitionBy("run_id")).alias("documents"))


def dq_step_rules(spark, d):
    """One row for each rule that a step breaks: required, conditional, composite and at-least-one-of."""
    missing = lambda c: F.col(c).isNull() | (F.col(c) == "")
    rules = {
        "type required": missing("step_type"),
        "title required": F.col("step_type").isin("figure", "table") & F.col("title").isNull(),
        "block order": F.col("last_block") < F.col("first_block"),
        "title or message": missing("title") & missing("message"),
    }
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return view(spark, d, "step_view").select("run_id", "step_no", F.explode(broken).alias("rule"))


_MESSAGES = "select cast(floor(o_orderkey / 64) as bigint) as log_id, o_orderkey as pos, case o_custkey % 7 when 0 then ' ERROR: ' || o_orderpriority when 1 then 'WF_ERROR: ' || o_orderstatus when 2 then '錯誤：x' when 3 then null else 'WARN: y' end as message from orders where o_custkey % 19 = 0"
_RUNS = "select cast(floor(o_orderkey / 64) as bigint) as log_id, o_orderkey as run_no, case when o_custkey % 13 = 0 then ' Error' else 'ok' end as status, case when o_custkey % 17 = 0 then ' run ' || o_orderpriority || ' ' when o_custkey % 17 = 1 then ' ' end as error from orders"
_STEPS = """select cast(floor(l_orderkey / 64) as bigint) as log_id, l_orderkey as run_no, l_linenumber as step_no, case when l_suppkey % 5 = 0 then 'ERROR' else 'ok' end as status,
  case when l_partkey % 9 = 0 then 'step ' || cast(l_partkey as string) when l_partkey % 9 = 1 then '' end as error, case when l_suppkey % 2 = 0 then 'Extract' end as action, case when l_partkey % 2 = 0 then 'chapter' else ' ' end as detail from lineitem"""


@book.add("agg_run_error", f"""with m as (select log_id, trim(coalesce(message, '')) as t, pos from ({_MESSAGES})), mb as (select *, regexp_matches(t, '^(ERROR:|錯誤：|WF_ERROR:|工作流程錯誤：)') as bad from m),
r as (select log_id, run_no, lower(trim(status)) = 'error' as failed, trim(coalesce(error, '')) as t from ({_RUNS})),
s as (select *, lower(trim(status)) = 'error' as failed, trim(coalesce(error, '')) as t from ({_STEPS})),
e as (select log_id, bad, 0 as k, pos as a, 0 as b, case when bad then t end as t from mb union all select log_id, failed or t <> '', 1, run_no, -1, nullif(t, '') from r
  union all select log_id, failed or t <> '', 1, run_no, step_no, case when failed and t <> '' then case when action is not null and trim(detail) <> '' then action || ' :: ' || trim(detail) || ' :: ' || t when action is not null then action || ': ' || t else t end end from s)
select log_id, bool_or(bad) as has_error, coalesce(arg_min(t, (k, a, b, t)) filter (where t is not null), '') as first_error from e group by 1""")
def agg_run_error(spark, d):
    return R.log_errors(sql(spark, d, _MESSAGES), sql(spark, d, _RUNS), sql(spark, d, _STEPS))


@book.add("agg_ordered_titles", f"with t as (select run_id, step_no, title, lower({norm('title')}) as k from step_view where title is not null) select run_id, title, row_number() over (partition by run_id order by step_no, title) as place from (select *, row_number() over (partition by run_id, k order by step_no, title) as rn from t) where rn = 1", "step_view")
def agg_ordered_titles(spark, d):
    rows = view(spark, d, "step_view").filter("title is not null").withColumn("k", F.lower(T.norm_text("title")))
    first = rows.groupBy("run_id", "k").agg(F.min(F.struct("step_no", "title")).alias("f")).select("run_id", "f.step_no", "f.title")
    return first.select("run_id", "title", F.row_number().over(Window.partitionBy("run_id").orderBy("step_no", "title")).alias("place"))


@book.add("agg_probe_lists", "with p as (select source_no, run_id * 10 + step_no as seen, unnest([title, step_type || ' of ' || source_path]) as probe from step_view), f as (select source_no, probe, min(seen) as seen from p where probe is not null group by 1, 2) select source_no, count(*) as n, md5(string_agg(probe, '|' order by seen, probe)) as h from f group by 1", "step_view")
def agg_probe_lists(spark, d):
    """Probe texts of each source without repeats, in order of first appearance."""
    probes = F.explode(F.array_compact(F.array("title", F.concat("step_type", F.lit(" of "), "source_path"))))
    rows = view(spark, d, "step_view").select("source_no", (F.col("run_id") * 10 + F.col("step_no")).alias("at"), probes.alias("probe"))
    first = rows.groupBy("source_no", "probe").agg(F.min("at").alias("at"))
    return first.groupBy("source_no").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "probe"))), lambda x: x["probe"]), "|")).alias("h"))


@book.add("txt_descriptor", "select run_id, step_no, 'src_' || lpad(cast(row_number() over (partition by run_id order by step_no) as varchar), 6, '0') as source_id from step_view where step_type <> 'copy'", "step_view")
def txt_descriptor(spark, d):
    n = F.row_number().over(Window.partitionBy("run_id").orderBy("step_no"))
    return view(spark, d, "step_view").filter("step_type <> 'copy'").select("run_id", "step_no", F.format_string("src_%06d", n).alias("source_id"))


@book.add("win_template_order", """select row_no, row_number() over (partition by output, template order by insert_at desc, case when mode = 'replace' and k = 1 then 0 when mode = 'insert_after' then 1 else 2 end, row_no desc) as place from
(select *, row_number() over (partition by output, template, insert_at, mode order by row_no) as k from mapping_view where mode in ('replace', 'insert_after'))""", "mapping_view")
def win_template_order(spark, d):
    """Merge order at a template: index downwards; at one index the first replacement, then insertions from the last, then further replacements from the last."""
    rows = view(spark, d, "mapping_view").filter(F.col("mode").isin("replace", "insert_after"))
    k = F.row_number().over(Window.partitionBy("output", "template", "insert_at", "mode").orderBy("row_no"))
    turn = F.when((F.col("mode") == "replace") & (F.col("k") == 1), 0).when(F.col("mode") == "insert_after", 1).otherwise(2)
    w = Window.partitionBy("output", "template").orderBy(F.desc("insert_at"), turn, F.desc("row_no"))
    return rows.withColumn("k", k).select("row_no", F.row_number().over(w).alias("place"))


@book.add("agg_batch_items", """with x as (select o_custkey as batch, 1 as part, o_orderkey as pos, case o_orderkey % 4 when 1 then 'mapping_scheme' when 3 then 'odd' else 'task' end as kind, case when o_custkey % 50 = 0 then '' else 'T' || (o_orderkey % 5) end as task, 's' || (o_orderkey % 2) as scheme from orders where o_orderkey % 13 <> 0
union all select o_custkey, 2, o_orderkey, 'task', 'T' || (o_orderkey % 7), '' from orders where o_orderkey % 3 = 0), f as (select batch, kind, task, scheme, min((part, pos)) as first from x where kind <> 'odd' and task <> '' group by 1, 2, 3, 4)
select batch, kind, task, scheme, cast(row_number() over (partition by batch order by first) - 1 as int) as place from f""")
def agg_batch_items(spark, d):
    """The items of each customer's batch, from tokens (some of them broken) and plain ids."""
    kind = F.expr("case o_orderkey % 4 when 0 then 'task' when 1 then ' Mapping_Scheme ' when 3 then 'odd' end")
    record = F.struct(kind.alias("kind"), F.when(F.col("o_custkey") % 50 == 0, "").otherwise(F.concat(F.lit("T"), (F.col("o_orderkey") % 5).cast("string"))).alias("task_id"), F.concat(F.lit("s"), (F.col("o_orderkey") % 2).cast("string")).alias("scheme_id"))
    token = F.when(F.col("o_orderkey") % 13 == 0, F.when(F.col("o_orderkey") % 2 == 0, "!!").otherwise("WzFd")).otherwise(F.translate(F.base64(F.to_json(record).cast("binary")), "+/=\r\n", "-_"))
    plain = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("T"), (F.col("o_orderkey") % 7).cast("string")))
    listed = lambda c, glue: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", c.alias("x")))), lambda r: r["x"]), glue)
    batches = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("batch")).agg(listed(token, ",").alias("tokens"), listed(plain, " , ").alias("ids"))
    return batches.select("batch", F.posexplode(R.batch_items("tokens", "ids")).alias("place", "i")).select("batch", "i.*", "place")
