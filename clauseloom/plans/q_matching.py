"""Queries of catalog matching, from loads to classified changes."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import standards as S
from ..functions import text as T
from ..operators import matching as M
from ..sources.views import sql, view
from .book import Book
from .q_functions import family, ident, key, latest_year, level, match_key, norm, regulation_key

book = Book()
V = ("catalog_view", "requirement_view", "adoption_view")

_lname, _lrank = level("standard_no")
CAT = f"""cat as (select sheet, row_no as cat_row, standard_no, title, {match_key('standard_no')} as mkey, {_lname} as level, {_lrank} as level_rank, {latest_year('standard_no')} as year,
  case when sheet = 'ASTM' then regexp_replace(standard_no, '-[0-9]{{2}}$', '') else trim(regexp_replace(standard_no, ':.*$', '')) end as display,
  case when regexp_extract(standard_no, '/A([0-9]+)', 1) = '' then title else title || ' - Amendment ' || regexp_extract(standard_no, '/A([0-9]+)', 1) end as cat_title
  from catalog_view where relevance = '是')"""
REQ = f"""req as (select *, {match_key('standards')} as mkey, {family('standards')} as fam from requirement_view)"""
CAND = """cand as (select r.table_id, r.row_no, r.fam, c.*, case when c.sheet = 'EN' then 1 else 0 end as sheet_order,
  case when r.fam in ('ISO_FAMILY','IEC_FAMILY') then c.level in ('BS EN ISO','BS EN','EN','EN ISO') else true end as by_year,
  c.level in ('BS EN ISO','BS EN','EN','EN ISO','BS ISO','ISO','BS') as known,
  case c.level when 'BS EN ISO' then 7 when 'BS EN' then 6 when 'EN' then 5 when 'EN ISO' then 4 when 'BS ISO' then 3 when 'ISO' then 2 when 'BS' then 1 else 0 end as prio,
  c.sheet || '|' || c.cat_row || '|' || c.standard_no as candidate_id
  from req r join cat c on r.mkey = c.mkey and ((r.fam = 'ISO_FAMILY' and c.sheet in ('ISO','EN')) or (r.fam = 'IEC_FAMILY' and c.sheet = 'IEC') or (r.fam = 'ASTM' and c.sheet = 'ASTM')))"""
ADOPT = f"""alines as (select {ident('l')} as line from (select unnest(string_split(reference, chr(10))) as l from adoption_view)),
al as (select line, {latest_year('line')} as y, {match_key('line')} as k from alines where regexp_matches(line, '^(EN|ISO|BS|DIN|IEC|ASTM)\\b')),
adopt as (select distinct * from (select line as akey, y from al union all select k, y from al) where akey <> '')"""
ADOPTED = f"""acand as (select c.*, case when regexp_matches({key('standard_no')}, '^(BS\\s+EN\\s+ISO|EN\\s+ISO|EN\\s+IEC)\\b') and
  exists (select 1 from adopt a where a.y = c.year and a.akey in ({ident('standard_no')}, c.mkey)) then 'YES' else 'NO' end as adopted from cand c)"""


def rank_sql(source, out, best=True, levels=None):
    pool = f"""{out}_b as (select *, first_value(sheet_order * 1000000000 + cat_row) over (partition by table_id, row_no, level order by sheet_order, cat_row) as seen,
      row_number() over (partition by table_id, row_no, level order by coalesce(year, 0) desc, sheet_order, cat_row) as rn from {source})""" if best else f"""{out}_b as (select *, sheet_order * 1000000000 + cat_row as seen, 1 as rn from {source})"""
    keep = "and (fam = 'ASTM' or case when checked then by_year and known when anyknown then known else true end)" if best else ""
    return f"""{pool}, {out}_e as (select table_id, row_no, bool_or(by_year and known) as checked, bool_or(known) as anyknown from {levels or source} group by 1, 2),
    {out} as (select b.*, row_number() over (partition by b.table_id, b.row_no order by case when fam = 'ASTM' or checked then coalesce(year, 0) else prio end desc,
      case when fam = 'ASTM' then 0 when checked then prio else coalesce(year, 0) end desc, seen) as final_rank
      from {out}_b b join {out}_e e on b.table_id = e.table_id and b.row_no = e.row_no where rn = 1 {keep})"""


PICK = f"""{rank_sql('acand', 'rk')}, ycand as (select * from acand where adopted = 'YES'), {rank_sql('ycand', 'yk', False, 'acand')},
pick as (select d.table_id, d.row_no, coalesce(y.candidate_id, d.candidate_id) as candidate_id, d.candidate_id as default_id,
  y.candidate_id is not null and y.candidate_id <> d.candidate_id as fallback, coalesce(y.display, d.display) as display, coalesce(y.cat_title, d.cat_title) as cat_title,
  case when y.candidate_id is not null then y.year else d.year end as year, coalesce(y.adopted, d.adopted) as adopted, coalesce(y.cat_row, d.cat_row) as cat_row
  from (select * from rk where final_rank = 1) d left join (select * from yk where final_rank = 1) y on d.table_id = y.table_id and d.row_no = y.row_no)"""
CLASS = f"""cl0 as (select r.*, p.display, p.cat_title, cast(p.year as varchar) as ny, p.adopted, p.fallback,
  {key('standards')} <> {key('p.display')} or (p.year is not null and {norm('issued_year')} <> cast(p.year as varchar)) or {key('harmonised')} <> {key('p.adopted')} or {key('r.title')} <> {key('p.cat_title')} as changed,
  upper(harmonised) in ('YES','Y') and p.adopted = 'NO' as back
  from requirement_view r left join pick p on r.table_id = p.table_id and r.row_no = p.row_no),
cls as (select table_id, row_no, case when display is null then 'NOT_FOUND' when changed and back then 'SAME_NO_UPDATE' when fallback then 'HARMONISED_YES_FALLBACK' when changed then 'UPDATED' else 'SAME_NO_UPDATE' end as status,
  coalesce(display is not null and changed and back, false) as rolled_back,
  case when display is null or (changed and back) then standards else display end as standards,
  case when display is null or (changed and back) then issued_year else coalesce(ny, issued_year) end as issued_year,
  case when display is null or (changed and back) then harmonised else adopted end as harmonised,
  case when display is null or (changed and back) then title else cat_title end as title from cl0)"""


def catalog(spark, d) -> DataFrame:
    return M.load_catalog(view(spark, d, "catalog_view"))


def requirements(spark, d) -> DataFrame:
    return view(spark, d, "requirement_view")


def cands(spark, d) -> DataFrame:
    """Candidates per search."""
    return M.key_candidates(requirements(spark, d), catalog(spark, d))


def adopted(spark, d) -> DataFrame:
    flagged = M.with_adoption(catalog(spark, d), M.adoption_keys(view(spark, d, "adoption_view")))
    return M.key_candidates(requirements(spark, d), flagged)


def for_rows(spark, d, per_key) -> DataFrame:
    return M.for_rows(requirements(spark, d), per_key)


def picked(spark, d) -> DataFrame:
    return for_rows(spark, d, M.picks(adopted(spark, d)))


def changes(spark, d) -> DataFrame:
    return M.classified(requirements(spark, d), picked(spark, d))


@book.add("src_catalog", f"with {CAT} select sheet, cat_row as row_no, standard_no, mkey, display, level, level_rank, year from cat", V[0])
def src_catalog(spark, d):
    return catalog(spark, d).select("sheet", "row_no", "standard_no", "mkey", "display", "level", "level_rank", "year")


@book.add("src_adoption_list", f"with {ADOPT} select akey as key, y as year from adopt", V[2])
def src_adoption_list(spark, d):
    return M.adoption_keys(view(spark, d, "adoption_view"))


@book.add("src_regulation_register", f"select row_no, {regulation_key('key_text')} as rkey, title, cast(substring(date_text, 1, 4) as int) as year from register_view where row_no >= 4", "register_view")
def src_regulation_register(spark, d):
    return view(spark, d, "register_view").filter("row_no >= 4").select("row_no", S.regulation_key("key_text").alias("rkey"), "title", T.years_max("date_text").alias("year"))


@book.add("join_candidates", f"with {CAT}, {REQ}, {CAND} select table_id, row_no, candidate_id, year, level, by_year from cand", *V[:2])
def join_candidates(spark, d):
    return M.pairs_for_rows(requirements(spark, d), cands(spark, d).select("skey", "candidate_id", "year", "level", "by_year"))


@book.add("join_adoption_flag", f"with {CAT}, {REQ}, {CAND}, {ADOPT}, {ADOPTED} select table_id, row_no, candidate_id, adopted from acand", *V)
def join_adoption_flag(spark, d):
    return M.pairs_for_rows(requirements(spark, d), adopted(spark, d).select("skey", "candidate_id", "adopted"))


@book.add("win_best_per_level", f"with {CAT}, {REQ}, {CAND}, {rank_sql('cand', 'rk')} select table_id, row_no, level, candidate_id from rk_b where rn = 1", *V[:2])
def win_best_per_level(spark, d):
    return for_rows(spark, d, M.best_per_level(cands(spark, d)).select("skey", "level", "candidate_id"))


@book.add("win_final_rank", f"with {CAT}, {REQ}, {CAND}, {rank_sql('cand', 'rk')} select table_id, row_no, candidate_id, final_rank from rk", *V[:2])
def win_final_rank(spark, d):
    return for_rows(spark, d, M.ranked(cands(spark, d)).select("skey", "candidate_id", "final_rank"))


@book.add("win_adopted_first", f"with {CAT}, {REQ}, {CAND}, {ADOPT}, {ADOPTED}, {PICK} select table_id, row_no, candidate_id, fallback from pick", *V)
def win_adopted_first(spark, d):
    return picked(spark, d).select("table_id", "row_no", "candidate_id", "fallback")


@book.add("win_display_rank", f"""with {CAT}, {REQ}, {CAND}, e as (select table_id, row_no, bool_or(by_year and known) as checked from cand group by 1, 2)
select c.table_id, c.row_no, candidate_id, row_number() over (partition by c.table_id, c.row_no order by by_year desc, case when fam = 'ASTM' or known then 1 else 0 end desc,
  case when fam = 'ASTM' or checked then coalesce(year, 0) else prio end desc, case when fam = 'ASTM' then 0 when checked then prio else coalesce(year, 0) end desc, sheet_order, cat_row) as shown
from cand c join e on c.table_id = e.table_id and c.row_no = e.row_no""", *V[:2])
def win_display_rank(spark, d):
    return M.pairs_for_rows(requirements(spark, d), M.shown(cands(spark, d)).select("skey", "candidate_id", "shown"))


_OVER = "select table_id, row_no, case when row_no % 3 = 0 then 'none' else max(candidate_id) end as candidate_id from cand where row_no % 5 = 0 group by table_id, row_no"


@book.add("join_override", f"""with {CAT}, {REQ}, {CAND}, {ADOPT}, {ADOPTED}, {PICK}, ov as ({_OVER}), good as (select o.* from ov o where exists (select 1 from cand c where c.table_id = o.table_id and c.row_no = o.row_no and c.candidate_id = o.candidate_id))
select p.table_id, p.row_no, coalesce(g.candidate_id, p.candidate_id) as candidate_id, p.candidate_id as automatic_id, g.candidate_id is not null as overridden from pick p left join good g on p.table_id = g.table_id and p.row_no = g.row_no""", *V)
def join_override(spark, d):
    c = adopted(spark, d)
    wanted = sql(spark, d, _OVER, cand=for_rows(spark, d, c.groupBy("skey").agg(F.max("candidate_id").alias("candidate_id"))))
    return M.overridden(requirements(spark, d), c, M.picks(c), wanted)


_EDITS = "select table_id, row_no, case row_no % 3 when 0 then 'title' when 1 then 'issued_year' else 'colour' end as field, 'edit ' || cast(row_no as string) as value from requirement_view where row_no % 4 = 0"


@book.add("join_manual_edits", f"""with e as ({_EDITS}) select r.table_id, r.row_no, coalesce(t.value, r.title) as title, coalesce(y.value, r.issued_year) as issued_year from requirement_view r
left join e t on t.field = 'title' and r.table_id = t.table_id and r.row_no = t.row_no left join e y on y.field = 'issued_year' and r.table_id = y.table_id and r.row_no = y.row_no""", V[1])
def join_manual_edits(spark, d):
    return M.edited(view(spark, d, "requirement_view"), sql(spark, d, _EDITS), ["title", "issued_year"])


_REGREQ = "select table_id, row_no, case when row_no % 7 = 0 then 'MEDDEV 2.7/' || cast(row_no % 9 as string) || ' Revision 4' else standards end as standards from requirement_view"


@book.add("join_regulation_first", f"""with {CAT}, {REQ}, {CAND}, {ADOPT}, {ADOPTED}, {PICK}, rq as ({_REGREQ}), reg as (select {regulation_key('key_text')} as rkey, row_no as reg_row, title, cast(substring(date_text, 1, 4) as int) as year from register_view),
newest as (select * from (select *, row_number() over (partition by rkey order by year desc, reg_row) as rn from reg) where rn = 1)
select rq.table_id, rq.row_no, case when n.rkey is not null then 'register' when p.candidate_id is not null then 'catalog' else 'none' end as found_in, coalesce(n.title, p.cat_title) as title, coalesce(n.year, p.year) as year
from rq left join newest n on starts_with(rq.standards, 'MEDDEV') and n.rkey = {regulation_key('rq.standards')} left join pick p on rq.table_id = p.table_id and rq.row_no = p.row_no""", *V, "register_view")
def join_regulation_first(spark, d):
    return M.regulation_first(sql(spark, d, _REGREQ), view(spark, d, "register_view"), picked(spark, d))


@book.add("win_regulation_latest", f"""with r as (select *, {regulation_key('key_text')} as rkey, cast(substring(date_text, 1, 4) as int) as year from register_view) select rkey, row_no, year from (select *, row_number() over (partition by rkey order by year desc, row_no) as rn from r) where rn = 1""", "register_view")
def win_regulation_latest(spark, d):
    rows = view(spark, d, "register_view").select(S.regulation_key("key_text").alias("rkey"), "row_no", T.years_max("date_text").alias("year"))
    w = Window.partitionBy("rkey").orderBy(F.col("year").desc_nulls_last(), "row_no")
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


_ALL = f"with {CAT}, {REQ}, {CAND}, {ADOPT}, {ADOPTED}, {PICK}, {CLASS} "


@book.add("chg_row_status", _ALL + "select table_id, row_no, status, standards, issued_year, harmonised, title from cls", *V)
def chg_row_status(spark, d):
    return changes(spark, d).drop("rolled_back")


@book.add("chg_yes_no_rollback", _ALL + "select table_id, row_no, rolled_back from cls", *V)
def chg_yes_no_rollback(spark, d):
    return changes(spark, d).select("table_id", "row_no", "rolled_back")


@book.add("agg_status_stats", _ALL + "select count_if(status in ('UPDATED','HARMONISED_YES_FALLBACK')) as updated, count_if(status = 'HARMONISED_YES_FALLBACK') as fallback, count_if(status = 'SAME_NO_UPDATE') as same, count_if(status = 'NOT_FOUND') as missing, count(*) as total from cls", *V)
def agg_status_stats(spark, d):
    return M.status_counts(changes(spark, d))
