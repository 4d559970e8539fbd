"""Queries over records: joins, roll-ups, change detection, upserts, retention, states."""

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import records as R
from ..operators import retention as X
from ..operators.paths import resolved_names
from ..sources.views import sql, table, view
from .book import Book

book = Book()


@book.add("join_user_roles", "select c_custkey, c_name, coalesce(string_agg(n_name, ',' order by n_name), '') as roles from customer left join nation on n_nationkey = c_nationkey or n_nationkey = (c_nationkey + 7) % 25 group by 1, 2")
def join_user_roles(spark, d):
    """Every user with the ordered list of the user's roles."""
    users = table(spark, d, "customer").withColumn("role_id", F.explode(F.array_distinct(F.array(F.col("c_nationkey"), (F.col("c_nationkey") + 7) % 25))))
    roles = users.join(table(spark, d, "nation"), F.col("role_id") == F.col("n_nationkey"), "left")
    return roles.groupBy("c_custkey", "c_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("roles"))


@book.add("join_permission", "select distinct c_custkey, r_name as permission from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey or r_regionkey = (n_regionkey + 2) % 5 where c_custkey % 2 = 0")
def join_permission(spark, d):
    """Users with the permissions their role's groups grant (role to permission is a key list, so all joins are equi joins)."""
    users = table(spark, d, "customer").filter("c_custkey % 2 = 0").select("c_custkey", "c_nationkey")
    roles = table(spark, d, "nation").select("n_nationkey", F.explode(F.array("n_regionkey", (F.col("n_regionkey") + 2) % 5)).alias("r_regionkey"))
    grants = roles.join(table(spark, d, "region"), "r_regionkey").select("n_nationkey", F.col("r_name").alias("permission"))
    return users.join(grants, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "permission").distinct()


CUTOFF = "1996-01-01"
_EXPIRED = f"o_orderstatus in ('F', 'O') and o_orderdate < timestamp '{CUTOFF}'"


@book.add("join_expired_children", f"select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey in (select o_orderkey from orders where {_EXPIRED})")
def join_expired_children(spark, d):
    return table(spark, d, "lineitem").join(expired(spark, d), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


def expired(spark, d) -> DataFrame:
    """Terminal records older than the cutoff, which is passed in and never the current time."""
    return table(spark, d, "orders").filter(F.col("o_orderstatus").isin("F", "O") & (F.col("o_orderdate") < F.lit(CUTOFF).cast("timestamp_ntz"))).select("o_orderkey")


_JOBS = "select cast(o_orderkey as bigint) as id, case when o_orderkey % 3 = 1 then null else cast(floor(o_orderkey / 3) as bigint) end as parent, o_orderstatus as status, case when o_custkey % 4 = 0 then null else o_orderdate end as completed_at, o_orderdate as created_at from orders"


@book.add("chg_retention", f"""with recursive j as ({_JOBS}), gone as (select id from j where status in ('F', 'O') and coalesce(completed_at, created_at) < timestamp '1993-06-30'
union select j.id from j join gone on j.parent = gone.id)
select 'job' as tab, id, null::bigint as line from j where id not in (select id from gone) union all
select 'item', l_orderkey, cast(l_linenumber as bigint) from lineitem where l_orderkey not in (select id from gone) union all
select 'matched ' || t, n, null from (select 'jobs' as t, count(*) as n from gone union all select 'items', count(*) from lineitem where l_orderkey in (select id from gone)) union all
select 'deleted dry ' || t, 0, null from (select unnest(['jobs', 'items']) as t)""")
def chg_retention(spark, d):
    """Ended jobs of more than 550 days go, with the jobs under them and the items of all."""
    jobs = sql(spark, d, _JOBS)
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("id"), F.col("l_linenumber").cast("long").alias("line"))
    old = X.expired(jobs, 550, datetime(1995, 1, 1), "completed_at", "created_at", ended=F.col("status").isin("F", "O"))
    ids = X.with_children(old, jobs.select("id", "parent"))
    tables = {"jobs": (jobs, "id"), "items": (items, "id")}
    kept, counts = X.cleaned(tables, ids)
    _, dry = X.cleaned(tables, ids, dry_run=True)
    none = F.lit(None).cast("long").alias("line")
    out = kept["jobs"].select(F.lit("job").alias("tab"), "id", none).unionByName(kept["items"].select(F.lit("item").alias("tab"), "id", "line"))
    out = out.unionByName(counts.select(F.concat(F.lit("matched "), "tab").alias("tab"), F.col("deleted").alias("id"), none))
    return out.unionByName(dry.select(F.concat(F.lit("deleted dry "), "tab").alias("tab"), F.col("deleted").alias("id"), none))


@book.add("agg_cleanup_counts", f"select 'jobs' as tab, count(*) as n from orders where {_EXPIRED} union all select 'items', count(*) from lineitem where l_orderkey in (select o_orderkey from orders where {_EXPIRED})")
def agg_cleanup_counts(spark, d):
    jobs = expired(spark, d).agg(F.count("*").alias("n")).select(F.lit("jobs").alias("tab"), "n")
    items = join_expired_children(spark, d).agg(F.count("*").alias("n")).select(F.lit("items").alias("tab"), "n")
    return jobs.unionByName(items)


@book.add("join_active_job", "select user_id, kind, event_id from (select *, row_number() over (partition by user_id, kind order by ts desc, event_id desc) as rn from (select *, event_id % 2 as kind from events where event_type in ('view', 'click', 'signup') and value > 20) x) e where rn = 1")
def join_active_job(spark, d):
    states = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "claimed").when(F.col("event_type") == "signup", "running").otherwise("completed")
    jobs = table(spark, d, "events").select("user_id", (F.col("event_id") % 2).alias("kind"), "event_id", "ts", "value", states.alias("status"))
    return R.active_job(jobs, ["user_id", "kind"], [F.desc("ts"), F.desc("event_id")], accept=F.col("value") > 20).select("user_id", "kind", "event_id")


@book.add("join_actor_fallback", "select o_orderkey, case when o_orderkey % 3 = 1 then o_orderpriority when o_orderkey % 3 = 0 and o_clerk_id is not null then o_clerk_id else c_name end as actor from (select *, case when o_orderkey % 2 = 0 then 'w' || o_custkey end as o_clerk_id from orders) o left join customer on c_custkey = o_custkey")
def join_actor_fallback(spark, d):
    """The batch's label, else its work id, else the job's actor."""
    label = F.when(F.col("o_orderkey") % 3 == 0, " ").when(F.col("o_orderkey") % 3 == 1, F.col("o_orderpriority"))
    work = F.when(F.col("o_orderkey") % 3 == 0, F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("w"), F.col("o_custkey").cast("string"))))
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select("o_orderkey", R.said(label, work, F.col("c_name")).alias("actor"))




@book.add("join_recipient", """select c_custkey, count_if(o_orderstatus = 'F') as ok, count_if(o_orderstatus <> 'F') as failed, string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey) as lines
from orders join customer on c_custkey = o_custkey where c_custkey % 4 <> 0 group by 1""")
def join_recipient(spark, d):
    """Batches by the actor's e-mail; actors without one drop out."""
    mail = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.concat("c_name", F.lit("@example.com"))).alias("mail")).filter("mail is not null")
    rows = table(spark, d, "orders").join(mail, F.col("o_custkey") == F.col("c_custkey"))
    ok = F.col("o_orderstatus") == "F"
    return rows.groupBy("c_custkey").agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.array_join(F.sort_array(F.collect_list("o_orderkey")), ",").alias("lines"))


_A = "select o_orderkey as id, case when o_orderkey % 4 = 0 then '' else o_orderpriority end as name, o_orderstatus as lock from orders where o_orderkey % 3 <> 0"
_B = "select o_orderkey as id, concat('file ', cast(o_orderkey as string)) as name, 'x' as lock from orders where o_orderkey % 3 <> 1"


@book.add("join_record_merge", f"select coalesce(a.id, b.id) as id, coalesce(nullif(a.name, ''), b.name) as name, a.lock as lock from ({_A}) a full outer join ({_B.replace('as string', 'as varchar')}) b on a.id = b.id")
def join_record_merge(spark, d):
    """The table's values where they are not empty, the file's in the gaps; the lock is always the table's."""
    a, b = sql(spark, d, _A), sql(spark, d, _B).select("id", F.col("name").alias("other"))
    return a.join(b, "id", "full_outer").select("id", F.coalesce(F.nullif("name", F.lit("")), "other").alias("name"), "lock")


_FOLDERS = """select c_custkey as id, case c_custkey % 3 when 0 then ' ' when 1 then null else c_name end as name, case when c_custkey % 4 > 0 then timestamp '2023-05-01 10:20:30' end as created, case when c_custkey % 5 > 0 then c_mktsegment end as creator,
  case when c_custkey % 7 = 0 then 'editor' when c_custkey % 7 = 1 then '' end as editor, case when c_custkey % 11 = 0 then timestamp '2023-06-02 03:04:05' end as edited, o.changed from customer left join (select o_custkey, max(o_orderdate) as changed from orders group by 1) o on o.o_custkey = c_custkey"""


@book.add("join_missing_records", f"""with f as ({_FOLDERS}), g as (select *, coalesce(created, date_trunc('minute', changed)::timestamp) as made from f where id not in (select o_custkey from orders where o_orderkey % 9 = 0))
select id, coalesce(case when trim(name) <> '' then name end, cast(id as varchar)) as name, made as created, creator, coalesce(nullif(editor, ''), creator, '') as editor, coalesce(edited, made) as edited from g""")
def join_missing_records(spark, d):
    records = table(spark, d, "orders").filter("o_orderkey % 9 = 0").select(F.col("o_custkey").alias("id"))
    stamp = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return R.missing_records(sql(spark, d, _FOLDERS).select("id", "name", stamp("created"), "creator", "editor", stamp("edited"), stamp("changed")), records)


_FILES = "select p_size % 5 as base, p_type || '/' || p_brand || '/' || substring(p_name, 1, 6) || case when p_partkey % 7 = 0 then '.pdf' else '.docx' end as path from part"
_WANTED = """select distinct p_size % 5 as base, case p_partkey % 6 when 0 then upper(p_type) || chr(92) || p_brand || '/' || substring(p_name, 1, 6) || '.DOCX' when 1 then upper(substring(p_name, 1, 6)) || '.docx' when 2 then p_type || '/' || lower(p_brand)
  when 3 then ' ' when 4 then p_type || '/' || p_name || '.docx' else substring(p_name, 1, 6) || '.odt' end as name from part"""


@book.add("join_name_resolve", f"""with f as (select distinct base, path, lower(path) as low from ({_FILES})), w as (select base, name, lower(trim(replace(name, chr(92), '/'))) as k from ({_WANTED})),
j as (select *, case when k = '' then 'unnamed' when not contains(list_extract(string_split(k, '/'), -1), '.') then 'folder' when contains(k, '/') then 'path' else 'name' end as kind from w),
h as (select j.base, j.name, kind, f.path from j left join f on f.base = j.base and case kind when 'path' then f.low = k when 'name' then list_extract(string_split(f.low, '/'), -1) = k when 'folder' then regexp_replace(f.low, '/[^/]*$', '') = k and regexp_matches(f.low, '[.]docx?$') else false end)
select base, name, count(path) as n, case when kind = 'unnamed' then 'unnamed' when count(path) = 0 then 'not found' when kind = 'name' and count(path) > 1 then 'ambiguous' else 'found' end as state, case when kind <> 'name' or count(path) = 1 then min(path) end as path from h group by base, name, kind""")
def join_name_resolve(spark, d):
    return resolved_names(sql(spark, d, _FILES), sql(spark, d, _WANTED))


@book.add("join_scheme_revision", """with c as (select o_custkey as task, count(*) as revision from orders group by 1)
select o_orderkey, case when o_orderkey % 5 = 0 or o_orderkey % 7 = 0 then 'error' when o_orderkey % 20 < coalesce(revision, 0) then 'needs_review' else 'ready' end as status from orders left join c on task = o_custkey""")
def join_scheme_revision(spark, d):
    orders = table(spark, d, "orders")
    current = orders.groupBy("o_custkey").agg(F.count("*").alias("revision"))
    ok = (F.col("o_orderkey") % 5 != 0) & (F.col("o_orderkey") % 7 != 0)
    state = F.when(~ok, "error").when(F.col("o_orderkey") % 20 < F.coalesce("revision", F.lit(0)), "needs_review").otherwise("ready")
    return orders.join(current, "o_custkey", "left").select("o_orderkey", state.alias("status"))


@book.add("agg_batch_counts", "select o_custkey, count_if(l_returnflag = 'R') as ok, count_if(l_returnflag <> 'R') as failed, count(*) as items, max(o_orderdate) as newest from orders join lineitem on l_orderkey = o_orderkey group by o_custkey order by newest desc, o_custkey limit 40")
def agg_batch_counts(spark, d):
    items = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return R.batch_summary(items, "o_custkey", F.col("l_returnflag") == "R", "o_orderdate", 40)


@book.add("agg_tab_counts", "select case when event_type in ('view', 'click') then 'flow' when event_type = 'purchase' then 'mapping' else 'running' end as kind, count(*) as n from events group by 1")
def agg_tab_counts(spark, d):
    kind = F.when(F.col("event_type").isin("view", "click"), "flow").when(F.col("event_type") == "purchase", "mapping").otherwise("running")
    return R.kind_totals(table(spark, d, "events"), kind)




@book.add("agg_duplicate_names", "select lower(trim(p_name)) as name, count(*) as n from part group by 1 having count(*) > 1")
def agg_duplicate_names(spark, d):
    return table(spark, d, "part").groupBy(F.lower(T.norm_text("p_name")).alias("name")).agg(F.count("*").alias("n")).filter("n > 1")


@book.add("agg_latest_mtime", "select f.o_custkey, latest, coalesce(latest > saved, true) as needs_review from (select o_custkey, max(o_orderdate) as latest from orders group by 1) f left join (select o_custkey, arg_max(o_orderdate, o_orderkey) as saved from orders where o_custkey % 5 <> 0 group by 1) s on f.o_custkey = s.o_custkey")
def agg_latest_mtime(spark, d):
    """The saved time is that of the task's last registered file; a task that saved none needs a review."""
    orders = table(spark, d, "orders")
    saved = orders.filter("o_custkey % 5 <> 0").groupBy("o_custkey").agg(F.max_by("o_orderdate", "o_orderkey").alias("saved"))
    return R.latest_change(orders, saved, "o_custkey", "o_orderdate")


@book.add("agg_version_counts", "select o_custkey, sum(case o_orderstatus when 'O' then 1 else 0 end)::bigint as manual from orders group by 1")
def agg_version_counts(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("manual"))


@book.add("agg_role_count", "select count(*) as holders from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 3)")
def agg_role_count(spark, d):
    roles = table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return R.holders(table(spark, d, "customer"), roles, "c_nationkey", F.col("n_regionkey") == 3)


@book.add("win_active_release", "select o_custkey, coalesce(arg_max(o_orderkey, (o_orderdate, o_orderkey)) filter (where o_orderstatus = 'O'), arg_max(o_orderkey, (o_orderdate, o_orderkey))) as o_orderkey from orders group by 1")
def win_active_release(spark, d):
    return R.active_release(table(spark, d, "orders"), "o_custkey", F.col("o_orderstatus") == "O", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@book.add("win_version_change", """with v as (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as n from orders)
select a.o_orderkey, b.o_orderkey is null or a.o_orderpriority <> b.o_orderpriority or a.o_orderkey % 10 = 0 as is_new from v a left join v b on a.o_custkey = b.o_custkey and b.n = a.n - 1""")
def win_version_change(spark, d):
    rows = R.version_changes(table(spark, d, "orders"), "o_custkey", "o_orderpriority", [F.asc("o_orderdate"), F.asc("o_orderkey")], F.col("o_orderkey") % 10 == 0)
    return rows.select("o_orderkey", "is_new")


@book.add("win_version_prune", """with v as (select *, case o_orderstatus when 'O' then 'manual' when 'F' then 'before_restore' else 'other' end as origin from orders)
select o_custkey, o_orderkey, origin from v where origin = 'other' or (select count(*) from v w where w.o_custkey = v.o_custkey and w.origin = v.origin and (w.o_orderdate > v.o_orderdate or (w.o_orderdate = v.o_orderdate and w.o_orderkey > v.o_orderkey))) < case origin when 'manual' then 3 else 1 end""")
def win_version_prune(spark, d):
    origin = F.when(F.col("o_orderstatus") == "O", "manual").when(F.col("o_orderstatus") == "F", "before_restore").otherwise("other")
    rows = table(spark, d, "orders").withColumn("origin", origin)
    return R.pruned(rows, "o_custkey", "origin", [F.desc("o_orderdate"), F.desc("o_orderkey")], {"manual": 3, "before_restore": 1}).select("o_custkey", "o_orderkey", "origin")




@book.add("win_version_current", "with live as (select o_custkey, arg_max(o_orderpriority, lpad(cast(epoch_us(o_orderdate) as varchar), 20, '0') || lpad(cast(o_orderkey as varchar), 12, '0')) as h from orders group by 1) select o_orderkey, o_orderpriority = h as is_current from orders join live using (o_custkey) where o_orderstatus = 'O'")
def win_version_current(spark, d):
    orders = table(spark, d, "orders")
    live = orders.groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("h"))
    return orders.filter("o_orderstatus = 'O'").join(live, "o_custkey").select("o_orderkey", (F.col("o_orderpriority") == F.col("h")).alias("is_current"))


def win_dedup_names(spark, d):
    """``name``, ``name (1)``, ``name (2)``; a made name that is taken by a real one takes a further number in a second pass."""
    k = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    rows = table(spark, d, "part").select("p_partkey", "p_brand", k.alias("k"))
    made = rows.withColumn("final", F.when(F.col("k") == 0, F.col("p_brand")).otherwise(F.format_string("%s (%d)", "p_brand", "k")))
    taken = rows.select(F.col("p_brand").alias("final")).distinct().withColumn("taken", F.lit(True))
    both = made.join(taken, "final", "left")
    clash = F.coalesce("taken", F.lit(False)) & (F.col("k") > 0)
    total = F.count("*").over(Window.partitionBy("p_brand"))
    again = F.format_string("%s (%d)", "p_brand", total + F.col("k"))
    return both.select("p_partkey", F.when(clash, again).otherwise(F.col("final")).alias("final"))


@book.add("win_reusable_check", "select o_custkey, o_orderpriority, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey from orders where o_orderkey % 3 <> 0 and o_orderkey % 4 <> 0 group by 1, 2")
def win_reusable_check(spark, d):
    """The newest workspace of an owner for a file with both checks passed."""
    both = table(spark, d, "orders").filter((F.col("o_orderkey") % 3 != 0) & (F.col("o_orderkey") % 4 != 0))
    return R.first_per(both, ["o_custkey", "o_orderpriority"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderpriority", "o_orderkey")



_OLD = "select page_id % 50 as source_key, max(url) as filename, min(url) as uuid, case when min(page_id) % 4 = 0 then null else max(url) end as url from pages where page_id % 3 = 0 group by 1"
_NEW = "select page_id % 60 as source_key, max(url) as filename, min(url) as uuid, case when min(page_id) % 8 = 0 then null else max(url) end as url from pages where page_id % 2 = 0 group by 1"


@book.add("chg_source_decision", f"""select n.source_key, o.source_key is null or n.filename is distinct from o.filename or n.uuid is distinct from o.uuid or n.url is distinct from o.url as download,
case when o.source_key is null then 'no state' else concat_ws(',', case when n.filename is distinct from o.filename then 'filename' end, case when n.uuid is distinct from o.uuid then 'uuid' end, case when n.url is distinct from o.url then 'url' end) end as reasons from ({_NEW}) n left join ({_OLD}) o on n.source_key = o.source_key""")
def chg_source_decision(spark, d):
    return source_decision(sql(spark, d, _NEW), sql(spark, d, _OLD))


def source_decision(new: DataFrame, old: DataFrame, force: bool = False) -> DataFrame:
    """Whether a source needs a download, and why: filename, uuid and url are compared null-safely with the last state."""
    fields = ("filename", "uuid", "url")
    last = old.select("source_key", F.struct(*fields).alias("o"))
    both = new.join(last, "source_key", "left")
    why = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"o.{c}")), F.lit(c)) for c in fields]))
    reasons = F.when(F.lit(force), F.lit("forced")).when(F.col("o").isNull(), "no state").otherwise(F.array_join(why, ","))
    return both.select("source_key", (F.lit(force) | F.col("o").isNull() | (F.size(why) > 0)).alias("download"), reasons.alias("reasons"))


_RELEASES = """select o_custkey as owner, cast(o_orderkey as bigint) as id, '/nas/r' || cast(o_orderkey % 6 as string) || '.xlsx' as path, 'old' as file_name, case when o_orderkey % 4 = 0 then null else 'http://a' end as source_url, 'v1' as version_label,
'c1' as checksum, o_orderkey % 2 = 0 as is_active, 'failed' as status, 'lost' as error, o_orderdate as downloaded_at from orders"""
_REGISTERED = """select c_custkey as owner, case c_custkey % 3 when 0 then '/nas/r2.xlsx' when 1 then '/nas/new/n.XLS' else '/nas/r1.pdf' end as path, case when c_custkey % 2 = 0 then '' else 'http://b' end as source_url,
case when c_custkey % 5 = 0 then 'v9' else '' end as version_label, case when c_custkey % 7 = 0 then null else 'c2' end as checksum, timestamp '2024-05-06 07:08:09' as downloaded_at from customer where c_custkey % 4 <> 3"""


@book.add("chg_activate_release", f"""with r as ({_RELEASES}), n as (select owner, path, nullif(source_url, '') as source_url, coalesce(nullif(version_label, ''), strftime(downloaded_at, '%Y%m%d-%H%M')) as version_label, nullif(checksum, '') as checksum, downloaded_at from ({_REGISTERED}) where not path like '%.pdf'),
f as (select r.owner, min(r.id) as id from r join n on r.owner = n.owner and r.path = n.path group by 1),
m as (select r.*, n.owner is not null as touched, f.id is not null and f.id = r.id as hit, n.source_url as nu, n.version_label as nl, n.checksum as nc, n.downloaded_at as na from r left join n on r.owner = n.owner left join f on f.owner = r.owner)
select owner, id, path, case when hit then parse_filename(path) else file_name end as file_name, case when hit then coalesce(nu, source_url) else source_url end as source_url, case when hit then nl else version_label end as version_label,
  case when hit then coalesce(nc, checksum) else checksum end as checksum, case when touched then hit else is_active end as is_active, case when hit then 'available' else status end as status, case when hit then null else error end as error,
  case when hit then na else downloaded_at end as downloaded_at from m
union all select n.owner, coalesce((select max(id) from r where r.owner = n.owner), 0) + 1, n.path, parse_filename(n.path), n.source_url, n.version_label, n.checksum, true, 'available', null, n.downloaded_at from n where not exists (select 1 from f where f.owner = n.owner)""")
def chg_activate_release(spark, d):
    return X.activated(sql(spark, d, _RELEASES), sql(spark, d, _REGISTERED).withColumn("downloaded_at", F.col("downloaded_at").cast("timestamp_ntz")))


_UP = "select c_custkey + 750 as c_custkey, case when c_custkey % 2 = 0 then 'new ' || c_name end as c_name, case when c_custkey % 3 = 0 then 'SEG' end as c_mktsegment from customer"


@book.add("chg_upsert_partial", f"select coalesce(u.c_custkey, c.c_custkey) as c_custkey, coalesce(u.c_name, c.c_name) as c_name, coalesce(u.c_mktsegment, c.c_mktsegment) as c_mktsegment from customer c full outer join ({_UP}) u on u.c_custkey = c.c_custkey")
def chg_upsert_partial(spark, d):
    return upsert(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), sql(spark, d, _UP), "c_custkey")


def upsert(rows: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """Inserts, or updates the fields that are given."""
    fields = [c for c in rows.columns if c != key]
    new = given.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    return rows.join(new, key, "full_outer").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in fields])


@book.add("chg_revision_bump", "select c_custkey, c_custkey % 5 + coalesce(n, 0) as revision from customer left join (select user_id, count(*) as n from events group by 1) e on user_id = c_custkey")
def chg_revision_bump(spark, d):
    bumps = table(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "customer").join(bumps, "c_custkey", "left").select("c_custkey", (F.col("c_custkey") % 5 + F.coalesce("n", F.lit(0))).alias("revision"))


def chg_registry(spark, d):
    """Last write per path wins; renames and removals act on a path and everything under it."""
    paths = table(spark, d, "pages").select(F.concat(F.lit("out/"), (F.col("page_id") % 9).cast("string"), F.lit("/f"), (F.col("page_id") % 40).cast("string")).alias("path"), "page_id")
    last = paths.groupBy("path").agg(F.max("page_id").alias("page_id"))
    kept = last.filter(~((F.col("path") == "out/4") | F.col("path").startswith("out/4/")))
    return kept.select(F.regexp_replace("path", r"^out/3(?=/|$)", "moved/3").alias("path"), "page_id")


@book.add("chg_ready_status", """select o_orderkey, case when o_totalprice > 1000 and o_orderkey % 5 <> 0 and (o_custkey % 2 = 1 or o_orderkey % 3 = 0) then 'ready' when o_orderstatus = 'P' then 'failed' else 'draft' end as status from orders""")
def chg_ready_status(spark, d):
    """Inputs: a file, a template; a list only where the mode is system."""
    rows = table(spark, d, "orders")
    given = [F.col("o_totalprice") > 1000, F.col("o_orderkey") % 5 != 0]
    status = R.ready_status(rows, given, F.col("o_orderkey") % 3 == 0, F.col("o_custkey") % 2 == 0, F.col("o_orderstatus") == "P")
    return rows.select("o_orderkey", status.alias("status"))


def _ok(s: str, x: str) -> str:
    steps = {"queued": "'claimed', 'canceled'", "claimed": "'running', 'canceled', 'queued'", "running": "'completed', 'failed', 'canceled', 'timeout', 'queued'"}
    return f"({s} is null or {s} = {x} or " + " or ".join(f"({s} = '{k}' and {x} in ({to}))" for k, to in steps.items()) + ")"


_STATES = "case event_type when 'signup' then 'queued' when 'view' then 'claimed' when 'click' then 'running' when 'purchase' then case event_id % 3 when 0 then 'completed' when 1 then 'failed' else 'timeout' end else case event_id % 2 when 0 then 'canceled' else 'queued' end end"


@book.add("chg_status_transitions", f"""with recursive e as (select event_id, user_id as job, {_STATES} as x, row_number() over (partition by user_id order by ts, event_id) as n from events),
f as (select job, n, event_id, null::varchar as before, true as allowed, x as after from e where n = 1
  union all select e.job, e.n, e.event_id, f.after, {_ok('f.after', 'e.x')}, case when {_ok('f.after', 'e.x')} then e.x else f.after end from f join e on e.job = f.job and e.n = f.n + 1)
select event_id, before, allowed, after, after in ('queued', 'claimed', 'running', 'canceled') as can_cancel, after in ('failed', 'canceled', 'timeout') as can_retry from f""")
def chg_status_transitions(spark, d):
    events = table(spark, d, "events").select("event_id", F.col("user_id").alias("job"), "ts", F.expr(_STATES).alias("status"))
    return R.folded_log(events, "job", ["ts", "event_id"], "status", ["event_id"]).drop("job")


@book.add("chg_stale_jobs", "select job_id, 'queued' as status from (select job_id, ts, status, row_number() over (partition by job_id order by ts desc) as rn from job_event_view) where rn = 1 and status in ('claimed', 'running') and ts < timestamp '2024-01-30 12:00:00'", "job_event_view")
def chg_stale_jobs(spark, d):
    beats = view(spark, d, "job_event_view").groupBy("job_id").agg(F.max("ts").alias("beat"), F.max_by("status", "ts").alias("status"))
    return R.requeued(beats, "status", "beat", F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")).select("job_id", "status")
