"""Queries of the streaming jobs and of user functions."""

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import leases
from ..operators import matching as M
from ..operators import sequences as Q
from ..operators import user_functions as U
from ..sources.shared import shared_path
from ..sources.views import sql, table, view
from ..streaming import jobs as J
from .book import Book
from .q_matching import ADOPT, ADOPTED, CAND, CAT, PICK, REQ, V, catalog
from .q_records import _NEW, _OLD, source_decision
from .q_search import chunks

book = Book()
_STATUS = "case event_type when 'signup' then 'queued' when 'view' then 'claimed' when 'click' then 'running' when 'purchase' then 'completed' else 'failed' end"


def event_stream(spark, d):
    return J.read_stream(spark, f"{d}/events.parque[t]").select("event_id", "ts", F.col("user_id").alias("job_id"), F.expr(_STATUS).alias("status"), "event_type")


@book.add("str_status_fold")
def str_status_fold(spark, d):
    """The latest state of every job; equal to the fold over the whole log."""
    rows = J.drained(J.status_fold(event_stream(spark, d).drop("event_type")), "status-fold", "update")
    return rows.groupBy("job_id").agg(F.max_by("status", "batch").alias("status"))


_LOG = f"select event_id, user_id as job_id, ts, {_STATUS} as status from events"


@book.add("str_dedup_enqueue", f"""with e as ({_LOG}), n as (select *, count(*) filter (status in ('completed', 'failed')) over (partition by job_id order by ts, event_id) as ended from e)
select job_id, arg_min(event_id, (ts, event_id)) as event_id from n where status = 'queued' group by job_id, ended""")
def str_dedup_enqueue(spark, d):
    return J.drained(J.dedup_enqueue(event_stream(spark, d).drop("event_type")), "dedup-enqueue").drop("batch")


@book.add("str_stale_timeout", f"""with e as (select job_id, epoch_us(ts) // 1000 as ms from ({_LOG})), n as (select job_id, ms, lead(ms) over (partition by job_id order by ms) as later from e)
select distinct job_id, ms as last_ms from n where later - ms > 259200000 or (later is null and ms + 259200000 < (select max(ms) - 3600000 from e))""")
def str_stale_timeout(spark, d):
    return J.drained(J.stale_timeout(event_stream(spark, d), 3 * 86400), "stale").drop("batch").distinct()


@book.add("str_error_stream", "select event_id from events where case upper(case event_id % 4 when 0 then 'debug' when 1 then 'warn' when 2 then 'x' else 'info' end) when 'DEBUG' then 10 when 'INFO' then 20 when 'WARN' then 30 else 40 end >= 40")
def str_error_stream(spark, d):
    rows = J.read_stream(spark, f"{d}/events.parque[t]").withColumn("level", F.expr("case event_id % 4 when 0 then 'debug' when 1 then 'warn' when 2 then 'x' else 'info' end"))
    return J.drained(J.error_stream(rows, "ERROR", T.severity).select("event_id"), "errors").drop("batch")


@book.add("str_source_changes", f"""with c as (select n.source_key, o.source_key is null or n.filename is distinct from o.filename or n.uuid is distinct from o.uuid or n.url is distinct from o.url as download from ({_NEW}) n left join ({_OLD}) o on n.source_key = o.source_key) select source_key from c where download""")
def str_source_changes(spark, d):
    """Snapshots arriving in drops: each batch is compared with the last state, and only changes come out."""
    drop = shared_path(spark, "snapshots")
    sql(spark, d, _NEW).write.parquet(drop)
    old = sql(spark, d, _OLD)
    return J.drained(J.read_stream(spark, drop), "source-changes", batch=lambda rows, n: source_decision(rows, old).filter("download").select("source_key")).drop("batch")


@book.add("str_file_arrivals")
def str_file_arrivals(spark, d):
    """Files of a release folder that arrive on the stream (lock files skipped), by name and size; content is not read."""
    drop = shared_path(spark, "arrivals")
    table(spark, d, "pages").select("page_id", "url").write.option("maxRecordsPerFile", 40).parquet(drop)
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.parquet").schema("path string, modificationTime timestamp, length long, content binary").load(drop)
    rows = J.drained(files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "modificationTime", "length"), "arrivals-out")
    rows = rows.filter(~F.col("name").startswith("~$"))
    newest = rows.agg(F.max(F.struct("modificationTime", "name")).alias("last")).select("last.name", F.lit(True).alias("newest"))
    return rows.join(F.broadcast(newest), "name", "left").select("name", "length", F.coalesce("newest", F.lit(False)).alias("newest"))


@book.add("str_match_rows", f"with {CAT}, {REQ}, {CAND}, {ADOPT}, {ADOPTED}, {PICK} select table_id, row_no, default_id as candidate_id from pick", *V)
def str_match_rows(spark, d):
    """Requirement rows matched to the catalog as they arrive."""
    drop = shared_path(spark, "requirements")
    view(spark, d, "requirement_view").write.parquet(drop)
    known = catalog(spark, d)
    pick = lambda rows, n: M.for_rows(rows, M.picks(M.key_candidates(rows, known)).select("skey", "candidate_id"))
    return J.drained(J.read_stream(spark, drop), "match-rows", batch=pick).drop("batch")


@book.add("udf_payload_match", """select event_id from (select event_id, list_transform(json_keys(props), lambda k: json_extract(props, '$.' || k)) as v from events)
where coalesce(list_sum(list_transform(list_filter(v, lambda x: json_type(x) in ('BIGINT', 'UBIGINT')), lambda x: cast(x as bigint))), 0) % 2 = 0""")
def udf_payload_match(spark, d):
    """Events whose payload a user's predicate accepts; an exception is no match."""
    return U.payload_filter(table(spark, d, "events"), "props", U.even_total).select("event_id")


@book.add("udf_boundary_pick", "select doc_id, arg_min(pos, (-length(line), pos)) as pos from toc_view where level is not null group by 1", "toc_view")
def udf_boundary_pick(spark, d):
    """A user's choice among each document's boundary candidates; answers outside the list are ignored."""
    rows = view(spark, d, "toc_view").filter("level is not null").select("doc_id", "pos", "line")
    return U.choose(rows, U.longest_line)


@book.add("udf_chunk_map", "with t as (select doc_id, regexp_replace(regexp_replace(text, '^[\\s\\p{Z}]+', ''), '[\\s\\p{Z}]+$', '') as t from documents) select doc_id, md5(replace(t, chr(101), chr(69))) as h from t where t <> ''")
def udf_chunk_map(spark, d):
    """A user's function on every chunk, rejoined in order."""
    pieces = U.map_chunks(chunks(table(spark, d, "documents"), 4000, 0), U.mark_vowel)
    joined = pieces.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "text"))), lambda c: c["text"]), "").alias("text"))
    return joined.select("doc_id", F.md5("text").alias("h"))


_REQUESTS = """select cast(floor(event_id / 200) as bigint) as target, event_id as seq, cast(extract(day from ts) * 86400 + extract(hour from ts) * 3600 + extract(minute from ts) * 60 + floor(extract(second from ts)) as double) as sec,
case event_type when 'signup' then 'takeover' when 'view' then 'acquire' when 'click' then 'acquire' when 'purchase' then 'refresh' else 'release' end as op, user_id % 3 as actor from events where event_id % 11 > 2"""
HOLD, NOW = 4 * 3600, 15 * 86400


@book.add("chg_lock_state", f"""with recursive log as (select *, row_number() over (partition by target order by sec, seq) as k from ({_REQUESTS}) x),
st as (select distinct target, 0::bigint as k, null::bigint as seq, null::double as sec, null::varchar as outcome, null::bigint as holder, null::double as until from log
union all select target, k, seq, sec, outcome, case outcome when 'released' then null when 'denied' then was else actor end, case outcome when 'released' then null when 'denied' then until else sec + {HOLD} end from (
  select l.target, l.k, l.seq, l.sec, l.actor, s.holder as was, s.until, case when l.op = 'release' then case when s.holder = l.actor then 'released' else 'denied' end
    when l.op = 'takeover' then 'granted' when s.holder = l.actor then case when s.until > l.sec then 'extended' else 'granted' end when l.op = 'acquire' and coalesce(s.until <= l.sec, true) then 'granted' else 'denied' end as outcome
  from st s join log l on l.target = s.target and l.k = s.k + 1)),
ends as (select target, arg_max({{'h': holder, 'u': until}}, k) as l from st where k > 0 and sec <= {NOW} group by 1),
n as (select target, count(*) filter (outcome = 'granted') as granted, count(*) filter (outcome = 'extended') as extended, count(*) filter (outcome = 'released') as released, count(*) filter (outcome = 'denied') as denied from st where k > 0 group by 1)
select target, granted, extended, released, denied, coalesce(case when l.h is null then 'free' when l.u > {NOW} then 'active' else 'expired' end, 'free') as state, l.h as holder from n left join ends using (target)""")
def chg_lock_state(spark, d):
    """Outcomes of each target's requests, and who holds its lease at a time."""
    log = leases.lease_log(sql(spark, d, _REQUESTS).withColumnRenamed("sec", "at"), HOLD)
    n = lambda said: F.count(F.when(F.col("outcome") == said, 1)).alias(said)
    counts = log.groupBy("target").agg(*map(n, ("granted", "extended", "released", "denied")))
    states = leases.lease_states(log, F.lit(float(NOW)))
    return counts.join(states, "target", "left").withColumn("state", F.coalesce("state", F.lit("free")))
