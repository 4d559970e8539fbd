"""Rules over record tables: newest rows, versions, job states, readiness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def first_per(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order that has no ties."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


#: States of a job that has not ended, and the steps from state to state; fixed values.
ACTIVE = ("queued", "claimed", "running")
TRANSITIONS = {
    "queued": ("claimed", "canceled"),
    "claimed": ("running", "canceled", "queued"),
    "running": ("completed", "failed", "canceled", "timeout", "queued"),
}
RETRYABLE = ("failed", "canceled", "timeout")


def active_job(jobs: DataFrame, keys: Sequence[str], newest: Sequence[Column], state: str = "status", accept: Column | None = None) -> DataFrame:
    """The newest job of each key that has not ended, among those that ``accept`` takes."""
    found = jobs.filter(F.col(state).isin(*ACTIVE))
    return first_per(found if accept is None else found.filter(accept), keys, newest)


def said(*values: Column) -> Column:
    """The first value that is not null, empty or blank."""
    return F.coalesce(*[F.when(F.trim(v) != "", v) for v in values])


def batch_summary(items: DataFrame, batch: str, ok: Column, at: str, n: int) -> DataFrame:
    """Items, successes and failures of each batch and its newest time; the ``n`` newest batches."""
    per = items.groupBy(batch).agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.count("*").alias("items"), F.max(at).alias("newest"))
    return per.orderBy(F.desc("newest"), batch).limit(n)


def kind_totals(rows: DataFrame, kind: Column) -> DataFrame:
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def latest_change(files: DataFrame, saved: DataFrame, task: str, at: str) -> DataFrame:
    """The latest time per task, and whether it is later than the one saved (task, saved)."""
    last = files.groupBy(task).agg(F.max(at).alias("latest"))
    return last.join(saved, task, "left").select(task, "latest", F.coalesce(F.col("latest") > F.col("saved"), F.lit(True)).alias("needs_review"))


def holders(users: DataFrame, roles: DataFrame, key: str, role: Column) -> DataFrame:
    """How many distinct users hold a role."""
    return users.join(roles.filter(role), key, "left_semi").agg(F.count("*").alias("holders"))


def active_release(releases: DataFrame, owner: str, active: Column, at: str, key: str) -> DataFrame:
    """Per owner the active release, newest first; where none is active, the newest one."""
    return first_per(releases, [owner], [F.when(active, 0).otherwise(1), F.desc(at), F.desc(key)])


def version_changes(versions: DataFrame, owner: str, digest: str, order: Sequence[Column], forced: Column | None = None) -> DataFrame:
    """Adds ``is_new``: the digest differs from the one before, or a version was forced."""
    before = F.lag(digest).over(Window.partitionBy(owner).orderBy(*order))
    differs = ~F.col(digest).eqNullSafe(before) | before.isNull()
    return versions.withColumn("is_new", differs if forced is None else differs | forced)


def pruned(versions: DataFrame, owner: str, origin: str, order: Sequence[Column], keep: dict[str, int]) -> DataFrame:
    """The newest versions of each owner and origin, as many as ``keep`` says; origins it does not name stay whole."""
    rn = F.row_number().over(Window.partitionBy(owner, origin).orderBy(*order))
    most = F.try_element_at(F.create_map(*[F.lit(v) for kv in keep.items() for v in kv]), F.col(origin))
    return versions.withColumn("_rn", rn).filter(most.isNull() | (F.col("_rn") <= most)).drop("_rn")


def ready_status(rows: DataFrame, given: Sequence[Column], listed: Column, system: Column, failed: Column) -> Column:
    """``ready`` when every input is there (the list only where the mode needs it); else
    ``failed`` stays failed, anything else is a draft."""
    there = F.lit(True)
    for g in given:
        there = there & F.coalesce(g, F.lit(False))
    ready = there & (~system | F.coalesce(listed, F.lit(False)))
    return F.when(ready, "ready").when(failed, "failed").otherwise("draft")


def folded_log(events: DataFrame, job: str, order: Sequence[str], state: str, keep: Sequence[str]) -> DataFrame:
    """Each event of a job's log with the state before it, whether the step is allowed (an
    unchanged state is), the state after it (a forbidden step changes nothing), and
    whether the job could then be canceled or retried. A log is one job's own."""
    allowed = F.create_map(*[v for s, to in TRANSITIONS.items() for v in (F.lit(s), F.array(*map(F.lit, to)))])
    row = F.struct(*order, F.col(state).alias("_to"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    logs = events.groupBy(job).agg(F.sort_array(F.collect_list(row)).alias("log"))

    def step(acc, e):
        before = acc["now"]
        ok = before.isNull() | (before == e["_to"]) | F.coalesce(F.array_contains(F.try_element_at(allowed, before), e["_to"]), F.lit(False))
        now = F.when(ok, e["_to"]).otherwise(before)
        return F.struct(now.alias("now"), F.concat(acc["out"], F.array(F.struct(before.alias("before"), ok.alias("allowed"), now.alias("after")))).alias("out"))

    start = F.struct(F.lit(None).cast("string").alias("now"), F.array().cast("array<struct<before:string,allowed:boolean,after:string>>").alias("out"))
    steps = F.aggregate("log", start, step, lambda acc: acc["out"])
    rows = logs.select(job, F.explode(F.arrays_zip(F.col("log"), steps.alias("steps"))).alias("r"))
    after = F.col("r.steps.after")
    return rows.select(
        job, *[F.col(f"r.log._k{i}").alias(c) for i, c in enumerate(keep)], F.col("r.steps.before").alias("before"), F.col("r.steps.allowed").alias("allowed"), after.alias("after"),
        F.coalesce(after.isin(*ACTIVE, "canceled"), F.lit(False)).alias("can_cancel"), F.coalesce(after.isin(*RETRYABLE), F.lit(False)).alias("can_retry"),
    )


def requeued(heartbeats: DataFrame, state: str, beat: str, before: Column) -> DataFrame:
    """Claimed or running jobs whose heartbeat is older than a time, reset to queued."""
    stale = F.col(state).isin("claimed", "running") & F.col(beat).isNotNull() & (F.col(beat) < before)
    return heartbeats.filter(stale).withColumn(state, F.lit("queued"))


def active_roots(roots: DataFrame, where: Column, active: str) -> DataFrame:
    """Rows that fit and are active; a row that does not say is."""
    return roots.filter(where & F.coalesce(active, F.lit(True)))


def queue_head(jobs: DataFrame, fits: Column, priority: str, at: str, key: str, n: int = 20) -> DataFrame:
    """Queued jobs of the chosen queues: highest priority, then oldest."""
    return jobs.filter(fits).orderBy(F.desc(priority), F.asc(at), F.asc(key)).limit(n)


def input_history(rows: DataFrame, owner: str, at: str, current: Column, key: str) -> DataFrame:
    """Adds ``place``: newest first, the current one first among equals."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy(F.desc(at), F.when(current, 0).otherwise(1), F.asc(key))))


def names_ignoring_case(*columns: DataFrame) -> DataFrame:
    """The distinct names of all tables' first columns, in lower-case order."""
    every = columns[0].toDF("name")
    for c in columns[1:]:
        every = every.union(c.toDF("name"))
    return every.distinct().orderBy(F.lower("name"), "name")


def active_union(runs: DataFrame, schemes: DataFrame, key: str, state: str) -> DataFrame:
    """Operation runs followed by scheme jobs, in one shape: key, kind, state."""
    shape = lambda rows, kind: rows.select(key, F.lit(kind).alias("kind"), F.col(state).alias("state"))
    return shape(runs, "run").unionByName(shape(schemes, "scheme"))


def missing_records(folders: DataFrame, records: DataFrame, key: str = "id") -> DataFrame:
    """Records for folders (key, name, created, creator, editor, edited, changed) that the
    table lacks, with their gaps filled: the name by the key, the creation by the time
    the folder was changed, to the minute; editor and edit by creator and creation."""
    rows = folders.join(records.select(key), key, "left_anti")
    gap = lambda c, other: F.coalesce(F.when(F.trim(c) != "", F.col(c)), other)
    rows = rows.withColumn("created", F.coalesce("created", F.date_trunc("minute", "changed").cast("timestamp_ntz")))
    return rows.select(key, gap("name", F.col(key).cast("string")).alias("name"), "created", "creator", gap("editor", F.coalesce("creator", F.lit(""))).alias("editor"), F.coalesce("edited", "created").alias("edited"))


#: How messages of errors begin.
ERROR_MARKS = ("ERROR:", "錯誤：", "WF_ERROR:", "工作流程錯誤：")


def log_errors(messages: DataFrame, runs: DataFrame, steps: DataFrame) -> DataFrame:
    """(log_id, has_error, first_error) of logs: messages (log_id, pos, message), runs
    (log_id, run_no, status, error) and their steps (log_id, run_no, step_no, status,
    error, action, detail).

    Any message that begins like an error, and any run or step with the status or a text
    of an error, makes it one. The first error is the first such message; else, in the
    order of runs, the run's own text, else that of its first step in error, behind its
    action and detail. Nulls are empty; without a text it is empty."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    failed = F.lower(text("status")) == "error"
    said = F.lit(False)
    for mark in ERROR_MARKS:
        said = said | text("message").startswith(mark)
    place = lambda kind, run, step: F.struct(F.lit(kind).alias("kind"), run.cast("long").alias("run"), step.cast("long").alias("step"))
    labelled = F.when((text("action") != "") & (text("detail") != ""), F.concat_ws(" :: ", text("action"), text("detail"), text("error"))).when(text("action") != "", F.concat_ws(": ", text("action"), text("error"))).otherwise(text("error"))
    parts = [
        messages.select("log_id", said.alias("bad"), place(0, F.col("pos"), F.lit(0)).alias("at"), F.when(said, text("message")).alias("text")),
        runs.select("log_id", (failed | (text("error") != "")).alias("bad"), place(1, F.col("run_no"), F.lit(-1)).alias("at"), F.nullif(text("error"), F.lit("")).alias("text")),
        steps.select("log_id", (failed | (text("error") != "")).alias("bad"), place(1, F.col("run_no"), F.col("step_no")).alias("at"), F.when(failed & (text("error") != ""), labelled).alias("text")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    first = F.min(F.when(F.col("text").isNotNull(), F.struct("at", "text")))["text"]
    return rows.groupBy("log_id").agg(F.bool_or("bad").alias("has_error"), F.coalesce(first, F.lit("")).alias("first_error"))


#: The kinds of batch items.
ITEM_KINDS = ("task", "mapping_scheme")


def batch_items(tokens, ids) -> Column:
    """Array of structs (kind, task, scheme) from comma-separated base64url JSON tokens and
    plain task ids. A missing kind is a task; unknown kinds, tokens that are no JSON
    object and empty tasks drop out; of equal items the first stays, ids behind tokens."""
    listed = lambda x: F.filter(F.transform(F.split(F.coalesce(T.col(x), F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")

    def item(token):
        plain = F.translate(token, "-_=", "+/")
        padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
        json = F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))
        return F.from_json(F.when(F.ltrim(json).startswith("{"), json), "kind string, task_id string, scheme_id string")

    text = lambda r, c: F.trim(F.coalesce(r[c], F.lit("")))
    made = lambda kind, task, scheme: F.struct(kind.alias("kind"), task.alias("task"), scheme.alias("scheme"))
    named = F.transform(F.transform(listed(tokens), item), lambda r: made(F.coalesce(F.nullif(F.lower(text(r, "kind")), F.lit("")), F.lit("task")), text(r, "task_id"), text(r, "scheme_id")))
    good = F.filter(named, lambda r: (r["task"] != "") & r["kind"].isin(*ITEM_KINDS))
    return F.array_distinct(F.concat(good, F.transform(listed(ids), lambda x: made(F.lit("task"), x, F.lit("")))))
