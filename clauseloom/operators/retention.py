"""Retention, releases and pages: what goes, what is current, what is shown."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_path


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def expired(rows: DataFrame, days: int, now: datetime, *times: str, ended: Column | None = None) -> DataFrame:
    """Rows whose time, the first of ``times`` that is given, lies more than ``days`` before
    ``now``; of records with states only those that ``ended``. ``days`` must be positive."""
    if days <= 0:
        raise ValueError("days of retention must be greater than 0")
    old = F.coalesce(*times) < F.lit(now - timedelta(days=days)).cast(rows.schema[times[0]].dataType)
    return rows.filter(old if ended is None else old & ended)


def with_children(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """(id): the seeds (id) and everything below them by ``links`` (id, parent), over any number
    of levels: one semi join a level, of what the level before found; cycles end."""
    found = _written(seeds.select("id").distinct(), "retention-ids")
    every, last = found, found
    while True:
        below = links.join(last.select(F.col("id").alias("parent")), "parent", "left_semi").select("id").distinct()
        last = _written(below.join(every, "id", "left_anti"), "retention-ids")
        if last.isEmpty():
            return every
        every = every.unionByName(last)


def cleaned(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame, dry_run: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables (name: rows and the column with the id they hang on) without the rows of
    ``ids``, and the counts (tab, matched, deleted). A dry run counts and keeps all."""
    kept, counts = {}, None
    for name, (rows, key) in tables.items():
        own = ids.select(F.col("id").alias(key))
        kept[name] = rows if dry_run else rows.join(own, key, "left_anti").select(rows.columns)
        n = rows.join(own, key, "left_semi").agg(F.count("*").alias("matched")).select(F.lit(name).alias("tab"), "matched")
        n = n.withColumn("deleted", F.lit(0).cast("long") if dry_run else F.col("matched"))
        counts = n if counts is None else counts.unionByName(n)
    return kept, counts


#: Files that can be a release; fixed values.
SHEETS = ("xlsx", "xlsm", "xltx", "xltm", "xls")


def activated(releases: DataFrame, registered: DataFrame) -> DataFrame:
    """``releases`` (owner, id, path, file_name, source_url, version_label, checksum, is_active,
    status, error, downloaded_at) after at most one file (owner, path, source_url,
    version_label, checksum, downloaded_at) was registered for an owner.

    The owner's releases become inactive; the first one of that path is updated, or a row
    is appended, and is the active one. Empty values leave what was there; without a label
    the version is the time. What is no sheet by its extension changes nothing.
    """
    given = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    new = registered.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*SHEETS)).select(
        "owner", F.col("path").alias("n_path"), given("source_url").alias("n_url"), given("checksum").alias("n_checksum"), F.col("downloaded_at").alias("n_at"),
        F.coalesce(given("version_label"), F.date_format("downloaded_at", "yyyyMMdd-HHmm")).alias("n_label"),
    )
    name = F.regexp_extract("n_path", r"([^/]*)$", 1)
    rows = releases.join(new, "owner", "left")
    hit = F.coalesce(F.col("path") == F.col("n_path"), F.lit(False))
    first = F.min(F.when(hit, F.col("id"))).over(Window.partitionBy("owner"))
    rows = rows.withColumn("_is", F.coalesce(F.col("id") == first, F.lit(False))).withColumn("_touched", F.col("n_path").isNotNull())
    is_, keep = F.col("_is"), lambda n, c: F.when(F.col("_is"), n).otherwise(F.col(c)).alias(c)
    merged = rows.select(
        "owner", "id", "path", keep(name, "file_name"), keep(F.coalesce("n_url", "source_url"), "source_url"), keep(F.col("n_label"), "version_label"),
        keep(F.coalesce("n_checksum", "checksum"), "checksum"), F.when(F.col("_touched"), is_).otherwise(F.col("is_active")).alias("is_active"),
        keep(F.lit("available"), "status"), keep(F.lit(None).cast("string"), "error"), keep(F.col("n_at"), "downloaded_at"),
    )
    known = releases.select("owner", F.col("path").alias("n_path")).distinct()
    last = releases.groupBy("owner").agg(F.max("id").alias("last"))
    added = new.join(known, ["owner", "n_path"], "left_anti").join(last, "owner", "left").select(
        "owner", (F.coalesce("last", F.lit(0)) + 1).alias("id"), F.col("n_path").alias("path"), name.alias("file_name"), F.col("n_url").alias("source_url"), F.col("n_label").alias("version_label"),
        F.col("n_checksum").alias("checksum"), F.lit(True).alias("is_active"), F.lit("available").alias("status"), F.lit(None).cast("string").alias("error"), F.col("n_at").alias("downloaded_at"),
    )
    return merged.unionByName(added)


#: Pages that begin within so many rows of an end are taken from there.
NEAR = 1_000


def page(rows: DataFrame, order: list[str], number: int, size: int, clamp: bool = True, near: int = NEAR) -> DataFrame:
    """One page with total, page number and has_prev / has_next. ``order`` names columns,
    with a minus in front for descending ones, and ends in a unique key. With ``clamp`` a
    page past the end becomes the last one.

    A page close to an end is the top of the order from that end. Others are found by order
    statistics: the rows are dealt to ranges of the order, the ranges are counted, and only
    those that the page touches are sorted, so no task sees more than a range of rows.
    """
    total = rows.count()
    last = max(1, -(-total // size))
    at = min(max(1, number), last) if clamp else max(1, number)
    start = (at - 1) * size
    by = lambda back: [F.desc(c.lstrip("-")) if c.startswith("-") != back else F.asc(c.lstrip("-")) for c in order]
    if start + size <= near or start >= total:
        part = rows.orderBy(*by(False)).limit(min(start + size, total)).orderBy(*by(False)).offset(start)
    elif total - start <= near:
        part = rows.orderBy(*by(True)).limit(max(0, total - start)).orderBy(*by(False)).limit(size)
    else:
        dealt = _written(rows.repartitionByRange(*by(False)).withColumn("_range", F.spark_partition_id()), "page-ranges")
        before, counted = 0, sorted(dealt.groupBy("_range").count().collect())  # one row for each range
        spans = []
        for r, n in counted:
            spans.append((r, before, before + n))
            before += n
        hit = [(r, a) for r, a, b in spans if a < start + size and b > start]
        ranges = dealt.filter(F.col("_range").isin([r for r, _ in hit]))
        part = ranges.orderBy("_range", *by(False)).drop("_range").offset(start - hit[0][1]).limit(size)
    return part.withColumns({"page": F.lit(at), "total": F.lit(total).cast("long"), "has_prev": F.lit(at > 1), "has_next": F.lit(at < last)})
