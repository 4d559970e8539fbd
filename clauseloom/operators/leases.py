"""Leases on targets: outcomes of requests and the state at a time."""

from __future__ import annotations

from math import nan

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequences import grant_leases, walk_groups


def lease_log(requests: DataFrame, hold: float) -> DataFrame:
    """``requests`` (target, seq, at, op, actor; at in seconds) with outcome, holder and until.

    Each grant depends on those before, but not on all: a takeover settles the lease
    whatever came before, and so does an acquire at least ``hold`` behind the request
    before it, since no lease can still run. A running count of such requests cuts a log
    into pieces that are walked independently.
    """
    order = [F.col("at").asc_nulls_last(), F.col("seq")]
    log = Window.partitionBy("target").orderBy(*order)
    gap = F.col("at") - F.lag("at").over(log)
    fresh = (F.col("op") == "takeover") | ((F.col("op") == "acquire") & (gap >= hold))
    pieces = requests.withColumn("piece", F.sum(F.when(fresh, 1).otherwise(0)).over(log))

    def walk(rows: list[tuple]) -> list[tuple]:
        _, _, at, op, actor, _ = zip(*rows, strict=True)
        said = grant_leases([nan if t is None else t for t in at], op, actor, hold)
        return [(*r[:5], outcome, holder, None if until != until else until) for r, (outcome, holder, until) in zip(rows, said, strict=True)]

    columns = ["target", "seq", "at", "op", "actor"]
    schema = {c: requests.schema[c].dataType.simpleString() for c in columns}
    schema |= {"outcome": "string", "holder": schema["actor"], "until": "double"}
    return walk_groups(pieces.select(*columns, "piece"), ["target", "piece"], order, walk, schema)


def lease_states(log: DataFrame, now: float | Column) -> DataFrame:
    """(target, state, holder) at a time: active while the last lease runs, expired behind its
    end, free where it was given up or there was none."""
    last = log.filter(F.col("at") <= now).groupBy("target").agg(F.max_by(F.struct("holder", "until"), F.struct("at", "seq")).alias("l"))
    state = F.when(F.col("l.holder").isNull(), "free").when(F.col("l.until") > now, "active").otherwise("expired")
    return last.select("target", state.alias("state"), "l.holder")
