"""Structured Streaming jobs over event and record files.

Each job reads files as a stream, keeps its state in Spark's state store, and
writes through ``foreachBatch`` to a Parquet folder that the cluster shares.
Query functions run a job to the end of what is there (availableNow) and return
the sink as a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sequences import fold_status
from ..sources.shared import shared_path


def read_stream(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """A Parquet folder or file as a stream; the schema is that of what is there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)


def drained(stream: DataFrame, name: str, mode: str = "append", batch: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Runs a stream over all available input; the rows it wrote, with their ``batch``."""
    spark, sink = stream.sparkSession, shared_path(stream.sparkSession, name)
    schema: list = []

    def put(rows: DataFrame, n: int) -> None:
        out = (batch(rows, n) if batch else rows).withColumn("batch", F.lit(n).cast("long"))
        schema[:] = [out.schema]
        out.write.mode("overwrite").parquet(f"{sink}/batch={n}-rows")

    query = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", shared_path(spark, f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    if not schema:
        return spark.createDataFrame([], stream.schema).withColumn("batch", F.lit(0).cast("long"))
    return spark.read.schema(schema[0]).option("recursiveFileLookup", "true").parquet(sink)


def status_states(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A job's state after its events, in time order, through the allowed transitions."""
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    now = fold_status(rows.status.tolist(), state.get[0] if state.exists else None)
    state.update((now,))
    yield pd.DataFrame({"job_id": [key[0]], "status": [now]})


def status_fold(events: DataFrame) -> DataFrame:
    return events.groupBy("job_id").applyInPandasWithState(status_states, "job_id long, status string", "status string", "update", GroupStateTimeout.NoTimeout)


def first_requests(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Requests of one target that find no active job; an active one drops the rest until it ends."""
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    active, out = (state.get[0] if state.exists else False), []
    for event, status in zip(rows.event_id, rows.status, strict=True):
        if status == "queued" and not active:
            out.append(event)
            active = True
        elif status in ("completed", "failed"):
            active = False
    state.update((active,))
    yield pd.DataFrame({"job_id": [key[0]] * len(out), "event_id": out}).astype("int64")


def dedup_enqueue(events: DataFrame) -> DataFrame:
    return events.groupBy("job_id").applyInPandasWithState(first_requests, "job_id long, event_id long", "active boolean", "append", GroupStateTimeout.NoTimeout)


def stale_gaps(seconds: int):
    """Rows for jobs whose next heartbeat came later than ``seconds``, or has not come when the watermark passes."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        last = state.get[0] if state.exists else None
        if state.hasTimedOut:
            out.append(last)
            state.remove()
        else:
            for t in pd.concat(list(batches)).sort_values("beat").beat.astype("datetime64[ms]").astype("int64"):
                if last is not None and t - last > seconds * 1000:
                    out.append(last)
                last = max(t, last or t)
            state.update((last,))
            due = last + seconds * 1000
            if due > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(due)
        yield pd.DataFrame({"job_id": [key[0]] * len(out), "last_ms": out}).astype("int64")

    return run


def stale_timeout(events: DataFrame, seconds: int) -> DataFrame:
    beats = events.withColumn("beat", F.col("ts").cast("timestamp")).withWatermark("beat", "1 hour").select("job_id", "beat")
    return beats.groupBy("job_id").applyInPandasWithState(stale_gaps(seconds), "job_id long, last_ms long", "last_ms long", "append", GroupStateTimeout.EventTimeTimeout)


def error_stream(events: DataFrame, minimum: str, severity: Callable) -> DataFrame:
    """Events at or above a severity."""
    return events.filter(severity("level") >= severity(F.lit(minimum)))
