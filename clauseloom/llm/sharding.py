"""Shards of near-equal bytes: longest-processing-time scheduling.

Rows of equal text form a group that stays together. Groups go, largest first,
to the least-loaded shard through a heap. So that the heap's input is bounded
at any corpus size, groups below ``1 / (GRAIN * shards)`` of all bytes are
first packed, largest first, into parcels of that size inside hash buckets:
the driver sees at most about ``2 * GRAIN * shards`` items, whatever the input,
and the loads differ by about one part in ``GRAIN`` at most.

Null text has no bytes and is grouped with the empty text. Repeated rows are
rows of one group. An empty table gives an empty result. Extra columns are
left out.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prefix_offsets, written

#: Items per shard that the heap sees at least, when there are so many groups.
GRAIN = 1000
#: Rows that one task numbers at most, about.
SLOT_ROWS = 4000


def longest_first(items: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """Item to shard: each of ``items`` (size, name), largest first, to the least-loaded shard."""
    loads = [(0, s) for s in range(shards)]
    out = {}
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        load, s = heapq.heappop(loads)
        out[name] = s
        heapq.heappush(loads, (load + size, s))
    return out


def shard_groups(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(
        docs.select(
            "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"), F.md5(text).alias("_g"),
        ),
        "shard-rows",
    )
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    grain = max(1, -(-total // (GRAIN * shards)))
    groups = rows.groupBy("_g").agg(F.sum("size").alias("_gsize"))
    buckets = max(16, total // (grain * 64))
    w = Window.partitionBy("_b").orderBy(F.desc("_gsize"), "_g").rowsBetween(Window.unboundedPreceding, -1)
    small = (
        groups.filter(F.col("_gsize") < grain)
        .withColumn("_b", F.pmod(F.xxhash64("_g"), F.lit(buckets)))
        .withColumn("_p", F.floor(F.coalesce(F.sum("_gsize").over(w), F.lit(0)) / grain))
        .select("_g", "_gsize", F.concat_ws("-", F.lit("p"), "_b", "_p").alias("_item"))
    )
    small = written(small, "shard-parcels")
    items = (
        small.groupBy("_item").agg(F.sum("_gsize").alias("_gsize"))
        .unionByName(groups.filter(F.col("_gsize") >= grain).select(F.col("_g").alias("_item"), "_gsize"))
    ).toArrow()
    placed = longest_first(list(zip(items["_gsize"].to_pylist(), items["_item"].to_pylist(), strict=True)), shards)
    plan = docs.sparkSession.createDataFrame(
        pa.table({"_item": pa.array(placed.keys(), pa.string()), "shard": pa.array(placed.values(), pa.int32())})
    )
    plan = F.broadcast(plan)  # bounded by GRAIN * shards, see above
    first = rows.join(plan, rows["_g"] == plan["_item"], "left").drop("_item")
    out = (
        first.filter(F.col("shard").isNotNull())
        .unionByName(first.filter(F.col("shard").isNull()).drop("shard").join(small.drop("_gsize"), "_g").join(plan, "_item").drop("_item"))
        .drop("_g")
    )
    return with_slots(out, max(16, n // (shards * SLOT_ROWS)))


def with_slots(rows: DataFrame, buckets: int) -> DataFrame:
    """Adds ``slot``, gapless from 0 inside each shard, without gathering a
    shard in one task: bucket counts give offsets, rows are numbered inside buckets."""
    rows = written(rows.withColumn("_b", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets))), "shard-slots")
    counts = rows.groupBy("shard", "_b").agg(F.count("*").alias("_n"))
    starts = prefix_offsets(counts, ["shard"], "_b", "_n", "_at").drop("_n")
    w = Window.partitionBy("shard", "_b").orderBy("doc_id", "size", "text_crc32")
    return (
        rows.join(starts, ["shard", "_b"])
        .withColumn("slot", (F.col("_at") + F.row_number().over(w) - 1).cast("long"))
        .drop("_at", "_b")
    )
