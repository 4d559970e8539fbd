"""Exact inner-product search by Fagin's threshold algorithm.

Candidates are dealt into blocks once; a block holds, for every dimension, its
rows sorted by that component, and is written with these lists. Queries come in
batches of bounded size, each broadcast to one scan of the blocks. A query walks
a block's lists in step, best end first, scores what it meets, and stops once
the bound (the score a row at the current depth of every list would have) lies
below its kth score; a row that ties with the kth may still win by its id, so
the walk goes on while the bound equals it. The kth score is shared: it starts
from a first block that all queries see, and a task carries it from block to
block, so most blocks are left after a look at their best ends.

Vectors that are null, or hold a null or a non-finite component, or have no
vec_id take no part. Every row counts: rows with one vec_id are candidates each,
and a query row that is repeated gives its results each time; rows with the
query's own vec_id are no candidates of it. Vectors are only compared with
vectors of the same length. Scores beyond the long range are held at its ends.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import released, written

#: Rows of a block; components of the queries that are broadcast at once.
CANDIDATES, QUERY_CELLS = 2048, 2_000_000
_BLOCK = "dims int, ids binary, rows binary, lists binary"


def usable(vector: Column) -> Column:
    """True where no component is null or non-finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite), F.lit(False))


def scaled(vector: Column, by: int = 256) -> Column:
    """Components as floor(by * x), x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(by)) * x.cast("double")))


def _matrices(batch: pa.RecordBatch):
    """(dims, ids, rows) of a batch of vectors, by their length."""
    ids, column = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("_v")
    ends = column.offsets.to_numpy()
    values, sizes = column.values.to_numpy(zero_copy_only=False), np.diff(ends)
    for dims in np.unique(sizes):
        at = np.flatnonzero(sizes == dims)
        yield int(dims), ids[at], values[(ends[at][:, None] + np.arange(dims)[None, :])].reshape(len(at), dims)


def _blocks(batches):
    """Vectors as blocks with the order of their rows by every component."""
    held = defaultdict(list)

    def block(dims: int):
        ids, rows = (np.concatenate(x) for x in zip(*held.pop(dims), strict=True))
        for at in range(0, len(ids), CANDIDATES):
            part = np.ascontiguousarray(rows[at : at + CANDIDATES], np.int64)
            lists = np.ascontiguousarray(np.argsort(part, axis=0, kind="stable").T, np.int16)
            yield pa.record_batch([[dims], [ids[at : at + CANDIDATES].tobytes()], [part.tobytes()], [lists.tobytes()]], schema=pa.schema([("dims", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary()), ("lists", pa.binary())]))

    for batch in batches:
        for dims, ids, rows in _matrices(batch):
            held[dims].append((ids, rows))
            if sum(len(x) for x, _ in held[dims]) >= CANDIDATES:
                yield from block(dims)
    for dims in list(held):
        yield from block(dims)


def threshold_top(block: np.ndarray, ids: np.ndarray, lists: np.ndarray, query: np.ndarray, own: int, k: int, best=(), floor=None) -> list[tuple[int, int]]:
    """(-score, id) of the k best rows of one block and of ``best``, ties to the smaller
    id; rows that score below ``floor`` may be left out.

    ``lists[d]`` holds the rows in ascending order of component d.
    """
    n, dims = block.shape
    ahead, each = query > 0, np.arange(dims)
    used = np.flatnonzero(query != 0)
    unseen, at, step = ids != own, 0, 8
    best = list(best)

    def limit():
        kth = -best[-1][0] if len(best) == k else None
        return max((x for x in (kth, floor) if x is not None), default=None)

    # the best end of every list: no row of the block can score more
    top = (np.where(ahead, block[lists[:, n - 1], each], block[lists[:, 0], each]) * query).sum()
    if limit() is not None and top < limit():
        return best
    while at < n:
        to = min(n, at + step)
        met = np.zeros(n, bool)
        for part, flip in ((used[ahead[used]], True), (used[~ahead[used]], False)):
            met[lists[part, n - to : n - at] if flip else lists[part, at:to]] = True
        if not len(used):
            met[:] = True
        rows = np.flatnonzero(met & unseen)
        unseen[rows] = False
        if len(rows):
            scores = block[rows] @ query
            if len(rows) > 4 * k:
                # the k best here include every tie with the kth
                keep = scores >= np.partition(scores, len(rows) - k)[len(rows) - k]
                rows, scores = rows[keep], scores[keep]
            if (least := limit()) is not None:
                keep = scores >= least
                rows, scores = rows[keep], scores[keep]
            best = sorted([*best, *zip((-scores).tolist(), ids[rows].tolist(), strict=True)])[:k]
        edge = np.where(ahead, block[lists[each, n - to], each], block[lists[each, to - 1], each])
        if not unseen.any() or limit() is not None and (edge * query).sum() < limit():
            break
        at, step = to, step * 2
    return best


def _kind(dims: int, *parts: np.ndarray):
    """Doubles where they hold every score as a whole number, else Python's integers."""
    big = max(int(np.abs(x.astype(np.float64)).max(initial=0)) for x in parts)
    return np.float64 if big * big * max(1, dims) < 2**53 else object


def _search(k: int, shared):
    """The best of a task's blocks for every query of the batch: _row, query_id, vec_id, score."""

    def run(batches):
        found = {}
        for batch in batches:
            for b in batch.to_pylist():
                ids, dims = np.frombuffer(b["ids"], np.int64), b["dims"]
                asked = shared.value.get(dims)
                if asked is None:
                    continue
                rows, lists = np.frombuffer(b["rows"], np.int64).reshape(len(ids), dims), np.frombuffer(b["lists"], np.int16).reshape(dims, len(ids))
                kind = _kind(dims, rows, asked["vectors"])
                block, vectors = rows.astype(kind), asked["vectors"].astype(kind)
                for row, own, v, floor in zip(asked["rows"], asked["ids"], vectors, asked["floors"], strict=True):
                    found[row] = own, threshold_top(block, ids, lists, v, own, k, found[row][1] if row in found else (), floor)
        out = [(row, own, vec, min(max(int(-s), -(2**63)), 2**63 - 1)) for row, (own, best) in found.items() for s, vec in best]
        yield pa.record_batch([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], ["_row", "query_id", "vec_id", "score"])

    return run


_FOUND = "_row long, query_id long, vec_id long, score long"


def _batch(queries: DataFrame, blocks: DataFrame, k: int) -> dict:
    """A batch of queries by their length, with the kth scores that one block of that length gives."""
    held, out, n = defaultdict(list), {}, 0
    for batch in queries.toArrow().to_batches():  # bounded: QUERY_CELLS components, about
        for dims, ids, rows in _matrices(batch):
            held[dims].append((ids, rows))
    first = {b["dims"]: b for b in blocks.filter(F.col("dims").isin(*list(held)[:64])).groupBy("dims").agg(F.first("ids").alias("ids"), F.first("rows").alias("rows")).collect()} if held else {}
    for dims, parts in held.items():
        ids, vectors = (np.concatenate(x) for x in zip(*parts, strict=True))
        floors = [None] * len(ids)
        if dims in first:
            others = np.frombuffer(first[dims]["ids"], np.int64)
            rows = np.frombuffer(first[dims]["rows"], np.int64).reshape(len(others), dims)
            kind = _kind(dims, rows, vectors)
            for i, (own, v) in enumerate(zip(ids, vectors.astype(kind), strict=True)):
                scores = (rows[others != own].astype(kind)) @ v
                floors[i] = int(np.sort(scores)[len(scores) - k]) if len(scores) >= k else None
        out[dims] = {"rows": list(range(n, n + len(ids))), "ids": ids.tolist(), "vectors": vectors, "floors": floors}
        n += len(ids)
    return out


def top_k(vectors: DataFrame, queries: Column, k: int = 5) -> DataFrame:
    """The k best other rows for each row that ``queries`` selects:
    query_id, rank (from 1), vec_id, score."""
    spark = vectors.sparkSession
    base = vectors.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    base = base.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding")).alias("_v"), F.coalesce(queries, F.lit(False)).alias("_q"))
    base = written(base, "topk-vectors")
    blocks = written(base.select("vec_id", "_v").mapInArrow(released(_blocks), _BLOCK), "topk-blocks")
    asked = base.filter("_q")
    n = -(-asked.agg(F.coalesce(F.sum(F.size("_v")), F.lit(0))).first()[0] // QUERY_CELLS) or 1
    w = Window.partitionBy("_row").orderBy(F.desc("score"), "vec_id")
    parts = []
    for part in range(n):
        mine = asked.filter(F.pmod(F.xxhash64("vec_id", F.lit("batch")), F.lit(n)) == part).select("vec_id", "_v")
        shared = spark.sparkContext.broadcast(_batch(mine, blocks, k))
        found = blocks.mapInArrow(released(_search(k, shared)), _FOUND).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        parts.append(written(found.select("query_id", "rank", "vec_id", "score"), "topk-found"))
    return parts[0] if n == 1 else reduce(DataFrame.unionByName, parts)
