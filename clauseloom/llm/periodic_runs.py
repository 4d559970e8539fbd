"""Stretches of words that repeat periodically, by a dictionary of basic factors.

For each power of two the dictionary names the stretches of that many words,
equal names for equal stretches of one text; a name of the next power is a pair
of names. Stretches that occur once in their text are left unnamed and stay so
in all longer ones, so ordinary prose leaves the dictionary after a few levels.

Where a stretch occurs again within twice its length, and again after the same
distance, its occurrences form an arithmetic progression that proposes a
period. Neighbouring proposals of one period are one. Each is extended to both
sides by names of falling length, a factor of two at a time. A run has a
smallest period q and at least ``max(6, 4 * q)`` words and cannot be extended.
For 2 ** k in [q, 2q) the windows at its start recur after q and 2q words, so
each run is proposed; a stretch that two periods describe has the smaller.

Everything is worked out in a task over blocks of texts; nothing is shuffled
and no group is formed. A very long text is a block of its own and needs about
8 bytes a word for each level that it reaches (22 levels for 4 million words
of one period).

Defined results: a null text has no words and no runs; ties for the most
periodic run go to the smallest start, then the smallest period; rows that
repeat give equal rows. An empty table gives none. Only the given columns are
read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released
from .words import Block, blocks

LEAST, TIMES = 6, 4
RUNS = "array<struct<start: long, length: long, period: long>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _named(keys: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the stretches at ``at`` (ascending), equal for equal keys, -1 for all other
    places; and ``at`` by name, then place, without what occurs once."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1] if len(k) else np.zeros(0, bool)
    edge = np.concatenate([[False], same, [False]])
    several = edge[1:] | edge[:-1] if len(k) else same
    places = at[order][several]
    names = np.full(n, -1, np.int64)
    names[places] = np.cumsum(~edge[:-1])[several] if len(k) else 0
    return names, places


def _dictionary(ids: np.ndarray, row: np.ndarray):
    """Per power of two: the names of all stretches, and the places that have one, by name."""
    n, size = len(ids), 1
    names, places = _named(row * (int(ids.max(initial=0)) + 1) + ids, np.arange(n), n)
    while len(places):
        yield size, names, places
        pair = np.flatnonzero((names[:-size] >= 0) & (names[size:] >= 0)) if n > size else np.zeros(0, np.int64)
        names, places = _named(names[pair] * (n + 1) + names[pair + size], pair, n)
        size *= 2


def _proposals(size: int, names: np.ndarray, places: np.ndarray) -> np.ndarray:
    """(place, period): heads of progressions of three occurrences, each within twice the
    length of the one before; the first of neighbouring heads."""
    step = np.where(names[places[1:]] == names[places[:-1]], places[1:] - places[:-1], 0)
    step = np.where(step <= 2 * size, step, 0)
    head = np.flatnonzero((step[:-1] > 0) & (step[:-1] == step[1:]))
    head = head[(head == 0) | (step[head - 1] != step[head])]
    at, period = places[head], step[head]
    order = np.argsort(at)
    at, period = at[order], period[order]
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (period[1:] != period[:-1])]) if len(at) else np.zeros(0, bool)
    return np.stack([at[new], period[new]])


def find_runs(ids: np.ndarray, row: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs, by start and period. ``ids`` are the words of
    several texts, ``row`` the text that each belongs to."""
    n, levels, found = len(ids), [], [np.zeros((2, 0), np.int64)]
    for size, names, places in _dictionary(ids, row):
        levels.append((size, names))
        found.append(_proposals(size, names, places))
    at, period = np.unique(np.concatenate(found, axis=1), axis=1)
    lo, hi = at.copy(), at.copy()  # words lo to hi equal those one period on
    for size, names in reversed(levels):
        x, y = hi, hi + period
        ok = y < n
        ok[ok] = (names[x[ok]] >= 0) & (names[x[ok]] == names[y[ok]])
        hi = np.where(ok, hi + size, hi)
        x = lo - size
        ok = x >= 0
        ok[ok] = (names[x[ok]] >= 0) & (names[x[ok]] == names[(x + period)[ok]])
        lo = np.where(ok, lo - size, lo)
    length = hi - lo + period
    keep = length >= np.maximum(LEAST, TIMES * period)
    runs = np.stack([lo, length, period])[:, keep]
    runs = runs[:, np.lexsort((runs[2], runs[1], runs[0]))]
    new = np.concatenate([[True], (runs[:2, 1:] != runs[:2, :-1]).any(axis=0)]) if runs.shape[1] else np.zeros(0, bool)
    runs = runs[:, new]
    return runs[:, np.lexsort((runs[2], runs[0]))]


def outside(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of ``n`` words stays: no run holds it after the run's first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[0] + runs[2], 1)
    np.add.at(edge, runs[0] + runs[1], -1)
    return np.cumsum(edge)[:-1] == 0


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Numbers of the original words that stand in their places once a stretch of the text
    repeats; null for the nine tenths of documents that stay as they are."""
    if doc_id is None or n == 0 or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at >= a, a + (at - a) % p, at)


def _collapsed(plant: bool):
    def run(batches):
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for block in blocks(texts):
                yield _block(block, doc_ids[block.lo : block.hi], plant)

    return run


def _block(block: Block, doc_ids: list, plant: bool) -> pa.RecordBatch:
    places = np.arange(len(block.words))
    if plant:
        for i, doc_id in enumerate(doc_ids):
            lo, hi = block.ends[i], block.ends[i + 1]
            if (moved := planted(doc_id, int(hi - lo))) is not None:
                places[lo:hi] = lo + moved
    runs = find_runs(block.ids()[0][places], block.row())
    keep = outside(len(places), runs)
    owner = np.searchsorted(block.ends, runs[0], "right") - 1
    texts = [b" ".join([block.words[p] for p in places[lo:hi][keep[lo:hi]]]).decode() for lo, hi in zip(block.ends[:-1], block.ends[1:], strict=True)]
    ends = np.searchsorted(owner, np.arange(len(doc_ids) + 1))
    fields = [runs[0] - block.ends[owner], runs[1], runs[2]]
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in fields], fields=list(_RUN)))
    return pa.record_batch([pa.array(doc_ids, pa.int64()), lists, pa.array(texts, pa.string())], ["doc_id", "runs", "collapsed"])


def collapsed_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """One row per input row: doc_id, the runs of its text (``RUNS``, by start and period)
    and the text without a run's words after its first period, joined by one
    blank. ``plant``: on texts with known repeats put in (see ``planted``)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(released(_collapsed(plant)), f"doc_id long, runs {RUNS}, collapsed string")
