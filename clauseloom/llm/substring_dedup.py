"""Repeated passages across documents, by difference-cover anchors.

A passage is removed where ``LENGTH`` consecutive words also stand earlier: in
a document of smaller doc_id, or before in the same one. The first occurrence
stays; all are judged on the input.

Positions in a document whose remainder by 13 is in {0, 1, 3, 9} form a
difference cover: two equal windows of 20 words, wherever they start, have one
shift under 13 that puts both on such positions. So hashes of 8 words at these
positions alone (4 of 13) see every repeated window. Positions whose hash
occurs once are done with. The others are extended: the windows around them
are hashed in full, and each group of equal windows finds its first.

No pairs are made. A task works on blocks of texts and sends on one row for
each different hash of a block, so a passage in a third of all documents meets
as many rows as there are blocks. Texts move only if something in them may
repeat (their ids are broadcast up to a checked number; beyond it all move).

Hashes have 64 bits: among n windows that may repeat, about n * n / 2 ** 65 are
taken for equal by chance (0.03 for the billion that 30 GB of text may have).

Defined results: null text has no words; documents under 20 words lose none.
Rows with one doc_id are one document: windows that start at the same word of
it are none earlier than the other, so repeated rows fare alike, and a later
start in one of its texts repeats an earlier start in another. A missing
doc_id comes after all others. A very long text is a block of its own in one
task's memory. An empty table gives none. Other columns do not take part.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, released, written
from .words import Block, blocks, doubled, joined, split

LENGTH = 20
#: A perfect difference cover: each remainder is the difference of two of its members.
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = LENGTH - PERIOD + 1
#: Rows that Python works on at once for the results.
ROWS = 500
_LAST = "9223372036854775807"
_KEYS = ["o", "t"]
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_PLACE = pa.struct([("o", pa.int64()), ("t", pa.int64())])
_START = pa.struct([("o", pa.int64()), ("t", pa.int64()), ("start", pa.int32())])


class _Windows:
    """Hashes of a block's stretches of words and where they may stand."""

    def __init__(self, block: Block):
        n = np.diff(block.ends)
        self.row = np.repeat(np.arange(len(n), dtype=np.int32), n)
        self.at = (np.arange(len(self.row)) - np.repeat(block.ends[:-1], n)).astype(np.int32)
        self.left = np.repeat(n.astype(np.int32), n) - self.at  # words from here to the text's end
        self.four = doubled(doubled(block.hashes(), 1), 2)

    def places(self) -> np.ndarray:
        """The cover positions, in the block, of texts that have a window."""
        return np.flatnonzero((self.left + self.at >= LENGTH) & _IN_COVER[self.at % PERIOD] & (self.left >= ANCHOR))

    def anchors(self, starts: np.ndarray) -> np.ndarray:
        """Hashes of the 8 words at ``starts``; only there, as most places need none."""
        return joined(self.four[starts], self.four[starts + 4])

    def whole(self, starts: np.ndarray) -> np.ndarray:
        """Hashes of the windows at ``starts``."""
        return joined(joined(self.anchors(starts), self.anchors(starts + 8)), self.four[starts + 16])


def _lists(owner: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """One list for each of ``n`` rows, null where ``owner`` (ascending) names none of it."""
    counts = np.bincount(owner, minlength=n)
    ends = np.concatenate([[0], np.cumsum(counts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array(counts == 0))


def _by_block(batch: pa.RecordBatch, made):
    """``made`` of each block of a batch's texts and the batch's keys. Nothing of a block but
    its rows is left when the next one is cut."""
    o, t = (batch.column(c).to_numpy(zero_copy_only=False) for c in _KEYS)
    yield from map(lambda block: made(block, o, t), blocks(batch.column("text")))


def _anchors(batches):
    """A row for each different anchor of a block: hash, a document that has it, and, where
    the block itself repeats it, all documents of the block that do."""

    def made(block: Block, o: np.ndarray, t: np.ndarray) -> pa.RecordBatch:
        w = _Windows(block)
        at = w.places()
        h, row = w.anchors(at), w.row[at] + block.lo
        del w, at
        order = np.argsort(h, kind="stable")
        h, row = h[order], row[order]
        new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        many = np.bincount(group, minlength=len(first))[group] > 1 if len(h) else new
        once = many & (new | np.concatenate([[True], row[1:] != row[:-1]])) if len(h) else new  # a document once
        more = _lists(group[once], len(first), pa.StructArray.from_arrays([pa.array(o[row[once]]), pa.array(t[row[once]])], fields=list(_PLACE)))
        lead = row[first]
        out = pa.record_batch([pa.array(h[first].view(np.int64)), pa.array(o[lead]), pa.array(t[lead]), more], ["h", "o", "t", "more"])
        return out.take(pa.array(np.argsort(lead, kind="stable")))  # a document's rows together pack better

    for batch in batches:
        yield from _by_block(batch, made)


def _candidates(batches):
    """A row for each different window of a block that holds a repeated anchor: its hash and
    first place, and the places in the block that come after that."""

    def made(block: Block, o: np.ndarray, t: np.ndarray, ends: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        w = _Windows(block)
        at = w.places()
        ids = np.arange(block.hi - block.lo, dtype=np.uint64)
        known = joined(values[ends[block.lo] : ends[block.hi]], np.repeat(ids, np.diff(ends[block.lo : block.hi + 1])))
        at = at[np.isin(joined(w.anchors(at), ids[w.row[at]]), known)]
        covered = np.zeros(len(w.row) + 1, np.int64)
        np.add.at(covered, at - np.minimum(w.at[at], PERIOD - 1), 1)
        np.add.at(covered, at + 1, -1)
        starts = np.flatnonzero((np.cumsum(covered)[:-1] > 0) & (w.left >= LENGTH)) if len(w.row) else at
        h, row, start = w.whole(starts), w.row[starts] + block.lo, w.at[starts]
        order = np.lexsort((start, o[row], h))
        h, row, start = h[order], row[order], start[order]
        new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (o[row] > o[row][lead]) | (start > start[lead])
        asked = ~later  # the first place, and others that are it by doc_id and start
        place = [pa.array(o[row[later]]), pa.array(t[row[later]]), pa.array(start[later].astype(np.int32))]
        owner = (np.cumsum(asked) - 1)[later]
        more = _lists(owner, int(asked.sum()), pa.StructArray.from_arrays(place, fields=list(_START)))
        out = pa.record_batch(
            [pa.array(h[asked].view(np.int64)), pa.array(o[row[asked]]), pa.array(t[row[asked]]), pa.array(start[asked].astype(np.int32)), more],
            ["h", "o", "t", "start", "more"],
        )
        return out.take(pa.array(np.lexsort((start[asked], row[asked]))))

    for batch in batches:
        repeated = batch.column("hs")
        ends, values = repeated.offsets.to_numpy(), repeated.values.to_numpy(zero_copy_only=False).view(np.uint64)
        yield from _by_block(batch, partial(made, ends=ends, values=values))


def kept_words(words: list[bytes], starts) -> list[bytes]:
    """The words that no window at one of ``starts`` covers."""
    if starts is None or not len(starts):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.asarray(starts)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + LENGTH, len(words)), -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]


def _results(batches):
    for part in (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS)):
        out = []
        for doc_id, text, starts in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "starts")), strict=True):
            words = split(text)
            kept = kept_words(words, starts)
            out.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode()))
        columns = list(zip(*out, strict=True))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.record_batch([pa.array(c, x) for c, x in zip(columns, types, strict=True)], ["doc_id", "n_words", "n_removed", "kept_text"])


def _with(docs: DataFrame, lists: DataFrame, others: bool) -> DataFrame:
    """``docs`` with the lists of their keys; ``others``: also those without. Texts
    without a list stay where they are while the keys can be broadcast."""
    if lists.count() > BROADCAST_ROWS:
        return docs.join(lists, _KEYS, "left" if others else "inner")
    ids = F.broadcast(lists.select(_KEYS))
    found = docs.join(ids, _KEYS, "left_semi").hint("merge").join(lists.hint("merge"), _KEYS)
    if not others:
        return found
    name = next(c for c in lists.columns if c not in _KEYS)
    rest = docs.join(ids, _KEYS, "left_anti").withColumn(name, F.lit(None).cast(lists.schema[name].dataType))
    return found.unionByName(rest)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(o, t, starts): the windows of each text (o: doc_id, the last where it is
    null; t: hash of the text) that also start earlier."""
    rows = docs.mapInArrow(released(_anchors), "h long, o long, t long, more array<struct<o: long, t: long>>")
    met = rows.withColumn("n", F.count("*").over(Window.partitionBy("h"))).filter("n > 1 or more is not null")
    places = F.coalesce("more", F.array(F.struct("o", "t")))
    hs = met.select("h", F.explode(places).alias("p")).groupBy("p.o", "p.t").agg(F.collect_set("h").alias("hs"))  # one text's own
    hs = written(hs, "passage-anchors")

    near = _with(docs, hs, others=False).select("o", "t", "text", "hs")
    rows = near.mapInArrow(released(_candidates), "h long, o long, t long, start int, more array<struct<o: long, t: long, start: int>>")
    first = F.min(F.struct("o", "start")).over(Window.partitionBy("h"))
    rows = rows.withColumn("first", first).withColumn("later", F.struct("o", "start") > F.col("first")).filter("later or more is not null")
    own = F.when(F.col("later"), F.array(F.struct("o", "t", "start"))).otherwise(F.array().cast("array<struct<o: long, t: long, start: int>>"))
    places = F.concat(own, F.coalesce("more", F.array().cast("array<struct<o: long, t: long, start: int>>")))
    removed = rows.select(F.explode(places).alias("p")).groupBy("p.o", "p.t").agg(F.collect_set("p.start").alias("starts"))
    return written(removed, "passage-starts")


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed and kept_text, the words
    that stay joined by one blank."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(int(_LAST))).alias("o"), F.xxhash64(text).alias("t"),
    )
    found = _with(keyed, repeated_windows(keyed), others=True).select("doc_id", "text", "starts")
    return found.mapInArrow(released(_results), "doc_id long, n_words long, n_removed long, kept_text string")
