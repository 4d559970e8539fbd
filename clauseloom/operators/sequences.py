"""Order-dependent rules of one document, as small functions for applyInPandas.

Each is grouped by document (or run), so work spreads over partitions; one
document is one group, whose size is that of a document's block list.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable
from difflib import SequenceMatcher
from itertools import chain, groupby, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .records import TRANSITIONS


def walk_groups(rows: DataFrame, keys: list[str], order: list[str | Column], f: Callable[[list[tuple]], Iterable[tuple]], schema: dict[str, str]) -> DataFrame:
    """Runs ``f`` on the rows of each group, as tuples in order, and returns the tuples it
    gives. Groups follow one another in sorted partitions, so small ones cost no call of
    their own, and a task holds one group at a time. ``schema``: simple types by column."""
    at = [rows.columns.index(k) for k in keys]
    ddl = ", ".join(f"{c} {t}" for c, t in schema.items())
    given = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches):
        read = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        made = chain.from_iterable(f(list(g)) for _, g in groupby(read, lambda r: [r[i] for i in at]))
        while part := list(islice(made, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), given.types, strict=True)], schema=given)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, ddl)


def number_headings(levels: list[int | None], fill: bool = True) -> list[str | None]:
    """Hierarchical numbers. A heading counts its level up and resets deeper ones;
    with ``fill`` missing parents become 1, else they stay 0."""
    counters, out = [], []
    for level in levels:
        if level is None or level != level:
            out.append(None)
            continue
        level = int(level)
        counters += [0] * (level - len(counters))
        if fill:
            counters[: level - 1] = [c or 1 for c in counters[: level - 1]]
        counters[level - 1] += 1
        counters[level:] = [0] * (len(counters) - level)
        out.append(".".join(map(str, counters[:level])))
    return out


def roman(n: int) -> str:
    out = ""
    for value, sign in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        out += sign * (n // value)
        n %= value
    return out


def letter(n: int) -> str:
    """A to Z, then AA, BB and on."""
    return chr(65 + (n - 1) % 26) * ((n - 1) // 26 + 1)


FORMATS = {
    "decimal": str, "upperRoman": roman, "lowerRoman": lambda n: roman(n).lower(),
    "upperLetter": letter, "lowerLetter": lambda n: letter(n).lower(), "bullet": lambda n: "•",
}


def list_labels(levels: list[int], formats: list[str], templates: list[str], starts: list[int]) -> list[str]:
    """Labels of one numbered list; ``templates[l]`` such as ``%1.%2)`` names the levels it shows."""
    counters, out = {}, []
    for level in map(int, levels):
        counters[level] = counters.get(level, starts[level] - 1) + 1
        for deeper in [k for k in counters if k > level]:
            del counters[deeper]
        show = lambda m: FORMATS[formats[int(m[1]) - 1]](counters.get(int(m[1]) - 1, starts[int(m[1]) - 1]))
        out.append("•" if formats[level] == "bullet" else re.sub(r"%(\d)", show, templates[level]))
    return out


CAPTION = re.compile(r"^(Figure|Table)\s+(\d+)")
REFERENCE = re.compile(r"\b(Figure|Table)\s+(\d+)")


def renumber_captions(lines: list[str], headings: list[bool]) -> list[str]:
    """Figures and tables numbered in order. A reference takes the number of the
    caption that last had its old number since the last heading, else the first
    caption of that old number in the document; unknown references stay."""
    counts, queue, new = {"Figure": 0, "Table": 0}, {}, []
    for line in lines:
        m = CAPTION.match(line)
        if m:
            counts[m[1]] += 1
            queue.setdefault((m[1], m[2]), []).append(counts[m[1]])
        new.append(counts[m[1]] if m else None)
    recent, out = {}, []
    for line, heading, number in zip(lines, headings, new, strict=True):
        if heading:
            recent = {}
        m = CAPTION.match(line)
        if m:
            recent[m[1], m[2]] = number
        fix = lambda r: f"{r[1]} {recent.get((r[1], r[2])) or queue.get((r[1], r[2]), [r[2]])[0]}"
        head = f"{m[1]} {number}" if m else ""
        out.append(head + REFERENCE.sub(fix, line[m.end() if m else 0 :]))
    return out


def _places(texts: list[str]) -> dict[str, list[int]]:
    places: dict[str, list[int]] = {}
    for i, text in enumerate(texts):
        places.setdefault(text, []).append(i)
    return places


def _next(places: dict[str, list[int]], text: str, at: int) -> int | None:
    """The first place of a text at or behind ``at``."""
    own = places.get(text, [])
    k = bisect_left(own, at)
    return own[k] if k < len(own) else None


def match_in_order(merged: list[str], source: list[str]) -> list[int | None]:
    """For each merged paragraph the next equal source paragraph behind the pointer; misses leave the pointer."""
    places, at, out = _places(source), 0, []
    for text in merged:
        hit = _next(places, text, at)
        out.append(hit)
        at = at if hit is None else hit + 1
    return out


def token_diff(old: str, new: str) -> list[tuple[str, bool]]:
    """Segments of the new text; inserted or replaced tokens (not blanks) are marked."""
    token = re.compile(r"\s+|\w+|[^\w\s]")
    a, b = token.findall(old or ""), token.findall(new or "")
    out: list[tuple[str, bool]] = []
    for tag, _, _, j1, j2 in SequenceMatcher(a=a, b=b).get_opcodes():
        for t in b[j1:j2]:
            mark = tag != "equal" and not t.isspace()
            out[-1:] = [(out[-1][0] + t, mark)] if out and out[-1][1] == mark else [*out[-1:], (t, mark)]
    return out or [("", False)]


def token_diffs(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([[{"text": t, "marked": m} for t, m in token_diff(a, b)] for a, b in zip(old, new, strict=True)])


def fold_status(events: list[str], now: str | None = None) -> str | None:
    """The state after allowed transitions; forbidden ones are skipped."""
    for to in events:
        if now is None or to == now or to in TRANSITIONS.get(now, ()):
            now = to
    return now


def grant_leases(times: list[float], ops: list[str], actors: list, hold: float) -> list[tuple]:
    """(outcome, holder, until) after each request in time order; a lease lasts ``hold``.

    acquire: granted where no one else's lease runs, extended where the own one does.
    refresh: the same for the holder, even of a lease that ran out; others are denied.
    release: the holder gives the lease up. takeover: always granted.
    """
    holder, until, out = None, None, []
    for t, op, who in zip(times, ops, actors, strict=True):
        runs, own = holder is not None and until > t, holder is not None and holder == who
        if op == "release":
            said = "released" if own else "denied"
            holder, until = (None, None) if own else (holder, until)
        elif op == "takeover" or own or (op == "acquire" and not runs):
            said = "extended" if runs and own and op != "takeover" else "granted"
            holder, until = who, t + hold
        else:
            said = "denied"
        out.append((said, holder, until))
    return out
