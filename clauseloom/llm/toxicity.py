"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

The lexicon is learned from labelled rows outside the held-out fold (those with
crc32 of the doc_id's text not 0 mod 5; at most ``TRAIN`` rows, by a hash):
words and word beginnings that toxic documents hold far more often than others.
It becomes a trie; the Levenshtein automaton of every term, intersected with
the trie, is determinised as words run through it, so a misspelled word costs a
few table look-ups. Hits are told apart by distance and by context: inside
quotation marks or near a reporting word a hit is quotation, else abuse. A
logistic model on these counts gives the score.

Labels, lang, source and doc_id never enter a score. Null and empty texts get
the score of a text without hits. Without labels of both kinds all scores are
those of a fixed prior on an empty lexicon.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from math import log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .quality import bounded, fit_logistic

#: Most labelled rows that are learned from; they bound the lexicon and the fit.
TRAIN = 30_000
#: Least likelihood ratio (chi-square, one degree) between toxic and other documents of a term.
LEAST = 24.0
#: Lengths of the word beginnings that may be terms.
HEADS = (4, 5, 6)
#: Words on either side that make a hit's context.
WINDOW = 5
#: Words that report what others said.
REPORTING = frozenset("said says say wrote writes quote quoted quotes called calls dit sagte dijo".split())
#: Words whose match a worker keeps, and states after which its automaton starts anew.
HELD, STATES = 500_000, 100_000
FEATURES = ("exact", "exact_quoted", "near", "near_quoted", "head", "head_quoted", "weight", "share")

_WORD = re.compile(r"\w+")
#: Quotation marks, and the blank lines between paragraphs.
_MARKS = re.compile(r'["“”«»]|\n\s*\n')
_CLOSES = {'"': '"', "”": "“", "»": "«"}


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the doc_id as text is 0 mod 5 (null: as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def allowed(term: str) -> int:
    """Edits within which a word counts as this term misspelled."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """Levenshtein automata of all terms of a trie, as one table of states built as met.

    A state is a set of (trie node, edits). ``heads`` are terms that match the
    beginning of a word exactly; ``words`` match within their allowed edits.
    """

    def __init__(self, words: dict[str, float], heads: dict[str, float]):
        self.words, self.heads = words, heads
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        self.reach = [0]
        for term in words:
            at = 0
            self.reach[0] = max(self.reach[0], allowed(term))
            for c in term:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.reach.append(0)
                at = self.children[at][c]
                self.reach[at] = max(self.reach[at], allowed(term))
            self.ends[at] = term
        self.seen: dict[str, tuple | None] = {}
        self._anew()

    def _anew(self) -> None:
        """States by number; the moves of each, filled in as they are met."""
        self.states: list[tuple] = [(), self._close({0: 0})]
        self.numbers = {state: i for i, state in enumerate(self.states)}
        self.moves: list[dict[str, int]] = [{}, {}]

    def _close(self, nodes: dict[int, int]) -> tuple:
        """Adds what leaving out letters of the term reaches."""
        todo = list(nodes)
        while todo:
            at = todo.pop()
            e = nodes[at] + 1
            for to in self.children[at].values():
                if e <= self.reach[to] and nodes.get(to, 9) > e:
                    nodes[to] = e
                    todo.append(to)
        return tuple(sorted(nodes.items()))

    def _step(self, state: tuple, c: str) -> tuple:
        out: dict[int, int] = {}
        for at, e in state:
            if e < self.reach[at] and out.get(at, 9) > e + 1:
                out[at] = e + 1
            for x, to in self.children[at].items():
                cost = e + (x != c)
                if cost <= self.reach[to] and out.get(to, 9) > cost:
                    out[to] = cost
        return self._close(out)

    def _move(self, at: int, c: str) -> int:
        state = self._step(self.states[at], c)
        to = self.numbers.get(state)
        if to is None:
            to = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        self.moves[at][c] = to
        return to

    def match(self, word: str) -> tuple[str, int, float] | None:
        """(kind, edits, weight) of the best term for a word, or None."""
        if word in self.seen:
            return self.seen[word]
        found = self._match(word)
        if len(self.seen) < HELD:
            self.seen[word] = found
        return found

    def _match(self, word: str):
        if word in self.words:
            return "exact", 0, self.words[word]
        heads = [h for n in HEADS if (h := word[:n]) in self.heads and len(word) > n]
        if heads:
            return "head", 0, max(self.heads[h] for h in heads)
        if len(self.states) > STATES:
            self._anew()
        at = 1
        for c in word:
            to = self.moves[at].get(c)
            at = self._move(at, c) if to is None else to
            if not at:
                break
        ends = [(e, t) for node, e in self.states[at] if (t := self.ends[node]) and e <= allowed(t)]
        if ends:
            e, t = min(ends)
            return "near", e, self.words[t] / (1 + e)
        return None


def quotations(text: str) -> list[tuple[int, int]]:
    """Spans from an opening mark to its closing one; each kind is paired by itself, within a paragraph."""
    spans, opened = [], {}
    for m in _MARKS.finditer(text):
        mark = m[0]
        if mark.isspace():
            opened.clear()
        elif (begin := opened.pop(_CLOSES.get(mark), None)) is not None:
            spans.append((begin, m.end()))
        elif mark in '"“«':
            opened.setdefault(mark, m.start())
    return spans


def features(text: str | None, automaton: Automaton) -> list[float]:
    """Counts of hits by kind and context, the summed weight and the share of words."""
    lower = (text or "").lower()
    words = _WORD.findall(lower)
    match = automaton.match
    if not words or not any(map(match, set(words))):
        return [0.0] * len(FEATURES)
    quotes = quotations(lower)
    count, weight, hits = Counter(), 0.0, 0
    for i, m in enumerate(_WORD.finditer(lower)):
        if (got := match(m[0])) is None:
            continue
        near = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
        quoted = any(a < m.start() and m.end() < b for a, b in quotes) or not REPORTING.isdisjoint(near)
        count[got[0], quoted] += 1
        weight += got[2] * (0.3 if quoted else 1.0)
        hits += 1
    kinds = [log1p(count[k, q]) for k in ("exact", "near", "head") for q in (False, True)]
    return [*kinds, log1p(max(0.0, weight)), min(1.0, 20 * hits / len(words))]


def _terms(batches):
    """Words and beginnings of the documents, with the toxic and other documents that hold them."""
    pos, neg = Counter(), Counter()
    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(_WORD.findall((text or "").lower()))
            heads = {w[:n] + "*" for w in words for n in HEADS if len(w) > n}
            (pos if y else neg).update(words | heads)
    names = list(pos | neg)
    for at in range(0, len(names), 50_000):
        part = names[at : at + 50_000]
        yield pa.record_batch([pa.array(part, pa.string()), pa.array([pos[t] for t in part], pa.int64()), pa.array([neg[t] for t in part], pa.int64())], ["term", "pos", "neg"])


def learn_lexicon(train: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """(words, heads) with their log-odds, from rows (text, y). The likelihood ratio alone decides, so
    their number is bounded by the rows learned from, each term standing in three of them."""
    totals = train.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).first()
    if not totals[0] or not totals[1]:
        return {}, {}
    counts = train.select("text", "y").mapInArrow(_terms, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    p, q = F.col("pos") + 0.5, F.col("neg") + 0.5
    odds = F.log(p / (totals[0] + 1)) - F.log(q / (totals[1] + 1))
    xlogx = lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)
    pos, neg, n, m = F.col("pos").cast("double"), F.col("neg").cast("double"), F.lit(float(totals[0])), F.lit(float(totals[1]))
    cells = xlogx(pos) + xlogx(neg) + xlogx(n - pos) + xlogx(m - neg) + xlogx(n + m)
    ratio = 2 * (cells - xlogx(pos + neg) - xlogx(n + m - pos - neg) - xlogx(n) - xlogx(m))
    best = counts.filter("pos >= 3").select("term", odds.alias("odds"), ratio.alias("ratio")).filter((F.col("ratio") >= LEAST) & (F.col("odds") > 0)).orderBy("term")
    rows = best.collect()
    heads = {r["term"][:-1]: r["odds"] for r in rows if r["term"].endswith("*")}
    return {r["term"]: r["odds"] for r in rows if not r["term"].endswith("*")}, heads


#: This worker's automaton, by model: what it has met serves later tasks.
_BUILT: dict[str, Automaton] = {}


def _automaton(name: str, model) -> Automaton:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Automaton(*model.value)
    return _BUILT[name]


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    marks = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    marks = F.broadcast(bounded(marks, "doc_id", TRAIN))
    train = written(docs.select("doc_id", "text").join(marks, "doc_id").select("text", "y"), "toxic-train")
    words, heads = learn_lexicon(train)
    model, name = docs.sparkSession.sparkContext.broadcast((words, heads)), uuid.uuid4().hex  # bounded by the TRAIN rows

    def vectors(texts: pd.Series) -> pd.Series:
        automaton = _automaton(name, model)
        return texts.map(lambda t: features(t, automaton))

    x = F.pandas_udf(vectors, "array<double>")
    got = train.select("y", x(F.col("text")).alias("x")).toArrow()
    y = got["y"].to_numpy().astype(float)
    if len(y) and 0 < y.sum() < len(y):
        mean, scale, w = fit_logistic(np.array(got["x"].to_pylist()), y, ridge=0.1)
    else:
        mean, scale, w = np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.array([1.0] * len(FEATURES) + [-3.0])

    def scores(batches):
        automaton = _automaton(name, model)
        for texts in batches:
            x = np.array([features(t, automaton) for t in texts]).reshape(len(texts), len(FEATURES))
            yield pd.Series(1 / (1 + np.exp(-np.clip(((x - mean) / scale) @ w[:-1] + w[-1], -30, 30))))

    scores.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    p = F.pandas_udf(scores, "double")(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), p.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
