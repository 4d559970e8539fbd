"""Secret scans with corpus-wide ownership frequency.

Every text is searched for assigned secrets, access keys and long hex runs;
these base spans are always reported. Beside them, other long mixed runs are
candidates. All values, as SHA-256 hashes, are counted over the corpus by
distinct repositories and owners: values seen with ``SPREAD`` owners or more
are examples that get copied around, values of one owner look live. A
candidate that is no base span is reported (kind ``live``) only if its value
belongs to one owner and looks random.

Null or empty texts have no spans. Rows that repeat each get their spans. A
null owner or repository counts as one of its own. Offsets are code points,
ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from math import log2

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, salted_join, written

#: Owners from which on a value counts as an example.
SPREAD = 3
#: Bits per character from which on a value looks random, and length of a candidate.
RANDOM_BITS, CANDIDATE = 3.5, 32
KINDS = ("assign", "access", "hex", "live")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG = re.compile(r"[A-Za-z0-9+/_=-]+")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

HITS = "array<struct<kind:string,start:int,end:int,value_hash:string,random:boolean>>"


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(c / n * log2(c / n) for c in Counter(value).values())


def find_hits(text: str | None) -> list[tuple]:
    """(kind, start, end, value) by start, then kind; kind ``live`` marks candidates beside base spans."""
    if not text:
        return []
    out, lower = [], text.lower()
    if any(w in lower for w in WORDS):
        out += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if any(len(w) >= 24 for w in text.split()):
        out += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
        base = sorted((s, e) for _, s, e, _ in out)
        for m in LONG.finditer(text):
            v = m[0]
            if len(v) >= CANDIDATE and re.search("[0-9]", v) and re.search("[a-z]", v) and re.search("[A-Z]", v) and not any(s < m.end() and m.start() < e for s, e in base):
                out.append(("live", m.start(), m.end(), v))
    return sorted(out, key=lambda h: (h[1], KINDS.index(h[0])))


def _scan(texts: pd.Series) -> pd.Series:
    row = lambda h: {"kind": h[0], "start": h[1], "end": h[2], "value_hash": hashlib.sha256(h[3].encode()).hexdigest(), "random": entropy(h[3]) >= RANDOM_BITS}
    return texts.map(lambda t: [row(h) for h in find_hits(t)])


def ownership(hits: DataFrame) -> DataFrame:
    """(value_hash, rows, repositories, owners) of every value, in steps that combine before they shuffle."""
    by_repo = hits.groupBy("value_hash", "owner", "repository").agg(F.count("*").alias("rows"))
    by_owner = by_repo.groupBy("value_hash", "owner").agg(F.sum("rows").alias("rows"), F.count("*").alias("repositories"))
    return by_owner.groupBy("value_hash").agg(F.sum("rows").alias("rows"), F.sum("repositories").alias("repositories"), F.count("*").alias("owners"))


def scan(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """One row per input row: doc_id, text_md5 and ``spans``, array of (start,
    rank, kind, end, value_hash, rows, repositories, owners, verdict), by start, then kind."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    rows = docs.select(
        "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"),
        part(owner).alias("owner"), F.concat_ws("\1", *map(part, repository)).alias("repository"),
        F.pandas_udf(_scan, HITS)(F.col("text")).alias("hits"),
    )
    rows = written(rows, "secret-hits")
    marked = F.struct("doc_id", "text_md5", "owner", "repository")
    hits = rows.filter(F.size("hits") > 0).dropDuplicates(["doc_id", "text_md5", "owner", "repository"]).select(marked.alias("row"), F.explode("hits").alias("h"))
    flat = rows.filter(F.size("hits") > 0).select("owner", "repository", F.explode("hits.value_hash").alias("value_hash"))
    counts = written(ownership(flat), "secret-owners")
    known = salted_join(hits.select("row", "h", F.col("h.value_hash").alias("value_hash")), counts, "value_hash", F.col("row"))
    verdict = F.when(F.col("owners") >= SPREAD, "example").when((F.col("owners") == 1) & F.col("h.random"), "live").otherwise("shared")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("h.kind"))
    span = F.struct(F.col("h.start").alias("start"), rank.alias("rank"), F.col("h.kind").alias("kind"), F.col("h.end").alias("end"), "value_hash", "rows", "repositories", "owners", "verdict")
    known = known.withColumn("verdict", verdict).filter("h.kind <> 'live' or verdict = 'live'")
    spans = known.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))  # of one text
    spans = spans.select("row.*", "spans")
    same = [rows[c].eqNullSafe(spans[c]) for c in ("doc_id", "text_md5", "owner", "repository")]
    empty = F.array().cast(spans.schema["spans"].dataType)
    found = rows.join(spans, same[0] & same[1] & same[2] & same[3], "left")
    return found.select(rows["doc_id"], rows["text_md5"], F.coalesce(spans["spans"], empty).alias("spans"))


def redacted(docs: DataFrame, verdicts: tuple[str, ...] = ("live", "shared")) -> DataFrame:
    """``docs`` with the spans of the given verdicts replaced by ``[SECRET]``; examples stay."""
    found = scan(docs)
    bad = F.filter("spans", lambda s: s["verdict"].isin(*verdicts))
    marks = found.select("doc_id", "text_md5", F.transform(bad, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("_marks")).filter(F.size("_marks") > 0)
    marks = marks.dropDuplicates(["doc_id", "text_md5"]).select(F.col("doc_id").alias("_d"), F.col("text_md5").alias("_m"), "_marks")
    marks = checked_broadcast(written(marks, "secret-marks"))
    same = docs["doc_id"].eqNullSafe(F.col("_d")) & (F.md5("text") == F.col("_m"))
    text = F.pandas_udf(_redact, "string")(docs["text"], F.col("_marks"))
    both = docs.join(marks, same).withColumn("_text", text)  # only texts with marks go through Python
    new = [F.length("_text").cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else F.col("_text").alias(c) if c == "text" else docs[c] for c in docs.columns]
    return docs.join(marks, same, "left_anti").unionByName(both.select(new))


def _redact(texts: pd.Series, marks: pd.Series) -> pd.Series:
    def one(text, spans):
        if text is None or spans is None:
            return text
        out, at = [], 0
        for m in spans:
            if m["end"] > at:
                out += [text[at : max(at, m["start"])], "[SECRET]"] if m["start"] >= at else []
                at = m["end"]
        return "".join([*out, text[at:]])

    return pd.Series([one(t, m) for t, m in zip(texts, marks, strict=True)])
