"""Quality by hierarchical empirical Bayes.

A logistic classifier on plain text statistics, fitted on at most ``TRAIN``
labelled rows (chosen by a hash), gives each document a log-odds. Hosts and
paths (host and language here; any two columns) get posteriors by shrinking:
a host's mean towards the global mean, a path's mean towards its host's, each
with the weight that the variance between groups supports, so sparse sites stay
near their priors. A document's log-odds are then moved from the global prior
to its path's posterior, in which its own evidence does not count.

Null texts count as empty; a null host or path is a group of its own. Labels of
documents that are absent are ignored; of a doc_id with several texts, the one of
the smallest digest is fitted, and of several labels the larger one. Without any
usable labels every document is kept. Repeated rows are scored alike, rows with
one doc_id and other texts each by their own text.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, salted_join, written

#: Most labelled rows the classifier is fitted on.
TRAIN = 20_000
#: Names of the statistics, in order.
STATISTICS = ("log_words", "word_chars", "odd_chars", "digit_chars", "upper_words", "odd_ends", "odd_words", "repeated_words", "repeated_lines", "line_words")

_PLAIN = re.compile(r"[^\W_]+|\s+")
_END = re.compile(r"[^\w\s.,;:?'\")\]]")


def statistics(text: str | None) -> list[float]:
    text = text or ""
    words, n = text.split(), max(1, len(text))
    if not words:
        return [0.0] * len(STATISTICS)
    m, sample = len(words), len(text)
    plain = sum(map(len, _PLAIN.findall(text)))
    marks = text.count(".") + text.count(",") + text.count("'") + text.count("-")
    lines = text.split("\n")
    return [
        float(np.log1p(m)),
        min(sample / m, 40.0) / 10,
        max(0, n - plain - marks) / n,
        sum(map(text.count, "0123456789")) / n,
        sum(w.isupper() and len(w) > 1 for w in words) / m,
        sum(_END.match(w[-1]) is not None for w in words) / m,
        sum(not any(map(str.isalnum, w)) for w in words) / m,
        1 - len(set(words)) / m,
        1 - len(set(lines)) / len(lines),
        min(m / len(lines), 100.0) / 100,
    ]


def _statistics(texts: pd.Series) -> pd.Series:
    return texts.map(statistics)


def text_statistics(text: Column) -> Column:
    return F.pandas_udf(_statistics, "array<double>")(text)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights (the last one the intercept) by Newton's method."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    keep = np.full(z.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def bounded(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most about ``most`` rows, by a hash of ``key``: the same ones at every run."""
    n = rows.count()
    return rows if n <= most else rows.filter(F.pmod(F.xxhash64(key, F.lit("fit")), F.lit(1_000_000)) < int(1e6 * most / n))


def site_sums(scored: DataFrame) -> DataFrame:
    """(host, path) with the counts and sums of p of both (n, s and hn, hs), the global
    ``prior``, and the strengths kh and kp of the priors that hosts and paths are
    shrunk to: the mean variance within groups over that between them, by moments."""
    paths = written(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("q").alias("hq"))
    top = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
    prior = min(max((top["s"] or 0) / (top["n"] or 1), 1e-3), 1 - 1e-3)
    kh = _strength(hosts, F.col("hn"), F.col("hs"), F.col("hq"), F.lit(prior))
    hosts = hosts.withColumn("host_mean", (F.col("hs") + kh * prior) / (F.col("hn") + kh))
    both = paths.join(hosts.select("host", "hn", "hs", "host_mean"), "host")
    kp = _strength(both, F.col("n"), F.col("s"), F.col("q"), F.col("host_mean"))
    return both.select("host", "path", "n", "s", "hn", "hs", F.lit(prior).alias("prior"), F.lit(kh).alias("kh"), F.lit(kp).alias("kp"))


def posteriors(p: Column) -> tuple[Column, Column]:
    """The host's and the path's mean for a document of probability ``p``, without it."""
    c = F.col
    host = (c("hs") - p + c("kh") * c("prior")) / (c("hn") - 1 + c("kh"))
    return host, (c("s") - p + c("kp") * host) / (c("n") - 1 + c("kp"))


def _strength(groups: DataFrame, n: Column, s: Column, q: Column, centre: Column) -> float:
    got = groups.agg(F.sum(q - s * s / n).alias("within"), F.sum(n).alias("n"), F.sum(n * F.pow(s / n - centre, 2)).alias("between"), F.count("*").alias("groups")).first()
    if not got["n"]:
        return 1.0
    within = got["within"] / got["n"]
    between = max(0.0, (got["between"] - got["groups"] * within) / got["n"])
    return float(min(max(within / between if between > 0 else 1e6, 1.0), 1e6))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """One row per input row: doc_id, text_md5, evidence (log-odds), host_mean,
    path_mean, quality (probability) and keep (quality of a half or more)."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    rows = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), part(host).alias("host"), part(path).alias("path"), text_statistics(F.col("text")).alias("x"))
    rows = written(rows, "quality-rows")
    marks = bounded(labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("y")), "doc_id", TRAIN)
    one = rows.join(F.broadcast(marks), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text_md5", "x")).alias("r"), F.max("y").alias("y"))
    train = one.orderBy("doc_id").select("r.x", "y").toArrow()  # at most TRAIN labels
    y = train["y"].to_numpy().astype(float)
    if len(y) and 0 < y.sum() < len(y):
        mean, scale, w = fit_logistic(np.array(train["x"].to_pylist()), y)
    else:
        mean, scale, w = np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)), np.array([0.0] * len(STATISTICS) + [10.0])
    terms = [(F.get("x", F.lit(i)) - float(mean[i])) * float(w[i] / scale[i]) for i in range(len(STATISTICS))]
    evidence = sum(terms, F.lit(float(w[-1])))
    scored = rows.withColumn("evidence", F.greatest(F.least(evidence, F.lit(15.0)), F.lit(-15.0))).withColumn("p", 1 / (1 + F.exp(-F.col("evidence"))))
    sites = written(site_sums(scored).withColumn("site", F.concat_ws("\1", "host", "path")).drop("host", "path"), "quality-sites")
    out = salted_join(scored.withColumn("site", F.concat_ws("\1", "host", "path")), sites, "site", F.col("text_md5"))
    host_mean, path_mean = posteriors(F.col("p"))
    out = out.withColumn("host_mean", host_mean).withColumn("path_mean", path_mean)
    odds = lambda c: F.log(c / (1 - c))
    clamp = lambda c: F.greatest(F.least(c, F.lit(1 - 1e-3)), F.lit(1e-3))
    final = F.col("evidence") - odds(F.col("prior")) + odds(clamp(F.col("path_mean")))
    quality = 1 / (1 + F.exp(-final))
    return out.select("doc_id", "text_md5", "evidence", "host_mean", "path_mean", quality.alias("quality"), (quality >= 0.5).alias("keep"))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps."""
    bad = classify(docs, labels).filter("not keep").select(F.col("doc_id").alias("_d"), F.col("text_md5").alias("_m")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("_d")) & (F.md5(F.coalesce(docs["text"], F.lit(""))) == F.col("_m"))
    return docs.join(checked_broadcast(written(bad, "quality-bad")), same, "left_anti")
