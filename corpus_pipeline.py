"""The corpus pipeline: quality, near-duplicates, secrets, source mix, tokens.

Each stage works on everything the stage before kept; all but the last return
the columns of ``documents``, extra ones included. Null, empty and very long
texts pass through all stages like others; a stage says below what it makes of
them. Empty tables give empty results.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.llm import mixing, near_dedup, quality, secret_scan
from clauseloom.llm.common import table, written
from clauseloom.llm.queries import bpe_digests

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


#: The columns that stages work with.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _apart(stage):
    """Keeps all other columns in one struct while a stage works, so that no name of theirs
    meets one of its own."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = [c for c in docs.columns if c not in COLUMNS]
        if not others:
            return stage(spark, docs, sf_dir)
        held = docs.select(*COLUMNS, F.struct(*[F.col(f"`{c}`") for c in others]).alias("others"))
        out = stage(spark, held, sf_dir)
        if "others" not in out.columns:
            return out
        return out.select(*[F.col(c) if c in COLUMNS else F.col("others").getField(c).alias(c) for c in docs.columns])

    return run


@_apart
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the site-level classifier rejects go. A null text counts as
    empty; rows that repeat a document are kept or go alike. Without usable labels
    all stay."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


@_apart
def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the smallest doc_id.
    Unlike texts of one doc_id are documents of their own and stay; rows that repeat
    doc_id and text leave one. Texts without words, and rows without doc_id, stay."""
    return near_dedup.distinct_documents(docs)


@_apart
def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets that are not widely copied examples are replaced by ``[SECRET]``; all rows
    stay, null texts as they are. n_chars follows the text."""
    return secret_scan.redacted(docs)


@_apart
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken to their targets: a document may be taken not at all, in part, or
    twice, which gives two rows. Documents without words stay once. A null source is
    one of its own. Reruns agree."""
    return mixing.mixed_texts(docs)


@_apart
def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes, a row for each row;
    a null text has no tokens."""
    return bpe_digests(docs, RANKS)


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", source_mix),
    ("byte-level BPE encoding and decoding", byte_bpe),
]

#: No SQL: a fitted classifier and hashed permutations decide; tests hold the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
