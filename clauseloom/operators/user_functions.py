"""Places where a user's Python functions run, and the ones the queries use."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def payload_filter(rows: DataFrame, column: str, accept: Callable[[dict], bool]) -> DataFrame:
    """Rows whose JSON payload ``accept`` takes; bad JSON is an empty object, an exception no match."""

    def test(payloads: pd.Series) -> pd.Series:
        def one(text):
            try:
                value = json.loads(text)
            except (TypeError, ValueError):
                value = {}
            try:
                return bool(accept(value if isinstance(value, dict) else {}))
            except Exception:  # the contract of the hook: a failing predicate does not match
                return False

        return payloads.map(one).astype(bool)

    return rows.filter(F.pandas_udf(test, "boolean")(F.col(column)))


def choose(candidates: DataFrame, pick: Callable[[pd.DataFrame], int | None]) -> DataFrame:
    """(doc_id, pos): the candidate that ``pick`` names for each document, if it is one of them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        answer = pick(pdf.sort_values("pos"))
        return pdf[pdf.pos == answer][["doc_id", "pos"]].head(1)

    return candidates.groupBy("doc_id").applyInPandas(run, "doc_id long, pos long")


def map_chunks(chunks: DataFrame, f: Callable[[str], str]) -> DataFrame:
    """Chunks with ``f`` applied to their text, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(text=pdf.text.map(f))

    return chunks.mapInPandas(run, chunks.schema)


def even_total(payload: dict) -> bool:
    return sum(v for v in payload.values() if isinstance(v, int)) % 2 == 0


def longest_line(pdf: pd.DataFrame) -> int:
    return int(pdf.loc[pdf.line.str.len().idxmax(), "pos"])


def mark_vowel(text: str) -> str:
    return text.replace("e", "E")
