"""Typed blocks of documents with the texts that they are found by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Least characters of a cell, and of a row of cells, to be a probe.
CELL, ROW = 20, 24


def table_probes(cells, hide: Column) -> Column:
    """Probe texts of a table, given as rows of cells: each long cell, then its row's
    cells joined if they are long together, without repeats in order of appearance.
    Cells that ``hide`` lists and empty ones do not count."""
    shown = lambda row: F.filter(F.transform(F.coalesce(row, F.array().cast("array<string>")), T.norm_text), lambda c: (c != "") & ~F.array_contains(hide, c))
    rows = F.transform(F.coalesce(T.col(cells), F.array().cast("array<array<string>>")), shown)
    line = lambda row: F.array_join(row, " ")
    probes = F.transform(rows, lambda row: F.concat(F.filter(row, lambda c: F.length(c) >= CELL), F.filter(F.array(line(row)), lambda x: F.length(x) >= ROW)))
    return F.array_distinct(F.flatten(probes))


def typed_blocks(parts: DataFrame, hide: DataFrame | None = None, drawing_type: str = "drawing", drawing_probes: Column | None = None) -> DataFrame:
    """Blocks (doc_id, pos, type, norm, probes, has_drawing) of the parts of documents
    (doc_id, pos, kind ``paragraph`` or ``table``, text, cells, has_drawing).

    A paragraph with text is found by that text; one without, or whose text is among a
    document's hidden ones (``hide``: doc_id, texts), counts only for its drawing,
    which has no text of its own and takes ``drawing_probes``. A table is found by
    its long cells and rows, and drops out without any. Positions stay those of the
    parts. Nulls count as empty texts, no cells and no drawing."""
    none = F.array().cast("array<string>")
    rows = parts if hide is None else parts.join(hide.select("doc_id", F.col("texts").alias("hidden")), "doc_id", "left")
    hidden = none if hide is None else F.coalesce("hidden", none)
    drawn, norm = F.coalesce("has_drawing", F.lit(False)), T.norm_text("text")
    is_table = F.col("kind") == "table"
    read = ~is_table & (norm != "") & ~F.array_contains(hidden, norm)
    kind = F.when(is_table, "table").when(read, "paragraph").when(drawn, drawing_type)
    probes = F.when(is_table, table_probes("cells", hidden)).when(read, F.array(norm)).otherwise(none if drawing_probes is None else drawing_probes)
    out = rows.select("doc_id", "pos", kind.alias("type"), F.when(read, norm).otherwise("").alias("norm"), probes.alias("probes"), (drawn & ~is_table).alias("has_drawing"))
    return out.filter(F.col("type").isNotNull() & ((F.col("type") != "table") | (F.size("probes") > 0)))
