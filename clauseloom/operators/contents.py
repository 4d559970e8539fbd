"""Contents lines, captions of figures, and numbers in the texts of headings.

Paragraphs come as rows; what an office file says of one (style, field code, link
anchors, tab leaders) stands in columns beside its text.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .sequences import number_headings

#: Words that mark a contents style, and the leaders of contents tabs.
CONTENTS_STYLES, LEADERS = ("TOC", "目錄", "目录"), ("dot", "middleDot")
#: Styles of figure captions.
CAPTION_STYLES = ("caption", "figurecaption", "figcaption")
#: A leading number and the text behind it.
NUMBERED = r"^\s*(\d+(?:[.．]\d+)*)[.．]?\s*(\S.*)$"


def _text(x) -> Column:
    return F.coalesce(T.col(x), F.lit(""))


def is_contents_line(style_name="style_name", style_id="style_id", field="field", anchors="anchors", leaders="leaders") -> Column:
    """Whether a paragraph is a contents line: by its style, a contents field, a link to
    a contents anchor, or a tab with a dotted leader. Nulls say nothing."""
    style = F.upper(F.concat_ws(" ", T.col(style_id), T.col(style_name)))
    styled = F.lit(False)
    for word in CONTENTS_STYLES:
        styled = styled | style.contains(word)
    none = F.array().cast("array<string>")
    linked = F.exists(F.coalesce(T.col(anchors), none), lambda a: F.coalesce(a, F.lit("")).startswith("_Toc"))
    dotted = F.exists(F.coalesce(T.col(leaders), none), lambda x: F.coalesce(x, F.lit("")).isin(*LEADERS))
    return styled | F.upper(_text(field)).contains("TOC") | linked | dotted


def contents_parts(text, style_name="style_name", style_id="style_id") -> Column:
    """Struct (number, title, page, level) of a contents line. The page is a last part of
    digits behind a tab, else up to five digits at the end of a word that holds no
    others. The level is that of the style's name or id, else the count of number parts."""
    chunks = F.filter(F.transform(F.split(F.translate(_text(text), "\n\r", " "), "\t"), T.norm_text), lambda c: c != "")
    n = F.size(chunks)
    last = F.get(chunks, n - 1)
    tabbed = (n >= 2) & last.rlike(r"^\d+$")
    merged = F.array_join(chunks, " ")
    head, digits = (F.regexp_extract(merged, r"^(.*?)(\d{1,5})$", i) for i in (1, 2))
    ends = (digits != "") & ~F.regexp_extract(head, r"([^ ]*)$", 1).rlike(r"\d")
    title = F.when(tabbed, F.array_join(F.slice(chunks, F.lit(1), F.greatest(n - 1, F.lit(0))), " ")).when(ends, F.trim(head)).otherwise(merged)
    page = F.when(tabbed, last).when(ends, digits).otherwise("")
    number = F.regexp_replace(F.regexp_extract(title, r"^(\d+(?:[.．]\d+)*)", 1), "．", ".")
    rest = F.trim(F.regexp_replace(title, r"^\d+(?:[.．]\d+)*", ""))
    by_style = lambda s: F.nullif(F.regexp_extract(_text(s), r"(?i)TOC\s*(\d+)", 1), F.lit("")).cast("int")
    level = F.coalesce(by_style(style_name), by_style(style_id), F.when(number != "", F.size(F.split(number, r"\."))))
    return F.struct(number.alias("number"), rest.alias("title"), page.alias("page"), level.alias("level"))


def contents_rows(paragraphs: DataFrame) -> DataFrame:
    """The contents lines of documents (doc_id, pos, text and signals) with their parts;
    lines with neither number nor title drop out."""
    rows = paragraphs.filter(is_contents_line()).select("doc_id", "pos", contents_parts("text").alias("p"))
    return rows.select("doc_id", "pos", "p.*").filter("number <> '' or title <> ''")


def caption_accepted(text, style) -> Column:
    """Struct (accepted, reason): whether the paragraph below a figure is its caption. A
    caption or heading style or a figure's number says so; else a short line will do."""
    t, s = T.norm_text(text), F.lower(T.norm_text(style))
    long_, short = F.length(t) > 180, (T.words(t) <= 20) & (F.length(t) <= 120)
    reason = (
        F.when(t == "", "empty_text").when(s.isin(*CAPTION_STYLES) | s.startswith("heading"), "style_match")
        .when(t.rlike(r"(?i)^(figure|fig\.?)\s+\d+(?:\s*[-.:])?\s*\S+"), "figure_number_prefix")
        .when(long_, "too_long").when(short, "short_standalone_line").otherwise("no_caption_signal")
    )
    return F.struct(reason.isin("style_match", "figure_number_prefix", "short_standalone_line").alias("accepted"), reason.alias("reason"))


def heading_level(text, style) -> Column:
    """Level of a numbered heading: that of its heading style, else, for a line that reads
    like a heading, the count of its number's parts. Null for other lines."""
    t = T.norm_text(text)
    styled = F.nullif(F.regexp_extract(F.regexp_replace(_text(style), T.SPACE, ""), r"(?i)heading([1-9])", 1), F.lit("")).cast("int")
    return F.when(t.rlike(NUMBERED), F.coalesce(styled, F.when(T.heading_tests(t)["plain"], F.size(T.number_parts(t)))))


def renumbered_headings(lines: DataFrame) -> DataFrame:
    """(doc_id, pos, line, number) of lines (doc_id, pos, line, style): numbered headings
    get the hierarchical number that their place gives them instead of their own;
    other lines stay as they are, with a null number. Only headings reach Python, one
    document's at a time, as each number follows from those before."""
    rows = lines.select("doc_id", "pos", "line", heading_level("line", "style").alias("level"))
    rest = F.trim(F.regexp_extract(F.trim("line"), NUMBERED, 2))
    headings = rows.filter("level is not null").select("doc_id", "pos", "level", rest.alias("rest"))

    def numbered(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        numbers = pd.Series(number_headings(pdf.level.tolist()), index=pdf.index, dtype=object)
        return pd.DataFrame({"doc_id": pdf.doc_id, "pos": pdf.pos, "line": numbers + " " + pdf.rest, "number": numbers})

    types = dict(rows.dtypes)
    made = headings.groupBy("doc_id").applyInPandas(numbered, f"doc_id {types['doc_id']}, pos {types['pos']}, line string, number string")
    return made.unionByName(rows.filter("level is null").select("doc_id", "pos", "line", F.lit(None).cast("string").alias("number")))
