"""Rules over the fields of steps, given as rows of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "step_type string, kind string, fields array<string>, proxy string, when_field string, when_equals string, when_true boolean"

_CHAPTER = ("composite", ["target_chapter_section", "target_chapter_title"], "chapter_ref", None, None)
_SUBTITLE = ("conditional", ["target_subtitle"], None, "use_chapter_title", "true")
#: What each type of step must state (kind, fields, field that is named, condition).
RULES = {
    "extract_pdf_pages_as_images": [("required", ["input_file"], None, None, None)],
    "extract_word_all_content": [("required", ["input_file"], None, None, None)],
    "extract_word_chapter": [
        ("required", ["input_file"], None, None, None), _CHAPTER, _SUBTITLE,
        ("conditional", ["explicit_end_number", "explicit_end_title"], "continuous_end_ref", "continuous_extract", "true"),
    ],
    "extract_specific_figure_from_word": [
        ("required", ["input_file"], None, None, None), _CHAPTER, _SUBTITLE,
        ("any", ["target_caption_label", "target_figure_title", "target_figure_index"], "target_caption_label", None, None),
    ],
    "extract_specific_table_from_word": [
        ("required", ["input_file"], None, None, None), _CHAPTER, _SUBTITLE,
        ("any", ["target_caption_label", "target_table_title", "target_table_index"], "target_caption_label", None, None),
    ],
    "insert_text": [("required", ["text"], None, None, None)],
    "insert_roman_heading": [("required", ["text"], None, None, None)],
}


def rule_table(spark: SparkSession, rules: dict = RULES) -> DataFrame:
    """Rules by type of step as rows; a condition is a text to equal or a boolean to read."""
    rows = []
    for step_type, listed in rules.items():
        for kind, fields, proxy, field, value in listed:
            flag = value if isinstance(value, bool) else None
            rows.append((step_type, kind, fields, proxy, field, None if flag is not None else value, flag))
    return spark.createDataFrame(rows, SCHEMA)


def broken_rules(steps: DataFrame, rules: DataFrame) -> DataFrame:
    """One row (run_id, step_no, step_type, kind, field) for each rule that a step breaks.

    ``steps``: run_id, step_no, step_type and ``values``, a map of fields to texts. Each step
    meets the rules of its type. required and composite: all fields have text (the chapter
    reference may instead stand in one text, and must have a number and a title);
    conditional: all, where the condition's field has the value; any: one of them. The
    field named is the proxy, else the first. Whether an end is asked for is read off the
    fields of the end where no field says so.
    """
    value = lambda f: F.coalesce(F.try_element_at("values", f), F.lit(""))
    has = lambda f: F.trim(F.regexp_replace(value(f), r"(?U)^\s+|\s+$", "")) != ""
    some = F.size("fields") > 0
    every = some & F.forall("fields", has)
    # a chapter reference: number and title
    whole = F.when(every, F.array_join(F.transform("fields", value), " ")).otherwise(value(F.lit("chapter_ref")))
    text = F.regexp_replace(whole, r"(?U)^\s+|\s+$", "")
    led = r"^(\d+(?:\.\d+)*)\.?(?:\s+(.+))?$"
    chapter = F.when(text.rlike(led), F.trim(F.regexp_extract(text, led, 2)) != "").otherwise(text.rlike(r"\b\d+(?:\.\d+)*\b"))
    # a condition
    ends = [has(F.lit(n)) for n in ("explicit_end_number", "explicit_end_title", "continuous_end_ref")]
    said = value(F.col("when_field"))
    said = F.when((said == "") & (F.col("when_field") == "continuous_extract"), F.when(ends[0] | ends[1] | ends[2], "true").otherwise("false")).otherwise(said)
    true = F.lower(F.trim(said)).isin("1", "true", "yes", "y", "on")
    holds = F.coalesce(F.when(F.col("when_true").isNotNull(), true == F.col("when_true")).otherwise(said == F.col("when_equals")), F.lit(False)) & (F.coalesce("when_field", F.lit("")) != "")
    kept = (
        F.when(F.col("kind") == "any", some & F.exists("fields", has)).when(F.col("kind") == "conditional", ~holds | every)
        .when((F.col("kind") == "composite") & (F.coalesce("proxy", F.get("fields", F.lit(0))) == "chapter_ref"), chapter).otherwise(every)
    )
    met = steps.join(F.broadcast(rules), "step_type").filter(~kept)  # the rules of a program: a few dozen rows
    return met.select("run_id", "step_no", "step_type", "kind", F.coalesce("proxy", F.get("fields", F.lit(0))).alias("field"))
