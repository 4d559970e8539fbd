"""Functions on the cells of a mapping sheet: item types, actions, options, modes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: Item types by what a type cell may say (lower case); fixed values.
ITEM_TYPES = {
    "extract_all": ("all", "extract all", "全文", "擷取全文", "提取全文"),
    "figure_table": ("figure table", "figuretable", "table figure", "tablefigure", "表格圖片", "表格图片", "表格包圖", "表格包图"),
    "figure": ("figure", "fig", "extract figure", "擷取圖片", "提取图片", "擷取图"),
    "table": ("table", "表格", "表"),
    "copy_file": ("copy file", "copyfile", "file copy", "複製檔案", "复制文件", "複製文件"),
    "copy_folder": ("copy folder", "copy dir", "copy directory", "copyfolder", "複製資料夾", "复制文件夹"),
    "add_text": ("add text", "text", "文字", "加入文字", "新增文字"),
    "numbered_heading": ("numbered heading", "arabic heading", "insert numbered heading", "insert_numbered_heading", "阿拉伯數字標題", "數字標題", "插入阿拉伯數字標題", "插入數字標題"),
    "roman_heading": ("roman heading", "insert roman heading", "insert_roman_heading", "羅馬數字標題", "羅馬標題", "插入羅馬數字標題"),
    "bulleted_heading": ("bulleted heading", "bullet heading", "insert bulleted heading", "insert_bulleted_heading", "項目符號標題", "符號標題", "插入項目符號標題"),
    "pdf_image": ("pdf image", "pdf images", "pdfimage", "pdf_img", "pdf圖片", "pdf图", "pdf 圖片", "pdf 图片"),
    "add_image": ("add image", "image", "加入圖片", "新增圖片", "加入图片", "新增图片"),
}
#: Cells that mean a figure to extract, or an image to add where the operation says no more; fixed values.
PICTURES = ("圖片", "图片", "圖", "图")
#: Actions by item type; fixed values.
ACTIONS = {
    "extract_all": "Extract all", "figure_table": "Extract figure", "figure": "Extract figure", "table": "Extract table", "copy_file": "Copy file", "copy_folder": "Copy folder",
    "add_text": "Append text", "numbered_heading": "Append heading", "roman_heading": "Append heading", "bulleted_heading": "Append heading", "pdf_image": "Extract PDF images", "add_image": "Add Image",
}
#: Yes and no of a title cell, and insert modes; fixed values.
YES = ("1", "true", "yes", "y", "on", "include", "show", "keep", "包含", "顯示", "保留", "是", "要")
NO = ("0", "false", "no", "n", "off", "exclude", "hide", "omit", "remove", "不包含", "不顯示", "隱藏", "否", "不要", "移除")
AFTER = ("insert_after", "insertafter", "after", "append", "段落後新增", "插入於該段落後方", "插入該段落後", "新增於段落後")
REPLACE = ("replace", "取代", "取代該段落", "替換", "替換該段落")
OPTIONS = ("title", "index", "container")


def _cell(x) -> Column:
    return F.trim(F.coalesce(col(x), F.lit("")))


def _looked_up(cell: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """The name under which a cell's value is listed, or null."""
    pairs = [F.lit(v) for name, aliases in table.items() for a in aliases for v in (a, name)]
    return F.try_element_at(F.create_map(*pairs), cell)


def item_type(cell, operation) -> Column:
    """One of twelve types by alias, empty for an unknown one. A picture is a figure to
    extract if the operation says what, else an image to add."""
    kind, what = F.lower(_cell(cell)), F.lower(_cell(operation))
    picture = F.when((what != "") & ~what.isin("add image", "image"), "figure").otherwise("add_image")
    return F.when(kind.isin(*PICTURES), picture).otherwise(F.coalesce(_looked_up(kind, ITEM_TYPES), F.lit("")))


def action(operation, kind) -> Column:
    """What a row does: by its type, else a chapter where the operation starts with a number."""
    by_type = _looked_up(col(kind), {v: tuple(k for k, a in ACTIONS.items() if a == v) for v in dict.fromkeys(ACTIONS.values())})
    return F.coalesce(by_type, F.when(_cell(operation).rlike(r"^\d"), "Extract chapter").otherwise("Mapping"))


def option_tail(x) -> Column:
    """Struct (core, options, error) of ``core|key=value|...``. Bars inside quotes do not
    split; only known keys are kept; the first tail part without ``=`` is the error,
    and what stands behind it is not read."""
    parts = F.transform(F.regexp_extract_all(F.concat(F.lit("|"), _cell(x)), F.lit(r"""(?s)\|((?:[^|"']|"[^"]*(?:"|$)|'[^']*(?:'|$))*)"""), F.lit(1)), lambda p: F.trim(p))
    unquoted = lambda v: F.when(v.rlike(r"""(?s)^(?:"[^"]*"|'[^']*')$"""), F.trim(F.substr(v, F.lit(2), F.length(v) - 2))).otherwise(v)
    bound = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))  # noqa: E731  # the array binds the value once

    def told(parts: Column, tail: Column, wrong: Column) -> Column:
        read = F.when(wrong > 0, F.slice(tail, F.lit(1), wrong - 1)).otherwise(tail)
        pairs = F.transform(read, lambda p: F.struct(F.lower(F.trim(F.substring_index(p, "=", 1))).alias("k"), unquoted(F.trim(F.substr(p, F.instr(p, "=") + 1))).alias("v")))
        known = F.filter(pairs, lambda p: p["k"].isin(*OPTIONS))
        last = F.aggregate(known, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.create_map(p["k"], p["v"])))
        return F.struct(F.coalesce(F.get(parts, F.lit(0)), F.lit("")).alias("core"), last.alias("options"), F.when(wrong > 0, F.get(tail, wrong - 1)).alias("error"))

    tail = lambda p: F.filter(F.slice(p, F.lit(2), F.lit(1 << 30)), lambda p: p != "")
    wrong = lambda t: F.array_position(F.transform(t, lambda p: ~p.contains("=")), F.lit(True)).cast("int")
    return bound(parts, lambda p: bound(tail(p), lambda t: bound(wrong(t), lambda w: told(p, t, w))))


def _flag(x, groups: dict[str, tuple[str, ...]], default: str) -> Column:
    cell = _cell(x)
    found = _looked_up(F.lower(F.regexp_replace(cell, r"(?U)\s+", "")), groups)
    return F.struct(F.coalesce(found, F.lit(default)).alias("value"), F.when(found.isNull() & (cell != ""), cell).alias("error"))


def include_title(x) -> Column:
    """Struct (value yes or no, error): yes where empty or unknown; an unknown value is the error."""
    return _flag(x, {"yes": YES, "no": NO}, "yes")


def insert_mode(x) -> Column:
    """Struct (value, error): insert_after where empty or unknown; an unknown value is the error."""
    return _flag(x, {"insert_after": AFTER, "replace": REPLACE}, "insert_after")
