"""Text, path and hash functions: Column in, Column out."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every white space run that Unicode knows.
SPACE = r"(?U)\s+"
YEAR = r"(?<!\d)(19\d{2}|20\d{2})(?!\d)"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def norm_text(x) -> Column:
    """Null as empty; white space runs as one blank; stripped."""
    return F.trim(F.regexp_replace(F.coalesce(col(x), F.lit("")), SPACE, " "))


def year_coerce(x) -> Column:
    """A four-digit year from 1900 to 2099 as int, else null."""
    t = norm_text(x)
    return F.when(t.rlike(r"^(19|20)\d{2}$"), t).cast("int")


def years_max(x, pattern: str = YEAR, group: int = 1) -> Column:
    """The greatest year that a pattern finds, or null."""
    found = F.regexp_extract_all(col(x), F.lit(pattern), F.lit(group))
    return F.array_max(F.transform(found, lambda y: y.cast("int")))


def number_parts(x) -> Column:
    """Leading number such as 1.2.3 as an int array (null if there is none)."""
    head = F.regexp_extract(norm_text(x), r"^(\d+(?:[.．]\d+)*)(?!\d)", 1)
    return F.when(head != "", F.transform(F.split(head, "[.．]"), lambda p: p.cast("int")))


def number_rest(x) -> Column:
    """The text behind a leading number and its separators."""
    return F.trim(F.regexp_replace(norm_text(x), r"^\d+(?:[.．]\d+)*[.．、:)]*\s*", ""))


def number_boundary(start, cand, cross: bool = False) -> Column:
    """Whether a numbered candidate ends the section that ``start`` opens: no deeper and
    not the same; its last part must differ and the parts before it agree. With
    ``cross`` any other number of the same depth will do."""
    s, c = col(start), col(cand)
    n = F.size(c)
    parents = F.slice(c, F.lit(1), F.greatest(n - 1, F.lit(0))) == F.slice(s, F.lit(1), F.greatest(n - 1, F.lit(0)))
    ok = parents & (F.get(c, n - 1) != F.get(s, n - 1))
    return F.coalesce((n > 0) & (n <= F.size(s)) & (c != s) & (F.lit(cross) & (n == F.size(s)) | ok), F.lit(False))


def words(x) -> Column:
    t = norm_text(x)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " ")))


CAPTION_LIKE = r"(?i)^(?:figure|table)\s+\d+(?:[.:]\d+)*[.:]?(?:\s|$)"
CJK = r"[\x{3400}-\x{9fff}]"


def heading_tests(x) -> Column:
    """Struct of heading-like tests on a line: ``boundary`` (at most 28 words, no
    caption, no sentence end beyond six words), ``plain`` (a boundary with a leading
    number), ``unstructured`` (at most 20 words, no closing mark, two words that
    start with a capital, or CJK), ``sentence`` (long, or ended, or with a comma)."""
    t = norm_text(x)
    n = words(x)
    closed = lambda marks: t.rlike(f"[{marks}]$")
    short = lambda most: (t != "") & ~t.rlike(CAPTION_LIKE) & (n <= most) & ~((n > 6) & closed(".。;；"))
    rest = F.trim(F.regexp_replace(t, r"^\d+(?:[.．]\d+)*", ""))
    capital = lambda line: line.rlike(r"^\p{Lu}") | (F.upper(F.split(line, " ")[0]) == F.split(line, " ")[0]) & F.split(line, " ")[0].rlike(r"\p{Lu}")
    named = (rest == "") | rest.contains(" ") | capital(rest) | rest.rlike(CJK)
    return F.struct(
        short(28).alias("boundary"), (short(28) & number_parts(t).isNotNull() & named).alias("plain"),
        (short(20) & ~closed(".。;；:") & (t.rlike(CJK) | ((n >= 2) & capital(t)))).alias("unstructured"),
        ((n >= 14) | ((n >= 5) & closed(".。;；")) | ((n >= 6) & t.rlike("[,，]"))).alias("sentence"),
    )


def heading_match(x, number, title, require: bool = False) -> Column:
    """Whether a line is the heading asked for. With a number, that stands in front
    (no digit behind it) and the title is contained; where it does not, the title
    must be the line or its end, unless numbers are required. Without a number the
    title is contained. Case counts."""
    t, num, name = norm_text(x), F.regexp_replace(norm_text(number), r"\.+$", ""), norm_text(title)
    as_dots = F.when(t.rlike(r"^\d"), F.translate(t, "．", ".")).otherwise(t)
    digits = F.translate(F.regexp_replace(num, "[.．]+$", ""), "．", ".")
    after = F.substr(as_dots, F.length(digits) + 1, F.lit(1))
    in_front = (digits != "") & as_dots.startswith(digits) & ~after.rlike(r"^\d")
    by_number = F.when(in_front, (name == "") | t.contains(name)).when(F.lit(require), False).otherwise((name != "") & t.endswith(name))
    return F.when(num != "", by_number).otherwise((name != "") & t.contains(name))


def section_expr(x) -> Column:
    """Struct (first, last, title) of a section request such as ``1.1 - 1.3 title``;
    empty where there is none. A number inside the text opens a section whose title
    is the whole text."""
    t = F.trim(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"(?U)^\s+|\s+$", ""))
    pattern = r"(?U)^(\d+(?:\.\d+)*\.?)(?:\s*[-~～至到]\s*(\d+(?:\.\d+)*\.?))?(?:\s+(.+))?$"
    inline = F.regexp_extract(t, r"(?U)\b(\d+(?:\.\d+)*)\b", 1)
    fits, bare = t.rlike(pattern), lambda c: F.regexp_replace(c, r"\.+$", "")
    part = lambda i: F.regexp_extract(t, pattern, i)
    return F.struct(
        F.when(fits, bare(part(1))).otherwise(inline).alias("first"), F.when(fits, bare(part(2))).otherwise("").alias("last"),
        F.when(fits, F.trim(part(3))).when(inline != "", t).otherwise("").alias("title"),
    )


def probe_prefixes(x, sizes: Iterable[int] = (180, 120, 80, 48), least: int = 12) -> Column:
    """A text (if short) and its prefixes of several lengths, without repeats."""
    t = norm_text(x)
    sizes = tuple(sizes)
    every = F.array(F.when(F.length(t) <= sizes[0], t), *[F.trim(F.substring(t, 1, n)) for n in sizes])
    return F.array_distinct(F.filter(every, lambda p: F.length(p) >= least))


def caption_label(x) -> Column:
    """Struct (kind, number, rest) of a figure or table caption; nulls if it is none."""
    t = norm_text(x)
    pattern = r"(?i)^(figure|fig\.?|table|圖|表)\s*[.:：]?\s*(\d+(?:[-.]\d+)*)\s*[.:：、]?\s*(.*)$"
    word = F.lower(F.regexp_extract(t, pattern, 1))
    kind = F.when(word.isin("figure", "fig", "fig.", "圖"), "figure").when(word.isin("table", "表"), "table")
    part = lambda i: F.when(kind.isNotNull(), F.regexp_extract(t, pattern, i))
    return F.struct(kind.alias("kind"), part(2).alias("number"), part(3).alias("rest"))


def path_norm(x) -> Column:
    """Slashes forward, empty and dot parts dropped."""
    parts = F.split(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"\\", "/"), "/")
    return F.array_join(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: ~p.isin("", ".")), "/")


def safe_name(x) -> Column:
    """A file name without illegal characters; reserved stems get a prefix."""
    n = F.regexp_replace(F.trim(F.coalesce(col(x), F.lit(""))), r'[<>:"/\\|?*\x00-\x1f]', "_")
    reserved = F.upper(F.split(n, r"\.")[0]).rlike("^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$")
    return F.when(n == "", "_").when(reserved, F.concat(F.lit("_"), n)).otherwise(n)


#: Words of file names that say nothing; fixed values.
GENERIC_WORDS = (
    "a", "an", "and", "by", "for", "from", "ii", "iii", "information", "input", "inputs", "manufacturer", "of",
    "path", "section", "supplied", "system", "task", "td", "test", "the", "to", "ustar",
)


def name_tokens(x, folder=None, drop: Iterable[str] = GENERIC_WORDS) -> Column:
    """Lower-case word tokens in order, repeats kept, without digits, dropped words and
    the folder name's own tokens."""
    cut = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^0-9A-Za-z]+"), lambda t: t != "")
    kept = F.filter(cut(col(x)), lambda t: ~t.rlike(r"^\d+$") & ~t.isin(*drop))
    return kept if folder is None else F.filter(kept, lambda t: ~F.array_contains(cut(col(folder)), t))


def slug(display, text="", most: int = 60) -> Column:
    """A variable name of a heading's number and text: word characters only, ``section``
    if nothing is left, ``sec_`` before a digit; a long one is cut and ends in a hash."""
    t = norm_text(F.concat_ws(" ", col(display), F.lit(text) if isinstance(text, str) else text))
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[^0-9A-Za-z_ ]+", "_"), " ", "_"), "_+", "_")
    t = F.regexp_replace(t, "^_+|_+$", "")
    t = F.when(t == "", "section").when(t.rlike("^[0-9]"), F.concat(F.lit("sec_"), t)).otherwise(t)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most), F.lit("_"), F.substring(F.md5(t), 1, 8)))


def severity(x) -> Column:
    """DEBUG 10 to CRITICAL 50; WARN is WARNING; anything else is ERROR."""
    level = F.upper(norm_text(x))
    level = F.when(level == "WARN", "WARNING").otherwise(level)
    table = F.create_map(*[F.lit(v) for kv in (("DEBUG", 10), ("INFO", 20), ("WARNING", 30), ("ERROR", 40), ("CRITICAL", 50)) for v in kv])
    return F.coalesce(F.try_element_at(table, level), F.lit(40))


#: Error classes by words, in order; fixed values.
ERROR_WORDS = (
    ("database", ("sqldriverconnect", "login timeout expired", "sql server", "sqlalchemy", "pyodbc")),
    ("ldap", ("ldap", "active directory")),
    ("smtp", ("smtp",)),
    ("download", ("requestexception", "urlerror")),
    ("storage", ("permissionerror", "nas", "network path", "permission denied")),
)


def error_class(x) -> Column:
    """The first class of which a word occurs, else unknown."""
    t = F.lower(F.coalesce(col(x), F.lit("")))
    hit = lambda ws: reduce(lambda a, b: a | b, (t.contains(w) for w in ws))
    (name, ws), *rest = ERROR_WORDS
    chain = F.when(hit(ws), name)
    for name, ws in rest:
        chain = chain.when(hit(ws), name)
    return chain.otherwise("unknown")


def content_hash(*columns: str) -> Column:
    """SHA-256 of the compact JSON of the columns, keys in order."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def parse_time(x, formats: Iterable[str] = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd")) -> Column:
    """The first format that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(norm_text(x), F.lit(f)).cast("timestamp_ntz") for f in formats])


def end_of_day(x) -> Column:
    """The next midnight of a date text, so that day ranges are half-open."""
    return (F.date_trunc("day", parse_time(x)) + F.expr("interval 1 day")).cast("timestamp_ntz")


def payload_text(x, path: str) -> Column:
    """A field of a JSON text; null where the text is bad or no object."""
    return F.get_json_object(col(x), f"$.{path}")
