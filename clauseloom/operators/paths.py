"""Paths: a registry under renames and removals, free names, suffixes of shared names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import shared_path
from .sequences import walk_groups


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def registry(log: DataFrame) -> DataFrame:
    """What a log of operations on a tree of paths leaves: (root, path, value).

    ``log``: root, seq (unique in a root), op (record, rename or remove), path, new_path,
    value. A record writes its path. Renames and removals act on a path and everything
    under it as they find it; what is renamed onto a taken path takes its place.

    Every record is followed by itself through the operations that meet it: its next one
    is the earliest later one on its path or one above (a record's ancestors are looked up
    by path, so records never meet records). A round moves all records one step, as
    many rounds as the most often moved record has moves. Of records that end on one
    path the one that came there last stays: they travelled together since they met, so
    their arrivals, latest first, first differ at the arrival that decided. The
    operations on one path of a root are held in one array.
    """
    log = log.withColumn("path", T.path_norm("path")).withColumn("new_path", T.path_norm("new_path"))
    acts = log.filter((F.col("op") == "remove") & (F.col("path") != "") | (F.col("op") == "rename") & (F.col("path") != "") & (F.col("new_path") != "") & (F.col("path") != F.col("new_path")))
    acts = acts.groupBy("root", "path").agg(F.sort_array(F.collect_list(F.struct("seq", "op", "new_path"))).alias("acts")).withColumnRenamed("path", "above")
    acts = _written(acts, "registry-acts")
    now = log.filter((F.col("op") == "record") & (F.col("path") != "")).select("root", F.col("seq").alias("id"), "path", "value", F.array("seq").alias("came"))
    done = None
    while True:
        parts = F.split("path", "/")
        above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
        met = now.select("root", "id", F.get("came", F.lit(0)).alias("at"), F.explode(above).alias("above")).join(acts, ["root", "above"])
        ahead = F.get(F.filter("acts", lambda a: a["seq"] > F.col("at")), F.lit(0))
        step = met.select("root", "id", F.struct(ahead["seq"].alias("seq"), ahead["op"].alias("op"), ahead["new_path"].alias("to"), "above").alias("s")).filter("s.seq is not null")
        step = step.groupBy("root", "id").agg(F.min("s").alias("s"))
        both = _written(now.join(step, ["root", "id"], "left"), "registry-step")
        rest = both.filter("s is null").drop("s")
        done = rest if done is None else done.unionByName(rest)
        moved = both.filter("s.op = 'rename'")
        if moved.isEmpty():
            break
        path = F.concat("s.to", F.expr("substring(path, length(s.above) + 1)"))
        now = moved.select("root", "id", path.alias("path"), "value", F.concat(F.array("s.seq"), "came").alias("came"))
    return done.groupBy("root", "path").agg(F.max(F.struct("came", "value")).alias("m")).select("root", "path", "m.value")


# --- free names ---


def _numbered(form: str) -> tuple[str, int]:
    """A regular expression that takes a made name apart (head, number, tail), and the first number."""
    return {"file": (r"^(.*) \((0|[1-9][0-9]{0,8})\)(\.[^.]*)?$", 1), "folder": (r"^(.*)_(0|[1-9][0-9]{0,8})()$", 2)}[form]


def _made(name: Column, number: Column, form: str) -> Column:
    """The numbered form of a name: before a file's extension, behind a folder's name.
    Leading dots belong to the name."""
    if form == "folder":
        return F.concat(name, F.lit("_"), number)
    ext = F.regexp_extract(name, r"^\.*[^.].*?(\.[^.]*)$", 1)
    return F.concat(F.left(name, F.length(name) - F.length(ext)), F.lit(" ("), number, F.lit(")"), ext)


def free_names(requests: DataFrame, existing: DataFrame, form: str = "file") -> DataFrame:
    """The name that each request gets: (folder, seq, name, final).

    ``requests`` (folder, seq, name) are served by seq; ``existing`` (folder, name) are taken
    from the start. A name that is taken gets the smallest free number: ``stem (1).ext`` for
    files, ``name_2`` for folders.

    A name belongs to the family of its stem. From a family's side a numbered name is
    taken from the first request for that very name on, whoever gets it, so families are
    settled one after another only along ``a``, ``a (1)``, ``a (1) (1)``. Within one the
    numbers rise with the requests: the i-th gets number i plus the taken ones it passes.
    Families without taken numbers are ranked by one window; the others walk over the
    taken numbers and the requests up to the greatest of them.
    """
    pattern, least = _numbered(form)
    asked = requests.select("folder", "seq", "name")
    first = asked.groupBy("folder", "name").agg(F.min("seq").alias("since"))
    names = existing.select("folder", "name").distinct().withColumn("old", F.lit(True)).join(first, ["folder", "name"], "full")
    never = F.lit(-(1 << 62))
    names = names.select("folder", "name", F.when(F.col("old"), never).otherwise(F.col("since")).alias("since"), F.coalesce("old", F.lit(False)).alias("old"))
    head, number, tail = (F.regexp_extract("name", pattern, i) for i in (1, 2, 3))
    outer = F.concat(head, tail)
    fits = (number != "") & (number.cast("long") >= least) & (_made(outer, number, form) == F.col("name"))
    names = names.withColumn("number", F.when(fits, number.cast("long"))).withColumn("family", F.when(fits, outer))
    taken = _written(names, "names-taken")  # (folder, name, since, old, number, family)

    # how deep a name lies among families that are asked for
    families = asked.select("folder", F.col("name").alias("family")).distinct()
    level = taken.join(families, ["folder", "family"], "left_semi").select("folder", "name", "family", "number")
    out, todo = None, asked
    used = None
    while True:
        open_ = todo.join(level.select("folder", "name").distinct(), ["folder", "name"], "left_anti")  # no family to wait for
        got = _written(_settled(open_, taken, used, form, least), "names-got")
        out = got if out is None else out.unionByName(got)
        todo = todo.join(level.select("folder", "name").distinct(), ["folder", "name"], "left_semi")
        if todo.isEmpty():
            return out.select("folder", "seq", "name", "final")
        now = got.filter("k > 0").select("folder", F.col("final").alias("name"), "seq")
        used = now if used is None else used.unionByName(now)
        settled = open_.select("folder", F.col("name").alias("family")).distinct()
        level = _written(level.join(settled, ["folder", "family"], "left_anti"), "names-level")
        todo = _written(todo, "names-todo")


def _settled(asked: DataFrame, taken: DataFrame, used: DataFrame | None, form: str, least: int) -> DataFrame:
    """(folder, seq, name, final, k) for requests whose own names are settled: ``used`` (folder, name,
    seq) were made by other families."""
    base = taken.filter("old").select("folder", "name", F.lit(-(1 << 62)).alias("since"))
    if used is not None:
        base = base.unionByName(used.select("folder", "name", F.col("seq").alias("since")))
    base = base.groupBy("folder", "name").agg(F.min("since").alias("base"))
    others = taken.filter("number is not null").select("folder", F.col("family").alias("name"), "number", "since")
    most = others.groupBy("folder", "name").agg(F.max("number").alias("most"))
    rank = F.row_number().over(Window.partitionBy("folder", "name").orderBy("seq"))
    rows = asked.withColumn("rank", rank).join(base, ["folder", "name"], "left").join(most, ["folder", "name"], "left")
    # the first request gets the bare name unless it is taken by then
    bare = F.col("base").isNull() | (F.col("base") > F.min("seq").over(Window.partitionBy("folder", "name")))
    rows = rows.withColumn("i", F.col("rank") - F.when(bare, 1).otherwise(0)).withColumn("i", F.when(F.col("i") > 0, F.col("i") + least - 1).otherwise(0))  # 0: bare
    rows = _written(rows, "names-ranked")
    plain = rows.filter("most is null").withColumn("k", F.col("i"))
    walked = rows.filter("most is not null")
    near = walked.filter("i > 0 and i <= most")

    def walk(rows):  # (folder, name, 0, number, since) of taken numbers, then (folder, name, 1, seq, null) of requests
        since, k = {}, least - 1
        for folder, name, asks, at, first in rows:
            if not asks:
                since[at] = first
                continue
            k += 1
            while since.get(k, at + 1) <= at:
                k += 1
            yield folder, name, at, k

    passed = others.select("folder", "name", F.lit(0).alias("asks"), F.col("number").alias("at"), "since")
    passed = passed.unionByName(near.select("folder", "name", F.lit(1).alias("asks"), F.col("seq").cast("long").alias("at"), F.lit(None).cast("long").alias("since")))
    schema = {"folder": asked.schema["folder"].dataType.simpleString(), "name": "string", "seq": "long", "k": "long"}
    k = walk_groups(passed, ["folder", "name"], ["asks", "at"], walk, schema)
    k = _written(k, "names-walked")
    skipped = k.groupBy("folder", "name").agg(F.max("k").alias("last"), F.count("*").alias("n"))
    late = walked.filter("i > most").join(skipped, ["folder", "name"], "left")
    late = late.withColumn("k", F.col("i") + F.coalesce(F.greatest(F.col("last") - F.col("n") - least + 1, F.lit(0)), F.lit(0)))
    columns = ["folder", "seq", "name", "k"]
    every = plain.select(columns).unionByName(walked.filter("i = 0").withColumn("k", F.lit(0).cast("long")).select(columns))
    every = every.unionByName(near.select("folder", "name", "seq").join(k, ["folder", "name", "seq"]).select(columns)).unionByName(late.select(columns))
    final = F.when(F.col("k") == 0, F.col("name")).otherwise(_made(F.col("name"), F.col("k").cast("string"), form))
    return every.select(*columns, final.alias("final"))


# --- names of inputs ---


def resolved_names(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """What the names of inputs stand for: (base, name, state, path, n) for each wanted
    (base, name) over files (base, path), in any case.

    A file name with folders is a path, one without may stand in any folder, where
    several are ambiguous; a name without a dot is a folder and stands for its first
    Word document. ``n`` counts the matches; the path is null unless found. Keys are
    matched by equi joins and counted, so no list of files is held anywhere."""
    parts = lambda p: F.split(F.lower(p), "/")
    leaf = lambda p: F.element_at(parts(p), -1)
    key = lambda kind, k: F.struct(F.lit(kind).alias("kind"), k.alias("key"))
    rows = files.select("base", T.path_norm("path").alias("path")).distinct()
    above = F.array_join(F.slice(parts("path"), F.lit(1), F.size(parts("path")) - 1), "/")
    word = F.when(leaf("path").rlike(r"\.docx?$"), key("folder", above))
    keys = rows.select("base", "path", F.explode(F.array_compact(F.array(key("path", F.lower("path")), key("name", leaf("path")), word))).alias("k")).select("base", "path", "k.*")
    name = F.translate(F.trim(F.coalesce("name", F.lit(""))), "\\", "/")
    asked = wanted.select("base", "name", name.alias("given"), F.lower(T.path_norm(name)).alias("key")).distinct()
    kind = F.when(F.col("key") == "", "unnamed").when(~leaf("key").contains("."), "folder").when(F.col("given").contains("/"), "path").otherwise("name")
    asked = asked.select("base", "name", "key", kind.alias("kind"))
    on = ["base", "kind", "key"]
    hits = keys.join(asked.select(*on).distinct(), on, "left_semi").groupBy(*on).agg(F.count("*").alias("n"), F.min("path").alias("path"))
    many = (F.col("kind") == "name") & (F.col("n") > 1)
    state = F.when(F.col("kind") == "unnamed", "unnamed").when(F.col("n").isNull(), "not found").when(many, "ambiguous").otherwise("found")
    return asked.join(hits, on, "left").select("base", "name", state.alias("state"), F.when(~many, F.col("path")).alias("path"), F.coalesce("n", F.lit(0)).alias("n"))


# --- suffixes ---


def conflict_suffix(source: Column, other: Column, folder: Column) -> Column:
    """The word that tells a file or folder from one of the same name: of the folders on the
    way to both, compared from the root, the last that differs in its words gives its
    last one; where none does, the nearest folder with a word. Numbers, generic words and
    the words of ``folder`` do not count; null where nothing is left."""
    ways = [F.split(T.path_norm(p), "/") for p in (source, other)]
    ways = [F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))) for w in ways]
    told = lambda w: F.transform(w, lambda x: F.struct(x.alias("x"), T.name_tokens(x, folder).alias("t")))
    none = F.array().cast("array<string>")
    pairs = F.zip_with(told(ways[0]), told(ways[1]), lambda a, b: F.struct(a["x"].alias("a"), b["x"].alias("b"), F.coalesce(a["t"], none).alias("t"), F.coalesce(b["t"], none).alias("u")))
    apart = F.filter(pairs, lambda p: ~p["a"].eqNullSafe(p["b"]) & (F.size(p["t"]) > 0) & (p["t"] != p["u"]))
    near = F.filter(told(ways[0]), lambda p: F.size(p["t"]) > 0)
    last = lambda words: F.try_element_at(words, F.lit(-1))
    return F.coalesce(last(last(apart)["t"]), last(last(near)["t"]))
