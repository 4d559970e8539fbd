"""Byte-level BPE as Spark higher-order functions over distinct words.

Texts are cut into words by the public pattern, as Spark's own regular
expressions. Each distinct word becomes an array of byte ids, and a fold merges
its lowest-ranked pair again and again, looking pairs up in a rank map (a hash
table of longs, built from the rank file). The words come in bundles, and each
bundle brings the map in its own row: in the plan it would stand as a literal,
which the driver copies, prints and sends with every stage. Python numbers
words and puts their ids in their places; it merges nothing but words beyond
``FOLD_BYTES`` bytes, where a heap takes the place of the fold's squared cost.
Decoding concatenates the tokens' binary pieces.

Frequent words (at most ``TABLE_WORDS`` of them, which bounds what is
broadcast; counted over all texts) are folded once; the other words once for
each stretch of blocks they occur in, so texts are never shuffled. A stretch
lasts until its words would exceed ``STRETCH_WORDS`` or ``STRETCH_BYTES``.

Null text is empty and gives no ids. Special tokens are ordinary text. Rows
that repeat are encoded alike; a row is one document whatever its doc_id. An
empty table gives an empty result. Other columns are kept, whatever their
names; only a column that has the name of the result is replaced by it.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, released, written

#: Longest word, in bytes, that the fold merges.
FOLD_BYTES = 512
#: Most words that are broadcast, and the fewest occurrences that earn a place.
TABLE_WORDS, OFTEN = 300_000, 3
#: Words of a block (about), and words that a task counts before it passes them on.
BLOCK_WORDS, HELD = 1_500_000, 300_000
#: Most different words that blocks share, and their bytes; one block may have more.
STRETCH_WORDS, STRETCH_BYTES = 600_000, 16 << 20
#: Rows that Python works on at once, and words that share a row of the fold (about).
ROWS, BUNDLE = 500, 10_000


@lru_cache(maxsize=4)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=1)
def pair_ranks(path: str) -> dict[tuple[int, int], int]:
    """Every pair of tokens whose joined bytes are a token, to that token's rank."""
    ranks, out = ranks_of(path), {}
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            a, b = ranks.get(piece[:i]), ranks.get(piece[i:])
            if a is not None and b is not None:
                out[a, b] = rank
    return out


#: Ids and ranks take 17 bits.
SHIFT = 1 << 17
NONE = SHIFT - 1


def _rank_map(path: str) -> list[list[int]]:
    """The rank map: pair (a, b) lies in bucket (1021 a + b) mod 2^17 as b * 2^17 + rank.
    1021 is odd, so no two pairs with one b share a bucket."""
    buckets: list[list[int]] = [[] for _ in range(SHIFT)]
    for (a, b), rank in pair_ranks(path).items():
        buckets[1021 * a + b & NONE].append(b * SHIFT + rank)
    return buckets


def _byte_map(path: str) -> list[int]:
    """The parts that words start with: at 512 a + b, for byte a before byte b (256: before
    nothing), the pair's rank (NONE if it has none) * 2^17 + the id of a."""
    ranks, pairs = ranks_of(path), pair_ranks(path)
    single = [ranks[bytes([i])] for i in range(256)]
    return [pairs.get((single[a], single[b]) if b < 256 else None, NONE) * SHIFT + single[a] if b <= 256 else 0 for a in range(256) for b in range(512)]


@lru_cache(maxsize=1)
def _maps(path: str) -> tuple[pa.Array, pa.Array]:
    """Both maps, each as a column of one row."""
    return pa.array([_rank_map(path)], pa.list_(pa.list_(pa.int64()))), pa.array([_byte_map(path)], pa.list_(pa.int64()))


#: The maps as columns of the rows that hold words to fold.
MAPS = "_ranks array<array<bigint>>, _starts array<bigint>"


#: Classes of the pattern whose members hang on the Unicode version.
CLASSES = (r"\p{L}", r"\p{N}", r"\s")


def _ranges(points) -> str:
    runs: list[list[int]] = []
    for x in sorted(points):
        if runs and runs[-1][1] == x - 1:
            runs[-1][1] = x
        else:
            runs.append([x, x])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in runs)


def _spark_classes(spark: SparkSession) -> dict[str, set[int]]:
    """The code points of each class as the executors' regular expressions have them."""
    point = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    points = spark.range(0, 0x110000, 1, 4).filter("id < 55296 or id > 57343").select(F.col("id").cast("int"), *[point.rlike(f"^{c}$").alias(f"c{i}") for i, c in enumerate(CLASSES)])
    got = points.filter("c0 or c1 or c2").toArrow()  # the letters and digits of Unicode, whatever the input
    return {c: set(got.filter(got[f"c{i}"])["id"].to_pylist()) for i, c in enumerate(CLASSES)}


def _library_classes() -> dict[str, set[int]]:
    """The same as the tokenizer library has them."""
    import tiktoken

    single, out = {bytes([i]): i for i in range(256)}, {}
    points = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF)
    for c in CLASSES:
        library = tiktoken.Encoding("points", pat_str=c, mergeable_ranks=single, special_tokens={})
        out[c] = {ord(x) for at in range(0, len(points), 1 << 14) for x in bytes(library.encode_ordinary(points[at : at + (1 << 14)])).decode()}
    return out


def _rewritten(pattern: str, bodies: dict[str, str]) -> str:
    """``pattern`` with its classes spelled as ``bodies``, inside and outside brackets."""
    out, inside, at = "", False, 0
    while at < len(pattern):
        name = next((c for c in CLASSES if pattern.startswith(c, at)), None)
        if name:
            out, at = out + (bodies[name] if inside else f"[{bodies[name]}]"), at + len(name)
        elif pattern.startswith(r"\S", at):
            out, at = out + rf"[^{bodies[chr(92) + 's']}]", at + 2
        else:
            step = 2 if pattern[at] == "\\" else 1
            inside = pattern[at] == "[" or inside and pattern[at] != "]"
            out, at = out + pattern[at : at + step], at + step
    return out


def _apostrophes_last(pattern: str) -> str:
    """Leading alternatives that begin with an apostrophe, moved behind the next one
    where that begins with a blank or a letter: no text fits both, and most fit that."""
    heads = 0
    parts = pattern.split("|")
    while heads < len(parts) and re.fullmatch(r"'\w+", parts[heads]):
        heads += 1
    if heads < len(parts) and re.fullmatch(r" \?\\p\{L\}\+", parts[heads]):
        parts = [parts[heads], *parts[:heads], *parts[heads + 1 :]]
    return "|".join(parts)


_PATTERNS: dict[str, tuple[str, str, int]] = {}


def spark_pattern(spark: SparkSession, pattern: str) -> tuple[str, str, int]:
    """``pattern`` for Spark as (plain, exact, agreed): where the Unicode versions
    differ, code points are taken out of a class or added to it in ``exact``;
    for texts below the code point ``agreed``, ``plain`` does the same."""
    if pattern not in _PATTERNS:
        ours, theirs = _spark_classes(spark), _library_classes()
        white = _ranges(theirs[r"\s"])
        plain, exact, agreed = {r"\s": white}, {r"\s": white}, 0x110000
        for c in CLASSES[:2]:
            less, more = ours[c] - theirs[c], theirs[c] - ours[c]
            agreed = min([agreed, *less, *more])
            plain[c] = c
            exact[c] = (f"[{c}&&[^{_ranges(less)}]]" if less else c) + _ranges(more)
        quick = _apostrophes_last(pattern)
        _PATTERNS[pattern] = _rewritten(quick, plain), _rewritten(quick, exact), agreed
    return _PATTERNS[pattern]


#: Stands behind each word of a cut text: a noncharacter, but any text may hold it.
MARK = "\uffff"


def cut_words(text: Column, patterns: tuple[str, str, int]) -> Column:
    """The words of a text as struct (marked, listed): the text with ``MARK`` behind
    each word, or, where it holds that itself, its words as a list. The pattern
    must cover every text, as tokenizers' patterns do."""
    plain, exact, agreed = patterns
    text = F.coalesce(text.cast("string"), F.lit(""))
    by = lambda f: f(plain) if agreed > 0x10FFFF else F.when(text.rlike(rf"[\x{{{agreed:X}}}-\x{{10FFFF}}]"), f(exact)).otherwise(f(plain))
    taken = F.contains(text, F.lit(MARK))
    marked = by(lambda p: F.regexp_replace(text, F.lit(p), F.lit("$0" + MARK)))
    listed = by(lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    return F.struct(F.when(~taken, marked).alias("marked"), F.when(taken, listed).alias("listed"))


def _words(cut: pa.StructArray) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts, one after the other, and where each text's begin and end."""
    marked, listed = cut.field("marked"), cut.field("listed")
    if marked.null_count:
        rows = [x if x is not None else m.split(MARK)[:-1] for m, x in zip(marked.to_pylist(), listed.to_pylist(), strict=True)]
        return _lists(pa.array(rows, pa.list_(pa.string())))
    values, ends = _lists(pc.split_pattern(marked, MARK))
    keep = np.ones(len(values), bool)
    keep[ends[1:] - 1] = False  # what stands behind a text's last mark
    return values.filter(pa.array(keep)), ends - np.arange(len(ends))


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_merges(word: Column, path: str) -> Column:
    """Token ids (array of bigint) of a word given as an array of its bytes. The plan holds
    the rank map; ``fold_bundle`` takes it from the rows."""
    text = lambda x: F.lit(json.dumps(x, separators=(",", ":")))
    ranks = F.from_json(text(_rank_map(path)), T.ArrayType(T.ArrayType(T.LongType())))
    starts = F.from_json(text(_byte_map(path)), T.ArrayType(T.LongType()))
    return _bound(ranks, lambda r: _bound(starts, lambda s: _bound(word.cast("array<int>"), lambda w: _folded(w, r, s))))


def fold_bundle(words: Column) -> Column:
    """The ids of each word of a bundle, by the maps that its row holds (``MAPS``)."""
    return F.transform(words, lambda w: _folded(w, F.col("_ranks"), F.col("_starts"))).cast("array<array<int>>")


def _folded(word: Column, ranks: Column, starts: Column) -> Column:
    """The fold over a word's bytes.

    Parts are packed as rank * 2^17 + id, where rank is that of the pair the part
    forms with the next one (NONE if it forms none). The least part is the
    lowest-ranked pair; equal parts are equal pairs, and the first is merged: its
    part takes the pair's rank as its id, the part before it is packed anew and
    the part behind it goes.
    """
    none = mask = _long(NONE)
    gone, rest = _long(-1), F.lit(1 << 30)  # to the end
    ident = lambda x: x.bitwiseAND(mask)

    def packed(a, b):
        bucket = F.get(ranks, (1021 * a + b).bitwiseAND(mask).cast("int"))
        # b * 2^17 taken from the pair's entry leaves its rank, from others more than a rank
        rank = F.aggregate(bucket, none, lambda least, x: F.least(least, x.bitwiseXOR(F.shiftleft(b, 17))))
        return F.shiftleft(F.least(rank, none), 17).bitwiseOR(a)

    def step(parts, _):
        def merged(p):  # the place of the least part, from 1
            def part(x, i):
                first = packed(F.shiftright(x, 17), ident(F.get(parts, p + 1)))
                before = packed(ident(x), F.shiftright(F.get(parts, p - 1), 17))
                return F.when((i < p - 2) | (i > p), x).when(i == p - 1, first).when(i == p, gone).otherwise(before)

            return F.array_remove(F.transform(parts, part), gone)

        place = F.array_position(parts, F.array_min(parts)).cast("int")
        return F.when(F.array_min(parts) < _long(NONE * SHIFT), _bound(place, merged)).otherwise(parts)

    parts = F.transform(word, lambda a, i: F.get(starts, F.shiftleft(a, 9).bitwiseOR(F.coalesce(F.get(word, i + 1), F.lit(256)))))
    return F.transform(F.aggregate(F.slice(word, F.lit(2), rest), parts, step), ident)


def heap_merges(ids: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """The same merges for long words: lowest rank first, then leftmost."""
    ids, n = list(ids), len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(pairs[p], i) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in pairs]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i] if ids[i] is not None else n
        if j >= n or pairs.get((ids[i], ids[j])) != rank:
            continue
        ids[i], ids[j], after[i] = rank, None, after[j]
        if after[j] < n:
            before[after[j]] = i
            if (p := (rank, ids[after[i]])) in pairs:
                heapq.heappush(heap, (pairs[p], i))
        if before[i] >= 0 and (p := (ids[before[i]], rank)) in pairs:
            heapq.heappush(heap, (pairs[p], before[i]))
    return [x for x in ids if x is not None]


class _Vocabulary:
    """Tokens as columns: their bytes and ranks."""

    def __init__(self, path: str):
        ranks = ranks_of(path)
        self.path, self.pieces, self.ranks = path, pa.array(list(ranks), pa.binary()), np.fromiter(ranks.values(), np.int32, len(ranks))

    def tokens(self, words: pa.Array) -> np.ndarray:
        """The rank of each word that is a token, -1 for others."""
        at = pc.index_in(words.cast(pa.binary()), value_set=self.pieces).fill_null(-1).to_numpy()
        return np.where(at >= 0, self.ranks[at], -1)

    @staticmethod
    def bytes_of(words: pa.Array) -> pa.ListArray:
        """The bytes of each word, as numbers."""
        raw = pa.concat_arrays([words.cast(pa.binary())])
        ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int32)
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        return pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(data.astype(np.int32)))


def _lists(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The values of a list column, and where each row's begin and end."""
    ends = column.offsets.to_numpy()
    return column.values.slice(ends[0], ends[-1] - ends[0]), ends - ends[0]


def _counts(path: str):
    """Words that are no tokens, with their occurrences in a part of the texts."""

    def run(batches):
        vocabulary, parts = _Vocabulary(path), []

        def gathered():
            table = pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")])
            parts[:] = [table.select(["word", "n_sum"]).rename_columns(["word", "n"])]
            return parts[0]

        def flush():
            table = gathered()
            parts.clear()
            # the table only saves work: a word seen once here does not earn a place here
            table = table.filter(pc.and_(pc.greater(table["n"], 1), pc.less_equal(pc.binary_length(table["word"]), FOLD_BYTES)))
            words = table["word"].combine_chunks()
            return table.filter(pa.array(vocabulary.tokens(words) < 0)).to_batches() if len(words) else []

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                values, _ = _words(batch.column(0).slice(at, ROWS))
                seen = values.value_counts()
                parts.append(pa.table({"word": seen.field(0), "n": seen.field(1)}))
                if len(parts) >= 16 and len(gathered()) > HELD:
                    yield from flush()
        if parts:
            yield from flush()

    return run


def _bundle(values: pa.Array, at: int) -> pa.ListArray:
    """A column of one row that holds the values from ``at`` on, at most ``BUNDLE`` of them."""
    part = values.slice(at, BUNDLE)
    return pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)


def _byte_rows(path: str):
    def run(batches):
        for batch in batches:
            words = batch.column(0)
            for at in range(0, len(words), BUNDLE):
                yield pa.record_batch([_bundle(words, at), _bundle(_Vocabulary.bytes_of(words), at), *_maps(path)], ["words", "bytes", "_ranks", "_starts"])

    return run


def word_table(words: DataFrame, path: str) -> pa.Table:
    """(word, ids) of the corpus's most frequent words, at most ``TABLE_WORDS`` of them."""
    counts = words.mapInArrow(released(_counts(path)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN)
    counts = written(counts, "bpe-words")
    level = F.floor(F.log2("n") * 8)
    steps = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()  # a few hundred at most
    least, room = 1 << 20, TABLE_WORDS
    for row in sorted(steps, key=lambda r: -r["level"]):
        room -= row["words"]
        if room < 0:
            break
        least = row["level"]
    often = counts.filter(level >= least).select("word").repartition(words.sparkSession.sparkContext.defaultParallelism, "word")
    bundles = often.mapInArrow(released(_byte_rows(path)), f"words array<string>, bytes array<array<int>>, {MAPS}")
    folded = bundles.select("words", fold_bundle(F.col("bytes")).alias("ids")).toArrow()
    flat = lambda c: pc.list_flatten(folded[c])
    return pa.table({"word": flat("words").cast(pa.string()), "ids": flat("ids").cast(pa.list_(pa.int32()))})


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


#: Kinds of rows: words to fold, words with ids (both in bundles), documents, and what begins a stretch.
FOLD, DONE, DOCUMENT, STRETCH = 0, 1, 2, 3
_INTS = pa.list_(pa.int32())


def _found(words: pa.Array, among: pa.Array) -> pa.Array:
    """Where each word stands among others, null where it does not."""
    return pc.index_in(words, value_set=among) if len(among) else pa.nulls(len(words), pa.int32())


def _blocks(path: str, table, block_words: int):
    """Blocks: the distinct words that are no tokens and new in the stretch, in bundles,
    then the documents, where -i stands for the stretch's word i - 1."""

    def run(batches):
        vocabulary, known, pairs = _Vocabulary(path), pa.ipc.open_stream(table.value).read_all().combine_chunks(), None
        rows, texts, sizes, held = [], [], [], 0
        numbered = pa.array([], pa.string())  # the stretch's words, in order

        def batch_of(kind: int, words: pa.Array, maps, ids: pa.Array, row: pa.Array) -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.full(len(row), kind, np.int32)), words, *maps, ids, row], ["_kind", "_words", "_ranks", "_starts", "_ids", "_row"])

        def word_rows(kind: int, ids: pa.Array):
            maps = _maps(path) if kind == FOLD else no_maps(1)
            for at in range(0, len(ids), BUNDLE):
                yield batch_of(kind, _bundle(ids, at), maps, pa.nulls(1, _INTS), pa.nulls(1, rows[0].type))

        def no_maps(n: int) -> list[pa.Array]:
            return [pa.nulls(n, pa.list_(pa.list_(pa.int64()))), pa.nulls(n, pa.list_(pa.int64()))]

        def block():
            nonlocal pairs, numbered
            one = pa.chunked_array(texts).unify_dictionaries()
            words = one.chunk(0).dictionary
            refs = vocabulary.tokens(words)
            others = np.flatnonzero(refs < 0)
            rare = words.take(pa.array(others))
            before = _found(rare, numbered)
            if not len(numbered) or len(numbered) + before.null_count > STRETCH_WORDS or numbered.nbytes + rare.nbytes > STRETCH_BYTES:
                numbered, before = numbered[:0], pa.nulls(len(rare), pa.int32())
                yield batch_of(STRETCH, pa.nulls(1, pa.list_(_INTS)), no_maps(1), pa.nulls(1, _INTS), pa.nulls(1, rows[0].type))
            new = np.flatnonzero(before.is_null().to_numpy(zero_copy_only=False))
            fresh = rare.take(pa.array(new))
            found = _found(fresh, known["word"].combine_chunks())
            long = pc.greater(pc.binary_length(fresh), FOLD_BYTES)
            fold = np.flatnonzero(pc.and_(found.is_null(), pc.invert(long)).to_numpy(zero_copy_only=False))
            heap = np.flatnonzero(pc.and_(found.is_null(), long).to_numpy(zero_copy_only=False))
            done = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
            yield from word_rows(FOLD, vocabulary.bytes_of(fresh.take(pa.array(fold))))
            if len(done):
                yield from word_rows(DONE, known["ids"].combine_chunks().take(found.take(pa.array(done))))
            if len(heap):
                pairs, ranks = pairs or pair_ranks(path), ranks_of(path)
                yield from word_rows(DONE, pa.array([heap_merges([ranks[bytes([b])] for b in x.encode()], pairs) for x in fresh.take(pa.array(heap)).to_pylist()], _INTS))
            order = np.concatenate([fold, done, heap])
            numbers = before.fill_null(0).to_numpy(zero_copy_only=False).copy()
            numbers[new[order]] = len(numbered) + np.arange(len(order))
            refs[others] = -1 - numbers
            numbered = pa.concat_arrays([numbered, fresh.take(pa.array(order))])
            for part, own, ends in zip(one.chunks, rows, sizes, strict=True):
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(refs[part.indices.to_numpy()]))
                yield batch_of(DOCUMENT, pa.nulls(len(own), pa.list_(_INTS)), no_maps(len(own)), ids, own)
            for x in (rows, texts, sizes):
                x.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                values, ends = _words(part.column(0))
                texts.append(values.dictionary_encode())
                sizes.append(ends)
                rows.append(pa.concat_arrays([part.column(1)]))
                held += len(values)
                if held >= block_words:
                    yield from block()
                    held = 0
        if rows:
            yield from block()

    return run


def _documents(finish):
    """Rows with their ids: the stretch's words put in place of their references."""

    def run(batches):
        pool, starts, words = np.empty(0, np.int32), np.zeros(1, np.int64), []
        for batch in batches:
            kinds = batch.column(0).to_numpy()
            kinds = np.where(kinds == FOLD, DONE, kinds)
            cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if kinds[a] == STRETCH:
                    pool, starts = np.empty(0, np.int32), np.zeros(1, np.int64)
                    continue
                if kinds[a] == DONE:
                    values, ends = _lists(_lists(batch.column(1).slice(a, b - a))[0])
                    words.append((values.to_numpy(), np.diff(ends)))
                    continue
                if words:
                    pool = np.concatenate([pool, *[x for x, _ in words]])
                    starts = np.concatenate([starts, starts[-1] + np.cumsum(np.concatenate([n for _, n in words]))])
                    words = []
                for at in range(a, b, ROWS):
                    values, ends = _lists(batch.column(2).slice(at, min(ROWS, b - at)))
                    made = _placed(values.to_numpy(), ends, pool, starts, batch.column(3).slice(at, min(ROWS, b - at)))
                    yield finish(made) if finish else made

    return run


def _placed(flat: np.ndarray, ends: np.ndarray, pool: np.ndarray, starts: np.ndarray, rows: pa.StructArray) -> pa.RecordBatch:
    hits = np.flatnonzero(flat < 0)
    which = -1 - flat[hits]
    n = starts[which + 1] - starts[which]
    sizes = np.ones(len(flat), np.int64)
    sizes[hits] = n
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(at[-1], np.int32)
    out[at[:-1][flat >= 0]] = flat[flat >= 0]
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(at[:-1][hits], n) + within] = pool[np.repeat(starts[which], n) + within]
    ids = pa.ListArray.from_arrays(pa.array(at[ends], pa.int32()), pa.array(out))
    return pa.record_batch([*rows.flatten(), ids], [*[f.name for f in rows.type], "_ids"])


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text: str = "text", out: str = "ids", block_words: int = BLOCK_WORDS, finish=None, schema: str | None = None) -> DataFrame:
    """``docs`` without ``text`` but with ``out``: its token ids, array<int>.

    With ``finish``, a function of a record batch (the other columns and ``_ids``)
    whose results have the given ``schema``, those come back instead: it runs
    where the ids are put together, which saves sending them on.
    """
    spark = docs.sparkSession
    cut = cut_words(F.col(text), spark_pattern(spark, pattern))
    table = spark.sparkContext.broadcast(_packed(word_table(docs.select(cut.alias("_cut")), path)))
    give_back()
    kept = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields if f.name not in (text, out)])
    row = F.struct(*[F.col(f"`{c}`") for c in kept.names]) if len(kept) else F.struct(F.lit(0).alias("_none"))
    inner = kept if len(kept) else T.StructType([T.StructField("_none", T.IntegerType())])
    ints = T.ArrayType(T.IntegerType())
    fields = [("_kind", T.IntegerType()), ("_words", T.ArrayType(ints)), *[(f.name, f.dataType) for f in T.StructType.fromDDL(MAPS)], ("_ids", ints), ("_row", inner)]
    rows = T.StructType([T.StructField(name, kind) for name, kind in fields])
    blocks = docs.select(cut.alias("_cut"), row.alias("_row")).mapInArrow(released(_blocks(path, table, block_words)), rows)
    words = F.when(F.col("_kind") == FOLD, fold_bundle(F.col("_words"))).otherwise(F.col("_words"))
    made = blocks.select("_kind", words.alias("_words"), "_ids", "_row").mapInArrow(released(_documents(finish)), schema if finish else T.StructType([*inner.fields, rows["_ids"]]))
    return made if finish else made.select(*[F.col(f"`{c}`") for c in kept.names], F.col("_ids").alias(out))


@lru_cache(maxsize=2)
def pieces_of(path: str) -> pa.Array:
    """The tokens' bytes, by id."""
    pieces: list[bytes] = [b""] * (max(ranks_of(path).values()) + 1)
    for piece, rank in ranks_of(path).items():
        pieces[rank] = piece
    return pa.array(pieces, pa.binary())


def joined(ids: pa.ListArray, pieces: pa.Array) -> pa.Array:
    """For each list of ids its pieces, concatenated."""
    values, ends = _lists(ids.fill_null([]) if ids.null_count else ids)
    raw = pieces.take(values)
    starts = np.frombuffer(raw.buffers()[1], np.int32) if len(raw) else np.zeros(1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(starts[ends], np.int32)), raw.buffers()[2] if len(raw) else pa.py_buffer(b"")])


def _decoded(path: str, at: int):
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                yield pa.record_batch([*part.columns, joined(part.column(at), pieces_of(path))], [*part.schema.names, "_bytes"])

    return run


def decode(coded: DataFrame, path: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """``coded`` with ``out``: the bytes that the ids stand for, their pieces
    concatenated. Null ids give no bytes."""
    names = [c for c in coded.columns if c != out]
    rows = coded.select([F.col(f"`{c}`") for c in names])
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in rows.schema.fields], T.StructField("_bytes", T.BinaryType())])
    return rows.mapInArrow(released(_decoded(path, names.index(ids))), schema).withColumnRenamed("_bytes", out)


@lru_cache(maxsize=2)
def _decimals(n: int) -> pa.Array:
    return pa.array([b"%d," % i for i in range(n)], pa.binary())


def digests(path: str):
    """A ``finish`` for rows of doc_id: the number of ids, and the digests of the
    decimal ids and of the bytes that they decode to."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("_ids")
        numbers = joined(ids, _decimals(len(pieces_of(path))))
        sha = lambda column, end: pa.array([hashlib.sha256(memoryview(x.as_buffer())[: len(x.as_buffer()) - end] if x.as_buffer().size else b"").hexdigest() for x in column])
        sizes = pc.list_value_length(ids).cast(pa.int64())
        return pa.record_batch([batch.column("doc_id"), sizes, sha(numbers, 1), sha(joined(ids, pieces_of(path)), 0)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run
