"""MPEG columns, BPE, chat formatting and near-duplicates: round trips, brute force and odd rows."""

import collections
import hashlib
import itertools
import random
import re
import types
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from clauseloom.llm import bpe, chat_format, mpeg_audio, near_dedup, queries

SF = "/root/testdata/sf0.01"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def parsed(media):
    return dict(zip([x.split()[0] for x in re.sub("<[^>]*>", "", mpeg_audio.READ).split(", ")], mpeg_audio.read_bytes(media), strict=True))


def test_mpeg_round_trip():
    random.seed(1)
    for n in [0, 1, 63, 64, 65, 1416, 1417, 1418, 5000, 100_000]:
        raw = bytes(random.randrange(256) for _ in range(n))
        media = mpeg_audio.store_bytes(raw)
        got = parsed(media)
        padded = raw + bytes(-n % 64 or (0 if n else 64))
        assert got["payload"] == padded and got["n_bytes"] == n and got["payload_crc_ok"] and got["vbr_ok"] and got["seek_ok"]
        assert got["crc_bad"] == 0 and got["crc_checked"] == got["frames"] + 1 and got["samples"] == 1152 * got["frames"]
        assert all(mpeg_audio.header(media[o : o + 4]) for o in got["offsets"])


def test_mpeg_damage():
    raw = bytes(range(256)) * 40
    media = mpeg_audio.store_bytes(raw)
    offsets = parsed(media)["offsets"]
    junk = media[: offsets[2]] + b"\xff\x00junk\xff\xe0" + media[offsets[2] :]
    got = parsed(junk)
    assert got["payload"] == parsed(media)["payload"] and got["resyncs"] >= 1 and not got["vbr_ok"]
    hurt = bytearray(media)
    hurt[offsets[1] + 8] ^= 1
    assert parsed(bytes(hurt))["crc_bad"] == 1
    assert parsed(b"")["frames"] == 0 and parsed(b"\xff" * 50)["frames"] == 0
    at = media.index(b"Xing")
    table = bytearray(media)
    table[at + 16 + 60] ^= 128  # one seek point
    assert parsed(bytes(table))["seek_ok"] is False and parsed(bytes(table))["vbr_ok"]


def crc_of_bits(bits):
    """The checksum as polynomial division, bit by bit."""
    rest = [1] * 16
    for bit in bits:
        top = rest[0] ^ int(bit)
        rest = rest[1:] + [0]
        if top:
            rest = [x ^ y for x, y in zip(rest, map(int, f"{0x8005:016b}"), strict=True)]
    return int("".join(map(str, rest)), 2)


def protected_frame(head, bits):
    size = mpeg_audio.header(head)[0]
    crc = crc_of_bits(f"{head[2]:08b}{head[3]:08b}" + bits)
    body = bits + "01" * (8 * size)
    return head + crc.to_bytes(2, "big") + int(body[: 8 * (size - 6)], 2).to_bytes(size - 6, "big")


def test_mpeg_checksums_of_layers_one_and_two():
    random.seed(4)
    rand = lambda n: "".join(random.choice("01") for _ in range(n))
    one = lambda mode: bytes((0xFF, 0xFE, 8 << 4, mode))  # noqa: E731  44.1 kHz, 256 kbit/s
    frames = [protected_frame(one(0xC0), rand(128)), protected_frame(one(0x00), rand(256)), protected_frame(one(0x40), rand(4 * (2 * 4 + 28)))]
    # layer II, 44.1 kHz: 128 kbit/s stereo (64 a channel: 27 bands), 192 mono (30), 32 mono (8), joint stereo from band 8 on
    for index, mode, bands, widths in ((8, 0x00, 27, lambda b: 4 if b < 11 else 3 if b < 23 else 2), (10, 0xC0, 30, lambda b: 4 if b < 11 else 3 if b < 23 else 2), (1, 0xC0, 8, lambda b: 4 if b < 2 else 3), (8, 0x50, 27, lambda b: 4 if b < 11 else 3 if b < 23 else 2)):
        bits, chosen = "", 0
        for b in range(bands):
            for _ in range(1 if mode == 0xC0 or (mode == 0x50 and b >= 8) else 2):
                value = random.choice(["0" * widths(b), rand(widths(b))])
                bits += value
                chosen += (int(value, 2) > 0) * (2 if mode == 0x50 and b >= 8 else 1)
        frames.append(protected_frame(bytes((0xFF, 0xFC, index << 4, mode)), bits + rand(2 * chosen)))
    for f in frames:
        good, hurt = parsed(f * 3), bytearray(f * 3)
        hurt[len(f) + 7] ^= 16
        assert (good["frames"], good["crc_checked"], good["crc_bad"]) == (3, 3, 0)
        assert parsed(bytes(hurt))["crc_bad"] == 1


def test_mpeg_foreign_tags():
    frame = mpeg_audio.store_bytes(b"x")[-144:]
    sync = lambda n: bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))

    def tag(version, flags, frames, extended=b""):
        body = extended + b"".join(name + (sync(len(d)) if version == 4 else len(d).to_bytes(4, "big")) + b"\0\0" + d for name, d in frames)
        if flags & 0x80:
            body = body.replace(b"\xff", b"\xff\0")
        return b"ID3" + bytes((version, 0, flags)) + sync(len(body)) + body

    texts = [(b"TIT2", b"\1" + "é漢".encode("utf-16")), (b"TPE1", b"\3" + "né".encode()), (b"TALB", b"\2" + "ab".encode("utf-16-be")), (b"TXXX", b"\0payload_bytes\0many"), (b"TXXX", b"\0n_bytes\0-"), (b"TXXX", b"\0payload_crc32\0x"), (b"APIC", b"\0\xff\xe0")]
    for version, flags, extended in ((3, 0, b""), (4, 0, b""), (3, 0x80, b""), (3, 0x40, b"\0\0\0\6" + bytes(6)), (4, 0x40, b"\0\0\0\6" + bytes(2))):
        got = parsed(tag(version, flags, texts, extended) + frame * 2 + b"TAG" + b"Old".ljust(30, b"\0") + bytes(95))
        assert (got["tags"]["TIT2"], got["tags"]["TPE1"], got["tags"]["TALB"]) == ("é漢", "né", "ab")
        assert got["payload"] == b"" and got["n_bytes"] == 0 and got["payload_crc_ok"] is None and got["frames"] == 2 and got["resyncs"] == 0
    assert parsed(frame * 2 + b"TAG" + b"Old".ljust(30, b"\0") + bytes(95))["tags"] == {"TIT2": "Old"}
    for cut in range(0, 200, 7):
        parsed(tag(4, 0x40, texts)[:cut])


def test_mpeg_payload_that_spells_an_old_tag():
    met = 0
    for n in range(3001):
        media = mpeg_audio.store_bytes(b"y" * n)
        at = n - media[-128:].count(b"y")
        raw = (b"y" * at + b"TAG" + b"y" * n)[:n]
        media = mpeg_audio.store_bytes(raw)
        met += media[-128:-125] == b"TAG"
        got = parsed(media)
        assert got["payload"][:n] == raw and len(got["payload"]) == max(64, -(-n // 64) * 64) and got["payload_crc_ok"] and got["vbr_ok"], n
        if n % 100 == 0:
            tagged = parsed(media + b"TAG" + b"title".ljust(125, b"\0"))
            assert tagged["tags"]["TIT2"] == "title" and tagged["payload"] == got["payload"] and tagged["vbr_ok"] and tagged["resyncs"] == 0
    assert met > 1500
    cut = parsed(mpeg_audio.store_bytes(b"y" * 5000)[:-20] + b"TAG" + b"title".ljust(125, b"\0"))
    assert cut["tags"]["TIT2"] == "title"


def test_mpeg_vbri():
    frames = [mpeg_audio._frame(i, b"") for i in (3, 5, 9, 2, 7)]
    steps = b"".join(len(f).to_bytes(2, "big") for f in frames)
    head = bytearray(mpeg_audio._frame(9, b""))
    size = len(head) + sum(map(len, frames))
    head[36:62] = b"VBRI" + bytes(6) + size.to_bytes(4, "big") + (5).to_bytes(4, "big") + (5).to_bytes(2, "big") + (1).to_bytes(2, "big") + (2).to_bytes(2, "big") + (1).to_bytes(2, "big")
    head[62 : 62 + len(steps)] = steps
    got = parsed(bytes(head) + b"".join(frames))
    assert (got["vbr_frames"], got["vbr_bytes"], got["vbr_ok"], got["seek_ok"], got["frames"]) == (5, size, True, True, 5)
    head[63] += 1
    assert parsed(bytes(head) + b"".join(frames))["seek_ok"] is False


def test_mpeg_query_equals_brute_force(spark, tmp_path):
    texts = [None, "", "plain", "é漢😀 " * 900, "plain", "z" * 64]
    spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media int").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op4_media_mpeg(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        media, r = mpeg_audio.store_bytes(raw), got[i]
        frames = -(-len(padded) // mpeg_audio._room(14))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256, len(r.frame_offsets)) == (len(media), hashlib.sha256(media).hexdigest(), frames)
        assert abs(r.duration_s - frames * 1152 / 32000) < 1e-12 and r.feature.startswith(f"frames={frames};samples={1152 * frames};rate=32000;") and "vbr_ok=true;seek_ok=true" in r.feature
    assert got[2].feature == got[4].feature and got[2].media_sha256 == got[4].media_sha256


def test_mpeg_columns(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "é" * 70_000, 1), (4, "same", 1), (4, "same", 1), (None, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, p int")
    got = df.select("doc_id", "text", mpeg_audio.read(mpeg_audio.store(F.col("text"))).alias("r")).collect()
    for r in got:
        raw = (r.text or "").encode()
        assert bytes(r.r.payload) == raw + bytes(-len(raw) % 64 or (0 if raw else 64))
    assert df.limit(0).select(mpeg_audio.read(mpeg_audio.store(F.col("text")))).count() == 0
    assert spark.range(1).select(mpeg_audio.read(F.lit(None).cast("binary")).alias("r")).first().r.payload is None


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(RANKS), special_tokens={})


def check_bpe(spark, docs):
    enc, want = library(), collections.Counter()
    for r in docs.collect():
        ids = enc.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, queries.bpe_digests(docs, RANKS).collect())) == want


def odd_texts():
    random.seed(5)
    odd = [None, "", " ", "  a  b ", "\n \n x", "a" * 500, "ab" * 3000, "' 's''t", "\x1c\x1d a\x1f b\x85c  d\u2003 e", "é" * 300, "<|endoftext|> x", "🤷🏽\u200d♀️ ﷽ ١٢٣ Ⅷ½ ǅ ͏a", " " * 700 + "x", "don't I'll we'VE", "x " * 50_000]
    odd += ["".join(random.choice("ab \n\t'st1.,é😀\u3000\x1fè漢") for _ in range(random.randint(1, 60))) for _ in range(200)]
    odd += ["".join(chr(random.choice([random.randint(1, 0xD7FF), random.randint(0xE000, 0x10FFFF)])) for _ in range(40)) for _ in range(100)]
    return [(i, x, "clash") for i, x in enumerate(odd)] + [(3, odd[3], "clash"), (None, "thing", "clash")]


def test_bpe_odd_texts(spark):
    docs = spark.createDataFrame(odd_texts(), "doc_id long, text string, ids string")
    check_bpe(spark, docs)
    assert queries.bpe_digests(docs.limit(0), RANKS).count() == 0


def test_bpe_every_code_point(spark):
    points = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i <= 0xDFFF]
    rows = [(at, "a".join(points[at : at + 2000]) + " " + " ".join(points[at : at + 2000])) for at in range(0, len(points), 2000)]
    check_bpe(spark, spark.createDataFrame(rows, "doc_id long, text string").filter("doc_id < 240000 or doc_id >= 900000"))


def test_bpe_small_blocks_and_clashes(spark):
    """Several blocks in a task; a column with the result's name is replaced, others stay as they are."""
    rows = [(i, t, x, {"_kind": i}) for i, t, x in odd_texts()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, _row map<string,int>").withColumn("bytes", F.lit(1)).repartition(2)
    coded = bpe.decode(bpe.encode(docs, RANKS, block_words=700), RANKS)
    assert coded.columns == ["doc_id", "_row", "ids", "bytes"]
    enc = library()
    want = collections.Counter((i, str(m), tuple(enc.encode_ordinary(t or "")), (t or "").encode()) for i, t, _, m in rows)
    assert collections.Counter((r.doc_id, str(r._row), tuple(r.ids), bytes(r.bytes)) for r in coded.collect()) == want
    only = bpe.encode(docs.select("text"), RANKS)
    assert only.columns == ["ids"] and only.count() == len(rows)


def test_bpe_plan_without_rank_map(spark):
    """The rank map travels with the words; as a literal, every plan of the driver held it (over a million characters)."""
    plan = bpe.encode(spark.createDataFrame([(1, "unwordlike")], "doc_id long, text string"), RANKS)._jdf.queryExecution()
    assert len(plan.optimizedPlan().toString()) < 100_000


@pytest.mark.parametrize("most", [10, 600_000])
def test_bpe_stretches(monkeypatch, most):
    """Blocks of one stretch have a word folded once; a stretch of few words ends early. Both place the same ids."""
    monkeypatch.setattr(bpe, "STRETCH_WORDS", most)
    texts = [" ".join(f"qz{chr(97 + i * j % 23)}xvwk" for j in range(30)) for i in range(40)]
    cut = pa.StructArray.from_arrays([pa.array(["".join(w + bpe.MARK for w in re.findall(" ?[a-z]+", t)) for t in texts]), pa.nulls(40, pa.list_(pa.string()))], ["marked", "listed"])
    rows = pa.record_batch([cut, pa.StructArray.from_arrays([pa.array(range(40))], ["doc_id"])], ["_cut", "_row"])
    monkeypatch.setattr(bpe, "ROWS", 4)
    none = bpe._packed(pa.table({"word": pa.array([], pa.string()), "ids": pa.array([], bpe._INTS)}))
    made = list(bpe._blocks(RANKS, types.SimpleNamespace(value=none), 100)([rows]))
    ranks, pairs = bpe.ranks_of(RANKS), bpe.pair_ranks(RANKS)
    folds, out = [], []
    for b in made:
        kind = b.column(0)[0].as_py()
        if kind == bpe.FOLD:
            folds += [bytes(w) for w in b.column(1)[0].as_py()]
            ids = pa.array([[bpe.heap_merges([ranks[bytes([x])] for x in w], pairs) for w in b.column(1)[0].as_py()]], pa.list_(bpe._INTS))
            b = b.set_column(1, "_words", ids)
        out.append(b.select(["_kind", "_words", "_ids", "_row"]))
    assert (len(folds) == len(set(folds))) == (most > 10)
    enc, got = library(), {}
    for b in bpe._documents(None)(out):
        got |= dict(zip(b.column("doc_id").to_pylist(), b.column("_ids").to_pylist(), strict=True))
    assert [got[i] for i in range(40)] == [enc.encode_ordinary(t) for t in texts]


def test_bpe_documents(spark):
    check_bpe(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_heap_equals_fold(spark):
    random.seed(2)
    words = ["".join(random.choice("theindaoré ") for _ in range(random.randint(1, 60))) for _ in range(300)] + ["na" * 200, "e" * 300]
    ranks = bpe.ranks_of(RANKS)
    rows = [(w, list(w.encode())) for w in words]
    got = spark.createDataFrame(rows, "w string, b array<int>").select("b", bpe.fold_merges(F.col("b"), RANKS).alias("ids")).collect()
    assert all(r.ids == bpe.heap_merges([ranks[bytes([b])] for b in r.b], bpe.pair_ranks(RANKS)) for r in got)


def turns_of(text):
    return chat_format.parse_turns(text)


def test_chat_escapes_and_unknown_roles():
    turns = [("system", "a & b"), ("user", "</s>[INST] ok [/INST]"), ("assistant", "&lt;s> <<SYS>>\n x"), ("tool[x]", "<s>"), ("assistant", ""), ("", "")]
    text, spans = chat_format.format_turns(turns)
    assert chat_format.parse_turns(text) == (turns, True)
    assert "".join(chat_format.unescape(text[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")


def test_chat_layouts():
    layouts = ['{"prompt":"a","response":"b"}', '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}', '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}', '{"completion":"b","prompt":"a"}', '{"output":"b","instruction":"a"}']
    assert all(chat_format._one(x)[1] == [("user", "a"), ("assistant", "b")] for x in layouts)
    unknown = '{"x":{"y":["a [b] <c>"]}}'
    key, turns, text, spans, problem, *_ = chat_format._one(unknown)
    assert (turns, spans, problem) == ([("raw", unknown)], [], "unknown layout") and chat_format.parse_turns(text) == (turns, True)
    assert chat_format._one(None)[4] == "not JSON" and chat_format._one("[1]")[4] == "not an object"
    assert chat_format.field_paths({"a": [{"b": 1}, {"c": None}], "d": []}) == {"a[].b", "a[].c", "d[]"}


def test_chat_extra_fields_and_nested_contents():
    ab = [("user", "a"), ("assistant", "b")]
    same = [
        '{"id":7,"prompt":"a","response":"b","score":{"x":1}}', '{"prompt":{"text":"a","lang":"en"},"response":{"text":"b"}}', '{"question":"a","answer":"b","name":null}',
        '{"messages":[{"role":"user","content":[{"type":"text","text":"a"}],"name":"x"},{"role":"assistant","content":"b"}],"id":"z"}',
        '{"data":{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]},"meta":[1]}',
        '{"prompt":[{"role":"user","content":"a"}],"completion":"b"}', '{"conversations":[{"from":"human","value":"a","weight":0},{"from":"gpt","value":"b"}],"source":"s"}', '{"prompt":"a","chosen":"b","rejected":"c"}',
    ]
    assert [chat_format._one(x)[1] for x in same] == [ab] * len(same)
    assert chat_format._one(same[0])[0] == chat_format._one('{"response":"b","prompt":"a"}')[0]
    assert chat_format._one('{"system":"s","prompt":"a","response":null}')[1] == [("system", "s"), ("user", "a"), ("assistant", "")]
    parts = '{"messages":[{"role":"user","content":[{"type":"text","text":"a"},{"type":"image_url","image_url":{"url":"u"}},"c"]}]}'
    assert chat_format._one(parts)[1] == [("user", 'a{"type": "image_url", "image_url": {"url": "u"}}c')]
    assert chat_format._one('{"messages":[]}')[1] == [] and chat_format._one("[" * 100_000)[4] == "not JSON"


def test_chat_query(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 1, "assistant", "b<[]&"), (2, 0, "user", "a"), (2, 0, "user", "a"), (3, 0, None, "x"), (4, None, "system", ""), (None, 0, "user", "n"), (5, 0, "system", "s"), (5, 1, "user", "u" * 100_000), (5, 2, "assistant", "v"), (6, 0, "assistant", "only")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("f", F.lit(1)).write.parquet(str(tmp_path / "conversations.parquet"))
    by = collections.defaultdict(list)
    for c, t, r, x in rows + [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    got = queries.op10_chat_format(spark, str(tmp_path)).collect()
    assert len(got) == len(by)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in got:
        turns = sorted(by[r.conv_id])
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{a}\n{x}\n" for _, a, x in turns)), len(loss), sha(loss))


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = {d: d for d, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    inverted, shared = collections.defaultdict(list), collections.Counter()
    for i, s in enumerate(sets):
        for k in s:
            inverted[k].append(i)
    for v in inverted.values():
        shared.update(itertools.combinations(v, 2))
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(rows[a][0]), find(rows[b][0])
            up[max(x, y)] = min(x, y)
    return collections.Counter((d, len(s), find(d), find(d) == d) for (d, _), s in zip(rows, sets, strict=True))


def same_components(spark, rows):
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n_shingles int")
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect())
    assert got == brute_components(rows)


def test_near_dedup_documents(spark):
    same_components(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])


def test_near_dedup_families_at_the_threshold(spark):
    """Near copies whose similarity lies around the threshold, documents that share a passage, odd rows."""
    random.seed(11)
    word = lambda: "w%d" % random.randrange(10**6)
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join([word() for _ in range(40)] + passage + [word() for _ in range(40)])) for i in range(150)]
    stem = [word() for _ in range(100)]
    for i in range(200, 320):
        copy = list(stem)
        for _ in range(3):
            copy[random.randrange(100)] = word()
        rows.append((i, " ".join(copy)))
    rows += [(400 + i, passage_text) for i, passage_text in enumerate(["A b  C", "a b c", "a b", "", None, "a\tb\nc", "x " * 9000, "x " * 9001])]
    rows += [(500 + i, " ".join(stem)) for i in range(30)]
    same_components(spark, rows)


def test_near_dedup_open_rows_go_through_prefixes(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 3)
    test_near_dedup_families_at_the_threshold(spark)


def test_near_dedup_ids_with_several_texts(spark):
    rnd = random.Random(2)
    words = lambda n: [str(rnd.randrange(10**6)) for _ in range(n)]
    changed = lambda t, *at: [("x" + w if i in at else w) for i, w in enumerate(t)]
    a, b, c, d = words(250), words(250), words(80), words(80)
    rows = [(1, a), (1, b), (2, changed(a, 100)), (3, changed(b, 7)), (7, c), (7, d), (7, a), (8, changed(d, 40)), (9, changed(c, 3)), (9, words(30)), (4, words(9)), (4, words(3))]
    rows += [(5, words(40)) for _ in range(30)] + [(6, changed(a, 5, 200))]
    same_components(spark, [(i, " ".join(t)) for i, t in rows])


def test_near_dedup_recall_just_above_the_threshold(spark):
    """Pairs with an index of 0.75 to 0.80, planted from ten seeds: all are found."""
    rows, planted = [], 0
    for seed in range(10):
        rnd = random.Random(seed)
        for _ in range(40):
            t = [f"{seed}-{rnd.randrange(10**9)}" for _ in range(rnd.randint(60, 300))]
            u, n = list(t), len(t) - 4
            apart = lambda: len({i for i in range(n) for j in range(i, i + 5) if t[j] != u[j]})  # noqa: E731, B023
            for i in rnd.sample(range(len(t)), len(t)):
                was, u[i] = u[i], "x"
                if (n - apart()) / (n + apart()) < 0.75:
                    u[i] = was
                    break
            planted += 0.75 <= (n - apart()) / (n + apart()) <= 0.80
            rows += [(len(rows), " ".join(t)), (len(rows) + 1, " ".join(u))]
    assert planted > 300
    same_components(spark, rows)


def test_near_dedup_repeated_ids(spark):
    text = " ".join(map(str, range(50)))
    rows = [(1, text), (1, text), (2, "p q r s t u v"), (1, "p q r s t u v"), (None, text), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect())
    assert got == {(1, 1, True): 3, (2, 1, False): 1, (None, None, True): 1, (3, 3, True): 1}
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_chat_rest_keeps_what_no_mapping_names():
    import json

    calls = [{"id": "c1", "function": {"name": "f", "arguments": "{}"}}]
    cases = [
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None, "tool_calls": calls}]}, {"messages": [None, {"tool_calls": calls}]}),
        ({"instruction": "a", "input": "b", "output": "c", "context": "long text"}, {"context": "long text"}),
        ({"prompt": "a", "chosen": "b", "rejected": "c", "score": 3}, {"rejected": "c", "score": 3}),
        ({"prompt": "a", "response": "b"}, None),
        ({"messages": []}, None),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "x"}, {"type": "image", "url": "u"}]}], "meta": {}, "tags": []}, {"meta": {}, "tags": []}),
        ({"prompt": {"text": "a", "lang": "en"}, "response": {"text": "b"}}, {"prompt": {"lang": "en"}}),
    ]
    for record, want in cases:
        *_, problem, rest, unmapped = chat_format._one(json.dumps(record))
        assert problem is None and (None if rest is None else json.loads(rest)) == want
        assert (unmapped is None) == (want is None) and (want is None or set(unmapped) == chat_format.field_paths(want))
    assert chat_format._one("no JSON")[-2:] == (None, None)
