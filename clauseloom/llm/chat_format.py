"""Chat formatting by schema fingerprints.

A record is one JSON object in any known layout. Those of its nested field paths
that any layout knows are hashed; the hash selects a declarative mapping, which
yields canonical turns (role, text). Other fields do not count for the choice. A
content may be a text or a list of parts, whose texts are joined; a part without a
text stays as JSON. Turns are written in a bracketed instruction
template, with control characters inside texts escaped so that no text can hold
a marker, and read back from the formatted text alone.

Nothing is dropped: what the chosen mapping does not name (ids and scores, but also
tool calls, a context, a rejected answer) is the record's ``rest``, as JSON of the
same shape with null for list items that are used up, and ``unmapped`` lists its
field paths; both are null where all is mapped. Malformed JSON and layouts without a mapping give one turn of
the role ``raw`` with the record's text, and name the problem. A null record
gives no turns; a null role or text counts as empty. An empty table gives an
empty result, and equal records give equal values.
"""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Layouts: the field paths of a record, and the turns they map to. A turn is
#: (role, path of the text), or a list's path with the fields of its items;
#: what stands under ``then`` comes behind the list.
LAYOUTS = [
    *[{"paths": [*system, user, answer], "turns": [*[("system", x) for x in system], ("user", user), ("assistant", answer)]} for system in ((), ("system",)) for user in ("prompt", "instruction", "question") for answer in ("response", "completion", "output", "answer", "chosen")],
    {"paths": ["prompt.text", "response.text"], "turns": [("user", "prompt.text"), ("assistant", "response.text")]},
    {"paths": ["prompt.text", "completion.text"], "turns": [("user", "prompt.text"), ("assistant", "completion.text")]},
    {"paths": ["instruction", "input", "output"], "turns": [("system", "instruction"), ("user", "input"), ("assistant", "output")]},
    {"paths": ["messages[].role", "messages[].content"], "each": ("messages", "role", "content")},
    {"paths": ["conversations[].from", "conversations[].value"], "each": ("conversations", "from", "value"), "roles": {"human": "user", "gpt": "assistant"}},
    {"paths": ["system", "messages[].role", "messages[].content"], "turns": [("system", "system")], "each": ("messages", "role", "content")},
    {"paths": ["system", "conversations[].from", "conversations[].value"], "turns": [("system", "system")], "each": ("conversations", "from", "value"), "roles": {"human": "user", "gpt": "assistant"}},
    *[{"paths": ["prompt[].role", "prompt[].content", answer], "each": ("prompt", "role", "content"), "then": [("assistant", answer)]} for answer in ("response", "completion")],
    {"paths": ["data.messages[].role", "data.messages[].content"], "each": ("data.messages", "role", "content")},
    {"paths": ["messages[]"], "turns": []},
    {"paths": ["conversations[]"], "turns": []},
    {"paths": ["system", "messages[]"], "turns": [("system", "system")]},
]
#: A part's fields count as the content that they belong to.
PART = re.compile(r"(\[\]\.(?:content|value))\[\].*$")

# The template's fixed marks.
SYSTEM, USER, ASSISTANT, OTHER = ("<<SYS>>\n", "\n<</SYS>>\n"), ("<s>[INST] ", " [/INST]"), (" ", " </s>"), ("[ROLE {}] ", " [/ROLE]")
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lb;"), ("]", "&rb;"))
TURN = re.compile(r"<<SYS>>\n([^<\[]*)\n<</SYS>>\n|<s>\[INST\] ([^<\[]*) \[/INST\]|\[ROLE ([^<\[\]]*)\] ([^<\[]*) \[/ROLE\]| ([^<\[]*) </s>")

FORMATTED = "fingerprint string, turns array<struct<role:string,text:string>>, formatted string, loss_spans array<struct<start:int,end:int>>, problem string, rest string, unmapped array<string>"
PARSED = "turns array<struct<role:string,text:string>>, loss_text string, whole boolean"


def field_paths(value, at: str = "") -> set[str]:
    """The nested field paths that lead to values; list items share a path."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in field_paths(v, f"{at}.{k}" if at else k)} or {f"{at}{{}}"}
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


MAPPINGS = {fingerprint(x["paths"]): x for x in LAYOUTS}
KNOWN = {p for x in LAYOUTS for p in x["paths"]}


def known_paths(record: dict) -> set[str]:
    """A record's field paths that some layout knows."""
    return {PART.sub(r"\1", p) for p in field_paths(record)} & KNOWN


def _said(x) -> str:
    if isinstance(x, list):
        return "".join(p["text"] if isinstance(p, dict) and isinstance(p.get("text"), str) else _said(p) for p in x)
    return "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def _at(record, path: str):
    for name in path.split("."):
        record = record.get(name) if isinstance(record, dict) else None
    return record


def canonical_turns(record: dict, mapping: dict) -> list[tuple[str, str]]:
    turns = [(role, _said(_at(record, path))) for role, path in mapping.get("turns", ())]
    if "each" in mapping:
        items, role, content = mapping["each"]
        names = mapping.get("roles", {})
        for x in _at(record, items):
            x = x if isinstance(x, dict) else {content: x}
            turns.append((names.get(_said(x.get(role)), _said(x.get(role))), _said(x.get(content))))
    return turns + [(role, _said(_at(record, path))) for role, path in mapping.get("then", ())]


_USED = object()


def rest_of(value, mapped, at: str = ""):
    """What a record holds beside the ``mapped`` field paths, or ``_USED`` if nothing."""
    if at in mapped:
        return _USED
    if isinstance(value, dict) and value:
        left = {k: r for k, v in value.items() if (r := rest_of(v, mapped, f"{at}.{k}" if at else k)) is not _USED}
        return left or _USED
    if isinstance(value, list):
        if not value:
            return _USED if any(p.startswith(f"{at}[]") for p in mapped) else value
        left = [rest_of(v, mapped, f"{at}[]") for v in value]
        return _USED if all(x is _USED for x in left) else [None if x is _USED else x for x in left]
    return value


def escape(text: str) -> str:
    for plain, safe in ESCAPES:
        text = text.replace(plain, safe)
    return text


def unescape(text: str) -> str:
    for plain, safe in reversed(ESCAPES):
        text = text.replace(safe, plain)
    return text


def format_turns(turns) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans (code points, end exclusive) of the assistant's texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        before, after = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}.get(role) or (OTHER[0].format(escape(role)), OTHER[1])
        safe = escape(text)
        if role == "assistant":
            spans.append((at + len(before), at + len(before) + len(safe)))
        out.append(before + safe + after)
        at += len(out[-1])
    return "".join(out), spans


def parse_turns(formatted: str) -> tuple[list[tuple[str, str]], bool]:
    """Turns read back from formatted text; False if something lay between them."""
    turns, at = [], 0
    while m := TURN.match(formatted, at):
        system, user, role, other, assistant = m.groups()
        for name, text in (("system", system), ("user", user), (None, other), ("assistant", assistant)):
            if text is not None:
                turns.append((unescape(role) if name is None else name, unescape(text)))
        at = m.end()
    return turns, at == len(formatted)


def _one(payload):
    def raw(key, problem):
        turns = [("raw", payload)] if payload is not None else []
        return key, turns, *format_turns(turns), problem, None, None

    try:
        record = json.loads(payload)
    except (TypeError, ValueError, RecursionError):
        return raw(None, "not JSON")
    if not isinstance(record, dict):
        return raw(None, "not an object")
    key = fingerprint(known_paths(record))
    if key not in MAPPINGS:
        return raw(key, "unknown layout")
    turns = canonical_turns(record, MAPPINGS[key])
    rest = rest_of(record, MAPPINGS[key]["paths"])
    if rest is _USED:
        return key, turns, *format_turns(turns), None, None, None
    return key, turns, *format_turns(turns), None, json.dumps(rest, ensure_ascii=False), sorted(field_paths(rest))


def _format(payloads: pd.Series) -> pd.DataFrame:
    rows = []
    for key, turns, formatted, spans, *others in map(_one, payloads):
        rows.append((key, [{"role": r, "text": t} for r, t in turns], formatted, [{"start": a, "end": b} for a, b in spans], *others))
    return pd.DataFrame(rows, columns=["fingerprint", "turns", "formatted", "loss_spans", "problem", "rest", "unmapped"])


def _parse(formatted: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = []
    for text, marks in zip(formatted, spans, strict=True):
        turns, whole = parse_turns(text or "")
        loss = "".join(unescape(text[m["start"] : m["end"]]) for m in (marks if marks is not None else ()))
        rows.append(([{"role": r, "text": t} for r, t in turns], loss, whole))
    return pd.DataFrame(rows, columns=["turns", "loss_text", "whole"])


def format_records(payload: Column) -> Column:
    """Struct of fingerprint, canonical turns, formatted text, loss spans, problem, rest and unmapped paths."""
    return F.pandas_udf(_format, FORMATTED)(payload)


def read_back(formatted: Column, loss_spans: Column) -> Column:
    """Struct of the turns and the text under the loss mask, from the formatted text."""
    return F.pandas_udf(_parse, PARSED)(formatted, loss_spans)


def layout_records(turns: Column) -> Column:
    """JSON records from ordered turns (role, text): pairs as prompt and response,
    system triples as instruction, strict alternations as conversations, and
    everything else as messages, with a leading system text apart."""
    roles = F.transform(turns, lambda t: F.coalesce(t["role"], F.lit("")))
    text = lambda i: F.coalesce(F.get(turns, F.lit(i))["text"], F.lit(""))
    is_ = lambda *names: roles == F.array(*map(F.lit, names))
    pairs = lambda role, content, of: F.transform(of, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias(role), F.coalesce(t["text"], F.lit("")).alias(content)))
    humans = F.transform(turns, lambda t: F.struct(F.when(t["role"] == "user", "human").otherwise("gpt").alias("from"), F.coalesce(t["text"], F.lit("")).alias("value")))
    return (
        F.when(is_("user", "assistant"), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response"))))
        .when(is_("system", "user", "assistant"), F.to_json(F.struct(text(0).alias("instruction"), text(1).alias("input"), text(2).alias("output"))))
        .when(F.forall(roles, lambda r: r.isin("user", "assistant")) & (F.size(turns) > 0), F.to_json(F.struct(humans.alias("conversations"))))
        .when((F.get(roles, F.lit(0)) == "system") & (F.size(turns) > 1), F.to_json(F.struct(text(0).alias("system"), pairs("role", "content", F.slice(turns, F.lit(2), F.size(turns))).alias("messages"))))
        .otherwise(F.to_json(F.struct(pairs("role", "content", turns).alias("messages"))))
    )
