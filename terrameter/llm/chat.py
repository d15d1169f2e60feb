"""Chat formatting by schema fingerprints.

A record's fingerprint is the hash of its sorted nested field paths.  It selects a declarative
mapping, which turns prompt, instruction and message layouts into canonical turns.  Each turn is
formatted alone, so a conversation of any length spreads over tasks; digests of whole conversations
are streamed in order without holding them.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches

# Fixed values of the template: its control strings.
TURNS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("<|role|>", "<|text|>", "<|end|>")
CONTROL = [c for pair in TURNS.values() for c in pair] + list(OTHER)
_HIDE = re.compile("|".join(re.escape(c) for c in ["\\", *CONTROL]))
_FIND = re.compile("|".join(re.escape(c) for c in CONTROL))
_SHOW = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """``text`` without control strings: a backslash after their first character, backslashes doubled."""
    return _HIDE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _SHOW.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and the code point span of its text under the loss mask (0, 0: none)."""
    if role in TURNS:
        begin, end = TURNS[role]
        body = escape(text)
        span = (len(begin), len(begin) + len(body)) if role == "assistant" else (0, 0)
        return f"{begin}{body}{end}", *span
    return f"{OTHER[0]}{escape(role)}{OTHER[1]}{escape(text)}{OTHER[2]}", 0, 0


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, begin, end) of each turn of a formatted text; the span is of the escaped text."""
    marks = list(_FIND.finditer(formatted))
    role_of, at = {b: r for r, (b, _) in TURNS.items()}, 0
    while at < len(marks):
        if marks[at][0] == OTHER[0]:
            role, begin, end = unescape(formatted[marks[at].end() : marks[at + 1].start()]), marks[at + 1].end(), marks[at + 2].start()
            at += 3
        else:
            role, begin, end = role_of[marks[at][0]], marks[at].end(), marks[at + 1].start()
            at += 2
        yield role, unescape(formatted[begin:end]), begin, end


def paths(value: object, at: str = "") -> set[str]:
    """Nested field paths; list elements share the path ``[]``."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths(v, f"{at}.{k}" if at else k)} or {at}
    if isinstance(value, list):
        return {p for v in value for p in paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def fingerprint(field_paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(field_paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns: fixed (role, path) pairs, or a list with role and text fields."""

    fields: tuple[tuple[str, str], ...] = ()
    each: str | None = None
    role: str = ""
    text: str = ""
    rename: bool = False  # whether role names follow ROLES


# Role names of other layouts and their canonical ones.
ROLES = {"human": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant", "prompter": "user"}

LAYOUTS: dict[tuple[str, ...], Mapping] = {
    ("role", "text"): Mapping(each="", role="role", text="text"),
    ("prompt", "completion"): Mapping(fields=(("user", "prompt"), ("assistant", "completion"))),
    ("prompt", "response"): Mapping(fields=(("user", "prompt"), ("assistant", "response"))),
    ("question", "answer"): Mapping(fields=(("user", "question"), ("assistant", "answer"))),
    ("instruction", "output"): Mapping(fields=(("user", "instruction"), ("assistant", "output"))),
    ("instruction", "input", "output"): Mapping(fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    ("system", "prompt", "response"): Mapping(fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    ("messages[].role", "messages[].content"): Mapping(each="messages", role="role", text="content"),
    ("messages[].role", "messages[].text"): Mapping(each="messages", role="role", text="text"),
    ("conversations[].from", "conversations[].value"): Mapping(each="conversations", role="from", text="value", rename=True),
    ("dialog.turns[].speaker", "dialog.turns[].utterance"): Mapping(each="dialog.turns", role="speaker", text="utterance", rename=True),
}
REGISTRY = {fingerprint(p): m for p, m in LAYOUTS.items()}


def _get(value: object, path: str) -> object:
    for key in path.split(".") if path else ():
        value = value.get(key) if isinstance(value, dict) else None
    return value


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns(record: object, registry: dict[str, Mapping] = REGISTRY) -> tuple[str, list[tuple[str, str]] | None]:
    """A record's fingerprint and canonical turns; None where no mapping knows the layout."""
    print_ = fingerprint(paths(record))
    mapping = registry.get(print_)
    if mapping is None:
        return print_, None
    if mapping.each is None:
        return print_, [(role, _text(_get(record, path))) for role, path in mapping.fields]
    rows = _get(record, mapping.each)
    rows = rows if isinstance(rows, list) else [rows]
    names = ROLES if mapping.rename else {}
    return print_, [(names.get(r := _text(_get(x, mapping.role)), r), _text(_get(x, mapping.text))) for x in rows]


def format_records(records: DataFrame, key_cols: list[str], json_col: str, registry: dict[str, Mapping] = REGISTRY) -> DataFrame:
    """Key columns, fingerprint, part, role, text, formatted, loss_begin and loss_end of every turn.

    A null, malformed or unknown record gives one row with part -1 and a null role, so no row is
    lost.  Null texts and roles count as empty.  Repeated rows stay; other columns are ignored.
    """
    bounded_batches(records.sparkSession)
    kinds = ", ".join(f"`{c}` {records.schema[c].dataType.simpleString()}" for c in key_cols)
    schema = f"{kinds}, fingerprint string, part int, role string, text string, formatted string, loss_begin long, loss_end long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            take: list[int] = []
            for i, raw in enumerate(batch["_json"]):
                try:
                    mark, found = turns(json.loads(raw), registry)
                except (TypeError, ValueError):
                    mark, found = None, None
                for part, (role, text) in enumerate(found or ()):
                    rows.append((mark, part, role, text, *format_turn(role, text)))
                if found is None:
                    rows.append((mark, -1, None, None, None, 0, 0))
                take += [i] * (len(rows) - len(take))
            out = pd.DataFrame(rows, columns=["fingerprint", "part", "role", "text", "formatted", "loss_begin", "loss_end"])
            keys = batch[[f"_k{i}" for i in range(len(key_cols))]].iloc[take].reset_index(drop=True)
            yield pd.concat([keys.set_axis(key_cols, axis=1), out], axis=1)

    return records.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key_cols)], F.col(json_col).alias("_json")).mapInPandas(run, schema)


def conversation_digests(formatted: DataFrame, conv_col: str, order_cols: list[str]) -> DataFrame:
    """One row per conversation, read back from the formatted turns and their loss spans.

    Rows of a conversation meet in order in one sorted partition and are streamed through running
    hashes: a conversation is never held, however many turns it has.
    """
    kind = formatted.schema[conv_col].dataType.simpleString()
    schema = f"{conv_col} {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    rows = formatted.select(F.col(conv_col).alias("_c"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)], "formatted", "loss_begin", "loss_end")
    order = [F.col("_c"), *[F.col(f"_o{i}") for i in range(len(order_cols))], F.col("formatted")]
    rows = rows.repartition(F.col("_c")).sortWithinPartitions(*order).select(F.col("_c").cast("string"), "formatted", "loss_begin", "loss_end")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nothing = object()
        now: object = nothing
        state: list = []

        def row() -> tuple:
            return now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        for batch in batches:
            done = []
            for conv, text, begin, end in batch.itertuples(index=False, name=None):
                conv = None if conv is None or conv != conv else conv
                if now is nothing or conv != now:
                    if now is not nothing:
                        done.append(row())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body, _, _ in parse(text or ""):
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                if end > begin:
                    learned = unescape(text[begin:end])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(text or "")
            yield as_frame(done)
        if now is not nothing:
            yield as_frame([row()])

    def as_frame(done: list[tuple]) -> pd.DataFrame:
        names = ["_c", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pd.DataFrame(done, columns=names).astype({"n_turns": "int64", "loss_chars": "int64", "formatted_chars": "int64"})

    out = rows.mapInPandas(run, schema.replace(f"{conv_col} {kind}", "_c string"))
    return out.withColumn("_c", F.col("_c").cast(kind)).withColumnRenamed("_c", conv_col)


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '\\|<</?SYS>>|\[/?INST\]|</?s>|<\|(?:role|text|end)\|>'))
         + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 23 + length(role)
           + len(regexp_extract_all(role, '\\|<</?SYS>>|\[/?INST\]|</?s>|<\|(?:role|text|end)\|>')) END AS chars FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
