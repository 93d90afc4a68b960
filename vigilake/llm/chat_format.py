"""Chat formatting by schema fingerprints.

A record's schema is the sorted list of its field paths; its hash picks a declarative mapping from the record's
layout (flat turns, prompt and answer, instruction and input, lists of messages) to canonical turns.  Turns
are written in one template whose control strings can't occur in texts: those in texts are escaped, reversibly.
The loss mask covers the assistant's texts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Control strings: ours, and those of common templates, which are escaped in texts as well.
BEGIN, ROLE_END, END = "<|turn|>", "<|says|>", "<|over|>"
CONTROL = [BEGIN, ROLE_END, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
ESCAPE = "\\"
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """``text`` without control strings: escapes doubled, then one put behind a control string's first character."""
    return _CONTROL.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text.replace(ESCAPE, ESCAPE * 2))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, tuple[int, int] | None]:
    """The turn in the template, and where the loss mask lies in it (code points; None without one)."""
    head, body = BEGIN + escape(role) + ROLE_END, escape(text)
    return head + body + END, (len(head), len(head) + len(body)) if role == "assistant" else None


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out = []
    for turn in formatted.split(BEGIN)[1:]:
        role, body = turn.split(ROLE_END)
        out.append((unescape(role), unescape(body.removesuffix(END))))
    return out


# --- layouts -----------------------------------------------------------------------------------------------


def paths(value, at: str = "") -> set[str]:
    """The field paths of a parsed record; items of lists share one path."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths(v, f"{at}.{k}" if at else k)} or {at}
    if isinstance(value, list):
        return {p for v in value for p in paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def schema_hash(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """How a layout's fields become turns.

    ``turns``: (role, path) of single fields, joined by a blank line if a role follows itself; or ``each``: the
    list to go through, with the paths of role and text in an item.  ``optional`` paths may be missing.
    """

    fields: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, str], ...] = ()
    each: tuple[str, str, str] | None = None


MAPPINGS = [
    Mapping(("role", "text"), each=("", "role", "text")),
    Mapping(("prompt", "response"), turns=(("user", "prompt"), ("assistant", "response"))),
    Mapping(("prompt", "completion"), ("system",), turns=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Mapping(("question", "answer"), turns=(("user", "question"), ("assistant", "answer"))),
    Mapping(("instruction", "output"), ("input", "system"), turns=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping(("messages[].role", "messages[].content"), each=("messages", "role", "content")),
    Mapping(("conversations[].from", "conversations[].value"), each=("conversations", "from", "value")),
    Mapping(("data.dialog[].speaker", "data.dialog[].utterance"), each=("data.dialog", "speaker", "utterance")),
]
# Names of speakers in the layouts, and the roles they stand for.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}


def by_schema(mappings: list[Mapping] = MAPPINGS) -> dict[str, Mapping]:
    """Schema hash -> mapping, for every choice of the optional fields."""
    out = {}
    for m in mappings:
        for bits in range(1 << len(m.optional)):
            out[schema_hash({*m.fields, *(p for i, p in enumerate(m.optional) if bits >> i & 1)})] = m
    return out


def _get(record, path: str):
    for name in filter(None, path.split(".")):
        record = record.get(name) if isinstance(record, dict) else None
    return record


def to_turns(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    """Canonical (role, text) turns of a record; null texts are empty, missing fields no turn."""
    text = lambda x: "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
    if mapping.each:
        items, role, body = mapping.each
        got = _get(record, items)
        return [(ROLES.get(text(x.get(role)), text(x.get(role))), text(x.get(body))) for x in ([got] if isinstance(got, dict) else got or [])]
    out: list[tuple[str, str]] = []
    for role, path in mapping.turns:
        if path in record:
            if out and out[-1][0] == role:
                out[-1] = (role, out[-1][1] + "\n\n" + text(record[path]) if record[path] else out[-1][1])
            else:
                out.append((role, text(record[path])))
    return out


def _canonical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, nth, record) -> (id, nth, pos, role, text, schema): unknown layouts give one row without a role."""
    known = by_schema()
    for batch in batches:
        out = []
        for key, nth, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            try:
                record = json.loads(raw or "null")
            except ValueError:
                record = None
            schema = schema_hash(paths(record)) if isinstance(record, dict) else "none"
            turns = to_turns(record, known[schema]) if schema in known else [(None, raw)]
            out += [(key, nth, pos, role, text, schema) for pos, (role, text) in enumerate(turns)]
        cols = list(zip(*out, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)], names=["id", "nth", "pos", "role", "text", "schema"])


def canonical_turns(records: DataFrame, id_col: str, record_col: str, nth_col: str | None = None) -> DataFrame:
    """(id, nth, pos, role, text, schema): turns of JSON records of any known layout.

    ``nth_col`` orders the records of one id.  A record of an unknown layout, or one that isn't an object,
    keeps its text in one row with a null role.
    """
    nth = F.col(nth_col).cast("long") if nth_col else F.lit(0).cast("long")
    return records.select(F.col(id_col).cast("long").alias("id"), nth.alias("nth"), F.col(record_col).alias("record")).mapInArrow(_canonical, "id long, nth long, pos int, role string, text string, schema string")


# --- formatting --------------------------------------------------------------------------------------------


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [format_turn(r or "", t or "") for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
        loss = [x or (None, None) for _, x in got]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([f for f, _ in got], pa.string()), pa.array([a for a, _ in loss], pa.int64()), pa.array([b for _, b in loss], pa.int64())], names=["id", "nth", "pos", "formatted", "loss_from", "loss_to"])


def format_turns(turns: DataFrame) -> DataFrame:
    """(id, nth, pos, formatted, loss_from, loss_to): each turn's part of its conversation, and its loss mask.

    A conversation is its parts in order (nth, pos, formatted), one after the other; parts need no context, so a
    conversation of any length is never in one place.
    """
    return turns.select("id", "nth", "pos", "role", "text").mapInArrow(_format, "id long, nth long, pos int, formatted string, loss_from long, loss_to long")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts in order -> a row of digests per conversation, read back from the parts; holds one part at a time."""
    now, out = None, []

    def fresh(key):
        return [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]

    for batch in batches:
        for key, part, a, b in zip(*(batch.column(c).to_pylist() for c in ("id", "formatted", "loss_from", "loss_to")), strict=True):
            if now is None or now[0] != key:
                out += [now] if now else []
                now = fresh(key)
            for role, text in read_turns(part):
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if a is not None:
                lost = unescape(part[a:b])
                now[3] += len(lost)
                now[4].update(lost.encode("utf-8", "surrogatepass"))
            now[5] += len(part)
        if out:
            yield _rows(out)
            out = []
    if now:
        yield _rows([now])


def _rows(out: list) -> pa.RecordBatch:
    cols = [[x[0] for x in out], [x[1] for x in out], [x[2].hexdigest() for x in out], [x[3] for x in out], [x[4].hexdigest() for x in out], [x[5] for x in out]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digest(parts: DataFrame) -> DataFrame:
    """(id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of formatted conversations.

    A digest runs over a conversation from end to end, so its parts pass through one task, one at a time.
    """
    dealt = parts.repartition("id").sortWithinPartitions("id", "nth", "pos", "formatted")
    return dealt.mapInArrow(_digests, "id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Digests of conversations held a turn a row, formatted and read back.

    Null texts and roles are empty; rows of one turn follow each other by what they say; null turns come
    first; rows with a null id are one conversation.  An empty table gives no rows.
    """
    record = F.to_json(F.struct(F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    records = rows.select(F.col(id_col).alias("id"), F.col(turn_col).alias("nth"), record.alias("record"))
    return digest(format_turns(canonical_turns(records, "id", "record", "nth"))).withColumnRenamed("id", id_col)
