"""Chat formatting by schema fingerprints.

A record's fingerprint is the hash of its sorted nested field paths (list positions count as ``[]``).
It selects a declarative mapping that says where roles and texts stand; every layout becomes the same
canonical turns. Turns are written in one template whose control strings never occur inside texts: they
are escaped reversibly there. Conversations are streamed turn by turn from sorted partitions, so one
that holds a third of all rows needs no more memory than a short one.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that chat templates give a meaning. None of them may occur inside a formatted text.
CONTROL = r"<\|(?:turn|text|end|im_start|im_end|endoftext)\|>|</?s>|\[/?INST\]|<</?SYS>>"
_control, _escaped = re.compile(CONTROL), re.compile(r"\\(\\|)")
_piece = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)

ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Layouts: the paths a record has, then where its turns are. ``rows``: the record is one turn of ``id``.
#: ``list``: turns stand in a list. ``fields``: each named field is one turn of the given role.
LAYOUTS = [
    {"paths": ["conv_id", "turn", "role", "text"], "id": "conv_id", "rows": ("turn", "role", "text")},
    {"paths": ["id", "messages[].role", "messages[].content"], "id": "id", "list": ("messages", "role", "content")},
    {"paths": ["id", "conversations[].from", "conversations[].value"], "id": "id", "list": ("conversations", "from", "value")},
    {"paths": ["id", "prompt", "completion"], "id": "id", "fields": [("prompt", "user"), ("completion", "assistant")]},
    {"paths": ["id", "prompt", "response"], "id": "id", "fields": [("prompt", "user"), ("response", "assistant")]},
    {"paths": ["id", "question", "answer"], "id": "id", "fields": [("question", "user"), ("answer", "assistant")]},
    {"paths": ["id", "instruction", "output"], "id": "id", "fields": [("instruction", "user"), ("output", "assistant")]},
    {"paths": ["id", "instruction", "input", "output"], "id": "id", "fields": [("instruction", "user"), ("input", "user"), ("output", "assistant")]},
    {"paths": ["id", "system", "prompt", "response"], "id": "id", "fields": [("system", "system"), ("prompt", "user"), ("response", "assistant")]},
]


def escape(text: str) -> str:
    """Break every control string by a backslash behind its first character; backslashes are doubled."""
    return _control.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: m[1], text)


def paths(value, prefix: str = "") -> set[str]:
    """Field paths of a parsed record; empty lists and objects end a path themselves."""
    if isinstance(value, dict) and value:
        return set().union(*(paths(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(paths(v, prefix + "[]") for v in value)) if value else {prefix + "[]"}
    return {prefix}


def fingerprint(field_paths) -> str:
    return hashlib.sha256("\n".join(sorted(field_paths)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


MAPPINGS = {fingerprint(layout["paths"]): layout for layout in LAYOUTS}


def _string(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: str, mappings: dict[str, dict] = MAPPINGS) -> tuple[str, list[tuple[int | None, int | None, str, str]]]:
    """The fingerprint of a JSON record, and its turns (conversation, position, role, text).

    Records that aren't JSON objects have the fingerprint ``invalid``; they and layouts without a
    mapping have no turns. Null roles and texts are empty.
    """
    try:
        value = json.loads(record)
    except (ValueError, TypeError, RecursionError):
        value = None
    if not isinstance(value, dict):
        return "invalid", []
    name = fingerprint(paths(value))
    layout = mappings.get(name)
    if layout is None:
        return name, []
    owner = value[layout["id"]]
    owner = owner if isinstance(owner, int) else None
    if "rows" in layout:
        turn, role, text = (value[f] for f in layout["rows"])
        return name, [(owner, turn if isinstance(turn, int) else None, _string(role), _string(text))]
    if "list" in layout:
        field, role, text = layout["list"]
        return name, [(owner, i, ROLES.get(r := _string(x[role]), r), _string(x[text])) for i, x in enumerate(value[field])]
    return name, [(owner, i, role, _string(value[f])) for i, (f, role) in enumerate(layout["fields"]) if f == layout["fields"][-1][0] or value[f] not in (None, "")]


_TURNS = pa.schema([("layout", pa.string()), ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_PIECES = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int32()), ("loss_end", pa.int32())])
TURNS = "layout string, conv_id long, turn long, role string, text string"
PIECES = "conv_id long, formatted string, loss_start int, loss_end int"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _canonical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(name, *t) for r in batch["record"].to_pylist() for name, found in [turns_of(r)] for t in found]
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _TURNS)], schema=_TURNS)


def _layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [turns_of(r)[0] for r in batch["record"].to_pylist()]
        yield pa.record_batch({"layout": pa.array(names, pa.string()), "known": pa.array([n in MAPPINGS for n in names], pa.bool_())})


def layout_report(records: DataFrame) -> DataFrame:
    """(layout, known, n): how many records have each fingerprint, and whether a mapping reads it.

    Records of unknown layouts have no turns; this says which and how many they are.
    """
    return records.select("record").mapInArrow(_layouts, "layout string, known boolean").groupBy("layout", "known").agg(F.count("*").alias("n"))


def canonical_turns(records: DataFrame) -> DataFrame:
    """Canonical turns (layout, conv_id, turn, role, text) of JSON records in the column ``record``.

    Null records, records that are no JSON objects and unknown layouts have none (``layout_report`` counts them). Repeated
    records give their turns again. Other columns are ignored; an empty table gives no turns.
    """
    return records.select("record").mapInArrow(_canonical, TURNS)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        formatted, starts, ends = [], [], []
        for role, text in zip(batch["role"].to_pylist(), batch["text"].to_pylist()):
            head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
            formatted.append(f"{head}{body}{END}")
            learned = role == "assistant"
            starts.append(len(head) if learned else None)
            ends.append(len(head) + len(body) if learned else None)
        yield pa.record_batch([batch["conv_id"], pa.array(formatted, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], schema=_PIECES)


def format_turns(turns: DataFrame) -> DataFrame:
    """Formatted pieces, one per turn, in order within each conversation's partition.

    A piece is (conv_id, formatted, loss_start, loss_end): the loss mask covers an assistant's escaped
    text, null else. Turns are ordered by turn, then role and text (nulls first); conversations without
    an id form one conversation with a null id.
    """
    ordered = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_format, PIECES)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DIGEST.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    pack = lambda rows: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
    state, done = None, []
    for batch in batches:
        for conv, piece, start, end in zip(*(batch[c].to_pylist() for c in _PIECES.names)):
            if state is None or state[0] != conv:
                if state:
                    done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in _piece.findall(piece):
                state[1] += 1
                state[2].update(f"{unescape(role)}\n{unescape(text)}\n".encode("utf-8", "surrogatepass"))
            if start is not None:
                learned = unescape(piece[start:end])
                state[3] += len(learned)
                state[4].update(learned.encode("utf-8", "surrogatepass"))
            state[5] += len(piece)
        if done:
            yield pack(done)
            done = []
    if state:
        yield pack([(state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])])


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of every conversation, parsed from the formatted pieces (as format_turns gives them)."""
    return pieces.mapInArrow(_read, DIGEST)


def conversation_records(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as JSON records of one turn each; other columns are ignored."""
    fields = F.struct(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role"), F.coalesce("text", F.lit("")).alias("text"))
    return conversations.select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("record"))
