"""Chat formatting by schema fingerprints.

A record's nested field paths are hashed; the hash selects a declarative mapping that turns the record into canonical
turns (role, text). Turns are then written in one template and can be read back without loss.

Template of a turn: ``<turn ROLE>`` newline TEXT newline ``</turn>`` newline. Inside ROLE and TEXT a backslash, ``<`` and
``>`` get a backslash before them, so that no text can hold a control string.

Defined results: a null role or text is empty; a record of unknown layout, or one that is no JSON object, gives one row
with role and text null and its fingerprint, so that nothing is lost silently; rows with equal conversation and turn come
in the order of role and text; rows with a null conversation are one conversation, null turns come first; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The layouts that are known. "turns" lists (role or @path of the role, path of the text), left out where
# the text is empty and the role is in "optional"; "each" names a list of messages, to whose elements the paths apply;
# "rename" brings other makers' role names to ours.
LAYOUTS = [
    {"turns": [("@role", "text")]},
    {"turns": [("@role", "content")]},
    {"turns": [("user", "prompt"), ("assistant", "completion")]},
    {"turns": [("user", "prompt"), ("assistant", "response")]},
    {"turns": [("system", "system"), ("user", "prompt"), ("assistant", "response")], "optional": ["system"]},
    {"turns": [("user", "question"), ("assistant", "answer")]},
    {"turns": [("user", "instruction"), ("assistant", "output")]},
    {"turns": [("system", "instruction"), ("user", "input"), ("assistant", "output")], "optional": ["user"]},
    {"each": "messages", "turns": [("@role", "content")]},
    {"each": "messages", "turns": [("@role", "text")]},
    {"each": "conversations", "turns": [("@from", "value")], "rename": True},
    {"each": "data.turns", "turns": [("@speaker", "utterance")], "rename": True},
]
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(value: object) -> set[str]:
    """Paths of all leaves; a list's elements share the path ``name[]``. Dots and brackets in names are escaped."""
    paths, left = set(), [("", value)]
    while left:
        at, value = left.pop()
        if isinstance(value, dict) and value:
            for name, inner in value.items():
                name = re.sub(r"([\\.\[])", r"\\\1", name)
                left.append((f"{at}.{name}" if at else name, inner))
        elif isinstance(value, list) and value:
            left += [(f"{at}[]", inner) for inner in value]
        else:
            paths.add(at)
    return paths


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "replace")).hexdigest()[:16]


def _layout_paths(layout: dict) -> set[str]:
    before = f"{layout['each']}[]." if "each" in layout else ""
    return {before + p.removeprefix("@") for role, text in layout["turns"] for p in ([role, text] if role[0] == "@" else [text])}


MAPPINGS = {fingerprint(_layout_paths(x)): x for x in LAYOUTS}


def _at(value: object, path: str) -> object:
    for name in path.split("."):
        value = value.get(name) if isinstance(value, dict) else None
    return value


def _text(value: object) -> str:
    """The text of a leaf; halves of surrogate pairs, which UTF-8 can't hold, become U+FFFD."""
    text = value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)
    return re.sub("[\ud800-\udfff]", "\ufffd", text)


def turns_of(record: str | None) -> tuple[str | None, list[tuple[str, str]] | None]:
    """(fingerprint, turns); no turns if the layout is unknown, no fingerprint if it is not JSON or nested too deeply to be read."""
    try:
        value = json.loads(record)
    except (TypeError, ValueError, RecursionError):
        return None, None
    key = fingerprint(field_paths(value))
    if (layout := MAPPINGS.get(key)) is None:
        return key, None
    out = []
    for item in _at(value, layout["each"]) if "each" in layout else [value]:
        for role, path in layout["turns"]:
            text = _text(_at(item, path))
            name = _text(_at(item, role[1:])) if role[0] == "@" else role
            if text or role not in layout.get("optional", ()):
                out.append((ROLES.get(name, name) if layout.get("rename") else name, text))
    return key, out


def canonical_turns(df: DataFrame, record: str, keys: list[str]) -> DataFrame:
    """One row per turn: the keys, part (place in its record), role, text, layout (the fingerprint)."""
    fields = ", ".join(f"k{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, rows = [], []
            for i, value in enumerate(batch.column(len(keys)).to_pylist()):
                layout, turns = turns_of(value)
                for part, (role, text) in enumerate([(None, None)] if turns is None else turns):
                    take.append(i)
                    rows.append((part, role, text, layout))
            left = batch.select(range(len(keys))).take(pa.array(take, pa.int64()))
            right = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.string(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*left.columns, *right], [*(f"k{i}" for i in range(len(keys))), "part", "role", "text", "layout"])

    out = df.select(*keys, record).mapInArrow(convert, f"{fields}, part int, role string, text string, layout string")
    return out.toDF(*keys, "part", "role", "text", "layout")


def escaped(text: Column) -> Column:
    for c in ("\\", "<", ">"):
        text = F.replace(text, F.lit(c), F.lit("\\" + c))
    return text


def formatted(turns: DataFrame) -> DataFrame:
    """Adds segment (the turn in the template) and the loss mask in it: loss_start and loss_length, 0 if none."""
    head = F.concat(F.lit("<turn "), escaped(F.coalesce("role", F.lit(""))), F.lit(">\n"))
    body = escaped(F.coalesce("text", F.lit("")))
    learn = F.coalesce(F.col("role") == "assistant", F.lit(False))
    return turns.withColumns({
        "segment": F.concat(head, body, F.lit("\n</turn>\n")),
        "loss_start": F.length(head),
        "loss_length": F.when(learn, F.length(body)).otherwise(0),
    })


_TURN = re.compile(r"<turn ((?:[^\\<>]+|\\.)*)>\n((?:[^\\<>]+|\\.)*)\n</turn>\n", re.DOTALL)
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)


def unescaped(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def read_back(df: DataFrame, conversation: str) -> DataFrame:
    """Digests of each conversation from its formatted segments, which come sorted by conversation and turn.

    Segments stream through: a conversation is hashed as it passes and is never held whole, however long it is.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []

        def close() -> None:
            if state is not None:
                n, chars, turns, loss_chars, loss = state
                done.append((now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

        def batch_out() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(kinds)], names)
            done.clear()
            return out

        for batch in batches:
            for key, segment, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or key != now:
                    close()
                    now, state = key, [0, 0, hashlib.sha256(), 0, hashlib.sha256()]
                for m in _TURN.finditer(segment):
                    state[0] += 1
                    state[2].update(f"{unescaped(m[1])}\n{unescaped(m[2])}\n".encode())
                learned = unescaped(segment[start : start + length])
                state[1] += len(segment)
                state[3] += len(learned)
                state[4].update(learned.encode())
            yield batch_out()
        close()
        yield batch_out()

    schema = "key long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return df.select(F.col(conversation).cast("long"), "segment", "loss_start", "loss_length").mapInArrow(read, schema).withColumnRenamed("key", conversation)


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """Format all conversations (rows by turn) and return what their formatted form says, one row per conversation."""
    rows = conversations.select("conv_id", "turn", F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    turns = formatted(canonical_turns(rows, "record", ["conv_id", "turn"]))
    order = ["conv_id", "turn", "role", "text", "part"]
    dealt = turns.repartition("conv_id").sortWithinPartitions(*order)
    return read_back(dealt, "conv_id")
