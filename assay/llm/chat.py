"""Chat formatting: layouts told apart by schema fingerprint, turns by declarative mappings.

A record is a JSON object.  Its fingerprint is a hash of its sorted nested field paths
(``messages[].role``); it selects a ``Mapping`` that says where turns, roles and texts are.
Records whose fingerprint no mapping has are not guessed at: they come out as one row of
layout ``unknown`` without turns, for the caller to look at.

A turn is formatted as a block between control strings; control strings inside texts (our
own and those of a common instruction template) are broken by a backslash after their first
character and backslashes are doubled, which ``unescaped`` undoes exactly.  Assistant texts
are under the loss mask, as a range of code points of the block.

A formatted conversation is its blocks in order.  ``read_back`` parses the blocks again and
streams over each conversation's rows in order with two running digests, so no conversation
is ever held whole.

Cases: null texts and roles count as empty; rows without a conversation key form one
conversation; equal positions are ordered by block; repeated rows are turns of their own; an
empty table gives no rows; unknown layouts give no turns and don't fail; columns beside the
record are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import column

# Control strings, ours first.
TURN_OPEN, TURN_CLOSE = "<|turn|>", "<|end|>"
CONTROL = [TURN_OPEN, TURN_CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
CONTROL_RE = re.compile("|".join(map(re.escape, CONTROL)))
PLAIN_ROLE = re.compile(r"[A-Za-z0-9_.-]*")
TRAINED_ROLE = "assistant"


@dataclass(frozen=True)
class Mapping:
    """Where a layout has its turns.

    ``each`` names an array of messages with ``role`` and ``text`` fields in them; without it
    ``turns`` lists (role, paths), the texts of several paths joined by a blank line, and a
    path for the role makes the record a single turn.  ``roles`` renames roles.
    """

    name: str
    paths: tuple[str, ...]
    each: str = ""
    role: str = ""
    text: str = ""
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    key: str = ""
    position: str = ""
    roles: dict = field(default_factory=dict, hash=False)


SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
MAPPINGS = [
    Mapping("turn row", ("conv_id", "role", "text", "turn"), role="role", text="text", key="conv_id", position="turn"),
    Mapping("messages", ("messages[].content", "messages[].role"), each="messages", role="role", text="content", roles=SPEAKERS),
    Mapping("keyed messages", ("id", "messages[].content", "messages[].role"), each="messages", role="role", text="content",
            key="id", roles=SPEAKERS),
    Mapping("speaker list", ("conversations[].from", "conversations[].value"), each="conversations", role="from", text="value",
            roles=SPEAKERS),
    Mapping("keyed speaker list", ("conversations[].from", "conversations[].value", "id"), each="conversations", role="from",
            text="value", key="id", roles=SPEAKERS),
    Mapping("prompt and completion", ("completion", "prompt"), turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt and response", ("prompt", "response"), turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question and answer", ("answer", "question"), turns=(("user", ("question",)), ("assistant", ("answer",)))),
    Mapping("instruction", ("instruction", "output"), turns=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction with input", ("input", "instruction", "output"),
            turns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("system, prompt and response", ("prompt", "response", "system"),
            turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
]


def field_paths(value, prefix: str = "") -> set[str]:
    """Paths of the leaves; an array's items share one path."""
    if isinstance(value, dict):
        inner = [field_paths(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items()]
    elif isinstance(value, list):
        inner = [field_paths(v, f"{prefix}[]") for v in value]
    else:
        return {prefix}
    return set().union(*inner) if inner else {prefix}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def escaped(text: str) -> str:
    return CONTROL_RE.sub(lambda m: f"{m.group()[0]}\\{m.group()[1:]}", text.replace("\\", "\\\\"))


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def block_of(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and the code points of it that are trained on."""
    name = role if PLAIN_ROLE.fullmatch(role) else json.dumps(escaped(role))
    head, body = f"{TURN_OPEN}{name}\n", escaped(text)
    start = len(head)
    return f"{head}{body}{TURN_CLOSE}\n", start, start + len(body) if role == TRAINED_ROLE else start


def parsed(block: str) -> tuple[str, str]:
    """Role and text of a block."""
    name, body = block[len(TURN_OPEN):-len(TURN_CLOSE) - 1].split("\n", 1)
    return unescaped(json.loads(name)) if name.startswith('"') else name, unescaped(body)


def text_of(value) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value)


def turns_of(record, layouts: dict[str, Mapping]) -> tuple[str, str | None, int | None, list[tuple[str, str]]]:
    """(layout, key, position, [(role, text)]) of a record."""
    layout = layouts.get(fingerprint(field_paths(record)))
    if layout is None:
        return "unknown", None, None, []
    renamed = lambda r: layout.roles.get(text_of(r), text_of(r))
    key = None if not layout.key or record[layout.key] is None else text_of(record[layout.key])
    position = record[layout.position] if layout.position else 0
    if not (position is None or isinstance(position, int) and -2 ** 63 <= position < 2 ** 63):
        return "unknown", None, None, []  # a place that is no number can't be sorted by
    if layout.each:
        turns = [(renamed(m.get(layout.role)), text_of(m.get(layout.text))) for m in record[layout.each]]
    elif layout.turns:
        turns = [(role, "\n\n".join(t for p in paths if (t := text_of(record[p])))) for role, paths in layout.turns]
    else:
        turns = [(renamed(record[layout.role]), text_of(record[layout.text]))]
    return layout.name, key, position, turns


BLOCKS = "layout string, conv_key string, position long, item long, block string, loss_start long, loss_end long"


def formatted_turns(records: DataFrame, record_col: str = "record", mappings: list[Mapping] | None = None) -> DataFrame:
    """One row per turn: its place in its conversation, its block and loss range."""
    layouts = {fingerprint(m.paths): m for m in mappings or MAPPINGS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in column(batch, record_col):
                try:
                    record = json.loads(value.as_py() or "null")
                    name, key, position, turns = turns_of(record, layouts)
                except (ValueError, RecursionError):  # not JSON, or nested too deep to read
                    name, key, position, turns = turns_of(None, layouts)
                rows += [(name, key, position, i, *block_of(role, text)) for i, (role, text) in enumerate(turns)] or [
                    (name, key, position, None, None, None, None)]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            columns = zip(*rows) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)],
                                             names=[p.split()[0] for p in BLOCKS.split(", ")])

    return records.select(record_col).mapInArrow(run, BLOCKS)


DIGESTS = "conv_key string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(blocks: DataFrame) -> DataFrame:
    """Per conversation, what its blocks say: turns, text under the loss mask and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [p.split()[0] for p in DIGESTS.split(", ")]
        key, state = None, None

        def begun() -> list:
            return [0, hashlib.sha256(), 0, hashlib.sha256(), 0]

        def told(rows: list) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = zip(*rows) if rows else [[] for _ in kinds]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=names)

        def row() -> tuple:
            return key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        for batch in batches:
            done = []
            for name, block, start, end in zip(*(column(batch, n).to_pylist() for n in ("conv_key", "block", "loss_start", "loss_end"))):
                if state is None or name != key:
                    if state is not None:
                        done.append(row())
                    key, state = name, begun()
                role, text = parsed(block)
                trained = unescaped(block[start:end])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(trained)
                state[3].update(trained.encode())
                state[4] += len(block)
            yield told(done)
        yield told([row()] if state is not None else [])

    turns = blocks.filter(F.col("block").isNotNull()).select("conv_key", "position", "item", "block", "loss_start", "loss_end")
    ordered = turns.repartition("conv_key").sortWithinPartitions("conv_key", "position", "item", "block")
    return ordered.mapInArrow(run, DIGESTS)


def turn_records(conversations: DataFrame) -> DataFrame:
    """The rows of a turn table as records."""
    cells = F.struct(*(F.col(c).alias(c) for c in ("conv_id", "turn", "role", "text")))
    return conversations.select(F.to_json(cells, {"ignoreNullFields": "false"}).alias("record"))


def formatted_rows(conversations: DataFrame) -> DataFrame:
    """The contract's rows, with its added conversation."""
    said = "</s>[INST] ok [/INST]"
    added = conversations.sparkSession.range(2, numPartitions=1).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    found = read_back(formatted_turns(turn_records(own.unionByName(added))))
    return found.withColumn("conv_id", F.col("conv_key").cast("long")).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
