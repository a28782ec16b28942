"""Chat formatting: conversations rendered by a compiled template, with a loss mask.

The operator deals turns by conversation and sorts them; each task streams them
through the template's closures, so memory is bounded by one turn's text however
long a conversation is. Output is one row per turn: concatenated in order of
``seq`` they are the formatted conversation, and ``loss_spans`` are the parts of a
row under the loss mask, in code points.

Control strings inside texts are escaped by a backslash after their first
character, and backslashes are doubled; ``read_back`` inverts this exactly.

Defined cases: a null text or role is empty; turns sort by turn (nulls first), then
role, then text, so repeated turns all appear; rows with a null conv_id form one
conversation; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .templates import Template

#: Control strings of common chat formats, none of which may appear raw inside a text.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|startoftext|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
#: Marks each turn; the newline of a role is written as an escape, so the first raw one ends it.
TURN_TEMPLATE = (
    "{% for m in messages %}{{ '<|im_start|>' ~ m.role|escape_line ~ '\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}{% else %}{{ m.text|escape }}{% endif %}"
    "{{ '<|im_end|>' ~ '\n' }}{% endfor %}"
)
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_TURN = re.compile(r"<\|im_start\|>((?:[^\\\n]++|\\.)*+)\n((?:[^\\<]++|\\.|<(?!\|im_end\|>))*+)<\|im_end\|>\n", re.S)

PART_SCHEMA = "conv_id long, seq long, formatted string, loss_spans array<struct<start:long,end:long>>"
DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    """Text without raw control strings."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def escape_line(text: str) -> str:
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    """Inverse of both escapes: a backslash stands before a backslash, an ``n`` for a newline, or inside a control string."""
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


def chat_template(source: str = TURN_TEMPLATE) -> Template:
    return Template(source, {"escape": escape, "escape_line": escape_line, "trim": str.strip})


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Consecutive rows of each conversation, lazily."""
    from itertools import groupby

    def rows():
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    for conv_id, turns in groupby(rows(), key=lambda r: r[0]):
        yield conv_id, ({"role": role or "", "text": text or ""} for _, role, text in turns)


def _flush(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


PART_ARROW = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
DIGEST_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
#: Characters of output gathered before a batch is handed on.
FLUSH_CHARS = 1 << 22


def renderer(source: str):
    """Function for ``mapInArrow``: sorted turns to formatted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = chat_template(source)
        done: list[tuple] = []
        size = 0
        for conv_id, turns in _conversations(batches):
            # The template pulls turns one at a time; each pull after the first closes the part before it.
            state = {"text": [], "spans": [], "at": 0, "seq": 0}

            def close() -> None:
                nonlocal size
                text = "".join(state["text"])
                done.append((conv_id, state["seq"], text, [{"start": a, "end": b} for a, b in state["spans"]]))
                size += len(text)
                state.update(text=[], spans=[], at=0, seq=state["seq"] + 1)

            def emit(text: str, masked: bool) -> None:
                state["text"].append(text)
                if masked:
                    state["spans"].append((state["at"], state["at"] + len(text)))
                state["at"] += len(text)

            for turn in _paced(template, turns, emit):
                if turn and state["text"]:
                    close()
                if size > FLUSH_CHARS:
                    yield _flush(done, PART_ARROW)
                    done, size = [], 0
            if state["text"]:
                close()
        if done:
            yield _flush(done, PART_ARROW)

    return run


def _paced(template: Template, turns: Iterator[dict], emit) -> Iterator[bool]:
    """Render a conversation, yielding after each turn's output.

    A template whose outermost node is a loop over the messages is run item by
    item; any other is rendered in one go.
    """
    from .templates import For, Name, _compiled

    head = template.tree[0] if len(template.tree) == 1 else None
    if not (isinstance(head, For) and head.source == Name(("messages",))):
        template.render({"messages": turns}, emit)
        yield True
        return
    body = _compiled(head.body, template.filters, False)
    item, index = next(turns, None), 0
    while item is not None:
        after = next(turns, None)
        body({head.var: item, "loop": {"index0": index, "first": index == 0, "last": after is None}}, emit)
        yield True
        item, index = after, index + 1


def format_conversations(conversations: DataFrame, source: str = TURN_TEMPLATE) -> DataFrame:
    """One row per turn: conv_id, seq, formatted, loss_spans; sorted within each task."""
    chat_template(source)  # a bad template fails here, not in a task
    turns = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return turns.select("conv_id", "role", "text").mapInArrow(renderer(source), PART_SCHEMA)


def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parse formatted rows: turns, unescaped texts and what the loss mask covers."""
    from itertools import groupby

    def rows():
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    done: list[tuple] = []
    for conv_id, parts in groupby(rows(), key=lambda r: r[0]):
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n_turns = loss_chars = chars = 0
        for _, _, text, spans in parts:
            chars += len(text)
            at = 0
            while at < len(text):
                m = _TURN.match(text, at)
                if not m:
                    raise ValueError(f"conversation {conv_id}: no turn at {at}")
                turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                n_turns, at = n_turns + 1, m.end()
            for span in spans:
                covered = unescape(text[span["start"] : span["end"]])
                loss.update(covered.encode())
                loss_chars += len(covered)
        done.append((conv_id, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
        if len(done) >= 4096:
            yield _flush(done, DIGEST_ARROW)
            done = []
    if done:
        yield _flush(done, DIGEST_ARROW)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return format_conversations(table.unionByName(own)).mapInArrow(read_back, DIGEST_SCHEMA)


_SQL_CONTROL = "|".join(re.escape(c).replace("/", "[/]") for c in CONTROL)
_SQL_CHARS = "length({0}) + (length({0}) - length(replace({0}, chr(92), ''))) + length(regexp_replace({0}, '(" + _SQL_CONTROL + ")', '\\1.', 'g')) - length({0})"
OP9_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + ({_SQL_CHARS.format("role")}) + (length(role) - length(replace(role, chr(10), ''))) + ({_SQL_CHARS.format("text")})) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id
"""
