r"""Chat formatting by prefix-target expansion.

A turn is written ``### role: text</turn>`` and a line feed.  Inside roles and texts a
backslash goes before each backslash and ``#`` and before ``</turn>``, in roles also before
a colon; so no text can hold a mark, and reading back is exact.  Every assistant turn
becomes an example of its own: the text is all turns up to and including it, and only that
reply is trainable, from ``loss_start`` to ``loss_end``.  Turns behind the last assistant turn
end in one more row, in which nothing is trainable, so the output holds every turn.

An example is one string, so a conversation's text has to fit in a task's memory; nothing else
of it is held.  Conversations are dealt by id and sorted by turn in the shuffle.

Defined results.  A missing text or role is empty.  A missing conversation id is an id of its
own.  Turns go by number (missing first), then role and text; rows that repeat a turn are
turns of their own.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD, END = "### ", "</turn>"
TRAINED = "assistant"
#: Characters of text that a record batch gathers before it is passed on.
BATCH_CHARS = 4_000_000

_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("#", "\\#").replace(END, "\\" + END)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def header(role: str) -> str:
    return f"{HEAD}{escape(role).replace(':', chr(92) + ':')}: "


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation; the whole string has to be turns."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        yield unescape(m[1]), unescape(m[2])
        at = m.end()


def _expanded(turns: Iterator[tuple], trained: str) -> Iterator[tuple]:
    """Rows (conv_id, example, text, loss_start, loss_end) out of sorted (conv_id, role, text)."""
    conv, text, n, open_ = None, None, 0, False
    for conv_id, role, words in turns:
        if text is None or conv_id != conv:
            if open_:
                yield conv, n, text, None, None
            conv, text, n = conv_id, "", 0
        start = header(role)
        body = escape(words)
        at = len(text) + len(start)
        text = f"{text}{start}{body}{END}\n"
        open_ = role != trained
        if not open_:
            yield conv, n, text, at, at + len(body)
            n += 1
    if open_:
        yield conv, n, text, None, None


def _by_size(rows: Iterator[tuple], schema: pa.Schema, text_at: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[text_at])
        if size > BATCH_CHARS or len(held) >= 2048:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _rows(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in source:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def examples(conversations: DataFrame, *, trained: str = TRAINED) -> DataFrame:
    """conv_id, example, text, loss_start, loss_end (code points; missing where nothing is trainable).

    A conversation's rows stand together in one partition, in order.
    """
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    id_type = rows.schema["conv_id"].dataType
    ddl = f"conv_id {id_type.simpleString()}, example int, text string, loss_start bigint, loss_end bigint"
    schema = _arrow(conversations.sparkSession, ddl)

    def make(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _by_size(_expanded(_rows(source), trained), schema, 2)

    return rows.mapInArrow(make, ddl)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from its rows of ``examples`` alone: the turns that its last row
    holds, and what the rows' loss masks hold, unescaped, one after the other.
    """
    id_type = formatted.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {id_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    schema = _arrow(formatted.sparkSession, ddl)

    def digests(rows: Iterator[tuple]) -> Iterator[tuple]:
        last, conv = None, None
        loss, chars, total = hashlib.sha256(), 0, 0

        def close() -> tuple:
            turns, n = hashlib.sha256(), 0
            for role, text in turns_of(last):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), total

        for conv_id, _, text, start, end in rows:
            if last is not None and conv_id != conv:
                yield close()
                loss, chars, total, last = hashlib.sha256(), 0, 0, None
            conv, last = conv_id, text
            total += len(text)
            if start is not None:
                reply = unescape(text[start:end])
                loss.update(reply.encode())
                chars += len(reply)
        if last is not None:
            yield close()

    def make(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in digests(_rows(source)):
            held.append(row)
            if len(held) >= 2048:
                yield _batch(held, schema)
                held = []
        if held:
            yield _batch(held, schema)

    return formatted.mapInArrow(make, ddl)


def _arrow(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all formatted conversations, and of one whose texts look like marks."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    trap = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], rows.schema)
    return read_back(examples(rows.unionByName(extra)))


QUERIES = {"op4_chat_prefix_targets": op4}
ORACLE = {
    "op4_chat_prefix_targets": r"""
with raw as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k,
  length('### : </turn>') + 1 + length(role) + length(replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '\</turn>')) as n from raw),
u as (select *, sum(n) over (partition by conv_id order by k rows unbounded preceding) as upto, max(k) over (partition by conv_id) as top from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
  sum(upto) filter (role = 'assistant' or k = top)::bigint as formatted_chars
from u group by conv_id""",
}
