"""Chat formatting by event-sourced reconstruction.

A conversation log holds events: ``message`` opens a message, ``delta`` appends to it, ``edit`` replaces its text,
``regenerate`` replaces its text and drops the later messages that had begun by then, ``delete`` removes it. ``reconstruct``
folds a log into final messages, ``render`` writes each as a template turn, ``read_back`` parses rendered turns and
digests them by conversation.

Defined results: null text counts as empty, null role as an empty role; null sequences sort first; events with equal
sequence apply in the order of kind, role and text; a null conversation id is a conversation of its own; an empty log gives
no rows; columns other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuspark.llm.common import kind_of, table, text_or_empty

START, END = "<|im_start|>", "<|im_end|>"
RESETS = ("message", "edit", "regenerate")
DELTA_CHARS = 256
DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: Column) -> Column:
    """One more backslash inside every ``<|``, ``<\\|``, ``<\\\\|`` ...: no marker remains, and it can be undone."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(n|\\)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def reconstruct(events: DataFrame) -> DataFrame:
    """Fold events (conv_id, msg_id, seq, event, role, text) to final messages (conv_id, msg_id, seq, role, text).

    Messages, not conversations, are the unit of the first shuffle, so a hot conversation spreads over all tasks; only
    the rule of ``regenerate`` looks across a conversation, by a spillable running maximum.
    """
    ev = F.sort_array(F.collect_list(F.struct("seq", "event", "role", "text")))
    reset_at = F.expr(f"array_max(transform(ev, (x, i) -> if(x.event in {RESETS}, i + 1, 1)))")
    folded = (
        events.select("conv_id", "msg_id", "seq", "event", "role", "text")
        .groupBy("conv_id", "msg_id")
        .agg(ev.alias("ev"))
        .withColumn("reset_at", reset_at)
        .select(
            "conv_id",
            "msg_id",
            F.expr("ev[0].seq").alias("seq"),
            F.expr("coalesce(get(filter(ev, x -> x.role is not null), 0).role, '')").alias("role"),
            F.expr("array_join(transform(slice(ev, reset_at, size(ev)), x -> coalesce(x.text, '')), '')").alias("text"),
            F.expr("element_at(ev, -1).event <=> 'delete'").alias("deleted"),
            F.expr("array_max(filter(ev, x -> x.event = 'regenerate')).seq").alias("regenerated"),
        )
    )
    earlier = Window.partitionBy("conv_id").orderBy("seq", "msg_id").rowsBetween(Window.unboundedPreceding, -1)
    return (
        folded.withColumn("cut", F.max("regenerated").over(earlier))
        .where(~F.col("deleted") & ~F.coalesce(F.col("cut") > F.col("seq"), F.lit(False)))
        .select("conv_id", "msg_id", "seq", "role", "text")
    )


def render(messages: DataFrame) -> DataFrame:
    """Add ``rendered`` (the turn in the template) and ``loss_start``, ``loss_end`` (its span under the loss mask, null if none)."""
    head = F.concat(F.lit(START), escape_role(text_or_empty("role")), F.lit("\n"))
    body = escape(text_or_empty("text"))
    learnt = F.col("role") == "assistant"
    start = F.when(learnt, F.length(head))
    return messages.select(
        "*",
        F.concat(head, body, F.lit(END + "\n")).alias("rendered"),
        start.cast("long").alias("loss_start"),
        (start + F.length(body)).cast("long").alias("loss_end"),
    )


def _digest_stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by conversation and order; only running digests are held."""
    key, state, out = None, None, []

    def flushed(kind: pa.DataType) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [[]] * 6
        kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", *(c.split()[0] for c in DIGESTS.split(", "))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    def row():
        n, turns, chars, loss, total = state
        return (key, n, turns.hexdigest(), chars, loss.hexdigest(), total)

    kind = pa.null()
    for batch in batches:
        kind = batch.column(0).type
        for conv, rendered, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if state is None or conv != key:
                if state is not None:
                    out.append(row())
                key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, _, body = rendered[len(START) : -len(END) - 1].partition("\n")
            state[0] += 1
            state[1].update(f"{unescape_role(role)}\n{unescape(body)}\n".encode())
            if a is not None:
                learnt = unescape(rendered[a:b])
                state[2] += len(learnt)
                state[3].update(learnt.encode())
            state[4] += len(rendered)
        if out:
            yield flushed(kind)
            out.clear()
    if state is not None:
        out.append(row())
        yield flushed(kind)


def read_back(rendered: DataFrame) -> DataFrame:
    """Digest rendered turns by conversation. A digest is sequential, so a conversation is one stream, in order and never held whole:
    that is inherent in a SHA-256 of all its turns."""
    return (
        rendered.select("conv_id", "seq", "msg_id", "rendered", "loss_start", "loss_end")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "seq", "msg_id")
        .select("conv_id", "rendered", "loss_start", "loss_end")
        .mapInArrow(_digest_stream, f"conv_id {kind_of(rendered, 'conv_id')}, {DIGESTS}")
    )


def as_events(conversations: DataFrame, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """Turn rows (conv_id, turn, role, text) as a streamed log: ``message``, then deltas of ``delta_chars`` code points.

    Repeated (conv_id, turn) rows are messages of their own, ordered by role and text.
    """
    copy = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    parts = F.expr(f"transform(sequence(0, int(length(body) / {delta_chars})), i -> substring(body, i * {delta_chars} + 1, {delta_chars}))")
    return (
        conversations.select("conv_id", "turn", "role", text_or_empty().alias("body"), copy.alias("copy"))
        .select("conv_id", "turn", "copy", "role", F.posexplode(parts).alias("part", "text"))
        .select(
            "conv_id",
            F.struct("turn", "copy").alias("msg_id"),
            F.struct("turn", "copy", "part").alias("seq"),
            F.when(F.col("part") == 0, "message").otherwise("delta").alias("event"),
            F.when(F.col("part") == 0, F.col("role")).alias("role"),
            "text",
        )
    )


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql(
        f"SELECT -1L AS conv_id, turn, role, '{END}{START}assistant ok' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(render(reconstruct(as_events(turns))))


QUERIES = {"op1_chat": op1_chat}
ORACLE_SQL = {
    "op1_chat": f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{END}{START}assistant ok' UNION ALL SELECT -1, 1, 'assistant', '{END}{START}assistant ok'
), rendered AS (
  SELECT *, length('{START}') + length('{END}') + 2 + length(role)
    + length(regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g')) AS n FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM rendered GROUP BY conv_id"""
}
