"""Chat formatting from an event log.

A log holds, for each conversation, events in sequence: a message is opened, streamed
deltas are added to it, an edit replaces what it holds, a regeneration empties it. The log
is folded into final messages, which are rendered with turn marks and a loss mask.

The fold groups by message, not by conversation, so a conversation of any length spreads
over tasks; what a task gathers at once is the events of one message.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, DELTA, EDIT, REGENERATE = "open", "delta", "edit", "regenerate"
#: The template. In roles and texts a backslash and "<" are written with a backslash before.
HEAD, MIDDLE, TAIL = "<turn ", ">\n", "\n</turn>\n"
#: Roles whose texts are under the loss mask.
LEARNED = ("assistant",)
TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*)>\n((?:[^\\<]|\\.)*)\n</turn>\n", re.S)
ESCAPED = re.compile(r"\\(.)", re.S)


def fold(log: DataFrame, conversation: str = "conv_id", message: str = "msg", order: str = "seq") -> DataFrame:
    """Final messages of a log with columns ``kind``, ``role`` and ``text``: one row for each message opened.

    Events of a message count in the order of ``order`` (of any type that sorts); ties are
    ordered by kind and text. The text is the last edit's, or empty after a later
    regeneration, and the deltas that follow. The role is that of the first opening. Null
    texts and roles are empty, unknown kinds count as nothing; messages never opened vanish.
    """
    event = F.struct(
        F.col(order).alias("at"), F.col("kind").alias("kind"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
    )
    known = log.where(F.col("kind").isin(OPEN, DELTA, EDIT, REGENERATE))
    grouped = known.groupBy(F.col(conversation).alias("conv_id"), F.col(message).alias("msg")).agg(
        F.sort_array(F.collect_list(event)).alias("events")
    )
    opened = F.filter("events", lambda e: e["kind"] == OPEN)
    resets = F.transform("events", lambda e, i: F.when(e["kind"].isin(EDIT, REGENERATE), i + 1).otherwise(0))
    last = F.array_max(resets)
    tail = F.slice("events", F.greatest(last, F.lit(1)), F.size("events"))
    content = F.array_join(
        F.transform(tail, lambda e: F.when(e["kind"].isin(DELTA, EDIT), e["text"]).otherwise("")), ""
    )
    return grouped.where(F.size(opened) > 0).select(
        "conv_id", "msg", F.element_at(opened, 1)["role"].alias("role"), content.alias("text")
    )


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<>])", r"\\$1")


def render(messages: DataFrame) -> DataFrame:
    """Messages with ``formatted``, their part of the conversation's text, and the span of it
    under the loss mask (``loss_start``, ``loss_len`` in code points; null where there is none)."""
    head = F.concat(F.lit(HEAD), escape(F.col("role")), F.lit(MIDDLE))
    body = escape(F.col("text"))
    learned = F.col("role").isin(*LEARNED)
    return messages.withColumns({
        "formatted": F.concat(head, body, F.lit(TAIL)),
        "loss_start": F.when(learned, F.char_length(head)),
        "loss_len": F.when(learned, F.char_length(body)),
    })


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def read_back(rendered: DataFrame) -> DataFrame:
    """What each conversation's formatted text says, read from that text and its loss spans alone.

    Parts stream in order of ``msg`` through one task for each conversation, which keeps
    running digests and one part at a time, so a conversation may be of any length.
    """
    schema = (
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint"
    )
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        state: list | None = None
        done: list[list] = []

        def close() -> None:
            if state is not None:
                conv, n, turns, chars, loss, size = state
                done.append([conv, n, turns.hexdigest(), chars, loss.hexdigest(), size])

        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_len")]
            for conv, formatted, start, length in zip(*columns, strict=True):
                if state is None or state[0] != conv:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in TURN.findall(formatted):
                    state[1] += 1
                    state[2].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                if start is not None:
                    told = unescape(formatted[start : start + length])
                    state[3] += len(told)
                    state[4].update(told.encode())
                state[5] += len(formatted)
            if len(done) >= 1000:
                yield batch_of(done)
                done.clear()
        close()
        if done:
            yield batch_of(done)

    parts = rendered.select(F.col("conv_id").cast("bigint").alias("conv_id"), "msg", "formatted", "loss_start", "loss_len")
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "msg").mapInArrow(read, schema)


def as_log(turns: DataFrame, chunk: int = 256) -> DataFrame:
    """A log that ends in the turns of a table ``conv_id, turn, role, text``.

    User and system messages are opened and then set by one edit over a first wording.
    Assistant messages are streamed: a first attempt that is regenerated, then deltas of
    ``chunk`` code points. Messages are named by their turn and, where turns tie, by their
    rank by role and text; a null turn comes first.
    """
    ranked = turns.selectExpr(
        "cast(conv_id as bigint) as conv_id", "cast(turn as bigint) as turn",
        "coalesce(cast(role as string), '') as role", "coalesce(cast(text as string), '') as text",
    ).selectExpr("*", "row_number() over (partition by conv_id, turn order by role, text) as tie")
    streamed = F.transform(
        F.sequence(F.lit(0), F.floor((F.char_length("text") - 1) / chunk).cast("int")),
        lambda i: F.substring(F.col("text"), i * chunk + 1, F.lit(chunk)),
    )
    streamed = F.when(F.char_length("text") > 0, streamed).otherwise(F.array().cast("array<string>"))

    def event(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    first = F.substring(F.col("text"), 1, chunk)
    told = F.concat(
        F.array(event(DELTA, F.reverse(first)), event(REGENERATE, F.lit(""))), F.transform(streamed, lambda t: event(DELTA, t))
    )
    typed = F.array(event(DELTA, F.reverse(first)), event(EDIT, F.col("text")))
    events = F.concat(F.array(event(OPEN, F.lit(""))), F.when(F.col("role").isin(*LEARNED), told).otherwise(typed))
    return ranked.select("conv_id", F.struct("turn", "tie").alias("msg"), "role", F.posexplode(events).alias("seq", "event")).select(
        "conv_id", "msg", "seq", "role", "event.*"
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """Conversations formatted from the log of their turns, and what is read back from the output.

    A row for each conversation; a null id is a conversation of its own. No turns, no rows.
    """
    return read_back(render(fold(as_log(turns))))
