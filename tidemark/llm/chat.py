"""Chat formatting from event logs: fold events into messages, then render turns with reversible escapes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.base import texts_of

HEAD, MID, END = "### ", ": ", "</turn>\n"
#: A backslash goes before each of these inside a text; the last only inside a role.
CONTROL = ("\\", "###", "</turn>", ":")
TURN = re.compile(r"### ((?:[^\\:]|\\\\|\\:|\\###|\\</turn>)*): (.*?)(?<!\\)((?:\\\\)*)</turn>\n", re.S)
ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
#: Events that replace what a message said so far.
RESETS = ("start", "edit", "regenerate")
NO_SEQ = -(1 << 63)


def fold(events: DataFrame) -> DataFrame:
    """Final messages of event logs: conv_id, seq (of the first event), message, role, text.

    Events: conv_id, message (id within the conversation), seq, kind, role, text.  `start` opens a message, `delta`
    appends, `edit` replaces the text, `regenerate` empties it before new deltas, `delete` removes the message.  Events
    of a message meet once, sorted and streamed; only those from the last reset on are gathered, so a long log or a long
    conversation never meets in one row.  A null seq comes before all others and is given back as null, a null kind is a
    delta, null texts are empty, an event delivered twice counts once, ties in seq go by kind (resets first) and text.
    The role is that of the last event that names one (of several with one seq the greatest).
    """
    kind, key = F.coalesce("kind", F.lit("delta")), ["conv_id", "message"]
    rows = events.select(*key, F.coalesce("seq", F.lit(NO_SEQ)).alias("seq"), kind.alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    reset, of_message = F.col("kind").isin(*RESETS), Window.partitionBy(*key)
    # One exchange: all that follows is by the same key.
    e = rows.repartition(*key).distinct().select(
        "*", F.min("seq").over(of_message).alias("first_seq"), F.max(F.when(reset, F.col("seq"))).over(of_message).alias("last_reset"),
        F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).over(of_message).alias("named"), F.max(F.col("kind") == "delete").over(of_message).alias("deleted"))
    live = e.where("NOT deleted AND (last_reset IS NULL OR seq >= last_reset)")
    parts = F.sort_array(F.collect_list(F.struct("seq", (~reset).alias("delta"), "text")))
    return live.groupBy(*key).agg(F.min("first_seq").alias("seq"), F.max("named.role").alias("role"), parts.alias("parts")).select(
        "conv_id", F.nullif("seq", F.lit(NO_SEQ)).alias("seq"), "message", "role", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def escape(text: Column, controls: tuple[str, ...] = CONTROL[:3]) -> Column:
    for c in controls:
        text = F.replace(text, F.lit(c), F.lit("\\" + c))
    return text


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """The turns of `fold`, as strings: conv_id, seq, message, formatted, loss_start, loss_end (places in `formatted`).

    Written one after another in the order of conv_id, seq, message they are the formatted conversations.  The loss
    lies on the escaped text of the role `learn`; other turns have no span.  A null role is written as an empty one.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(HEAD), escape(role, CONTROL), F.lit(MID))
    mine = role == learn
    start = F.char_length(head).cast("long")
    return messages.select(
        "conv_id", "seq", "message", F.concat(head, escape(text), F.lit(END)).alias("formatted"),
        F.when(mine, start).alias("loss_start"), F.when(mine, start + F.char_length(escape(text))).alias("loss_end"))


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a formatted string."""
    at = 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        yield unescape(m[1]), unescape(m[2] + m[3])
        at = m.end()


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed back from `render`.

    A digest is sequential, so the turns of a conversation pass through one task in their order; that task keeps only
    running hashes, never the conversation.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        out = lambda rows: pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.string() if n.endswith("sha256") else pa.int64()) for i, n in enumerate(names)], names=names)
        close = lambda s: done.append((s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]))
        for batch in batches:
            for conv, text, start, end in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        close(state)
                    now, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in turns_of(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                if start is not None:
                    said = unescape(text[start:end])
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(text)
            if len(done) >= 10_000:
                yield out(done)
                done = []
        if state is not None:
            close(state)
        if done:
            yield out(done)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "message")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, schema)


def events_of(conversations: DataFrame) -> DataFrame:
    """An event log of finished conversations (conv_id, turn, role, text): a start and a delta for each row.

    Rows without a turn come first.  Rows of one turn are ordered by role and text, and equal rows stay apart: the id of
    a message is its turn and its place within it, so no text is part of a key.
    """
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.coalesce("text", F.lit("")).alias("text"))
    of_turn = Window.partitionBy("conv_id", "turn").orderBy(F.coalesce("role", F.lit("")), "text")
    message = F.format_string("%s:%019d", F.coalesce(F.col("turn").cast("string"), F.lit("")), F.row_number().over(of_turn))
    seq = F.col("turn") * 2
    return rows.withColumn("message", message).select("conv_id", "message", F.explode(F.array(
        F.struct(seq.alias("seq"), F.lit("start").alias("kind"), F.col("role"), F.lit("").alias("text")),
        F.struct((seq + 1).alias("seq"), F.lit("delta").alias("kind"), F.lit(None).cast("string").alias("role"), F.col("text"))))
        .alias("event")).select("conv_id", "message", "event.*")
