"""Operators over streams with state and event-time timers of their own: closed sessions, question dedup by time to live.

State is dropped by timers as the watermark passes, so it holds only what can still change.  Columns of the frames have no
leading underscore: such names don't reach a stateful processor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.text import query_key

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> None:
    """Timers need the RocksDB state store, a session setting."""
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKSDB)


def merged(spans: list[tuple[int, int, int]], times: np.ndarray, gap: int) -> list[tuple[int, int, int]]:
    """Open sessions (start, end = last event plus gap, events) with further events: what touches becomes one.

    An event at the very end of a session begins the next one.
    """
    out: list[list[int]] = []
    events = [(int(t), int(t) + gap, 1) for t in times]
    for start, end, n in sorted([*spans, *events]):
        if out and start < out[-1][1]:
            out[-1][1], out[-1][2] = max(out[-1][1], end), out[-1][2] + n
        else:
            out.append([start, end, n])
    return [tuple(x) for x in out]


class _Sessions(StatefulProcessor):
    """Open sessions of a key; when the watermark passes the end of the first, all closed ones are sent out."""

    def __init__(self, key: str, gap: int):
        self.key, self.gap = key, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "starts array<long>, ends array<long>, counts array<long>")

    def _held(self) -> list[tuple[int, int, int]]:
        state = self.open.get() if self.open.exists() else None
        return list(zip(*state, strict=True)) if state else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        spans = self._held()
        for pdf in rows:  # a frame at a time: only sessions are held
            spans = merged(spans, pdf["micros"].to_numpy(), self.gap)
        self._hold(spans)
        yield from ()

    def _hold(self, spans: list[tuple[int, int, int]]) -> None:
        """Keep open sessions, with one timer: at the end of the first of them."""
        self.open.update(tuple([s[i] for s in spans] for i in range(3)))
        self.handle.registerTimer(-(-min(s[1] for s in spans) // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Whatever the watermark has passed is closed, not only what this timer was set for.
        now = timerValues.getCurrentWatermarkInMs() * 1000
        spans = self._held()
        closed, still = [s for s in spans if s[1] <= now], [s for s in spans if s[1] > now]
        if still and closed:
            self._hold(still)
        elif not still:
            self.open.clear()
        if closed:
            yield pd.DataFrame({self.key: [key[0]] * len(closed), **{c: [s[i] for s in closed] for i, c in enumerate(("start_micros", "end_micros", "events"))}})


def closed_sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of a stream in append mode: each is sent out once, when the watermark has passed its end.

    Events of one micro-batch may come in any order, and later batches may join sessions that were apart, as long as they
    are not later than `delay`.  State is the open sessions.  Rows without a time are left out.
    """
    with_state_store(events.sparkSession)
    at = F.col(ts).cast("timestamp")
    rows = events.select(F.col(key), at.alias("event_at"), F.unix_micros(at).alias("micros")).where("event_at IS NOT NULL").withWatermark("event_at", delay)
    schema = T.StructType([events.schema[key], *(T.StructField(c, T.LongType()) for c in ("start_micros", "end_micros", "events"))])
    closed = rows.groupBy(key).transformWithStateInPandas(_Sessions(key, int(pd.Timedelta(gap).total_seconds() * 1e6)), schema, "Append", "EventTime")
    return closed.select(key, F.timestamp_micros("start_micros").alias("session_start"), F.timestamp_micros("end_micros").alias("session_end"), "events")


class _FirstInTtl(StatefulProcessor):
    """The time of the last kept question; a timer forgets it after the ttl."""

    def __init__(self, ttl: int, columns: list[str]):
        self.ttl, self.columns = ttl, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["micros", "tie"], kind="stable", ignore_index=True)
        last = self.last.get()[0] if self.last.exists() else None
        keep = []
        for t in pdf["micros"].tolist():
            keep.append(last is None or abs(t - last) >= self.ttl)
            last = max(t, last) if keep[-1] and last is not None else t if keep[-1] else last
        self.last.update((last,))
        self.handle.registerTimer(-(-(last + self.ttl) // 1000))
        yield pdf.loc[keep, self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and self.last.get()[0] + self.ttl <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.last.clear()
        yield from ()


def first_questions(questions: DataFrame, ident: str, ts: str = "asked_at", ttl: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Questions of a stream that no equal one, after normalising, precedes by less than the ttl: ident, query_key, ts.

    Unlike `dropDuplicatesWithinWatermark`, an equal question returns exactly when the ttl of the last kept one is over.
    Questions of a micro-batch are taken in time order (ties by ident); one that comes in a later batch but is older than
    the last kept one is kept only if it lies a ttl before it.  Null texts are equal; rows without a time are left out.
    A micro-batch of one question is held by one task, only its ids and times; its size is set at the source.
    """
    with_state_store(questions.sparkSession)
    at = F.col(ts).cast("timestamp")
    rows = questions.select(F.col(ident), query_key(F.col("text")).alias("query_key"), at.alias("event_at"), F.unix_micros(at).alias("micros"), F.col(ident).alias("tie")).where("event_at IS NOT NULL")
    schema = T.StructType([questions.schema[ident], T.StructField("query_key", T.StringType()), T.StructField("micros", T.LongType())])
    kept = rows.withWatermark("event_at", delay).groupBy("query_key").transformWithStateInPandas(
        _FirstInTtl(int(pd.Timedelta(ttl).total_seconds() * 1e6), [ident, "query_key", "micros"]), schema, "Append", "EventTime")
    return kept.select(ident, "query_key", F.timestamp_micros("micros").alias(ts))
