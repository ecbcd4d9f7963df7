"""Windowed stream operators; each works unchanged on a batch DataFrame."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.semantics import as_money
from tidemark.functions.text import query_key
from tidemark.streaming.limits import rate_limit
from tidemark.streaming.stateful import with_state_store


def with_event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP; NTZ columns are cast."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def revenue_tumbling(events: DataFrame, key: str, amount: str = "value", ts: str = "ts", delay: str = "1 day",
                     where: Column | None = None) -> DataFrame:
    """Sum and count per day and key."""
    rows = with_event_time(events, ts)
    if where is not None:
        rows = rows.where(where)
    return (
        rows.withWatermark(ts, delay).groupBy(F.window(ts, "1 day").alias("w"), key)
        .agg(F.sum(as_money(amount)).cast("double").alias("revenue"), F.count(F.lit(1)).alias("events"))
        .select(F.col("w.start").alias("day_start"), key, "revenue", "events"))


def activity_sliding(events: DataFrame, key: str, ts: str = "ts", length: str = "1 hour", step: str = "30 minutes",
                     delay: str = "1 hour") -> DataFrame:
    """Events per key in overlapping windows."""
    return (
        with_event_time(events, ts).withWatermark(ts, delay).groupBy(F.window(ts, length, step).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("events"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "events"))


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions that end after an inactivity gap; an event at the very end of a session begins the next one.

    A stream in append mode sends each out once, when the watermark has passed its end, and then drops its state.  Sessions of
    a first micro-batch are all open until it ends, so the state lies in the RocksDB store.  Rows without a time are left out.
    """
    if events.isStreaming:
        with_state_store(events.sparkSession)
    # Spark's session windows take in an event at their very end, so theirs end a microsecond earlier.
    span = F.session_window(ts, f"{round(pd.Timedelta(gap).total_seconds() * 1e6) - 1} microseconds")
    return (
        with_event_time(events, ts).where(F.col(ts).isNotNull()).withWatermark(ts, delay).groupBy(span.alias("w"), key)
        .agg(F.count(F.lit(1)).alias("events"))
        .select(key, F.col("w.start").alias("session_start"), (F.col("w.end") + F.expr("INTERVAL '0.000001' SECOND")).alias("session_end"), "events"))


def distinct_questions(questions: DataFrame, ts: str = "asked_at", ttl: str = "1 hour") -> DataFrame:
    """The first of equal questions (after normalising) within the ttl.

    A question that follows the last kept equal one by less than the ttl is
    left out.  A stream leaves it out for longer, namely until its watermark
    has passed the ttl.  Null texts are equal; a row without a time is left out.
    """
    rows = with_event_time(questions, ts).withColumn("query_key", query_key(F.col("text")))
    if not rows.isStreaming:
        seconds = pd.Timedelta(ttl).total_seconds()
        ordered = rows.withColumn("_tie", F.coalesce("text", F.lit("")))
        return rate_limit(ordered, "query_key", "_tie", ts, limit=1, seconds=seconds, inclusive=False).where("accepted").drop("accepted", "_tie")
    return rows.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(["query_key"])
