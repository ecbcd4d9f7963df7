"""Distribution profiles of the business tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.quantiles import approx_quantiles, quantiles
from tidemark.functions.semantics import committed, elapsed_days, whole_days
from tidemark.operators.churn import split_hash


def category_share(df: DataFrame, *columns: str) -> DataFrame:
    """Relative frequency of every value (or value combination); nulls do not count.

    The total is a scalar subquery over the same counts, so the shuffle is
    reused and no row has to pass through one task.
    """
    counts = df.select(*columns).dropna().groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows")).scalar()
    return (
        counts.withColumn("share", F.round(F.col("rows") / total, 6))
        .orderBy(F.desc("rows"), *columns))


def joint_share(bookings: DataFrame) -> DataFrame:
    return category_share(bookings, "status", "payment_status")


def seasonal_volume(bookings: DataFrame) -> DataFrame:
    """Mean bookings per day by month and weekday (Monday 0); days without bookings count as zero."""
    made = bookings.groupBy(F.col("booking_date").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    ends = bookings.agg(F.min("booking_date").cast("date").alias("a"), F.max("booking_date").cast("date").alias("b"))
    days = ends.where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("day"))
    return (
        days.join(made, "day", "left").groupBy(F.month("day").alias("month"), F.weekday("day").alias("weekday"))
        .agg(F.round(F.avg(F.coalesce("n", F.lit(0))), 6).alias("mean_bookings"), F.count(F.lit(1)).alias("days"))
        .orderBy("month", "weekday"))


def booking_rhythm(bookings: DataFrame) -> DataFrame:
    """First, last and number of committed bookings and the mean gap per customer."""
    rows = bookings.where(committed()).groupBy("customer_id").agg(
        F.max("booking_date").alias("last"), F.min("booking_date").alias("first"), F.count(F.lit(1)).alias("freq"))
    gap = whole_days("last", "first") / (F.col("freq") - 1)
    return rows.withColumn("avg_interval", F.when(F.col("freq") > 1, gap))


def ratio_distribution(bookings: DataFrame, exact: bool = True) -> DataFrame:
    """Quantiles of discount / base price."""
    rows = bookings.select(F.try_divide(F.col("discount_idr"), F.col("base_price_idr")).alias("ratio")).dropna()
    probs = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    table = (quantiles if exact else approx_quantiles)(rows, "ratio", probs)
    return table.select(F.lit("discount_ratio").alias("measure"), "n", *[F.round(p, 6).alias(p) for p in probs])


def lead_days(bookings: DataFrame, exact: bool = True) -> DataFrame:
    """Quantiles of whole days from booking to travel, at least 1."""
    days = F.floor(elapsed_days("travel_date", "booking_date"))
    rows = bookings.select(F.when(days.isNotNull(), F.greatest(days, F.lit(1))).alias("days")).dropna()
    probs = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    table = (quantiles if exact else approx_quantiles)(rows, "days", probs)
    return table.select(F.lit("lead_days").alias("measure"), "n", *[F.round(p, 6).alias(p) for p in probs])


def text_sample(df: DataFrame, text: str, by: str, key: str, per_group: int = 300, seed: int = 42) -> DataFrame:
    """Up to `per_group` non-null texts of every group, chosen by a reproducible hash.

    The row_number filter becomes a per-task group limit, so a hot group sends
    at most `per_group` rows per task into the shuffle.
    """
    order = Window.partitionBy(by).orderBy("_h", key)
    rows = df.where(F.col(text).isNotNull()).select(key, by, text, split_hash(key, seed).alias("_h"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_group).drop("_h")


def null_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.round(F.avg(F.col(c).isNull().cast("int")), 6).alias(c) for c in columns])
