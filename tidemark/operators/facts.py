"""Facts over committed bookings on `booking_date`, and their comparison over time."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.quantiles import approx_quantiles, quantiles
from tidemark.functions.semantics import (
    PAID, checked_range, committed, committed_paid, growth_vs_nonzero_base, half_even,
    as_money, in_range, key_or_unknown, money_sum, period_label, period_start, previous_period, safe_ratio,
)
from tidemark.operators.revenue import sums_by

# Top-n bounds and the number of months a trend shows.
DEFAULT_TOP_N = 5
MAX_TOP_N = 25
TREND_MONTHS = 24


def revenue_total(bookings: DataFrame, start, end) -> DataFrame:
    return bookings.where(committed_paid() & in_range("booking_date", start, end)).agg(
        money_sum("total_price_idr").alias("total_idr")
    )


def period_breakdown(bookings: DataFrame, start, end, granularity: str) -> DataFrame:
    """Label, revenue and count per period; labels are made after the aggregation."""
    return (
        bookings.where(committed_paid() & in_range("booking_date", start, end))
        .groupBy(period_start("booking_date", granularity).alias("p"))
        .agg(money_sum("total_price_idr").alias("r"), F.count(F.lit(1)).alias("booking_count"))
        .select(
            period_label(F.col("p"), granularity).alias("period"),
            half_even(F.col("r"), 2).alias("revenue_idr"), "booking_count",
        )
        .orderBy("period")
    )


def channel_performance(bookings: DataFrame, start, end) -> DataFrame:
    """Completion over all bookings; revenue of anything paid, whatever its status."""
    return (
        bookings.where(in_range("booking_date", start, end))
        .groupBy(key_or_unknown("channel").alias("channel"))
        .agg(
            F.count(F.lit(1)).alias("total_bookings"),
            F.count_if(committed()).alias("done"),
            money_sum("total_price_idr", F.col("payment_status") == PAID).alias("revenue_idr"),
        )
        .select(
            "channel", "total_bookings",
            half_even(safe_ratio(F.col("done"), F.col("total_bookings")), 3).alias("completion_rate"),
            "revenue_idr",
        )
        .orderBy(F.desc("revenue_idr"), "channel")
    )


def booking_count(bookings: DataFrame, start, end) -> DataFrame:
    return bookings.where(committed() & in_range("booking_date", start, end)).agg(
        F.count(F.lit(1)).alias("booking_count")
    )


def churn_buckets(scores: DataFrame) -> DataFrame:
    return (
        scores.groupBy("risk_bucket").agg(F.count(F.lit(1)).alias("customers")).orderBy("risk_bucket")
    )


def top_destinations(bookings: DataFrame, start, end, limit: int = DEFAULT_TOP_N, dimension: DataFrame | None = None, key: str = "customer_id") -> DataFrame:
    """Committed bookings, paid or not; the destination may live in `dimension`, one row per `key`."""
    rows = bookings.where(committed() & in_range("booking_date", start, end))
    sums = sums_by(rows, "destination_name", "destination", {"bookings": F.lit(1), "_sum": as_money("total_price_idr")}, dimension, key)
    return sums.select("destination", "bookings", F.coalesce(F.col("_sum").cast("double"), F.lit(0.0)).alias("revenue_idr")).orderBy(
        F.desc("revenue_idr"), "destination").limit(limit)


def top_customers(bookings: DataFrame, start, end, limit: int = DEFAULT_TOP_N, people: DataFrame | None = None) -> DataFrame:
    """Biggest spenders of a range, named as on their earliest booking in it, or as in `people`, which only the top meet."""
    first = F.struct("booking_date", "booking_id")
    names = {"customer_name": "customer_name", "customer_segment": "segment"}
    named = [] if people is not None else [F.min_by(c, first).alias(n) for c, n in names.items()]
    top = bookings.where(committed_paid() & in_range("booking_date", start, end)).groupBy("customer_id").agg(
        *named, money_sum("total_price_idr").alias("total_spent_idr"), F.count(F.lit(1)).alias("booking_count")).orderBy(
        F.desc("total_spent_idr"), "customer_id").limit(limit)
    if people is not None:
        known = people.select("customer_id", *[F.col(c).alias(n) for c, n in names.items()])
        top = known.join(F.broadcast(top), "customer_id", "right")  # `limit` rows
    return top.select("customer_id", *names.values(), "total_spent_idr", "booking_count").orderBy(F.desc("total_spent_idr"), "customer_id")


def period_comparison(bookings: DataFrame, start, end) -> DataFrame:
    """Every scalar fact now and one period earlier, from one scan."""
    start, end = checked_range(start, end)
    before_start, before_end = previous_period(start, end)
    windows = {
        "current": in_range("booking_date", start, end),
        "previous": in_range("booking_date", before_start, before_end),
    }
    paid = F.col("payment_status") == PAID
    sums = [money_sum("total_price_idr", paid & w).alias(f"revenue_idr_{n}") for n, w in windows.items()]
    counts = [F.count_if(w).cast("double").alias(f"booking_count_{n}") for n, w in windows.items()]
    one = bookings.where(committed() & in_range("booking_date", before_start, end)).agg(*sums, *counts)
    long = one.selectExpr(
        "stack(2, 'revenue_idr', revenue_idr_current, revenue_idr_previous,"
        " 'booking_count', booking_count_current, booking_count_previous)"
        " AS (metric, current, previous)"
    )
    now, base = F.col("current"), F.col("previous")
    return long.select(
        "metric", "current", "previous", F.round(now - base, 2).alias("change"),
        growth_vs_nonzero_base(now, base).alias("change_pct"),
    ).orderBy("metric")


def shifted_totals(bookings: DataFrame, start, end) -> DataFrame:
    """Committed-paid revenue of a range, the period before it and 365 days earlier, in one scan."""
    start, end = checked_range(start, end)
    prev_start, prev_end = previous_period(start, end)
    year = timedelta(days=365)
    ranges = {
        "total_idr": (start, end), "previous_idr": (prev_start, prev_end),
        "last_year_idr": (start - year, end - year),
    }
    touched = None
    for lo, hi in ranges.values():
        hit = in_range("booking_date", lo, hi)
        touched = hit if touched is None else touched | hit
    return bookings.where(committed_paid() & touched).agg(*[
        money_sum("total_price_idr", in_range("booking_date", lo, hi)).alias(name)
        for name, (lo, hi) in ranges.items()
    ])


def monthly_trend(bookings: DataFrame, start, end, last: int = TREND_MONTHS) -> DataFrame:
    """The last `last` months that have revenue."""
    months = (
        bookings.where(committed_paid() & in_range("booking_date", start, end))
        .groupBy(period_start("booking_date", "monthly").alias("p"))
        .agg(money_sum("total_price_idr").alias("revenue_idr"), F.count(F.lit(1)).alias("booking_count"))
        .orderBy(F.desc("p"))
        .limit(last)
    )
    return months.select(
        F.date_format("p", "yyyy-MM").alias("period"), "revenue_idr", "booking_count"
    ).orderBy("period")


def value_distribution(bookings: DataFrame, start, end, exact: bool = True) -> DataFrame:
    """Spread of committed booking values; `exact=False` uses one-pass sketches."""
    rows = bookings.where(committed() & in_range("booking_date", start, end)).select("total_price_idr")
    probs = {"min_idr": 0.0, "p25_idr": 0.25, "median_idr": 0.5, "p75_idr": 0.75, "p95_idr": 0.95, "max_idr": 1.0}
    table = (quantiles if exact else approx_quantiles)(rows, "total_price_idr", probs)
    return table.select(
        F.col("n").alias("total_bookings"), *[F.round(c, 4).alias(c) for c in probs]
    )


def segment_composition(customers: DataFrame, exact: bool = True) -> DataFrame:
    """Customers and median spend per segment, biggest segment first."""
    rows = customers.select(key_or_unknown("segment").alias("segment"), "total_spent_idr")
    sizes = rows.groupBy("segment").agg(F.count(F.lit(1)).alias("customers"))
    medians = (quantiles if exact else approx_quantiles)(
        rows, "total_spent_idr", {"median_spend_idr": 0.5}, by=["segment"]
    ).drop("n")
    return (
        sizes.join(medians, "segment", "left")
        .select("segment", "customers", F.round("median_spend_idr", 4).alias("median_spend_idr"))
        .orderBy(F.desc("customers"), "segment")
    )


def quality_snapshot(bookings: DataFrame, customers: DataFrame) -> DataFrame:
    """Table sizes and the share of bookings without a campaign."""
    b = bookings.agg(
        F.count(F.lit(1)).alias("total_bookings"),
        F.count_if(F.col("campaign_id").isNull()).alias("organic_bookings_no_campaign"),
    )
    people = customers.agg(F.count(F.lit(1)).alias("n")).scalar()
    share = safe_ratio(F.col("organic_bookings_no_campaign"), F.col("total_bookings"))
    return b.select(
        "total_bookings", people.alias("total_customers"), "organic_bookings_no_campaign",
        half_even(share, 3).alias("organic_share"),
    )


def last_rows(df: DataFrame, order: str, n: int, by: list[str]) -> DataFrame:
    """The last n rows of every group; Spark limits each group map-side first."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
