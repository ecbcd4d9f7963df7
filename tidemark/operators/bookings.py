"""Booking and transaction dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.semantics import (
    CANCELLED, calendar, elapsed_days, half_even, in_range, key_or_unknown, money_sum, safe_ratio,
)


def status_summary(bookings: DataFrame, start, end) -> DataFrame:
    return (
        bookings.where(in_range("created_at", start, end))
        .groupBy(key_or_unknown("status").alias("status"))
        .agg(F.count(F.lit(1)).alias("booking_count"))
        .orderBy(F.desc("booking_count"), "status")
    )


def volume(bookings: DataFrame, start, end) -> DataFrame:
    """Bookings for every day of the range."""
    made = (
        bookings.where(in_range("created_at", start, end))
        .groupBy(F.col("created_at").cast("date").alias("date"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    return (
        calendar(bookings, start, end).join(made, "date", "left")
        .select("date", F.coalesce("c", F.lit(0)).alias("booking_count"))
        .orderBy("date")
    )


def lead_time(bookings: DataFrame, start, end) -> DataFrame:
    """Days from booking to travel: average to 1 digit, extremes cut toward zero."""
    days = elapsed_days("travel_date", "booking_date")
    # Summing whole microseconds keeps the average independent of row order.
    span = F.unix_micros(F.col("travel_date").cast("timestamp")) - F.unix_micros(F.col("booking_date").cast("timestamp"))
    stats = bookings.where(in_range("created_at", start, end)).agg(
        F.sum(span.cast("decimal(38,0)")).cast("double").alias("s"), F.count(span).alias("n"),
        F.min(days).alias("lo"), F.max(days).alias("hi"),
    )
    average = F.try_divide(F.col("s"), F.col("n")) / F.lit(86_400_000_000.0)
    return stats.select(
        F.coalesce(half_even(average, 1), F.lit(0.0)).alias("avg_lead_time_days"),
        F.coalesce(F.col("lo").cast("int"), F.lit(0)).alias("min_lead_time_days"),
        F.coalesce(F.col("hi").cast("int"), F.lit(0)).alias("max_lead_time_days"),
    )


def cancellation_rate(bookings: DataFrame, start, end) -> DataFrame:
    counts = bookings.where(in_range("created_at", start, end)).agg(
        F.count(F.lit(1)).alias("total_bookings"),
        F.count_if(F.col("status") == CANCELLED).alias("cancelled_bookings"),
    )
    return counts.withColumn(
        "cancellation_rate", safe_ratio(F.col("cancelled_bookings"), F.col("total_bookings"))
    )


def payment_gateways(transactions: DataFrame, start, end) -> DataFrame:
    """Per payment method: successes, everything else, and the amount that succeeded."""
    ok = F.coalesce(F.col("status") == "Success", F.lit(False))
    return (
        transactions.where(in_range("transaction_date", start, end))
        .groupBy(key_or_unknown("payment_method").alias("payment_method"))
        .agg(
            F.count_if(ok).alias("success_count"),
            F.count_if(~ok).alias("failed_count"),
            money_sum("amount_idr", ok).alias("total_amount_idr"),
        )
        .orderBy(F.desc("total_amount_idr"), "payment_method")
    )
