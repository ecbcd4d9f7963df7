"""Customer dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.semantics import calendar, clamp, in_range, key_or_unknown, money_sum, safe_ratio

# Largest result sizes a caller may ask for.
MAX_SEARCH = 25
MAX_RISK = 100
MIN_QUERY_LENGTH = 2


def segment_distribution(customers: DataFrame) -> DataFrame:
    return (
        customers.groupBy(key_or_unknown("segment").alias("segment"))
        .agg(F.count(F.lit(1)).alias("customer_count"), money_sum("total_spent_idr").alias("total_spent_idr"))
        .orderBy(F.desc("total_spent_idr"), "segment")
    )


def age_distribution(customers: DataFrame) -> DataFrame:
    return (
        customers.groupBy(key_or_unknown("age_group").alias("age_group"))
        .agg(F.count(F.lit(1)).alias("customer_count"))
        .orderBy("age_group")
    )


def city_distribution(customers: DataFrame, limit: int = 10) -> DataFrame:
    return (
        customers.groupBy(key_or_unknown("city").alias("city"))
        .agg(F.count(F.lit(1)).alias("customer_count"))
        .orderBy(F.desc("customer_count"), "city")
        .limit(limit)
    )


def acquisition_channels(customers: DataFrame) -> DataFrame:
    return (
        customers.groupBy(key_or_unknown("acquisition_channel").alias("acquisition_channel"))
        .agg(F.count(F.lit(1)).alias("customer_count"))
        .orderBy(F.desc("customer_count"), "acquisition_channel")
    )


def top_spenders(customers: DataFrame, limit: int = 10) -> DataFrame:
    return (
        customers.select(
            F.coalesce("customer_code", F.lit("")).alias("customer_code"),
            F.coalesce("name", F.lit("")).alias("name"),
            key_or_unknown("segment").alias("segment"),
            F.coalesce("total_trips", F.lit(0)).cast("bigint").alias("total_trips"),
            F.coalesce("total_spent_idr", F.lit(0.0)).alias("total_spent_idr"),
        )
        .orderBy(F.desc("total_spent_idr"), "customer_code")
        .limit(limit)
    )


def new_by_day(customers: DataFrame, start, end) -> DataFrame:
    """Customers who joined, for every day of the range."""
    joined = (
        customers.where(in_range("join_date", start, end))
        .groupBy(F.col("join_date").cast("date").alias("date"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    return (
        calendar(customers, start, end).join(joined, "date", "left")
        .select("date", F.coalesce("c", F.lit(0)).alias("new_customer_count"))
        .orderBy("date")
    )


def repeat_ratio(customers: DataFrame) -> DataFrame:
    """Customers whose flag is null are in neither count."""
    flag = F.col("is_repeat_customer")
    counts = customers.agg(
        F.count_if(flag).alias("repeat_customer_count"), F.count_if(~flag).alias("new_customer_count")
    )
    total = F.col("repeat_customer_count") + F.col("new_customer_count")
    return counts.withColumn("repeat_rate", safe_ratio(F.col("repeat_customer_count"), total))


def search(customers: DataFrame, query: str, limit: int = 10, most: int = MAX_SEARCH) -> DataFrame:
    """Case-insensitive substring of name or code; shorter than two characters finds nothing.

    A report of at most `most` rows, as the surveyed search has it; pass a larger one for more.
    """
    text = (query or "").strip().lower()
    hit = (
        F.lower("name").contains(text) | F.lower("customer_code").contains(text)
        if len(text) >= MIN_QUERY_LENGTH else F.lit(False)
    )
    return (
        customers.where(hit)
        .select(
            "customer_id", "customer_code", "name", key_or_unknown("segment").alias("segment"),
            F.coalesce("total_trips", F.lit(0)).cast("bigint").alias("total_trips"),
            F.coalesce("total_spent_idr", F.lit(0.0)).alias("total_spent_idr"),
        )
        .orderBy("customer_code")
        .limit(min(limit, most))
    )


def churn_risk(scores: DataFrame, customers: DataFrame, bucket: str | None = None, limit: int = 25, most: int = MAX_RISK) -> DataFrame:
    """Highest-risk customers with their profile.

    A report of at most `most` rows, as the surveyed one.  The limit is taken
    before the join, so no more than that meet the customer table.
    """
    rows = scores.where(F.col("risk_bucket") == bucket) if bucket else scores
    order = [F.desc("churn_proba"), F.desc("monetary_total"), F.asc("customer_id")]
    top = rows.orderBy(*order).limit(clamp(limit, 1, most))
    profile = customers.select("customer_id", "customer_code", "name", "segment")
    # The limited side is the row-preserving one, so only a hint on it lets the big side stream.
    matched = profile.join(F.broadcast(top.select("customer_id")), "customer_id", "left_semi")
    return (
        top.join(matched, "customer_id", "left")
        .select(
            "customer_id",
            F.coalesce("customer_code", F.lit("")).alias("customer_code"),
            F.coalesce("name", F.lit("Tanpa nama")).alias("name"),
            F.coalesce("segment", F.lit("Unknown")).alias("segment"),
            F.coalesce("churn_proba", F.lit(0.0)).alias("churn_proba"),
            F.coalesce("risk_bucket", F.lit("Low")).alias("risk_bucket"),
            F.coalesce("track", F.lit("single")).alias("track"),
            F.coalesce("monetary_total", F.lit(0.0)).alias("monetary_total"),
            F.coalesce("tenure_days", F.lit(0)).alias("tenure_days"),
        )
        .orderBy(*order)
    )
