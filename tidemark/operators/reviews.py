"""Review dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.semantics import TRUNC_UNIT, in_range, key_or_unknown
from tidemark.operators.revenue import sums_by


def sentiment_summary(reviews: DataFrame, start, end) -> DataFrame:
    return (
        reviews.where(in_range("review_date", start, end))
        .groupBy(key_or_unknown("sentiment").alias("sentiment"))
        .agg(F.count(F.lit(1)).alias("review_count"), F.avg("rating").alias("avg_rating"))
        .orderBy(F.desc("review_count"), "sentiment")
    )


def rating_trend(reviews: DataFrame, start, end, granularity: str = "monthly") -> DataFrame:
    """Average rating per ISO week, year or month (the fallback); no gap filling."""
    unit = TRUNC_UNIT[granularity] if granularity in ("weekly", "annually") else "month"
    return (
        reviews.where(in_range("review_date", start, end))
        .groupBy(F.date_trunc(unit, "review_date").cast("date").alias("period"))
        .agg(F.avg("rating").alias("avg_rating"), F.count(F.lit(1)).alias("review_count"))
        .select("period", F.lit(granularity).alias("granularity"), "avg_rating", "review_count")
        .orderBy("period")
    )


def destination_ratings(reviews: DataFrame, start, end, limit: int = 10, dimension: DataFrame | None = None, key: str = "customer_id") -> DataFrame:
    """Mean rating and reviews per destination, the best first; the destination may live in `dimension`, one row per `key`."""
    rows = reviews.where(in_range("review_date", start, end))
    sums = sums_by(rows, "destination_name", "destination_name", {"_sum": F.col("rating").cast("double"), "_rated": F.col("rating").isNotNull().cast("int"), "review_count": F.lit(1)}, dimension, key)
    return sums.select("destination_name", F.try_divide("_sum", "_rated").alias("avg_rating"), "review_count").orderBy(F.desc("avg_rating"), "destination_name").limit(limit)
