"""Destinations, packages and partners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.semantics import as_money, in_range, key_or_unknown, realised
from tidemark.operators.revenue import sums_by


def popularity(destinations: DataFrame, bookings: DataFrame, start, end, dimension: DataFrame | None = None, key: str = "customer_id") -> DataFrame:
    """Master popularity next to realised bookings; either side may be missing.

    The destination may live in `dimension`, one row per `key`: bookings are summed per key before the join.
    """
    rows = bookings.where(realised() & in_range("created_at", start, end))
    sold = sums_by(rows, "destination_name", "destination_name", {"n": F.lit(1), "_sum": as_money("total_price_idr")}, dimension, key)
    sold = sold.select("destination_name", "n", F.coalesce(F.col("_sum").cast("double"), F.lit(0.0)).alias("revenue"))
    # A name listed twice keeps one score.
    master = destinations.groupBy(key_or_unknown("name").alias("destination_name")).agg(
        F.max("popularity_score").alias("popularity_score")
    )
    return (
        master.join(sold, "destination_name", "full_outer")
        .select(
            "destination_name",
            F.coalesce("popularity_score", F.lit(0.0)).alias("popularity_score"),
            F.coalesce("n", F.lit(0)).alias("actual_booking_count"),
            F.coalesce("revenue", F.lit(0.0)).alias("actual_revenue_idr"),
        )
        .orderBy(F.desc("actual_revenue_idr"), "destination_name")
    )


def _mean(column: str, digits: int = 6):
    exact = F.col(column).cast("decimal(28,10)")
    return F.round(F.try_divide(F.sum(exact).cast("double"), F.count(exact)), digits)


def region_summary(destinations: DataFrame) -> DataFrame:
    return (
        destinations.groupBy(key_or_unknown("region").alias("region"))
        .agg(F.count(F.lit(1)).alias("destination_count"), _mean("avg_rating").alias("avg_rating"))
        .orderBy(F.desc("destination_count"), "region")
    )


def package_types(packages: DataFrame) -> DataFrame:
    return (
        packages.groupBy(key_or_unknown("type").alias("type"))
        .agg(
            F.count(F.lit(1)).alias("package_count"),
            F.coalesce(F.sum("total_bookings"), F.lit(0)).alias("total_bookings"),
            _mean("rating").alias("avg_rating"),
            _mean("price_per_pax_idr").alias("avg_price_idr"),
        )
        .orderBy(F.desc("total_bookings"), "type")
    )


# Table -> (sort column, code column, {output column: default}).
TOP_SHAPES = {
    "packages": ("total_bookings", "package_code", {
        "package_code": "", "name": "", "destination_name": "Unknown", "type": "Unknown",
        "nights": 0, "price_per_pax_idr": 0.0, "rating": 0.0, "total_bookings": 0}),
    "hotels": ("rating", "hotel_code", {
        "hotel_code": "", "name": "", "destination_name": "Unknown", "star_rating": 0,
        "rating": 0.0, "total_reviews": 0, "commission_rate": 0.0}),
    "flights": ("avg_occupancy_rate", "flight_code", {
        "flight_code": "", "airline": "Unknown", "origin": "Unknown", "destination": "Unknown",
        "avg_occupancy_rate": 0.0, "commission_rate": 0.0}),
}


def top(table: DataFrame, kind: str, limit: int = 10) -> DataFrame:
    """Best packages, hotels or flight routes with defaults for missing fields."""
    sort, code, fields = TOP_SHAPES[kind]
    filled = [F.coalesce(F.col(c), F.lit(default)).alias(c) for c, default in fields.items()]
    return table.select(*filled).orderBy(F.desc(sort), code).limit(limit)
