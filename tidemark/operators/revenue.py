"""Revenue dashboards: realised revenue on `created_at`."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.semantics import (
    as_date, as_money, calendar, in_range, key_or_unknown, money_sum, period_start, realised, safe_ratio,
)


def current(bookings: DataFrame, as_of) -> DataFrame:
    """Today, last seven days, month to date and year to date in one pass.

    There is no upper bound: rows dated after `as_of` count, as in the dashboard.
    """
    today = as_date(as_of)
    since = {
        "today": today,
        "last_seven_days": today - timedelta(days=7),
        "current_month": today.replace(day=1),
        "this_year": today.replace(month=1, day=1),
    }
    oldest = min(since.values())
    rows = bookings.where(realised() & (F.col("created_at") >= F.lit(oldest)))
    return rows.agg(*[
        money_sum("total_price_idr", F.col("created_at") >= F.lit(day)).alias(name)
        for name, day in since.items()
    ])


def by_period(bookings: DataFrame, start, end, granularity: str = "monthly") -> DataFrame:
    """Revenue per day, week, month or year; periods without rows are absent."""
    return (
        bookings.where(realised() & in_range("created_at", start, end))
        .groupBy(period_start("created_at", granularity).alias("period"))
        .agg(money_sum("total_price_idr").alias("revenue"))
        .select("period", F.lit(granularity).alias("granularity"), "revenue")
        .orderBy("period")
    )


def daily(bookings: DataFrame, start, end) -> DataFrame:
    """Revenue for every day of the range, zero where nothing was sold."""
    sold = (
        bookings.where(realised() & in_range("created_at", start, end))
        .groupBy(F.col("created_at").cast("date").alias("date"))
        .agg(money_sum("total_price_idr").alias("revenue"))
    )
    return (
        calendar(bookings, start, end).join(sold, "date", "left")
        .select("date", F.coalesce("revenue", F.lit(0.0)).alias("revenue"))
        .orderBy("date")
    )


def by_key(bookings: DataFrame, start, end, column: str, name: str | None = None) -> DataFrame:
    """Revenue and booking count per value of one column, largest first."""
    name = name or column
    return (
        bookings.where(realised() & in_range("created_at", start, end))
        .groupBy(key_or_unknown(column).alias(name))
        .agg(money_sum("total_price_idr").alias("revenue"), F.count(F.lit(1)).alias("booking_count"))
        .orderBy(F.desc("revenue"), name)
    )


def sums_by(rows: DataFrame, column: str, name: str, sums: dict[str, Column], dimension: DataFrame | None = None, key: str = "customer_id") -> DataFrame:
    """Sums (as name -> summed column) per value of a column, of the rows or of another table with one row per `key`.

    In that case rows are summed per key before they meet the table, so the join moves one row per key instead of every
    row, and a key with a large share of the rows is one row like any other.
    """
    totals = [F.sum(c).alias(n) for n, c in sums.items()]
    if dimension is None:
        return rows.groupBy(key_or_unknown(column).alias(name)).agg(*totals)
    per_key = rows.groupBy(key).agg(*totals)
    return per_key.join(dimension.select(key, column), key, "left").groupBy(key_or_unknown(column).alias(name)).agg(*[F.sum(n).alias(n) for n in sums])


def by_dimension(bookings: DataFrame, dimension: DataFrame, key: str, start, end, column: str,
                 name: str | None = None) -> DataFrame:
    """`by_key` for a column that lives in another table, one row per `key` there.
    """
    name = name or column
    rows = bookings.where(realised() & in_range("created_at", start, end))
    sums = sums_by(rows, column, name, {"_sum": as_money("total_price_idr"), "_n": F.lit(1)}, dimension, key)
    return sums.select(name, F.coalesce(F.col("_sum").cast("double"), F.lit(0.0)).alias("revenue"), F.col("_n").alias("booking_count")).orderBy(F.desc("revenue"), name)


def by_customer_type(bookings: DataFrame, start, end, firsts: DataFrame | None = None, key: str = "customer_id") -> DataFrame:
    """New against repeat customers; a missing flag means new.

    Without a flag on the bookings, `firsts` (key, first_date) tells it: a booking after the first date of its customer is
    a repeat.  Bookings are summed per customer and date before the join, so a customer with a large share of them is no
    more rows than the calendar has days.
    """
    rows = bookings.where(realised() & in_range("created_at", start, end))
    sums = {"_sum": as_money("total_price_idr"), "_n": F.lit(1)}
    if firsts is None:
        flagged = rows.groupBy(F.coalesce(F.col("is_repeat_customer"), F.lit(False)).alias("is_repeat_customer")).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    else:
        per_day = rows.groupBy(key, "booking_date").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
        later = F.coalesce(F.col("booking_date") > F.col("first_date"), F.lit(False))
        flagged = per_day.join(firsts.select(key, "first_date"), key, "left").groupBy(later.alias("is_repeat_customer")).agg(*[F.sum(n).alias(n) for n in sums])
    return flagged.select("is_repeat_customer", F.coalesce(F.col("_sum").cast("double"), F.lit(0.0)).alias("revenue"), F.col("_n").alias("booking_count")).orderBy("is_repeat_customer")


def discount_impact(bookings: DataFrame, start, end) -> DataFrame:
    """Discount given away against the gross it was taken from."""
    totals = bookings.where(realised() & in_range("created_at", start, end)).agg(
        money_sum("discount_idr").alias("total_discount"),
        money_sum("total_price_idr").alias("total_revenue"),
    )
    gross = F.col("total_revenue") + F.col("total_discount")
    return totals.withColumn("discount_rate", safe_ratio(F.col("total_discount"), gross))


def payment_status_summary(bookings: DataFrame, start, end) -> DataFrame:
    """All bookings of the range by payment status, whatever their booking status."""
    return (
        bookings.where(in_range("created_at", start, end))
        .groupBy(key_or_unknown("payment_status").alias("payment_status"))
        .agg(money_sum("total_price_idr").alias("total_amount"), F.count(F.lit(1)).alias("booking_count"))
        .orderBy(F.desc("total_amount"), "payment_status")
    )


# Facet name -> bookings column.
FACETS = {
    "destination": "destination_name",
    "package_type": "package_type",
    "channel": "channel",
    "payment_method": "payment_method",
    "segment": "customer_segment",
}


def facets(bookings: DataFrame, start, end, columns: dict[str, str] | None = None, dimension: DataFrame | None = None, key: str = "customer_id") -> DataFrame:
    """Several breakdowns as one long table from one scan (GROUPING SETS).

    Columns of `dimension`, a table with one row per `key`, are broken down from the sums per key, which are one more
    grouping set of the same scan.
    """
    columns = columns or FACETS
    other = {n: c for n, c in columns.items() if dimension is not None and c in dimension.columns and c not in bookings.columns}
    names = [n for n in columns if n not in other]
    sets = names + (["_key"] if other else [])
    rows = bookings.where(realised() & in_range("created_at", start, end)).select(
        *[key_or_unknown(columns[n]).alias(n) for n in names], *([F.col(key).alias("_key")] if other else []), "total_price_idr")
    grouped = rows.groupingSets([[F.col(n)] for n in sets], *[F.col(n) for n in sets]).agg(
        F.grouping_id().alias("_set"), F.sum(as_money("total_price_idr")).alias("_sum"), F.count(F.lit(1)).alias("booking_count"))
    # grouping_id has a 1 for every column that is aggregated away.
    kept = {n: (2 ** len(sets) - 1) - 2 ** (len(sets) - 1 - i) for i, n in enumerate(sets)}
    facet: Column = F.lit(None).cast("string")
    for n in names:
        facet = F.when(F.col("_set") == kept[n], F.lit(n)).otherwise(facet)
    out = None
    if names:
        out = grouped.where(F.col("_set").isin([kept[n] for n in names])).select(facet.alias("facet"), F.coalesce(*names).alias("key"), "_sum", "booking_count")
    if other:
        homes = dimension.select(F.col(key).alias("_home"), *[key_or_unknown(c).alias(n) for n, c in other.items()])
        per_key = grouped.where(F.col("_set") == kept["_key"]).join(homes, F.col("_key") == F.col("_home"), "left")
        named = F.array(*[F.struct(F.lit(n).alias("facet"), F.coalesce(n, F.lit("Unknown")).alias("key")) for n in other])
        more = per_key.select(F.explode(named).alias("f"), "_sum", "booking_count").groupBy("f.facet", "f.key").agg(
            F.sum("_sum").alias("_sum"), F.sum("booking_count").alias("booking_count"))
        out = more if out is None else out.unionByName(more)
    return out.select("facet", "key", F.coalesce(F.col("_sum").cast("double"), F.lit(0.0)).alias("revenue"), "booking_count").orderBy("facet", F.desc("revenue"), "key")
