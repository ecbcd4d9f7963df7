"""Data-quality audits; every audit of a table is one aggregation pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.semantics import whole_days
from tidemark.sources.readers import parse_date, to_number

SAME_PRICE = 1.0
PARITY = 0.01


def _long(df: DataFrame, counts: Mapping[tuple[str, str], Column]) -> DataFrame:
    """(column_name, issue, rows) from a set of counting expressions, computed together."""
    keys = list(counts)
    one = df.agg(*[counts[k].alias(f"c{i}") for i, k in enumerate(keys)])
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(issue).alias("issue"), F.col(f"c{i}").cast("bigint").alias("rows"))
        for i, (c, issue) in enumerate(keys)]))
    return one.select(rows.alias("r")).select("r.*")


def audit_parse(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values of date columns that do not parse."""
    return _long(df, {(c, "parse_failed"): F.count_if(F.col(c).isNotNull() & parse_date(c).isNull()) for c in columns})


def audit_numeric(df: DataFrame, domains: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Values that are no number, negative, or outside [low, high] of their column."""
    counts = {}
    for c, (low, high) in domains.items():
        v = to_number(c)
        outside = F.lit(False)
        if low is not None:
            outside = outside | (v < low)
        if high is not None:
            outside = outside | (v > high)
        counts[(c, "coerced_to_null")] = F.count_if(F.col(c).isNotNull() & v.isNull())
        counts[(c, "negative")] = F.count_if(v < 0)
        counts[(c, "out_of_domain")] = F.count_if((v >= 0) & outside)
    return _long(df, counts)


def clean_numeric(df: DataFrame, domains: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """The same columns with every offending value set to null."""
    fixed = {}
    for c, (low, high) in domains.items():
        v = to_number(c)
        ok = v >= F.lit(max(0.0, low or 0.0))
        fixed[c] = F.when(ok & (v <= high) if high is not None else ok, v)
    return df.withColumns(fixed)


def audit_category(df: DataFrame, allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """Non-null values outside the list of their column."""
    return _long(df, {
        (c, "unknown_category"): F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*values)) for c, values in allowed.items()})


def audit_duplicates(df: DataFrame, column: str) -> DataFrame:
    """How many rows repeat an earlier value; they are reported, not dropped."""
    return (
        df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .agg(F.count(F.lit(1)).alias("values"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows"))
        .select(F.lit(column).alias("column_name"), F.lit("duplicate").alias("issue"), "values", "rows"))


def audit_consistency(bookings: DataFrame) -> DataFrame:
    """Dates in order, nights equal to the stay, total = base - discount + tax; checks need their columns."""
    have = set(bookings.columns)
    tests: dict[tuple[str, str], Column] = {}
    if {"travel_date", "booking_date"} <= have:
        tests[("travel_date", "before_booking")] = F.count_if(F.col("travel_date") < F.col("booking_date"))
    if {"return_date", "travel_date"} <= have:
        tests[("return_date", "before_travel")] = F.count_if(F.col("return_date") < F.col("travel_date"))
        if "nights" in have:
            tests[("nights", "differs_from_dates")] = F.count_if(F.col("nights") != whole_days("return_date", "travel_date"))
    if {"total_price_idr", "base_price_idr", "discount_idr", "tax_idr"} <= have:
        made = F.col("base_price_idr") - F.col("discount_idr") + F.col("tax_idr")
        tests[("total_price_idr", "price_identity")] = F.count_if(F.abs(F.col("total_price_idr") - made) > SAME_PRICE)
    if {"amount_idr", "type"} <= have:
        tests[("amount_idr", "negative_but_not_refund")] = F.count_if((F.col("amount_idr") < 0) & (F.col("type") != "Refund"))
    return _long(bookings, tests)


def repair_nights(bookings: DataFrame) -> DataFrame:
    """Nights taken from the dates wherever the dates are usable."""
    stay = whole_days("return_date", "travel_date")
    return bookings.withColumn("nights", F.when(stay >= 0, stay).otherwise(F.col("nights")))


def audit_nulls(df: DataFrame, columns: Sequence[str], issue: str = "missing") -> DataFrame:
    return _long(df, {(c, issue): F.count_if(F.col(c).isNull()) for c in columns})


def feature_sanity(features: DataFrame) -> DataFrame:
    """Violations of the feature rules; all zero when the table is sound."""
    ratio = F.col("recency_ratio")
    return _long(features, {
        ("recency_days", "negative"): F.count_if(F.col("recency_days") < 0),
        ("frequency", "below_one"): F.count_if(F.col("frequency") < 1),
        ("track", "unknown"): F.count_if(F.col("track").isNull() | ~F.col("track").isin("single", "repeat")),
        ("recency_ratio", "infinite"): F.count_if(F.abs(ratio) == float("inf")),
        ("recency_ratio", "nan"): F.count_if(F.isnan(ratio)),
    })


def score_parity(left: DataFrame, right: DataFrame, key: str = "customer_id", score: str = "churn_proba",
                 tolerance: float = PARITY, worst: int = 5) -> tuple[DataFrame, DataFrame]:
    """Agreement of two score tables (one row), and the worst disagreements."""
    both = left.select(key, F.col(score).alias("a")).join(right.select(key, F.col(score).alias("b")), key, "full_outer")
    both = both.withColumn("diff", F.abs(F.col("a") - F.col("b")))
    exact = F.col("diff").cast("decimal(20,10)")
    summary = both.agg(
        F.count("diff").alias("compared"), F.round(F.count("diff") / F.count("a"), 6).alias("overlap"),
        F.round(F.max("diff"), 6).alias("max_diff"),
        F.round(F.try_divide(F.sum(exact).cast("double"), F.count(exact)), 6).alias("mean_diff"),
        F.count_if(F.col("diff") > tolerance).alias("over_tolerance"))
    top = both.where("diff IS NOT NULL").orderBy(F.desc("diff"), key).limit(worst).select(key, "a", "b", F.round("diff", 6).alias("diff"))
    return summary, top
