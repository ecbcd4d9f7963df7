"""Rules shared by every operator: ranges, predicates, money, rounding, calendar.

All helpers return Columns, so Catalyst sees plain expressions and can push
filters and prune columns.  Range bounds are DATE literals: whichever side of
TIMESTAMP / TIMESTAMP_NTZ the column is, the literal is converted and the
column stays bare, which keeps parquet pushdown.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Booking statuses and payment states.
COMPLETED = "Completed"
CONFIRMED = "Confirmed"
CANCELLED = "Cancelled"
PAID = "Paid"
COMMITTED_STATUSES = (COMPLETED, CONFIRMED)

UNKNOWN = "Unknown"
MICROS_PER_DAY = 86_400_000_000

# Granularity -> date_trunc unit.
TRUNC_UNIT = {
    "daily": "day",
    "weekly": "week",
    "monthly": "month",
    "annually": "year",
    "yearly": "year",
}


def as_date(value: date | datetime | str) -> date:
    """Accept a date, datetime or ISO text."""
    if isinstance(value, datetime):
        return value.date()
    if isinstance(value, date):
        return value
    return date.fromisoformat(value[:10])


def checked_range(start, end) -> tuple[date, date]:
    """Both ends as dates; an inverted range is an error."""
    start, end = as_date(start), as_date(end)
    if start > end:
        raise ValueError(f"range start {start} is after range end {end}")
    return start, end


def in_range(column: str | Column, start, end) -> Column:
    """Inclusive days as the half-open interval [start 00:00, end + 1 day 00:00)."""
    c = F.col(column) if isinstance(column, str) else column
    start, end = as_date(start), as_date(end)
    return (c >= F.lit(start)) & (c < F.lit(end + timedelta(days=1)))


def realised() -> Column:
    """Dashboard revenue: completed and paid."""
    return (F.col("status") == COMPLETED) & (F.col("payment_status") == PAID)


def committed() -> Column:
    """Behavioural bookings: completed or confirmed, paid or not."""
    return F.col("status").isin(*COMMITTED_STATUSES)


def committed_paid() -> Column:
    """Resolver and model revenue: completed or confirmed, and paid."""
    return committed() & (F.col("payment_status") == PAID)


def key_or_unknown(column: str) -> Column:
    """Null and empty group keys become one 'Unknown' before grouping."""
    text = F.col(column).cast("string")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(UNKNOWN))


def as_money(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("decimal(18,2)")


def money_sum(c: str | Column, where: Column | None = None) -> Column:
    """Sum of money that does not depend on row order; nothing summed gives 0."""
    amount = as_money(c)
    if where is not None:
        amount = F.when(where, amount)
    return F.coalesce(F.sum(amount).cast("double"), F.lit(0.0))


def money_avg(c: str | Column, where: Column | None = None) -> Column:
    """Average of non-null money, null for an empty group."""
    amount = as_money(c)
    if where is not None:
        amount = F.when(where, amount)
    return F.try_divide(F.sum(amount).cast("double"), F.count(amount))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """n / d, 0 when d is 0 or null."""
    return F.coalesce(
        F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0)
    )


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def micros(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp"))


def elapsed_days(later: str | Column, earlier: str | Column) -> Column:
    """Fractional days between two instants."""
    return (micros(later) - micros(earlier)) / F.lit(float(MICROS_PER_DAY))


def whole_days(later: str | Column, earlier: str | Column) -> Column:
    """floor(elapsed / 24 h); not the same as counting calendar days."""
    return F.floor(elapsed_days(later, earlier)).cast("int")


def period_start(column: str | Column, granularity: str) -> Column:
    """First day of the period; weeks start on Monday, unknown units fall back to days."""
    return F.date_trunc(TRUNC_UNIT.get(granularity, "day"), column).cast("date")


def period_end(start: Column, horizon: str) -> Column:
    """Last day of a period that begins at `start`."""
    if horizon == "daily":
        return start
    if horizon == "weekly":
        return F.date_add(start, 6)
    return F.last_day(start)


def period_label(start: Column, granularity: str) -> Column:
    """2024-01-31 / ISO 2025-W01 / 2024-01."""
    if granularity == "daily":
        return F.date_format(start, "yyyy-MM-dd")
    if granularity == "weekly":
        week = F.lpad(F.weekofyear(start).cast("string"), 2, "0")
        return F.concat(F.date_part(F.lit("YEAROFWEEK"), start).cast("string"), F.lit("-W"), week)
    return F.date_format(start, "yyyy-MM")


def trimmed_period_label(label: Column, granularity: str) -> Column:
    """Monthly series show YYYY-MM whatever longer label they arrive with."""
    return F.substring(label, 1, 7) if granularity == "monthly" else label


def growth_vs_positive_base(now: Column, base: Column, digits: int = 1) -> Column:
    """Percent change, null unless the base is above zero (resolver rule)."""
    return F.when(base > 0, half_even((now - base) / base * 100, digits))


def growth_vs_nonzero_base(now: Column, base: Column, digits: int = 2) -> Column:
    """Percent change, null only for a zero or null base (analyst rule)."""
    return F.when(base != 0, half_even((now - base) / base * 100, digits))


def overlap_fraction(p_start: Column, p_end: Column, q_start: Column, q_end: Column) -> Column:
    """Share of the days [p_start, p_end] that lie in [q_start, q_end]."""
    low, high = F.greatest(p_start, q_start), F.least(p_end, q_end)
    shared = F.datediff(high, low) + 1
    return F.when(low > high, 0.0).otherwise(shared / (F.datediff(p_end, p_start) + 1))


FINENESS = {"daily": 1, "weekly": 2, "monthly": 3}


def granularity_for_span(days: int) -> str:
    return "daily" if days <= 30 else "weekly" if days <= 84 else "monthly"


def granularity_column(days: Column) -> Column:
    return F.when(days <= 30, "daily").when(days <= 84, "weekly").otherwise("monthly")


def horizon_rank(horizon: Column, first: str, days: int) -> Column:
    """Place of a forecast horizon in the order of preference for a span of `days`; null if it is too fine for it.

    The wanted horizon comes first, then the others from the finest that suits the span on.
    """
    fineness = F.create_map(*[F.lit(x) for g, n in FINENESS.items() for x in (g, n)])
    level = fineness[horizon]
    return F.when(horizon == first, 0).when(level >= FINENESS[granularity_for_span(days)], level)


def previous_period(start, end) -> tuple[date, date]:
    """The equally long range that ends the day before `start`."""
    start, end = checked_range(start, end)
    last = start - timedelta(days=1)
    return last - (end - start), last


def risk_bucket(p: Column) -> Column:
    return (
        F.when(p >= 0.75, "Very High").when(p >= 0.50, "High").when(p >= 0.25, "Medium").otherwise("Low")
    )


def booking_track(frequency: Column) -> Column:
    return F.when(frequency == 1, "single").otherwise("repeat")


def rating_sentiment(rating: Column) -> Column:
    return F.when(rating >= 4, "Positive").when(rating == 3, "Neutral").otherwise("Negative")


def age_band(age: Column) -> Column:
    return (
        F.when(age <= 25, "18-25").when(age <= 35, "26-35").when(age <= 45, "36-45")
        .when(age <= 55, "46-55").otherwise("56+")
    )


def calendar_parts(column: str | Column) -> dict[str, Column]:
    """ISO week, month, weekday (Monday = 0) and quarter."""
    return {
        "iso_week": F.weekofyear(column),
        "month": F.month(column),
        "weekday": F.weekday(column),
        "quarter": F.quarter(column),
    }


def code_number(code: Column, prefix: str) -> Column:
    """BK-000123 -> 123; codes of another shape give null."""
    digits = F.regexp_extract(code, prefix + r"-?0*(\d+)", 1)
    return F.nullif(digits, F.lit("")).try_cast("long")


def email_domain(email: Column) -> Column:
    return F.get(F.split(email, "@", -1), F.lit(1))


def clean_input(text: Column) -> Column:
    """Drop non-printing characters but newline and tab, then trim; empty is null."""
    kept = F.regexp_replace(text, r"[^\P{C}\n\t]", "")
    return F.nullif(F.regexp_replace(kept, r"^\s+|\s+$", ""), F.lit(""))


def object_id(text: Column) -> Column:
    """24 hex digits, or null."""
    return F.when(text.rlike("^[0-9a-fA-F]{24}$"), F.lower(text))


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(value, high))


def calendar(df: DataFrame, start, end, name: str = "date") -> DataFrame:
    """One row per day of an inclusive range."""
    start, end = checked_range(start, end)
    days = F.explode(F.sequence(F.lit(start), F.lit(end)))
    return df.sparkSession.range(0, 1, 1, 1).select(days.alias(name))
