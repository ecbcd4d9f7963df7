"""Revenue of any date range: actuals before the business date, prorated forecast from it on."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.semantics import (
    as_date, checked_range, granularity_for_span, growth_vs_positive_base, half_even, horizon_rank, overlap_fraction,
)
from tidemark.operators import facts
from tidemark.operators.asof import asof_join
from tidemark.plans.session import cut_lineage


def _end_of(period, horizon):
    return (
        F.when(horizon == "daily", period).when(horizon == "weekly", F.date_add(period, 6)).otherwise(F.last_day(period))
    )


def _actual_segment(bookings: DataFrame, start, end, granularity: str) -> DataFrame:
    days = (end - start).days + 1
    total = F.col("total_idr")
    return facts.shifted_totals(bookings, start, end).select(
        F.lit("actual").alias("kind"), F.lit(start).alias("start"), F.lit(end).alias("end"), F.lit(days).alias("days"),
        total, half_even(total / days, 2).alias("avg_daily_idr"),
        growth_vs_positive_base(total, F.col("previous_idr")).alias("vs_previous_period_pct"),
        growth_vs_positive_base(total, F.col("last_year_idr")).alias("vs_same_period_last_year_pct"),
        F.lit(granularity).alias("granularity_used"))


def _forecast_rows(forecast: DataFrame, start, end, granularity: str) -> DataFrame:
    """Forecast rows with the preference rank of their horizon and their share of the range."""
    rank = horizon_rank(F.col("horizon"), granularity, (end - start).days + 1)
    p_end = _end_of(F.col("period"), F.col("horizon"))
    share = overlap_fraction(F.col("period"), p_end, F.lit(start), F.lit(end))
    return forecast.select(
        rank.alias("rank"), "horizon", F.col("period").alias("period_start"), p_end.alias("period_end"),
        "forecast_idr", "model_mape_pct", share.alias("share")).where("rank IS NOT NULL")


def _forecast_segment(forecast: DataFrame, start, end, granularity: str) -> DataFrame:
    """Totals of the first horizon that has rows; an empty forecast table is an error."""
    inside = F.col("share") > 0
    part = F.when(inside, (F.col("forecast_idr") * F.col("share")).cast("decimal(28,6)"))
    per_horizon = _forecast_rows(forecast, start, end, granularity).groupBy("rank", "horizon").agg(
        F.coalesce(F.sum(part).cast("double"), F.lit(0.0)).alias("total"),
        F.min_by("model_mape_pct", "period_start").alias("mape"),
        F.coalesce(F.max(inside & (F.col("share") < 1)), F.lit(False)).alias("partial"),
        F.max(F.when(inside, F.least("period_end", F.lit(end)))).alias("covered"))
    best = per_horizon.agg(F.min_by(F.struct("*"), "rank").alias("b")).select("b.*")
    checked = F.when(F.col("horizon").isNull(), F.raise_error(F.lit("the forecast table is empty"))).otherwise(F.col("horizon"))
    return best.select(
        F.lit("forecast").alias("kind"), F.lit(start).alias("start"), F.lit(end).alias("end"),
        F.lit((end - start).days + 1).alias("days"), half_even(F.col("total"), 2).alias("total_idr"),
        checked.alias("granularity_used"), F.col("mape").alias("model_mape_pct"),
        F.col("partial").alias("prorated_edges"), F.col("covered").alias("covered_until"),
        (F.col("covered").isNull() | (F.col("covered") < F.lit(end))).alias("beyond_horizon"))


def resolve(bookings: DataFrame, forecast: DataFrame, start, end, as_of) -> tuple[DataFrame, DataFrame]:
    """Segments (one row per kind, with the grand total) and their periods."""
    start, end = checked_range(start, end)
    today = as_date(as_of)
    granularity = granularity_for_span((end - start).days + 1)
    segments = periods = None
    if start < today:
        last = min(end, today - timedelta(days=1))
        segments = _actual_segment(bookings, start, last, granularity)
        periods = facts.period_breakdown(bookings, start, last, granularity).select(
            F.lit("actual").alias("kind"), "period", "revenue_idr", "booking_count", F.lit(False).alias("partial"))
    if end >= today:
        first = max(start, today)
        ahead = _forecast_segment(forecast, first, end, granularity)
        ranked = _forecast_rows(forecast, first, end, granularity)
        used = ranked.where(F.col("rank") == ranked.agg(F.min("rank")).scalar())
        rows = used.where("share > 0").select(
            F.lit("forecast").alias("kind"), F.date_format("period_start", "yyyy-MM-dd").alias("period"),
            half_even(F.col("forecast_idr") * F.col("share"), 2).alias("revenue_idr"),
            F.lit(None).cast("bigint").alias("booking_count"), (F.col("share") < 1).alias("partial"))
        segments = ahead if segments is None else segments.unionByName(ahead, allowMissingColumns=True)
        periods = rows if periods is None else periods.unionByName(rows)
    # At most two rows reach this window.
    grand = F.round(F.sum(F.col("total_idr").cast("decimal(28,2)")).over(Window.partitionBy()).cast("double"), 2)
    wanted = {
        "kind": "string", "start": "date", "end": "date", "days": "int", "total_idr": "double",
        "avg_daily_idr": "double", "vs_previous_period_pct": "double", "vs_same_period_last_year_pct": "double",
        "granularity_used": "string", "model_mape_pct": "double", "prorated_edges": "boolean",
        "covered_until": "date", "beyond_horizon": "boolean"}
    shaped = segments.select(*[
        F.col(c) if c in segments.columns else F.lit(None).cast(t).alias(c) for c, t in wanted.items()])
    return (
        shaped.withColumn("grand_total_idr", grand).withColumn("contains_forecast", F.lit(end >= today)).orderBy("start"),
        periods.orderBy("kind", "period"))


def _share(row, start, end):
    return overlap_fraction(row["period"], row["last_day"], start, end)


def forecast_for_ranges(requests: DataFrame, forecast: DataFrame) -> DataFrame:
    """Prorated forecast of a table of ranges (request_id, start, end, horizon), one row each.

    The forecast becomes running totals per horizon; a range is the difference of two of them, those at its two edges,
    with the periods that an edge cuts taken in part.  Each edge finds its total by an as-of join, so a range costs the
    same however long it is, and periods need not lie on a calendar grid (but must not overlap within a horizon).  A range
    that no period covers has a total of 0; beyond_horizon tells that the forecast ends before the range.
    """
    amount = F.col("forecast_idr").cast("decimal(28,6)")
    rows = forecast.where("forecast_idr IS NOT NULL").groupBy("horizon", "period").agg(F.sum(amount).cast("decimal(28,6)").alias("idr"), F.count("*").alias("n"))
    rows = rows.withColumn("last_day", _end_of(F.col("period"), F.col("horizon")))
    # One row per period: as many as the calendar has.
    order = Window.partitionBy("horizon").orderBy("period")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    period = F.struct("period", "last_day", "idr")
    running = cut_lineage(rows.select(
        "horizon", period.alias("own"), F.sum("idr").over(upto).alias("idr"), F.sum("n").over(upto).alias("n"), F.lead(period).over(order).alias("next")))
    begun = running.select("horizon", F.col("own.period").alias("since"), "own", "idr", "n")
    over = running.select("horizon", F.date_add("own.last_day", 1).alias("since"), F.col("next").alias("own"), "idr", "n")
    wanted = requests.select("request_id", "start", "end", "horizon")
    edges = asof_join(asof_join(wanted, begun, ["horizon"], "end", "since", "upper"), over, ["horizon"], "start", "since", "lower")
    # Before the end of the first period nothing is over, and that one comes next.
    edges = edges.join(F.broadcast(running.groupBy("horizon").agg(F.min("own").alias("first"))), "horizon", "left")  # one row per horizon
    first, last = F.when(F.col("lower").isNull(), F.col("first")).otherwise(F.col("lower.own")), F.col("upper.own")
    n, idr = F.coalesce("lower.n", F.lit(0)), F.coalesce("lower.idr", F.lit(0).cast("decimal(38,6)"))
    hit = F.coalesce(F.col("upper.n") - n, F.lit(0)) > 0
    low, high = (_share(x, F.col("start"), F.col("end")) for x in (first, last))
    cut = lambda x, share: x["idr"] - (x["idr"].cast("double") * share).cast("decimal(28,6)")  # noqa: E731  what lies outside
    whole = F.col("upper.idr") - idr
    total = whole - cut(last, high) - F.when(first["period"] != last["period"], cut(first, low)).otherwise(F.lit(0).cast("decimal(28,6)"))
    return edges.select(
        "request_id", F.when(hit, F.col("upper.n") - n).otherwise(F.lit(0)).cast("long").alias("periods"),
        F.when(hit, F.round(total.cast("double"), 2)).otherwise(F.lit(0.0)).alias("total_idr"),
        (hit & ((low < 1) | (high < 1))).alias("partial"), (~hit | (last["last_day"] < F.col("end"))).alias("beyond_horizon"))
