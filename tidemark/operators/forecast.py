"""Revenue series, seasonal features, ridge and seasonal-naive forecasts.

A series is one row per calendar period after aggregation, so its length is
bounded by the calendar and not by the number of bookings.  Windows below
partition by series; many series run in parallel, and models are solved from sums, never from gathered series.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.semantics import as_date, as_money, committed_paid, key_or_unknown, period_start
from tidemark.plans.session import cut_lineage


@dataclass(frozen=True)
class Grain:
    """Fixed values of one granularity."""

    season: int
    test_rows: int
    horizon: int
    step: str
    levels: tuple[int, ...]


GRAINS = {
    "daily": Grain(364, 28, 30, "interval 1 day", tuple(range(0, 7))),
    "weekly": Grain(52, 12, 12, "interval 7 days", tuple(range(1, 54))),
    "monthly": Grain(12, 6, 12, "interval 1 month", tuple(range(1, 13))),
}


def season_level(period: str | Column, granularity: str) -> Column:
    """Weekday (Monday 0), ISO week or month of a period start."""
    return {"daily": F.weekday, "weekly": F.weekofyear, "monthly": F.month}[granularity](period)


def daily_sums(bookings: DataFrame, key: str | None = None, until=None) -> DataFrame:
    """(series, booking_date, amount): committed-paid revenue of each day, as a decimal; weeks and months add up from it."""
    rows = bookings.where(committed_paid() & F.col("booking_date").isNotNull() & F.col("total_price_idr").isNotNull())
    if until is not None:
        rows = rows.where(F.col("booking_date") < F.lit(as_date(until)))
    series = key_or_unknown(key) if key else F.lit("all")
    return rows.groupBy(series.alias("series"), F.col("booking_date").cast("date").alias("booking_date")).agg(
        F.sum(as_money("total_price_idr")).alias("amount"))


def revenue_series(bookings: DataFrame, granularity: str, key: str | None = None, until=None) -> DataFrame:
    """(series, period, y): committed-paid revenue, gaps filled with 0, the last and incomplete period left out.

    Each known period is expanded up to the next one, so one scan gives both
    the sums and the calendar; the last period has no successor and drops out.
    """
    return series_of(daily_sums(bookings, key, until), granularity)


def series_of(days: DataFrame, granularity: str) -> DataFrame:
    """The series of one granularity from the sums of the days."""
    sums = days.groupBy("series", period_start("booking_date", granularity).alias("p")).agg(F.sum("amount").cast("double").alias("amount"))
    following = F.lead("p").over(Window.partitionBy("series").orderBy("p"))
    spread = sums.withColumn("next", following).where("next IS NOT NULL").select(
        "series", "p", "amount",
        F.explode(F.sequence("p", F.date_sub("next", 1), F.expr(GRAINS[granularity].step))).alias("period"))
    return spread.select(
        "series", "period", F.when(F.col("period") == F.col("p"), F.col("amount")).otherwise(0.0).alias("y"))


def with_lags(series: DataFrame, granularity: str) -> DataFrame:
    """lag1, seasonal lag, position t and position from the end."""
    order = Window.partitionBy("series").orderBy("period")
    back = Window.partitionBy("series").orderBy(F.desc("period"))
    return series.select(
        "series", "period", "y",
        F.lag("y", 1).over(order).alias("lag1"),
        F.lag("y", GRAINS[granularity].season).over(order).alias("lag_s"),
        (F.row_number().over(order) - 1).alias("t"),
        F.row_number().over(back).alias("from_end"))


def series_features(series: DataFrame, granularity: str) -> DataFrame:
    """Model rows: lags, t and calendar dummies without the first level; rows without a lag are dropped."""
    rows = with_lags(series, granularity).where("lag1 IS NOT NULL AND lag_s IS NOT NULL")
    level = season_level("period", granularity)
    dummies = [(level == v).cast("int").alias(f"period_{v}") for v in GRAINS[granularity].levels[1:]]
    return rows.select("series", "period", "y", "lag1", "lag_s", "t", "from_end", *dummies)


def holdout(features: DataFrame, granularity: str) -> tuple[DataFrame, DataFrame]:
    """Training rows and the last test rows of every series."""
    last = F.col("from_end") <= GRAINS[granularity].test_rows
    return features.where(~last), features.where(last)


def naive_backtest(series: DataFrame, granularity: str) -> DataFrame:
    """MAPE of the seasonal-naive forecast on the holdout; periods with y = 0 are counted, not divided by."""
    test = with_lags(series, granularity).where(F.col("from_end") <= GRAINS[granularity].test_rows)
    error = F.abs((F.col("y") - F.col("lag_s")) / F.nullif(F.col("y"), F.lit(0.0)))
    return test.groupBy("series").agg(
        F.round(F.avg(F.round(error, 9)) * 100, 2).alias("mape_naive"),
        F.count_if(F.col("y") == 0).alias("zero_rows")).select(
        "series", F.lit(granularity).alias("horizon"), "mape_naive", "zero_rows")


def _ahead(lagged: DataFrame, granularity: str) -> DataFrame:
    grain = GRAINS[granularity]
    ahead = lagged.where((F.col("from_end") <= grain.season) & (F.col("from_end") > grain.season - grain.horizon))
    if granularity == "monthly":
        period = F.add_months("period", grain.season)
    else:
        period = F.date_add("period", grain.season * (7 if granularity == "weekly" else 1))
    return ahead.withColumns({
        "period": period, "horizon": F.lit(granularity), "forecast_idr": F.greatest("y", F.lit(0.0))})


def naive_forecast(series: DataFrame, granularity: str) -> DataFrame:
    """The value of one season ago for each step of the horizon."""
    return _ahead(with_lags(series, granularity), granularity).select("series", "period", "horizon", "forecast_idr")


def naive_table(bookings: DataFrame, as_of) -> DataFrame:
    """Forecast table of all granularities by the seasonal-naive rule, from bookings before `as_of`.

    The bookings are read once, into the sums of the days; the backtest is a window aggregate over the same rows.
    """
    out = None
    # One scan: a row for each day is all that is left of the bookings.
    days = cut_lineage(daily_sums(bookings, until=as_of))
    for granularity, grain in GRAINS.items():
        # The period that contains as_of is incomplete; the series leaves its last period out.
        rows = with_lags(series_of(days, granularity), granularity)
        error = F.abs((F.col("y") - F.col("lag_s")) / F.nullif(F.col("y"), F.lit(0.0)))
        tested = F.when(F.col("from_end") <= grain.test_rows, F.round(error, 9))
        rows = rows.withColumn("mape", F.round(F.avg(tested).over(Window.partitionBy("series")) * 100, 2))
        rows = _ahead(rows, granularity).select(
            "period", "horizon", "forecast_idr", F.col("mape").alias("model_mape_pct"),
            F.lit(as_date(as_of)).cast("timestamp").alias("generated_at"))
        out = rows if out is None else out.unionByName(rows)
    return out


#: Columns that a model weighs besides the calendar dummies.
LAGS = ("lag1", "lag_s", "t")
#: Products whose sums a model needs.
_SUMS = [(a, b) for i, a in enumerate(LAGS) for b in (*LAGS, "y")[i:]]


def _solved(parts: list[dict], alpha: float) -> tuple[float, list[float], list[float]]:
    """Intercept, weights of LAGS and of each calendar level after the first, from the sums of the training rows.

    A level that no training row has gets weight 0, as does the first one, which the intercept stands for.
    """
    n = sum(p["n"] for p in parts)
    levels = parts[1:]
    d = len(LAGS) + len(levels)
    total = np.array([sum(p[c] for p in parts) for c in LAGS] + [float(p["n"]) for p in levels])
    gram, cross = np.zeros((d, d)), np.zeros(d)
    for a, b in _SUMS:
        both, i = sum(p[f"{a}_{b}"] for p in parts), LAGS.index(a)
        if b == "y":
            cross[i] = both
        else:
            gram[i, LAGS.index(b)] = gram[LAGS.index(b), i] = both
    for k, p in enumerate(levels, len(LAGS)):
        gram[k, k], cross[k] = p["n"], p["y"]
        for i, c in enumerate(LAGS):
            gram[i, k] = gram[k, i] = p[c]
    y = sum(p["y"] for p in parts)
    # Centred, so the intercept is not shrunk.
    w = np.linalg.solve(gram - np.outer(total, total) / n + alpha * np.eye(d), cross - total * y / n)
    return float((y - total @ w) / n), w[: len(LAGS)].tolist(), [0.0, *w[len(LAGS):].tolist()]


def ridge_models(series: DataFrame, granularity: str, alpha: float = 1.0) -> DataFrame:
    """One row per series with its ridge model (unpenalised intercept), fitted on all but the last test rows.

    Columns: series, rows (length), usable (rows with both lags), last (period), intercept, weights (of `LAGS`), levels
    (calendar level to weight), test and tail: the test rows, and the values of a season ago for each step ahead.

    The Gram matrix is sums of products per series and calendar level, partial aggregates that never gather a series;
    what is solved is a row of at most a season's levels, whatever the series' length.
    """
    grain = GRAINS[granularity]
    rows = with_lags(series, granularity).withColumn("level", season_level("period", granularity))
    usable = F.col("lag1").isNotNull() & F.col("lag_s").isNotNull()
    train = usable & (F.col("from_end") > grain.test_rows)
    of = lambda c: F.col(c).cast("double")
    sums = {**{c: of(c) for c in (*LAGS, "y")}, **{f"{a}_{b}": of(a) * of(b) for a, b in _SUMS}}
    ahead = (F.col("from_end") <= grain.season) & (F.col("from_end") > grain.season - grain.horizon)
    per_level = rows.groupBy("series", "level").agg(
        F.count_if(train).alias("n"), *[F.coalesce(F.sum(F.when(train, x)), F.lit(0.0)).alias(c) for c, x in sums.items()],
        F.count("*").alias("rows"), F.count_if(usable).alias("usable"), F.max(F.struct("period", "y")).alias("last"),
        F.collect_list(F.when(usable & (F.col("from_end") <= grain.test_rows), F.struct("period", "y", *LAGS, "level"))).alias("test"),
        F.collect_list(F.when(ahead, F.struct((grain.season - F.col("from_end") + 1).alias("k"), "y"))).alias("tail"))
    per_series = per_level.groupBy("series").agg(
        F.sort_array(F.collect_list(F.struct("level", "n", *sums))).alias("sums"), F.sum("rows").alias("rows"), F.sum("usable").alias("usable"), F.max("last").alias("last"),
        F.sort_array(F.flatten(F.collect_list("test"))).alias("test"), F.sort_array(F.flatten(F.collect_list("tail"))).alias("tail"))

    @F.pandas_udf("struct<intercept: double, weights: array<double>, levels: map<int, double>>")
    def solve(parts: pd.Series) -> pd.DataFrame:
        out = []
        for p in parts:
            given = [dict(x) if isinstance(x, dict) else x.asDict() for x in p]
            if not sum(x["n"] for x in given):
                out.append((None, None, None))
                continue
            intercept, weights, levels = _solved(given, alpha)
            out.append((intercept, weights, dict(zip((int(x["level"]) for x in given), levels, strict=True))))
        return pd.DataFrame(out, columns=["intercept", "weights", "levels"])

    return per_series.withColumn("model", solve("sums")).select("series", "rows", "usable", "last", "model.*", "test", "tail")


def fit_ridge(series: DataFrame, granularity: str, alpha: float = 1.0) -> DataFrame:
    """(series, feature, weight) of every series: lag1, lag_s, t, period_<level> after the first level, intercept."""
    models = ridge_models(series, granularity, alpha).where("intercept IS NOT NULL")
    named = F.map_from_arrays(F.array(*map(F.lit, LAGS)), "weights")
    first = F.array_min(F.map_keys("levels"))
    later = F.transform_keys(F.map_filter("levels", lambda k, v: k != first), lambda k, v: F.concat(F.lit("period_"), k.cast("string")))
    return models.select("series", F.explode(F.map_concat(named, later, F.create_map(F.lit("intercept"), F.col("intercept")))).alias("feature", "weight"))


def _next_period(last: Column, k: Column, granularity: str) -> Column:
    if granularity == "monthly":
        return F.add_months(last, k.cast("int"))
    return F.date_add(last, (k * (7 if granularity == "weekly" else 1)).cast("int"))


def ridge_forecast(series: DataFrame, granularity: str, alpha: float = 1.0, on_short: str = "error") -> DataFrame:
    """Backtested recursive forecast of every series; a model that loses to seasonal naive is replaced by it.

    Each step feeds the unclipped prediction into the next; the output is never negative.  A series too short to model
    is an error, or left out with on_short="skip".  Backtest and recursion run on the fixed-size row of a model.
    """
    grain = GRAINS[granularity]
    short = F.col("usable") < 3 * grain.test_rows
    models = ridge_models(series, granularity, alpha)
    if on_short == "error":
        message = F.format_string(f"{granularity} series %s: %s rows after a lag of {grain.season} are too few", F.col("series"), F.col("usable").cast("string"))
        models = models.withColumn("usable", F.when(short, F.raise_error(message).cast("bigint")).otherwise(F.col("usable")))
    models = models.where(~short)
    w = [F.get("weights", F.lit(i)) for i in range(len(LAGS))]
    guess = lambda lag1, lag_s, t, level: F.col("intercept") + w[0] * lag1 + w[1] * lag_s + w[2] * t + F.coalesce(F.col("levels")[level], F.lit(0.0))
    error = lambda r, at: F.abs((r["y"] - at) / r["y"])
    known = F.filter("test", lambda r: r["y"] != 0)
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(xs), F.lit(0)) * 100
    models = models.withColumns({
        "model_mape": mean(F.transform(known, lambda r: error(r, guess(r["lag1"], r["lag_s"], r["t"], r["level"])))),
        "naive_mape": mean(F.transform(known, lambda r: error(r, r["lag_s"])))})
    # Nothing to compare keeps the naive rule.
    models = models.withColumn("used_naive", ~F.coalesce(F.col("model_mape") < F.col("naive_mape"), F.lit(False)))
    steps = F.transform("tail", lambda r: F.struct(r["y"].alias("lag_s"), _next_period(F.col("last.period"), r["k"], granularity).alias("period"), (F.col("rows") + r["k"] - 1).cast("double").alias("t")))
    start = F.struct(F.col("last.y").alias("at"), F.array().cast("array<struct<period: date, value: double>>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        value = F.when(F.col("used_naive"), r["lag_s"]).otherwise(guess(acc["at"], r["lag_s"], r["t"], season_level(r["period"], granularity)))
        return F.struct(value.alias("at"), F.concat(acc["out"], F.array(F.struct(r["period"].alias("period"), value.alias("value")))).alias("out"))

    models = models.withColumn("ahead", F.explode(F.aggregate(steps, start, step)["out"]))
    shown = lambda c: F.coalesce(F.round(c, 2), F.lit(float("nan"))).alias(f"{c}_pct")
    return models.select(
        "series", "ahead.period", F.lit(granularity).alias("horizon"), F.greatest("ahead.value", F.lit(0.0)).alias("forecast_idr"), shown("model_mape"), shown("naive_mape"), "used_naive",
        F.col("rows").alias("rows_used"))


def forecast_panel(bookings: DataFrame, key: str, granularity: str = "monthly") -> DataFrame:
    """The same model for every value of one column; series that are too short are left to `short_series`."""
    return ridge_forecast(revenue_series(bookings, granularity, key), granularity, on_short="skip")


def short_series(series: DataFrame, granularity: str) -> DataFrame:
    """Series too short to model, with their length."""
    grain = GRAINS[granularity]
    return series.groupBy("series").agg(F.count(F.lit(1)).alias("rows")).where(
        F.col("rows") - grain.season < 3 * grain.test_rows)


def train_forecasts(bookings: DataFrame, generated_at) -> DataFrame:
    """Forecast rows of all three granularities, keyed by (period, horizon), ready for an upsert."""
    out = None
    days = cut_lineage(daily_sums(bookings))
    for granularity in GRAINS:
        rows = ridge_forecast(series_of(days, granularity), granularity)
        out = rows if out is None else out.unionByName(rows)
    return out.drop("series").withColumn("generated_at", F.lit(generated_at).cast("timestamp"))


def forecast_insight(forecast: DataFrame) -> DataFrame:
    """The forecast run as one sentence for the corpus."""
    facts = forecast.agg(
        F.max("generated_at").alias("at"),
        F.sum(F.when(F.col("horizon") == "monthly", F.col("forecast_idr"))).alias("year"),
        *[F.max(F.when(F.col("horizon") == g, F.col("model_mape_pct"))).alias(g) for g in GRAINS])
    text = F.format_string(
        "[Update: %s] Revenue projection for the next 12 months: Rp %.2f trillion. Out-of-time MAPE: monthly %.1f%%,"
        " weekly %.1f%%, daily %.1f%%.", F.date_format("at", "d MMMM yyyy"), F.col("year") / 1e12,
        "monthly", "weekly", "daily")
    return facts.select(F.lit("revenue_forecast").alias("id"), F.lit("forecast").alias("topic"), text.alias("text"))


def forecast_run(forecast: DataFrame) -> DataFrame:
    """One audit row: rows used, MAPE and whether naive was used, per horizon."""
    per = forecast.groupBy("horizon").agg(
        F.max("model_mape_pct").alias("mape"), F.max("used_naive").alias("naive"), F.max("rows_used").alias("n"),
        F.max("generated_at").alias("at"))
    return per.agg(
        F.lit("retrain_forecast").alias("job"), F.max("at").alias("ran_at"), F.max("n").alias("rows_used"),
        F.map_from_entries(F.collect_list(F.struct("horizon", "mape"))).alias("mape"),
        F.map_from_entries(F.collect_list(F.struct("horizon", "naive"))).alias("used_naive"))


def by_horizon(forecast: DataFrame, horizon: str) -> DataFrame:
    """Periods of one horizon with the total; yearly means the first twelve monthly rows; none is an error."""
    source = "monthly" if horizon == "yearly" else horizon
    rows = forecast.where(F.col("horizon") == source).orderBy("period")
    if rows.isEmpty():
        raise ValueError(f"the forecast table is empty for {source}")
    if horizon == "yearly":
        rows = rows.limit(12)
    total = rows.agg(F.sum(F.col("forecast_idr").cast("decimal(28,6)")).cast("double")).scalar()
    return rows.select(F.lit(horizon).alias("horizon"), "period", "forecast_idr", "model_mape_pct",
                       F.round(total, 2).alias("total_idr")).orderBy("period")
