"""Series, ridge, backtest, recursion and the resolver."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import bookings, pairs
from tidemark.operators import forecast as FC
from tidemark.operators import resolver as RS


def monthly(spark, months=60, noise=0.02, name="all"):
    rng = np.random.default_rng(1)
    rows, y, m = [], 2018, 1
    for t in range(months):
        value = (1000 + 10 * t) * (1 + 0.3 * np.sin(2 * np.pi * m / 12)) * (1 + noise * rng.standard_normal())
        rows.append((name, date(y, m, 1), float(value)))
        m, y = (1, y + 1) if m == 12 else (m + 1, y)
    return spark.createDataFrame(rows, "series string, period date, y double")


def test_series_fills_gaps_and_drops_the_last_period(spark):
    b = bookings(spark, [{"booking_date": "2024-01-10"}, {"booking_date": "2024-04-02", "status": "Confirmed"},
                         {"booking_date": "2024-05-01"}, {"booking_date": "2024-02-01", "status": "Cancelled"}])
    got = pairs(FC.revenue_series(b, "monthly").orderBy("period"), "period", "y")
    assert got == [(date(2024, 1, 1), 100.0), (date(2024, 2, 1), 0.0), (date(2024, 3, 1), 0.0), (date(2024, 4, 1), 100.0)]
    assert FC.revenue_series(b, "weekly").first()["period"] == date(2024, 1, 8)


def closed_form(pdf, granularity):
    """Weights, backtest error and recursive forecast of one series, from its gathered rows."""
    grain = FC.GRAINS[granularity]
    pdf = pdf.sort_values("period")
    y, index, s = pdf["y"].to_numpy(float), pd.DatetimeIndex(pdf["period"]), grain.season
    level_of = {"daily": lambda i: i.dayofweek, "weekly": lambda i: i.isocalendar().week, "monthly": lambda i: i.month}[granularity]
    levels = np.array([int(v) for v in level_of(index)])
    coded = np.unique(levels)[1:]
    row = lambda lag1, lag_s, t, level: np.array([lag1, lag_s, t, *(level == coded)], float)
    x = np.array([row(y[i - 1], y[i - s], i, levels[i]) for i in range(s, len(y))])
    cut = len(x) - grain.test_rows
    mean_x, mean_y = x[:cut].mean(axis=0), y[s:][:cut].mean()
    xc = x[:cut] - mean_x
    w = np.linalg.solve(xc.T @ xc + np.eye(x.shape[1]), xc.T @ (y[s:][:cut] - mean_y))
    b = mean_y - mean_x @ w
    test = y[s:][cut:] != 0
    mape = np.mean(np.abs((y[s:][cut:] - x[cut:] @ w - b) / y[s:][cut:])[test]) * 100
    step, history, out = {"daily": pd.offsets.Day(1), "weekly": pd.offsets.Day(7), "monthly": pd.offsets.MonthBegin(1)}[granularity], list(y), []
    for k in range(1, grain.horizon + 1):
        period = index[-1] + k * step
        history.append(row(history[-1], history[-s], len(history), int(level_of(pd.DatetimeIndex([period]))[0])) @ w + b)
        out.append((period.date(), max(history[-1], 0.0)))
    return dict(zip(["lag1", "lag_s", "t", *(f"period_{c}" for c in coded), "intercept"], [*w, b])), mape, out


@pytest.mark.parametrize("granularity, n", [("monthly", 70), ("weekly", 160), ("daily", 600)])
def test_models_of_many_series_equal_the_closed_form(spark, granularity, n):
    rng = np.random.default_rng(8)
    index = pd.date_range("2019-01-07" if granularity == "weekly" else "2019-01-01", periods=n, freq={"daily": "D", "weekly": "7D", "monthly": "MS"}[granularity])
    pdf = pd.concat([pd.DataFrame({"series": f"s{i}", "period": index.date, "y": 1e6 * (i + 1) * (50 + np.arange(n) / 9 + 9 * np.sin(np.arange(n)) + rng.standard_normal(n))}) for i in range(3)])
    series = spark.createDataFrame(pdf, "series string, period date, y double").repartition(5)
    weights = {}
    for r in FC.fit_ridge(series, granularity).collect():
        weights.setdefault(r["series"], {})[r["feature"]] = r["weight"]
    rows = {}
    for r in FC.ridge_forecast(series, granularity).orderBy("period").collect():
        rows.setdefault(r["series"], []).append(r)
    for name, own in pdf.groupby("series"):
        w, mape, ahead = closed_form(own, granularity)
        assert weights[name] == pytest.approx(w, rel=1e-5, abs=1e-3)
        assert [r["period"] for r in rows[name]] == [p for p, _ in ahead] and rows[name][0]["rows_used"] == n
        assert rows[name][0]["model_mape_pct"] == pytest.approx(mape, abs=0.01)
        if not rows[name][0]["used_naive"]:
            assert [r["forecast_idr"] for r in rows[name]] == pytest.approx([v for _, v in ahead], rel=1e-6)


def test_forecast_beats_naive_on_a_trend_and_is_recursive(spark):
    rows = FC.ridge_forecast(monthly(spark), "monthly").orderBy("period").collect()
    assert len(rows) == 12 and rows[0]["period"] == date(2023, 1, 1)
    assert not rows[0]["used_naive"] and rows[0]["model_mape_pct"] < rows[0]["naive_mape_pct"]
    assert all(r["forecast_idr"] >= 0 for r in rows)


def test_naive_wins_on_a_pure_season(spark):
    series = monthly(spark, noise=0.0).withColumn("y", F.month("period").cast("double") * 100)
    got = {r["period"]: r for r in FC.ridge_forecast(series, "monthly").collect()}
    assert all(r["used_naive"] and r["forecast_idr"] == p.month * 100 for p, r in got.items())
    assert pairs(FC.naive_backtest(series, "monthly"), "mape_naive") == [(0.0,)]


def test_naive_forecast_is_a_shift(spark):
    series = monthly(spark)
    last_year = dict(pairs(series.where("period >= '2022-01-01'"), "period", "y"))
    for p, v in pairs(FC.naive_forecast(series, "monthly"), "period", "forecast_idr"):
        assert v == last_year[date(p.year - 1, p.month, 1)]


def test_short_series_fail_or_are_listed(spark):
    short = monthly(spark, months=20)
    with pytest.raises(Exception, match="too few"):
        FC.ridge_forecast(short, "monthly").collect()
    both = short.withColumn("series", F.lit("short")).unionByName(monthly(spark, name="long"))
    assert {r[0] for r in FC.ridge_forecast(both, "monthly", on_short="skip").select("series").distinct().collect()} == {"long"}
    assert pairs(FC.short_series(both, "monthly"), "series") == [("short",)]


def test_zero_periods_are_counted_not_divided_by(spark):
    series = monthly(spark).withColumn("y", F.when(F.col("period") == "2022-12-01", 0.0).otherwise(F.col("y")))
    assert FC.naive_backtest(series, "monthly").first()["zero_rows"] == 1


def forecast_table(spark):
    rows = [(date(2024, m, 1), "monthly", 3100.0 if m in (7, 8) else 3000.0, 9.5) for m in range(7, 13)]
    return spark.createDataFrame(rows, "period date, horizon string, forecast_idr double, model_mape_pct double")


def daily_bookings(spark):
    start = date(2023, 1, 1)
    return bookings(spark, [{"booking_date": (start + timedelta(days=i)).isoformat(), "total_price_idr": 10.0 + (i % 3)} for i in range(560)])


def test_resolve_past_future_and_straddling(spark):
    b, f, today = daily_bookings(spark), forecast_table(spark), "2024-07-01"
    past, _ = RS.resolve(b, f, "2024-01-01", "2024-01-31", today)
    assert pairs(past, "kind", "contains_forecast") == [("actual", False)]
    future, periods = RS.resolve(b, f, "2024-07-01", "2024-08-15", today)
    row = future.first()
    assert row["kind"] == "forecast" and row["granularity_used"] == "monthly" and row["prorated_edges"] and not row["beyond_horizon"]
    assert row["total_idr"] == 3100 + 1500.0 and pairs(periods, "partial") == [(False,), (True,)]
    both, _ = RS.resolve(b, f, "2024-06-01", "2025-02-28", today)
    rows = {r["kind"]: r for r in both.collect()}
    assert set(rows) == {"actual", "forecast"} and rows["forecast"]["beyond_horizon"] and rows["forecast"]["covered_until"] == date(2024, 12, 31)
    assert rows["actual"]["grand_total_idr"] == round(rows["actual"]["total_idr"] + rows["forecast"]["total_idr"], 2)
    with pytest.raises(ValueError):
        RS.resolve(b, f, "2024-02-01", "2024-01-01", today)


def test_resolve_is_additive_over_actuals(spark):
    b, f = daily_bookings(spark), forecast_table(spark)
    total = lambda a, z: RS.resolve(b, f, a, z, "2024-07-01")[0].first()["total_idr"]
    assert total("2024-01-01", "2024-03-31") == total("2024-01-01", "2024-02-10") + total("2024-02-11", "2024-03-31")


def test_empty_forecast_table_is_an_error(spark):
    with pytest.raises(Exception, match="empty"):
        RS.resolve(daily_bookings(spark), forecast_table(spark).where("false"), "2024-07-01", "2024-07-31", "2024-07-01")[0].collect()
    with pytest.raises(ValueError, match="empty"):
        FC.by_horizon(forecast_table(spark).where("false"), "monthly")
    yearly = FC.by_horizon(forecast_table(spark), "yearly").collect()
    assert len(yearly) == 6 and {r["total_idr"] for r in yearly} == {18200.0}


def test_ranges_table_equals_one_by_one(spark):
    f = forecast_table(spark)
    requests = [(i, date(2024, 7, 1) + timedelta(days=i * 9), date(2024, 7, 1) + timedelta(days=i * 9 + i * 11), "monthly") for i in range(9)]
    got = {r["request_id"]: r for r in RS.forecast_for_ranges(
        spark.createDataFrame(requests, "request_id int, start date, end date, horizon string"), f).collect()}
    rows = f.collect()
    for i, start, end, _ in requests:
        want = 0.0
        for r in rows:
            last = (r["period"].replace(day=28) + timedelta(days=4)).replace(day=1) - timedelta(days=1)
            days = (min(last, end) - max(r["period"], start)).days + 1
            want += r["forecast_idr"] * max(days, 0) / last.day
        assert got[i]["total_idr"] == pytest.approx(want, abs=0.01)


def test_train_job_outputs(spark):
    start = date(2021, 1, 1)
    b = bookings(spark, [{"booking_date": (start + timedelta(days=i)).isoformat(), "total_price_idr": 100.0 + i % 7 * 10 + i / 20}
                         for i in range(1100)])
    rows = FC.train_forecasts(b, "2024-01-06")
    assert dict(pairs(rows.groupBy("horizon").count(), "horizon", "count")) == {"daily": 30, "weekly": 12, "monthly": 12}
    assert "MAPE" in FC.forecast_insight(rows).first()["text"]
    assert set(FC.forecast_run(rows).first()["mape"]) == {"daily", "weekly", "monthly"}


def test_ranges_without_a_forecast_are_returned(spark):
    f = forecast_table(spark)
    rows = [(1, date(1990, 1, 1), date(1990, 2, 1), "monthly"), (2, date(2024, 8, 1), date(2030, 1, 1), "monthly"), (3, date(2024, 8, 1), date(2024, 8, 31), "monthly")]
    got = {r["request_id"]: r for r in RS.forecast_for_ranges(spark.createDataFrame(rows, "request_id int, start date, end date, horizon string"), f).collect()}
    assert (got[1]["periods"], got[1]["total_idr"], got[1]["partial"], got[1]["beyond_horizon"]) == (0, 0.0, False, True)
    assert got[2]["beyond_horizon"] and got[2]["total_idr"] > 0 and not got[3]["beyond_horizon"]
