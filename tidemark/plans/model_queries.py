"""Churn, segmentation, forecast and resolver queries over the supplied tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.functions import semantics as S
from tidemark.operators import churn as H
from tidemark.operators import clusters as K
from tidemark.operators import forecast as FC
from tidemark.operators import resolver as RS
from tidemark.plans.kpi_queries import COMMIT, COMMIT_PAID, money, span
from tidemark.plans.registry import query
from tidemark.plans.session import cut_lineage, shared_base
from tidemark.sources import driver_tables as T
from tidemark.sources import sinks
from tidemark.sources.driver_tables import oracle

SNAPSHOT = "2000-06-30"
AS_OF = "2000-07-10"
REVIEW_SNAPSHOT = "2024-01-20"


def elapsed(a: str, b: str) -> str:
    return f"CAST(floor((epoch_us({a}) - epoch_us({b})) / 86400000000) AS INT)"


_SNAP = f"TIMESTAMP '{SNAPSHOT} 00:00:00'"


def base_sql(extra: str = "") -> str:
    """Booking features at the snapshot; `extra` adds aggregates and widens the scan."""
    valid = f"{COMMIT} AND booking_date <= DATE '{SNAPSHOT}'"
    avg_money = f"CAST(sum(CAST(total_price_idr AS DECIMAL(18,2))) FILTER ({valid}) AS DOUBLE) / count(*) FILTER ({valid})"
    return f"""
      SELECT *, {elapsed(_SNAP, 'last_booking')} AS recency_days, {elapsed(_SNAP, 'first_booking')} AS tenure_days,
        CASE WHEN frequency > 1 THEN {elapsed('last_booking', 'first_booking')} / (frequency - 1) END AS avg_interval,
        {elapsed(_SNAP, 'last_booking')} / nullif(CASE WHEN frequency > 1 THEN
          {elapsed('last_booking', 'first_booking')} / (frequency - 1) END, 0) AS recency_ratio,
        CASE WHEN frequency = 1 THEN 'single' ELSE 'repeat' END AS track
      FROM (SELECT customer_id, max(booking_date) FILTER ({valid}) AS last_booking,
        min(booking_date) FILTER ({valid}) AS first_booking, count(*) FILTER ({valid}) AS frequency,
        {money(where=valid)} AS monetary_total, {avg_money} AS monetary_avg,
        avg(pax_count) FILTER ({valid}) AS pax_avg, avg(nights) FILTER ({valid}) AS nights_avg,
        coalesce(avg(CAST(status = 'Cancelled' AS INT)) FILTER (booking_date <= DATE '{SNAPSHOT}'), 0) AS cancel_rate
        {extra} FROM bookings GROUP BY 1) WHERE frequency > 0"""


_RETURNED = (f", coalesce(bool_or({COMMIT} AND booking_date > DATE '{SNAPSHOT}' "
             f"AND booking_date <= DATE '{SNAPSHOT}' + INTERVAL 365 DAY), false) AS returned")
_REVIEWED = f"""
  SELECT customer_id, arg_max(rating, (review_date, review_id)) AS review_rating,
    arg_max(sentiment, (review_date, review_id)) AS review_sentiment, avg(value_for_money) AS aspect_value
  FROM reviews WHERE review_date <= DATE '{REVIEW_SNAPSHOT}' GROUP BY 1"""
_RFM_COLUMNS = ("customer_id, last_booking, first_booking, frequency, monetary_total, monetary_avg, pax_avg, nights_avg, "
                "recency_days, tenure_days, avg_interval, recency_ratio, track")

query("rfm_features", oracle("bookings", f"SELECT {_RFM_COLUMNS} FROM ({base_sql()})"))(
    lambda spark, sf: H.rfm(T.bookings(spark, sf), SNAPSHOT))

query("cancel_rate", oracle("bookings", f"""
  SELECT customer_id, avg(CAST(status = 'Cancelled' AS INT)) AS cancel_rate FROM bookings
  WHERE booking_date <= DATE '{SNAPSHOT}' GROUP BY 1"""))(
    lambda spark, sf: H.cancel_rate(T.bookings(spark, sf), SNAPSHOT))

query("last_review_features", oracle("reviews", _REVIEWED))(
    lambda spark, sf: H.review_features(T.reviews(spark, sf), REVIEW_SNAPSHOT))

query("profile_features", oracle("customers", "SELECT customer_id, age, segment, acquisition_channel FROM customers"))(
    lambda spark, sf: H.profile_features(T.customers(spark, sf)))


def moved_reviews(spark, sf):
    """The review events lie in 2024; the bookings end before, so the reviews are moved back 25 years."""
    return T.reviews(spark, sf).withColumn("review_date", F.col("review_date") - F.expr("INTERVAL 25 YEARS"))


def features(spark, sf, label_days=None, null_policy="keep"):
    """Features at the booking snapshot."""
    return H.churn_features(T.bookings(spark, sf), moved_reviews(spark, sf), T.customers(spark, sf), SNAPSHOT, label_days, null_policy)


_ALL_REVIEWED = _REVIEWED.replace(f" WHERE review_date <= DATE '{REVIEW_SNAPSHOT}'", "")
_FEATURES = f"""
  SELECT b.* EXCLUDE (returned), review_rating, coalesce(review_sentiment, 'No Review') AS review_sentiment, aspect_value,
    CAST(review_rating IS NOT NULL AS INT) AS has_review, age, segment, acquisition_channel, returned,
    CAST(NOT returned AND coalesce(recency_days + 365 > 3 * avg_interval, true) AS INT) AS label
  FROM ({base_sql(_RETURNED)}) b LEFT JOIN ({_ALL_REVIEWED}) v USING (customer_id) LEFT JOIN customers c USING (customer_id)"""

query("churn_features", oracle("bookings reviews customers", f"SELECT * EXCLUDE (returned, label) FROM ({_FEATURES})"))(
    lambda spark, sf: features(spark, sf))


def _aligned_sql() -> str:
    out = ["customer_id", "track"] + [f"CAST({c} AS DOUBLE) AS {c}" for c in H.NUMERIC]
    for c, values in H.CATEGORIES.items():
        out += [f"""coalesce(CAST({c} = '{v}' AS INT), 0) AS "{c}_{v}\"""" for v in values]
    return f"SELECT {', '.join(out)} FROM ({_FEATURES})"


query("align_features", oracle("bookings reviews customers", _aligned_sql()))(
    lambda spark, sf: H.align_features(features(spark, sf)))

query("unseen_categories", oracle("bookings reviews customers", f"""
  SELECT 'acquisition_channel' AS feature, acquisition_channel AS value, count(*) AS customers FROM ({_FEATURES})
  WHERE acquisition_channel = 'Radio' GROUP BY 1, 2"""))(lambda spark, sf: H.unseen_categories(features(spark, sf)))

query("churn_labels", oracle("bookings reviews customers", f"""
  SELECT customer_id, frequency, recency_days, avg_interval, returned, label FROM ({_FEATURES})"""))(
    lambda spark, sf: H.churn_labels(T.bookings(spark, sf), SNAPSHOT))

_HASH = "CAST('0x' || substr(md5(customer_id || ':42'), 1, 15) AS BIGINT)"

query("stratified_split", oracle("bookings reviews customers", f"""
  SELECT customer_id, label, row_number() OVER (PARTITION BY label ORDER BY {_HASH})
    <= ceil(count(*) OVER (PARTITION BY label) * 0.2) AS is_test FROM ({_FEATURES})"""))(
    lambda spark, sf: H.stratified_split(
        H.churn_labels(T.bookings(spark, sf), SNAPSHOT).select("customer_id", "label")).select("customer_id", "label", "is_test"))

# Exact rank AUC of a plain score: recency over the churn label.
query("evaluate_auc", oracle("bookings reviews customers", f"""
  SELECT track, CAST(sum(label) AS BIGINT) AS positives, CAST(sum(1 - label) AS BIGINT) AS negatives,
    round((sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2)
      / (sum(label) * sum(1 - label)), 6) AS auc
  FROM (SELECT track, label, rank() OVER w + (count(*) OVER (PARTITION BY track, s) - 1) / 2 AS r FROM (
      SELECT track, label, recency_days / 4000 + frequency / 7 AS s FROM ({_FEATURES}))
    WINDOW w AS (PARTITION BY track ORDER BY s)) GROUP BY 1"""))(
    lambda spark, sf: H.auc(
        features(spark, sf, 365).transform(H.with_label).withColumn("churn_proba", F.col("recency_days") / 4000 + F.col("frequency") / 7), by="track"))


#: Where the model of an application and a folder is stored, so that it is trained once.
_TRAINED: dict[tuple[str, str], str] = {}


def _scored(spark, sf):
    """The model and the rows it was trained and is tested on, written by the first query that needs them."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TRAINED:
        base = f"{shared_base(spark).rstrip('/')}/churn-{uuid4().hex}"
        labelled = H.with_label(features(spark, sf, 365, H.NULL_POLICY))
        H.stratified_split(cut_lineage(H.align_features(labelled))).write.parquet(f"{base}/rows")
        H.train_churn(spark.read.parquet(f"{base}/rows")).write().save(f"{base}/model")
        _TRAINED[key] = base
    return PipelineModel.load(f"{_TRAINED[key]}/model"), spark.read.parquet(f"{_TRAINED[key]}/rows")


_SPLIT = f"""SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_HASH}) <= ceil(count(*) OVER (PARTITION BY label) * 0.2) AS is_test
  FROM ({_FEATURES})"""


@query("train_churn", oracle("bookings reviews customers", f"""
  SELECT track, CAST(sum(label) AS BIGINT) AS positives, CAST(sum(1 - label) AS BIGINT) AS negatives, true AS auc_in_range, true AS as_good_as_recency
  FROM ({_SPLIT}) WHERE is_test GROUP BY 1"""))
def _train(spark, sf):
    """The held-out rows of each track, and whether the model ranks them all at least as well as recency alone does."""
    model, aligned = _scored(spark, sf)
    held = aligned.where("is_test")
    scored = H.score(model, held, keep=("label",))
    plain = H.auc(held.withColumn("churn_proba", F.col("recency_days").cast("double"))).select("auc").scalar()
    whole = H.auc(scored).select("auc").scalar()
    return H.auc(scored, by="track").select("track", "positives", "negatives", F.col("auc").between(0, 1).alias("auc_in_range"), (whole >= plain).alias("as_good_as_recency"))


def _bucket_fits():
    """The bucket is that of the stored probability, unless rounding put that on a border."""
    edge = F.round(F.col("churn_proba") * 4) / 4
    return (S.risk_bucket(F.col("churn_proba")) == F.col("risk_bucket")) | (F.abs(F.col("churn_proba") - edge) < 1e-4)


@query("rescore_all", oracle("bookings", f"""
  SELECT customer_id, track, monetary_total, tenure_days, TIMESTAMP '{SNAPSHOT}' AS scored_at, true AS in_range, true AS bucket_fits
  FROM ({base_sql()})"""))
def _rescore(spark, sf):
    model, _ = _scored(spark, sf)
    rows = H.rescore_all(model, T.bookings(spark, sf), moved_reviews(spark, sf), T.customers(spark, sf), SNAPSHOT)
    return rows.select("customer_id", "track", "monetary_total", "tenure_days", F.col("scored_at").cast("timestamp_ntz").alias("scored_at"),
                       F.col("churn_proba").between(0, 1).alias("in_range"), _bucket_fits().alias("bucket_fits"))


# Three runs: the first is deployed, a better champion keeps its place, an even worse one loses it.
@query("champion_gate", oracle("bookings reviews customers", f"""
  SELECT 'retrain_churn' AS job, '{SNAPSHOT}' AS snapshot, count(*) AS population, round(avg(label), 4) AS churn_rate, true AS auc_in_range, run,
    run = 'first' AS no_champion, run <> 'refused' AS deployed FROM ({_FEATURES}), (SELECT unnest(['first', 'refused', 'replaced']) AS run) GROUP BY run"""))
def _gate(spark, sf):
    tables = (T.bookings(spark, sf), moved_reviews(spark, sf), T.customers(spark, sf))
    model, rows = H.retrained_rows(*tables, "2001-06-30")
    first, _ = H.gated(model, rows, "2001-06-30")
    out = first.withColumn("run", F.lit("first"))
    for run, champion in (("refused", F.lit(1.0)), ("replaced", F.col("auc") - 0.2)):
        runs = first.withColumn("auc", champion)
        out = out.unionByName(H.gated(model, rows, "2001-06-30", runs)[0].withColumn("run", F.lit(run)))
    return out.select("job", "snapshot", "population", "churn_rate", F.col("auc").between(0, 1).alias("auc_in_range"), "run",
                      F.col("prev_auc").isNull().alias("no_champion"), "deployed")


def _score_run(spark, sf):
    """A run record whose AUC is that of the plain recency score."""
    scored = cut_lineage(features(spark, sf, 365).transform(H.with_label).withColumn("churn_proba", F.col("recency_days") / 4000).select("track", "label", "churn_proba"))
    quality = H.auc(scored, by="track").agg(F.map_from_entries(F.collect_list(F.struct("track", "auc"))).alias("m")).scalar()
    overall = H.auc(scored).select("auc").scalar()
    return scored.agg(F.count(F.lit(1)).alias("population"), F.round(F.avg("label"), 4).alias("churn_rate")).select(
        "population", "churn_rate", quality.alias("auc_by_track"), F.round(overall, 4).alias("auc"),
        F.lit(SNAPSHOT).alias("ran_at"), F.lit(True).alias("deployed"))


def _auc_sql(by: str) -> str:
    return f"""
      SELECT track, round((sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2)
        / (sum(label) * sum(1 - label)), 6) AS auc
      FROM (SELECT track, label, rank() OVER w + (count(*) OVER (PARTITION BY track, s) - 1) / 2 AS r FROM (
        SELECT {by} AS track, label, round(recency_days / 4000, 4) AS s FROM ({_FEATURES}))
      WINDOW w AS (PARTITION BY track ORDER BY s)) GROUP BY 1"""


query("churn_overview_insight", oracle("bookings reviews customers", f"""
  SELECT 'churn_model_overview' AS id, 'churn' AS topic,
    format('[Update: {SNAPSHOT}] Churn model replaced: AUC {{:.3f}} (single {{:.3f}}, repeat {{:.3f}}), churn rate {{:.1f}}% of {{:,}} customers.',
      round((SELECT auc FROM ({_auc_sql("'all'")})), 4), (SELECT auc FROM ({_auc_sql('track')}) WHERE track = 'single'),
      (SELECT auc FROM ({_auc_sql('track')}) WHERE track = 'repeat'), round(avg(label), 4) * 100, count(*)) AS text
  FROM ({_FEATURES})"""))(lambda spark, sf: H.overview_insight(_score_run(spark, sf)))


@query("predict_churn", oracle("customers bookings", f"""
  SELECT customer_id, h.customer_id IS NOT NULL AS has_history, CASE WHEN h.customer_id IS NOT NULL THEN true END AS as_rescored
  FROM customers c LEFT JOIN (SELECT customer_id FROM ({base_sql()})) h USING (customer_id) WHERE segment = 'Gold'"""))
def _predict(spark, sf):
    """The wanted customers, and whether each is scored as in the score table."""
    model, _ = _scored(spark, sf)
    tables = (T.bookings(spark, sf), moved_reviews(spark, sf), T.customers(spark, sf))
    ids = T.customers(spark, sf).where("segment = 'Gold'").select("customer_id")
    scored, missing = H.predict_churn(model, ids, *tables, SNAPSHOT)
    table = H.rescore_all(model, *tables, SNAPSHOT).select("customer_id", F.col("churn_proba").alias("p"), F.col("risk_bucket").alias("b"))
    same = (F.col("churn_proba") == F.col("p")) & (F.col("risk_bucket") == F.col("b"))
    return scored.join(table, "customer_id", "left").select("customer_id", F.lit(True).alias("has_history"), F.coalesce(same, F.lit(False)).alias("as_rescored")).unionByName(
        missing.select("customer_id", F.lit(False).alias("has_history"), F.lit(None).cast("boolean").alias("as_rescored")))


query("ids_without_history", oracle("customers bookings", f"""
  SELECT customer_id FROM customers WHERE customer_id NOT IN (
    SELECT customer_id FROM bookings WHERE {COMMIT} AND booking_date <= DATE '{SNAPSHOT}')"""))(
    lambda spark, sf: T.customers(spark, sf).select("customer_id").join(
        H.booking_features(T.bookings(spark, sf), SNAPSHOT).select("customer_id"), "customer_id", "left_anti"))


@query("customer_clusters", oracle("bookings", f"SELECT customer_id, true AS nearest FROM ({base_sql()})"))
def _clusters(spark, sf):
    """Every customer lies nearest to the centre of the own cluster."""
    rows = H.rfm(T.bookings(spark, sf), SNAPSHOT)
    model = K.fit_clusters(rows)
    at = vector_to_array("features")
    away = [F.aggregate(F.zip_with(at, F.array(*map(F.lit, map(float, c))), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
            for c in model.stages[-1].clusterCenters()]
    return model.transform(K.log_rfm(rows)).select("customer_id", (F.get(F.array(*away), F.col("cluster")) <= F.least(*away) + 1e-9).alias("nearest"))


# The profile is checked on a fixed grouping; cluster numbers of k-means have no SQL form.
query("cluster_profile", oracle("bookings", f"""
  SELECT cluster, count(*) AS customers, avg(CAST(track = 'single' AS INT)) AS single_share,
    round(quantile_cont(monetary_total, 0.5), 4) AS median_spend_idr,
    round(quantile_cont(recency_days, 0.5), 4) AS median_recency_days
  FROM (SELECT *, least(frequency, 5) AS cluster FROM ({base_sql()})) GROUP BY 1"""))(
    lambda spark, sf: K.cluster_profile(H.rfm(T.bookings(spark, sf), SNAPSHOT).withColumn(
        "cluster", F.least("frequency", F.lit(5)))))

query("due_to_return_score", oracle("bookings", f"""
  SELECT customer_id, frequency, recency_days, round(avg_interval, 6) AS avg_interval,
    round(exp(-0.5 * z * z) + 1e-6, 6) AS weight
  FROM (SELECT *, (recency_days - avg_interval) / greatest(avg_interval, 30) AS z FROM ({base_sql()}) WHERE frequency > 1)"""))(
    lambda spark, sf: H.due_to_return(T.bookings(spark, sf), SNAPSHOT))

query("customer_rollup", oracle("bookings customers", f"""
  SELECT customer_id, coalesce(n, 0) AS total_trips, coalesce(s, 0.0) AS total_spent_idr, d AS last_purchase_date,
    coalesce(n > 1, false) AS is_repeat_customer FROM customers LEFT JOIN (
      SELECT customer_id, count(*) AS n, {money()} AS s, max(booking_date) AS d FROM bookings WHERE {COMMIT} GROUP BY 1)
    USING (customer_id)"""))(
    lambda spark, sf: sinks.with_rollup(T.customers(spark, sf), sinks.customer_rollup(T.bookings(spark, sf))).select(
        "customer_id", "total_trips", "total_spent_idr", "last_purchase_date", "is_repeat_customer"))

# ---- forecasts -------------------------------------------------------------

_STEP = {"daily": "INTERVAL 1 DAY", "weekly": "INTERVAL 7 DAY", "monthly": "INTERVAL 1 MONTH"}
_UNIT = {"daily": "day", "weekly": "week", "monthly": "month"}


def series_sql(g: str, until: str | None = None) -> str:
    cut = f" AND booking_date < DATE '{until}'" if until else ""
    return f"""
      SELECT 'all' AS series, CAST(p AS DATE) AS period, coalesce(y, 0.0) AS y FROM (
        SELECT unnest(generate_series(min(m), max(m) - {_STEP[g]}, {_STEP[g]})) AS p FROM (
          SELECT CAST(date_trunc('{_UNIT[g]}', booking_date) AS TIMESTAMP) AS m FROM bookings WHERE {COMMIT_PAID}{cut})) c
      LEFT JOIN (SELECT CAST(date_trunc('{_UNIT[g]}', booking_date) AS TIMESTAMP) AS p, {money()} AS y FROM bookings
        WHERE {COMMIT_PAID}{cut} GROUP BY 1) s USING (p)"""


def lags_sql(g: str, until: str | None = None) -> str:
    return f"""
      SELECT *, lag(y, 1) OVER w AS lag1, lag(y, {FC.GRAINS[g].season}) OVER w AS lag_s,
        CAST(row_number() OVER w - 1 AS INT) AS t, CAST(row_number() OVER (PARTITION BY series ORDER BY period DESC) AS INT) AS from_end
      FROM ({series_sql(g, until)}) WINDOW w AS (PARTITION BY series ORDER BY period)"""


def backtest_sql(g: str, until: str | None = None) -> str:
    return f"""
      SELECT series, '{g}' AS horizon, round(avg(round(abs((y - lag_s) / nullif(y, 0)), 9)) * 100, 2) AS mape_naive,
        count(*) FILTER (y = 0) AS zero_rows FROM ({lags_sql(g, until)})
      WHERE from_end <= {FC.GRAINS[g].test_rows} GROUP BY 1"""


def naive_sql(g: str, until: str | None = None) -> str:
    grain = FC.GRAINS[g]
    shift = {"daily": "INTERVAL 364 DAY", "weekly": "INTERVAL 364 DAY", "monthly": "INTERVAL 12 MONTH"}[g]
    return f"""
      SELECT series, CAST(period + {shift} AS DATE) AS period, '{g}' AS horizon, greatest(y, 0.0) AS forecast_idr
      FROM ({lags_sql(g, until)}) WHERE from_end <= {grain.season} AND from_end > {grain.season - grain.horizon}"""


FORECAST_SQL = " UNION ALL ".join(
    f"SELECT period, f.horizon, forecast_idr, mape_naive AS model_mape_pct FROM ({naive_sql(g, AS_OF)}) f "
    f"JOIN ({backtest_sql(g, AS_OF)}) b USING (series)" for g in FC.GRAINS)

for _g in FC.GRAINS:
    _suffix = "" if _g == "monthly" else f"_{_g}"
    query("revenue_series" + _suffix, oracle("bookings", series_sql(_g)))(
        lambda spark, sf, g=_g: FC.revenue_series(T.bookings(spark, sf), g))
    query("backtest_mape_naive" + _suffix, oracle("bookings", backtest_sql(_g)))(
        lambda spark, sf, g=_g: FC.naive_backtest(FC.revenue_series(T.bookings(spark, sf), g), g))
    query("naive_forecast" + _suffix, oracle("bookings", naive_sql(_g)))(
        lambda spark, sf, g=_g: FC.naive_forecast(FC.revenue_series(T.bookings(spark, sf), g), g))

query("series_features", oracle("bookings", f"""
  SELECT series, period, y, lag1, lag_s, t, from_end, {', '.join(
      f"CAST(month(period) = {m} AS INT) AS period_{m}" for m in range(2, 13))}
  FROM ({lags_sql('monthly')}) WHERE lag_s IS NOT NULL"""))(
    lambda spark, sf: FC.series_features(FC.revenue_series(T.bookings(spark, sf), "monthly"), "monthly"))


_MONTHS = ", ".join(f"'period_{m}'" for m in range(2, 13))


# Level of a period (as a number), and the levels after the first.
_LEVEL = {"monthly": ("month({0})", (2, 13)), "weekly": ("weekofyear({0})", (2, 54)), "daily": ("isodow({0}) - 1", (1, 7))}
_PANEL = f"""SELECT series, CAST(p AS DATE) AS period, coalesce(y, 0.0) AS y FROM (
    SELECT series, unnest(generate_series(min(p), max(p) - INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS p FROM sums GROUP BY 1) LEFT JOIN sums USING (series, p)"""
_PANEL_SUMS = f"""SELECT coalesce(nullif(destination_name, ''), 'Unknown') AS series, CAST(date_trunc('month', booking_date) AS TIMESTAMP) AS p, {money()} AS y
    FROM bookings WHERE {COMMIT_PAID} GROUP BY 1, 2"""


def ridge_ctes(series: str, g: str, p: str = "") -> dict[str, str]:
    """Ridge models of all series, solved by Gauss-Jordan elimination of the centred normal equations, and what follows from
    them; names begin with p.  `solved` and `steps` rest on recursive tables."""
    grain, (level, (low, high)) = FC.GRAINS[g], _LEVEL[g]
    d = 3 + high - low
    dummies = lambda period: f"list_transform(range({low}, {high}), lambda q: CAST({level.format(period)} = q AS DOUBLE))"
    later = f"last + CAST(s.k + 1 AS INT) * {_STEP[g]}"
    return {
        f"{p}panel": series,
        f"{p}lagged": f"""SELECT *, lag(y, 1) OVER w AS lag1, lag(y, {grain.season}) OVER w AS lag_s, row_number() OVER w - 1 AS t,
            row_number() OVER (PARTITION BY series ORDER BY period DESC) AS from_end, count(*) OVER (PARTITION BY series) AS n
          FROM {p}panel WINDOW w AS (PARTITION BY series ORDER BY period)""",
        f"{p}x": f"SELECT *, [lag1, lag_s, CAST(t AS DOUBLE)] || {dummies('period')} AS v FROM {p}lagged WHERE lag_s IS NOT NULL AND n - {grain.season} >= {3 * grain.test_rows}",
        f"{p}cells": f"SELECT series, t, y, i, v[i] AS v FROM (SELECT *, unnest(range(1, {d + 1})) AS i FROM {p}x WHERE from_end > {grain.test_rows})",
        f"{p}centred": f"SELECT *, v - avg(v) OVER (PARTITION BY series, i) AS c, y - avg(y) OVER (PARTITION BY series, i) AS z FROM {p}cells",
        f"{p}gram": f"""SELECT series, i, list(s ORDER BY j) AS r FROM (
          SELECT a.series, a.i, b.i AS j, sum(a.c * b.c) + CASE WHEN a.i = b.i THEN 1.0 ELSE 0.0 END AS s FROM {p}centred a JOIN {p}centred b USING (series, t) GROUP BY 1, 2, 3) GROUP BY 1, 2""",
        f"{p}rhs": f"SELECT series, i, sum(c * z) AS s FROM {p}centred GROUP BY 1, 2",
        f"{p}matrix": f"SELECT series, list(r || [s] ORDER BY i) AS m FROM {p}gram JOIN {p}rhs USING (series, i) GROUP BY 1",
        f"{p}elimination": f"""SELECT series, 1 AS k, m FROM {p}matrix UNION ALL
          SELECT series, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / r[k]) ELSE list_transform(r, lambda v, j: v - r[k] / m[k][k] * m[k][j]) END)
          FROM {p}elimination WHERE k <= {d}""",
        f"{p}solved": f"SELECT series, list_transform(m, lambda r: r[{d + 1}]) AS w FROM {p}elimination WHERE k = {d + 1}",
        f"{p}means": f"SELECT series, list(a ORDER BY i) AS a, any_value(b) AS b FROM (SELECT series, i, avg(v) AS a, avg(y) AS b FROM {p}cells GROUP BY 1, 2) GROUP BY 1",
        f"{p}models": f"SELECT series, w, b - list_inner_product(a, w) AS intercept FROM {p}solved JOIN {p}means USING (series)",
        f"{p}errors": f"""SELECT series, avg(abs((y - intercept - list_inner_product(v, w)) / y)) * 100 AS model, avg(abs((y - lag_s) / y)) * 100 AS naive
          FROM {p}x JOIN {p}models USING (series) WHERE from_end <= {grain.test_rows} AND y <> 0 GROUP BY 1""",
        f"{p}tail": f"SELECT series, {grain.season} - from_end + 1 AS k, y AS lag_s FROM {p}lagged WHERE from_end <= {grain.season} AND from_end > {grain.season - grain.horizon}",
        f"{p}steps": f"""SELECT series, 0 AS k, period AS last, y AS value, n, NOT coalesce(model < naive, false) AS used_naive, round(model, 2) AS model, round(naive, 2) AS naive
            FROM {p}lagged JOIN {p}errors USING (series) WHERE from_end = 1 UNION ALL
          SELECT s.series, s.k + 1, last, CASE WHEN used_naive THEN lag_s ELSE intercept + list_inner_product([s.value, lag_s, CAST(n + s.k AS DOUBLE)] || {dummies(later)}, w) END,
            n, used_naive, model, naive
          FROM {p}steps s JOIN {p}tail t ON t.series = s.series AND t.k = s.k + 1 JOIN {p}models m ON m.series = s.series""",
    }


def recursive(body: str, **extra: str) -> str:
    return oracle("bookings", body, **extra).replace("WITH ", "WITH RECURSIVE ", 1)


_MONTHLY_PANEL = {"sums": _PANEL_SUMS, **ridge_ctes(_PANEL, "monthly")}
query("fit_ridge", recursive(f"""SELECT series, f[i] AS feature, round(CASE WHEN i <= 14 THEN w[i] ELSE intercept END, 3) AS weight FROM (
  SELECT *, ['lag1', 'lag_s', 't', {_MONTHS}, 'intercept'] AS f, unnest(range(1, 16)) AS i FROM models)""", **_MONTHLY_PANEL))(
    lambda spark, sf: FC.fit_ridge(FC.revenue_series(T.bookings(spark, sf, destination=True), "monthly", "destination_name"), "monthly").withColumn("weight", F.round("weight", 3)))


_NEXT = {"daily": "INTERVAL 1 DAY", "weekly": "INTERVAL 7 DAY", "monthly": "INTERVAL 1 MONTH"}


def _whole_forecast(g: str, p: str) -> str:
    return (f"SELECT '{g}' AS horizon, CAST(last + CAST(k AS INT) * {_NEXT[g]} AS DATE) AS period, n AS rows_used, model AS model_mape_pct, naive AS naive_mape_pct, used_naive, "
            f"round(greatest(value, 0.0), 0) AS forecast_idr FROM {p}steps WHERE k > 0")


def _shown_forecast(rows):
    return rows.select("horizon", "period", "rows_used", "model_mape_pct", "naive_mape_pct", "used_naive", F.round("forecast_idr", 0).alias("forecast_idr"))


query("forecast_recursive", recursive(_whole_forecast("monthly", ""), **ridge_ctes(series_sql("monthly"), "monthly")))(
    lambda spark, sf: _shown_forecast(FC.ridge_forecast(FC.revenue_series(T.bookings(spark, sf), "monthly"), "monthly")))
query("train_forecasts", recursive(" UNION ALL ".join(_whole_forecast(g, g[0] + "_") for g in FC.GRAINS), **{
    k: v for g in FC.GRAINS for k, v in ridge_ctes(series_sql(g), g, g[0] + "_").items()}))(
    lambda spark, sf: _shown_forecast(FC.train_forecasts(T.bookings(spark, sf), "2001-08-02")))
query("forecast_panel", recursive("""SELECT series, CAST(last + to_months(CAST(k AS INT)) AS DATE) AS period, 'monthly' AS horizon, round(greatest(value, 0.0), 1) AS forecast_idr,
  model AS model_mape_pct, naive AS naive_mape_pct, used_naive, n AS rows_used FROM steps WHERE k > 0""", **_MONTHLY_PANEL))(
    lambda spark, sf: FC.forecast_panel(T.bookings(spark, sf, destination=True), "destination_name").withColumn("forecast_idr", F.round("forecast_idr", 1)))
query("forecast_insight", recursive("""
  SELECT 'revenue_forecast' AS id, 'forecast' AS topic, printf('[Update: 2 August 2001] Revenue projection for the next 12 months: Rp %.2f trillion. Out-of-time MAPE: monthly %.1f%%, weekly %.1f%%, daily %.1f%%.',
    (SELECT sum(greatest(value, 0.0)) FROM m_steps WHERE k > 0) / 1e12, round((SELECT max(model) FROM m_steps), 1), round((SELECT max(model) FROM w_steps), 1), round((SELECT max(model) FROM d_steps), 1)) AS text""",
    **ridge_ctes(series_sql("monthly"), "monthly", "m_"), **ridge_ctes(series_sql("weekly"), "weekly", "w_"), **ridge_ctes(series_sql("daily"), "daily", "d_")))(
    lambda spark, sf: FC.forecast_insight(FC.train_forecasts(T.bookings(spark, sf), "2001-08-02")))
query("forecast_run", oracle("bookings", f"""
  SELECT 'retrain_forecast' AS job, TIMESTAMP '2001-08-02' AS ran_at, n AS rows_used, 3 AS horizons, true AS complete FROM (
    SELECT greatest({', '.join(f"(SELECT count(*) FROM ({series_sql(g)}))" for g in FC.GRAINS)}) AS n)"""))(
    lambda spark, sf: FC.forecast_run(FC.train_forecasts(T.bookings(spark, sf), "2001-08-02")).select(
        "job", F.col("ran_at").cast("timestamp_ntz").alias("ran_at"), "rows_used", F.size("mape").alias("horizons"),
        (F.array_size(F.map_keys("used_naive")) == F.size("mape")).alias("complete")))

query("forecast_table", oracle("bookings", FORECAST_SQL))(
    lambda spark, sf: FC.naive_table(T.bookings(spark, sf), AS_OF).drop("generated_at"))

query("forecast_by_horizon", oracle("bookings", f"""
  SELECT 'yearly' AS horizon, period, forecast_idr, model_mape_pct,
    round(CAST(sum(CAST(forecast_idr AS DECIMAL(28,6))) OVER () AS DOUBLE), 2) AS total_idr
  FROM ({FORECAST_SQL}) WHERE horizon = 'monthly'"""))(
    lambda spark, sf: FC.by_horizon(FC.naive_table(T.bookings(spark, sf), AS_OF), "yearly"))

query("wide_forecast_export", oracle("bookings", f"""
  SELECT period, max(forecast_idr) FILTER (horizon = 'monthly') AS monthly,
    max(forecast_idr) FILTER (horizon = 'weekly') AS weekly
  FROM ({FORECAST_SQL}) GROUP BY 1"""))(
    lambda spark, sf: sinks.wide_forecast(
        FC.naive_table(T.bookings(spark, sf), AS_OF), ["monthly", "weekly"]))


def _end_sql() -> str:
    return ("CASE horizon WHEN 'daily' THEN period WHEN 'weekly' THEN CAST(period + INTERVAL 6 DAY AS DATE) "
            "ELSE last_day(period) END")


def _resolve_sql(start: str, end: str, g: str, what: str) -> str:
    """Both parts of a range that straddles AS_OF, spelled out for one granularity."""
    pieces = {
        "cur": span("booking_date", start, "2000-07-09"),
        "rows": f"""SELECT *, {_end_sql()} AS period_end,
          (date_diff('day', greatest(period, DATE '{AS_OF}'), least({_end_sql()}, DATE '{end}')) + 1)
          / (date_diff('day', period, {_end_sql()}) + 1) AS share
          FROM ({FORECAST_SQL}) WHERE horizon = '{g}' AND period <= DATE '{end}' AND {_end_sql()} >= DATE '{AS_OF}'"""}
    if what == "periods":
        label = {"monthly": "%Y-%m", "weekly": "%G-W%V", "daily": "%Y-%m-%d"}[g]
        return f"""
          SELECT 'actual' AS kind, strftime(date_trunc('{_UNIT[g]}', booking_date), '{label}') AS period,
            {money()} AS revenue_idr, count(*) AS booking_count, false AS partial
          FROM bookings WHERE {COMMIT_PAID} AND {pieces['cur']} GROUP BY 2
          UNION ALL SELECT 'forecast', strftime(period, '%Y-%m-%d'), round_even(forecast_idr * share, 2), NULL, share < 1
          FROM ({pieces['rows']})"""
    return f"""
      WITH_SEGMENTS SELECT *, round(CAST(sum(CAST(total_idr AS DECIMAL(28,2))) OVER () AS DOUBLE), 2) AS grand_total_idr,
        true AS contains_forecast FROM (
        SELECT 'actual' AS kind, DATE '{start}' AS start, DATE '2000-07-09' AS "end", days, total_idr,
          round_even(total_idr / days, 2) AS avg_daily_idr,
          CASE WHEN prev > 0 THEN round_even((total_idr - prev) / prev * 100, 1) END AS vs_previous_period_pct,
          CASE WHEN yoy > 0 THEN round_even((total_idr - yoy) / yoy * 100, 1) END AS vs_same_period_last_year_pct,
          '{g}' AS granularity_used, CAST(NULL AS DOUBLE) AS model_mape_pct, CAST(NULL AS BOOLEAN) AS prorated_edges,
          CAST(NULL AS DATE) AS covered_until, CAST(NULL AS BOOLEAN) AS beyond_horizon
        FROM (SELECT date_diff('day', DATE '{start}', DATE '{AS_OF}') AS days, {money(where=pieces['cur'])} AS total_idr,
          {money(where=f"booking_date >= DATE '{start}' - (DATE '{AS_OF}' - DATE '{start}')::INT AND booking_date < DATE '{start}'")} AS prev,
          {money(where=f"booking_date >= DATE '{start}' - 365 AND booking_date < DATE '{AS_OF}' - 365")} AS yoy
          FROM bookings WHERE {COMMIT_PAID})
        UNION ALL SELECT 'forecast', DATE '{AS_OF}', DATE '{end}', date_diff('day', DATE '{AS_OF}', DATE '{end}') + 1,
          round_even(CAST(sum(CAST(forecast_idr * share AS DECIMAL(28,6))) AS DOUBLE), 2), NULL, NULL, NULL, min(horizon),
          arg_min(model_mape_pct, period), bool_or(share < 1), max(least(period_end, DATE '{end}')),
          max(least(period_end, DATE '{end}')) < DATE '{end}'
        FROM ({pieces['rows']}))""".replace("WITH_SEGMENTS ", "")


def _resolved(start: str, end: str, part: int):
    def run(spark, sf):
        rows = T.bookings(spark, sf)
        return RS.resolve(rows, FC.naive_table(rows, AS_OF), start, end, AS_OF)[part]
    return run


query("revenue_resolve", oracle("bookings", _resolve_sql("2000-05-15", "2000-09-10", "monthly", "segments")))(
    _resolved("2000-05-15", "2000-09-10", 0))
query("revenue_resolve_periods", oracle("bookings", _resolve_sql("2000-05-15", "2000-09-10", "monthly", "periods")))(
    _resolved("2000-05-15", "2000-09-10", 1))
query("revenue_resolve_weekly", oracle("bookings", _resolve_sql("2000-06-14", "2000-08-02", "weekly", "segments")))(
    _resolved("2000-06-14", "2000-08-02", 0))
query("revenue_resolve_daily", oracle("bookings", _resolve_sql("2000-07-01", "2000-07-25", "daily", "periods")))(
    _resolved("2000-07-01", "2000-07-25", 1))

query("forecast_for_ranges", oracle("bookings", f"""
  SELECT request_id, count(forecast_idr) AS periods, coalesce(round(CAST(sum(CAST(forecast_idr * share AS DECIMAL(28,6))) AS DOUBLE), 2), 0.0) AS total_idr,
    coalesce(bool_or(share < 1), false) AS partial, coalesce(max(pe) < max(e), true) AS beyond_horizon FROM (
    SELECT request_id, e, pe, forecast_idr, (date_diff('day', greatest(period, s), least(pe, e)) + 1)
      / (date_diff('day', period, pe) + 1) AS share
    FROM requests r LEFT JOIN (SELECT *, {_end_sql()} AS pe FROM ({FORECAST_SQL})) f
      ON f.horizon = r.horizon AND period <= e AND pe >= s) GROUP BY 1""",
    requests=f"""SELECT c_custkey AS request_id, DATE '{AS_OF}' + CAST(c_custkey % 40 AS INT) AS s,
      DATE '{AS_OF}' + CAST(c_custkey % 40 + c_custkey % 120 AS INT) AS e,
      CASE WHEN c_custkey % 120 + 1 <= 30 THEN 'daily' WHEN c_custkey % 120 + 1 <= 84 THEN 'weekly' ELSE 'monthly' END AS horizon
      FROM customer"""))(
    lambda spark, sf: RS.forecast_for_ranges(
        T.read(spark, sf, "customer").select(
            F.col("c_custkey").alias("request_id"),
            F.date_add(F.lit(AS_OF).cast("date"), (F.col("c_custkey") % 40).cast("int")).alias("start"),
            F.date_add(F.lit(AS_OF).cast("date"), (F.col("c_custkey") % 40 + F.col("c_custkey") % 120).cast("int")).alias("end"),
            S.granularity_column(F.col("c_custkey") % 120 + 1).alias("horizon")),
        FC.naive_table(T.bookings(spark, sf), AS_OF)))
