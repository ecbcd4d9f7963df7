"""Parsing, audit, profile, sink and stream queries over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import semantics as S
from tidemark.operators import churn as H
from tidemark.operators import forecast as FC
from tidemark.operators import profiles as P
from tidemark.operators import quality as QA
from tidemark.plans.kpi_queries import COMMIT, money
from tidemark.plans.model_queries import AS_OF, FORECAST_SQL, base_sql
from tidemark.plans.registry import query
from tidemark.sources import driver_tables as T
from tidemark.sources import readers as RD
from tidemark.sources import sinks
from tidemark.sources.driver_tables import oracle
from tidemark.streaming import events as E
from tidemark.streaming import jobs as J
from tidemark.streaming import limits as L
from tidemark.streaming import stateful as ST

_STRIP = r"regexp_replace({t}, '^\s+|\s+$', '', 'g')"

# ---- parsing --------------------------------------------------------------


def _raw(spark, sf):
    """Orders with the date written in six ways and the price sometimes spoiled."""
    key, d = F.col("o_orderkey"), F.col("o_orderdate")
    text = (
        F.when(key % 97 == 0, "n/a").when(key % 6 == 0, F.unix_millis(d.cast("timestamp")).cast("string"))
        .when(key % 6 == 1, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(key % 6 == 2, F.date_format(d, "MM/dd/yyyy"))
        .when((key % 6 == 3) & (F.dayofmonth(d) > 12), F.date_format(d, "dd/MM/yyyy"))
        .when(key % 6 == 4, F.date_format(d, "d MMM yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd")))
    price = (
        F.when(key % 50 == 0, "abc").when(key % 50 == 1, F.concat(F.lit("-"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")))
        .otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")))
    return T.read(spark, sf, "orders").select(key.alias("booking_id"), text.alias("booking_date"), price.alias("total_price_idr"))


query("parse_dates", """
  SELECT o_orderkey AS booking_id, CASE WHEN o_orderkey % 97 <> 0 THEN o_orderdate END AS booking_date FROM orders""")(
    lambda spark, sf: RD.parse_dates(_raw(spark, sf), ["booking_date"]).select("booking_id", "booking_date"))
query("audit_parse", """
  SELECT 'booking_date' AS column_name, 'parse_failed' AS issue, count(*) FILTER (o_orderkey % 97 = 0) AS rows FROM orders""")(
    lambda spark, sf: QA.audit_parse(_raw(spark, sf), ["booking_date"]))
query("audit_numeric", """
  SELECT 'total_price_idr' AS column_name, issue, rows FROM (
    SELECT 'coerced_to_null' AS issue, count(*) FILTER (o_orderkey % 50 = 0) AS rows FROM orders
    UNION ALL SELECT 'negative', count(*) FILTER (o_orderkey % 50 = 1) FROM orders
    UNION ALL SELECT 'out_of_domain', count(*) FILTER (o_orderkey % 50 > 1 AND (o_totalprice < 1000 OR o_totalprice > 400000)) FROM orders)""")(
    lambda spark, sf: QA.audit_numeric(_raw(spark, sf), {"total_price_idr": (1000.0, 400000.0)}))
query("numeric_coercion", """
  SELECT o_orderkey AS booking_id, CASE WHEN o_orderkey % 50 > 1 AND o_totalprice BETWEEN 1000 AND 400000 THEN o_totalprice END AS total_price_idr
  FROM orders""")(
    lambda spark, sf: QA.clean_numeric(_raw(spark, sf), {"total_price_idr": (1000.0, 400000.0)}).select("booking_id", "total_price_idr"))
query("json_field", "SELECT event_id, CAST(props->>'$.k' AS INT) AS k FROM events")(
    lambda spark, sf: T.read(spark, sf, "events").select("event_id", RD.json_field("props", "$.k").cast("int").alias("k")))
query("next_code_number", oracle("customers", "SELECT max(CAST(regexp_extract(customer_code, 'CUST-0*(\\d+)', 1) AS BIGINT)) + 1 AS next FROM customers"))(
    lambda spark, sf: RD.next_number(T.customers(spark, sf), "customer_code", "CUST"))
query("with_defaults", oracle("bookings", """
  SELECT booking_id, coalesce(campaign_id, -1) AS campaign_id, 'simulator' AS source FROM bookings"""))(
    lambda spark, sf: RD.with_defaults(T.bookings(spark, sf), {"booking_id": 0, "campaign_id": -1, "source": "simulator"}))
query("calendar_parts", oracle("bookings", """
  SELECT booking_id, CAST(weekofyear(booking_date) AS INT) AS iso_week, CAST(month(booking_date) AS INT) AS month,
    CAST(isodow(booking_date) - 1 AS INT) AS weekday, CAST(quarter(booking_date) AS INT) AS quarter FROM bookings"""))(
    lambda spark, sf: T.bookings(spark, sf).select(
        "booking_id", *[c.alias(n) for n, c in S.calendar_parts("booking_date").items()]))

# ---- audits ---------------------------------------------------------------

query("audit_category", oracle("bookings", """
  SELECT 'channel' AS column_name, 'unknown_category' AS issue, count(*) FILTER (channel NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS rows FROM bookings
  UNION ALL SELECT 'status', 'unknown_category', count(*) FILTER (status NOT IN ('Completed', 'Confirmed', 'Cancelled')) FROM bookings"""))(
    lambda spark, sf: QA.audit_category(T.bookings(spark, sf), {
        "channel": ["1-URGENT", "2-HIGH", "3-MEDIUM"], "status": ["Completed", "Confirmed", "Cancelled"]}))
query("audit_duplicates", oracle("customers", """
  SELECT 'email' AS column_name, 'duplicate' AS issue, count(*) AS values, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS rows
  FROM (SELECT count(*) AS n FROM customers GROUP BY email HAVING count(*) > 1)"""))(
    lambda spark, sf: QA.audit_duplicates(T.customers(spark, sf), "email"))


def _stays(spark, sf):
    """Booking lines with return date, stored nights and price parts, some of them wrong."""
    line = T.read(spark, sf, "lineitem")
    orders = T.read(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    price = F.col("l_extendedprice")
    return line.join(orders, line.l_orderkey == orders.o_orderkey, "left").select(
        F.col("o_orderdate").alias("booking_date"), F.col("l_shipdate").alias("travel_date"),
        F.date_add("l_shipdate", F.col("l_linenumber") - 2).alias("return_date"),
        (F.col("l_linenumber") - 2 + F.when(F.col("l_partkey") % 13 == 0, 1).otherwise(0)).alias("nights"),
        price.alias("base_price_idr"), (price * F.col("l_discount")).alias("discount_idr"), (price * F.col("l_tax")).alias("tax_idr"),
        (price - price * F.col("l_discount") + price * F.col("l_tax") + F.when(F.col("l_partkey") % 11 == 0, 5.0).otherwise(0.0)).alias("total_price_idr"))


query("audit_consistency", """
  SELECT column_name, issue, rows FROM (
    SELECT 'travel_date' AS column_name, 'before_booking' AS issue, count(*) FILTER (l_shipdate < o_orderdate) AS rows FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey
    UNION ALL SELECT 'return_date', 'before_travel', count(*) FILTER (l_linenumber < 2) FROM lineitem
    UNION ALL SELECT 'nights', 'differs_from_dates', count(*) FILTER (l_partkey % 13 = 0) FROM lineitem
    UNION ALL SELECT 'total_price_idr', 'price_identity', count(*) FILTER (l_partkey % 11 = 0) FROM lineitem)""")(
    lambda spark, sf: QA.audit_consistency(_stays(spark, sf)))
query("repair_nights", """
  SELECT CAST(CASE WHEN l_linenumber >= 2 THEN l_linenumber - 2 ELSE l_linenumber - 2 + CAST(l_partkey % 13 = 0 AS INT) END AS INT) AS nights, count(*) AS rows
  FROM lineitem GROUP BY 1""")(
    lambda spark, sf: QA.repair_nights(_stays(spark, sf)).groupBy(F.col("nights").cast("int").alias("nights")).agg(F.count(F.lit(1)).alias("rows")))
# Some amounts get a sign they must not have.
query("audit_transactions", oracle("transactions", """
  SELECT 'amount_idr' AS column_name, 'negative_but_not_refund' AS issue, count(*) FILTER (amount_idr <> 0 AND booking_id % 11 = 0 AND type <> 'Refund') AS rows FROM transactions"""))(
    lambda spark, sf: QA.audit_consistency(T.transactions(spark, sf).withColumn(
        "amount_idr", F.when(F.col("booking_id") % 11 == 0, -F.col("amount_idr")).otherwise(F.col("amount_idr")))))
query("audit_organic", oracle("bookings", """
  SELECT 'campaign_id' AS column_name, 'organic_bookings' AS issue, count(*) FILTER (campaign_id IS NULL) AS rows FROM bookings"""))(
    lambda spark, sf: QA.audit_nulls(T.bookings(spark, sf), ["campaign_id"], "organic_bookings"))
# Features as they are, and spoiled by customer number: every rule has rows that break it.
query("feature_sanity", oracle("bookings", f"""
  SELECT 'recency_days' AS column_name, 'negative' AS issue, count(*) FILTER (recency_days < 0 OR customer_id % 13 = 0) AS rows FROM ({base_sql()})
    UNION ALL SELECT 'frequency', 'below_one', count(*) FILTER (frequency < 1 OR customer_id % 17 = 0) FROM ({base_sql()})
    UNION ALL SELECT 'track', 'unknown', count(*) FILTER (track NOT IN ('single', 'repeat') OR customer_id % 19 < 2) FROM ({base_sql()})
    UNION ALL SELECT 'recency_ratio', 'infinite', count(*) FILTER (customer_id % 23 < 2) FROM ({base_sql()})
    UNION ALL SELECT 'recency_ratio', 'nan', count(*) FILTER (customer_id % 23 = 2) FROM ({base_sql()})"""))(
    lambda spark, sf: QA.feature_sanity(H.booking_features(T.bookings(spark, sf), "2000-06-30").withColumns({
        "recency_days": F.when(F.col("customer_id") % 13 == 0, -1).otherwise(F.col("recency_days")),
        "frequency": F.when(F.col("customer_id") % 17 == 0, 0).otherwise(F.col("frequency")),
        "track": F.when(F.col("customer_id") % 19 == 0, "gold").when(F.col("customer_id") % 19 != 1, F.col("track")),
        "recency_ratio": F.when(F.col("customer_id") % 23 == 0, F.lit(float("inf"))).when(F.col("customer_id") % 23 == 1, F.lit(float("-inf"))).when(
            F.col("customer_id") % 23 == 2, F.lit(float("nan"))).otherwise(F.col("recency_ratio"))})))


def _two_scores(spark, sf):
    scores = T.churn_scores(spark, sf)
    moved = scores.where(F.col("risk_bucket") != "Low").withColumn(
        "churn_proba", F.col("churn_proba") + (F.col("customer_id") % 7) / 500.0)
    return scores, moved


_BOTH = """(SELECT customer_id, a, b, abs(a - b) AS diff FROM (
  SELECT customer_id, churn_proba AS a, CASE WHEN risk_bucket <> 'Low' THEN churn_proba + customer_id % 7 / 500 END AS b FROM churn_scores))"""
query("score_parity", oracle("churn_scores", f"""
  SELECT count(diff) AS compared, round(count(diff) / count(a), 6) AS overlap, round(max(diff), 6) AS max_diff,
    round(CAST(sum(CAST(diff AS DECIMAL(20,10))) AS DOUBLE) / count(diff), 6) AS mean_diff, count(*) FILTER (diff > 0.01) AS over_tolerance FROM {_BOTH}"""))(
    lambda spark, sf: QA.score_parity(*_two_scores(spark, sf))[0])
query("score_parity_worst", oracle("churn_scores", f"""
  SELECT customer_id, a, b, round(diff, 6) AS diff FROM (SELECT * FROM {_BOTH} WHERE diff IS NOT NULL ORDER BY diff DESC, customer_id LIMIT 5)"""))(lambda spark, sf: QA.score_parity(*_two_scores(spark, sf))[1])

# ---- profiles -------------------------------------------------------------


def share_sql(table: str, *columns: str) -> str:
    known = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    return (f"SELECT {', '.join(columns)}, count(*) AS rows, round(count(*) / (SELECT count(*) FROM {table} WHERE {known}), 6) AS share "
            f"FROM {table} WHERE {known} GROUP BY ALL")


query("category_share", oracle("bookings", share_sql("bookings", "channel")))(
    lambda spark, sf: P.category_share(T.bookings(spark, sf), "channel"))
query("category_share_city", oracle("customers", share_sql("customers", "city")))(
    lambda spark, sf: P.category_share(T.customers(spark, sf), "city"))
query("category_share_email_domain", oracle("customers", share_sql("d", "domain"), d="SELECT split_part(email, '@', 2) AS domain FROM customers"))(
    lambda spark, sf: P.category_share(T.customers(spark, sf).select(S.email_domain(F.col("email")).alias("domain")), "domain"))
query("category_share_hour", oracle("", share_sql("h", "hour"), h="SELECT CAST(hour(ts) AS INT) AS hour FROM events"))(
    lambda spark, sf: P.category_share(T.read(spark, sf, "events").select(F.hour("ts").alias("hour")), "hour"))
query("joint_share", oracle("bookings", share_sql("bookings", "status", "payment_status")))(
    lambda spark, sf: P.joint_share(T.bookings(spark, sf)))
query("seasonal_volume_profile", oracle("bookings", """
  SELECT CAST(month(day) AS INT) AS month, CAST(isodow(day) - 1 AS INT) AS weekday, round(avg(coalesce(n, 0)), 6) AS mean_bookings, count(*) AS days
  FROM (SELECT unnest(generate_series((SELECT min(booking_date) FROM bookings), (SELECT max(booking_date) FROM bookings), INTERVAL 1 DAY)) AS day) d
  LEFT JOIN (SELECT booking_date AS day, count(*) AS n FROM bookings GROUP BY 1) b USING (day) GROUP BY 1, 2"""))(
    lambda spark, sf: P.seasonal_volume(T.bookings(spark, sf)))
query("booking_rhythm", oracle("bookings", f"""
  SELECT *, CASE WHEN freq > 1 THEN floor((epoch_us(last) - epoch_us(first)) / 86400000000) / (freq - 1) END AS avg_interval FROM (
    SELECT customer_id, max(booking_date) AS last, min(booking_date) AS first, count(*) AS freq FROM bookings WHERE {COMMIT} GROUP BY 1)"""))(
    lambda spark, sf: P.booking_rhythm(T.bookings(spark, sf)))
query("ratio_distributions", """
  SELECT 'discount_ratio' AS measure, count(r) AS n, round(quantile_cont(r, 0.1), 6) AS p10, round(quantile_cont(r, 0.5), 6) AS p50,
    round(quantile_cont(r, 0.9), 6) AS p90 FROM (SELECT l_extendedprice * l_discount / l_extendedprice AS r FROM lineitem)""")(
    lambda spark, sf: P.ratio_distribution(_stays(spark, sf)))
query("lead_days_distribution", oracle("trips", """
  SELECT 'lead_days' AS measure, count(d) AS n, round(quantile_cont(d, 0.1), 6) AS p10, round(quantile_cont(d, 0.5), 6) AS p50,
    round(quantile_cont(d, 0.9), 6) AS p90
  FROM (SELECT greatest(floor((epoch_us(travel_date) - epoch_us(booking_date)) / 86400000000), 1) AS d FROM trips)"""))(
    lambda spark, sf: P.lead_days(T.trips(spark, sf)))
query("stratified_text_sample", """
  SELECT doc_id, quality, text, CAST(rank AS INT) AS rank FROM (
    SELECT doc_id, quality, text, row_number() OVER (PARTITION BY quality ORDER BY CAST('0x' || substr(md5(doc_id || ':42'), 1, 15) AS BIGINT), doc_id) AS rank
    FROM documents JOIN labels USING (doc_id)) WHERE rank <= 300""")(
    lambda spark, sf: P.text_sample(
        T.read(spark, sf, "documents").join(T.read(spark, sf, "labels"), "doc_id"), "text", "quality", "doc_id"))
query("null_share", oracle("bookings", """
  SELECT round(avg(CAST(campaign_id IS NULL AS INT)), 6) AS campaign_id, round(avg(CAST(agent_id IS NULL AS INT)), 6) AS agent_id FROM bookings"""))(
    lambda spark, sf: P.null_share(T.bookings(spark, sf), ["campaign_id", "agent_id"]))
query("price_ratios", """
  SELECT l_orderkey AS booking_id, l_linenumber AS line, round(l_discount, 6) AS discount_ratio, round(l_tax, 6) AS tax_ratio,
    round(l_extendedprice / l_quantity, 8) AS unit_price FROM lineitem""")(
    lambda spark, sf: T.read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("booking_id"), F.col("l_linenumber").alias("line"),
        F.round(F.try_divide(F.col("l_extendedprice") * F.col("l_discount"), F.col("l_extendedprice")), 6).alias("discount_ratio"),
        F.round(F.try_divide(F.col("l_extendedprice") * F.col("l_tax"), F.col("l_extendedprice")), 6).alias("tax_ratio"),
        F.round(F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")), 8).alias("unit_price")))

# ---- sinks ----------------------------------------------------------------


@query("upsert_forecast", oracle("bookings", f"""
  SELECT period, horizon, forecast_idr FROM ({FORECAST_SQL}) WHERE horizon <> 'weekly'
  UNION ALL SELECT period, horizon, round(forecast_idr * 2, 2) FROM ({FORECAST_SQL}) WHERE horizon = 'weekly'"""))
def _upsert(spark, sf):
    rows = FC.naive_table(T.bookings(spark, sf), AS_OF).select("period", "horizon", "forecast_idr")
    base = J.shared_folder(spark)
    stored = sinks.saved(rows, base)
    changed = stored.where("horizon = 'weekly'").withColumn("forecast_idr", F.round(F.col("forecast_idr") * 2, 2))
    return sinks.saved(sinks.upserted(stored, changed, ["period", "horizon"]), base)


@query("mirror_sync", """
  SELECT count(*) FILTER (p_type = 'SMALL') AS added, count(*) FILTER (p_type NOT IN ('SMALL', 'ECONOMY')) AS replaced,
    count(*) FILTER (p_type = 'ECONOMY') AS deleted FROM part""")
def _mirror(spark, sf):
    parts = T.read(spark, sf, "part")
    base = J.shared_folder(spark)
    stored = sinks.saved(parts.where("p_type <> 'SMALL'"), base)
    mirrored = sinks.saved(parts.where("p_type <> 'ECONOMY'"), base)
    return sinks.mirror_counts(stored, mirrored, ["p_partkey"])


@query("latest_deployed_run", """
  SELECT 'retrain_churn' AS job, max(o_orderdate) AS ran_at, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS auc FROM orders
  WHERE o_orderstatus = 'F' AND o_orderdate = (SELECT max(o_orderdate) FROM orders WHERE o_orderstatus = 'F')
    AND o_orderkey = (SELECT max(o_orderkey) FROM orders WHERE o_orderstatus = 'F' AND o_orderdate = (SELECT max(o_orderdate) FROM orders WHERE o_orderstatus = 'F'))""")
def _latest(spark, sf):
    last = F.struct("o_orderdate", "o_orderkey")
    daily = T.read(spark, sf, "orders").groupBy("o_orderdate", "o_orderstatus").agg(F.max_by("o_totalprice", last).alias("auc"))
    runs = daily.select(F.lit("retrain_churn").alias("job"), F.col("o_orderdate").alias("ran_at"), "auc",
                        (F.col("o_orderstatus") == "F").alias("deployed"))
    return sinks.latest_run(runs, "retrain_churn").select("job", "ran_at", "auc")


query("resolve_codes", """
  SELECT l_partkey AS code, l_linenumber AS line, o_orderkey AS booking_id FROM lineitem LEFT JOIN orders ON o_orderkey = l_partkey""")(
    lambda spark, sf: sinks.resolve_codes(
        T.read(spark, sf, "lineitem").select(
            F.col("l_partkey").alias("code"), F.col("l_partkey").alias("booking_code"), F.col("l_linenumber").alias("line")),
        T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("booking_code"), F.col("o_orderkey").alias("booking_id"))))

# ---- streams --------------------------------------------------------------

query("stream_revenue_tumbling", f"""
  SELECT date_trunc('day', ts) AS day_start, event_type, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS revenue, count(*) AS events
  FROM events GROUP BY 1, 2""")(
    lambda spark, sf: J.drain(E.revenue_tumbling(J.read_stream(spark, sf, "events"), "event_type"), "update", keys=["day_start", "event_type"]))
query("stream_activity_sliding", """
  SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, user_id, count(*) AS events FROM (
    SELECT user_id, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY 1, 2, 3""")(
    lambda spark, sf: J.drain(E.activity_sliding(J.read_stream(spark, sf, "events"), "user_id"), "update", keys=["window_start", "user_id"]))
query("stream_sessions", """
  SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events FROM (
    SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
      SELECT user_id, ts, CAST(coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true) AS INT) AS fresh FROM events))
  GROUP BY user_id, s""")(
    lambda spark, sf: J.drain_closed(J.read_stream(spark, sf, "events"), lambda e: E.sessions(e, "user_id"), "ts"))
# The limiter step by step: the accepted times of the window travel along the events of a user.
_LIMITER = """
  WITH RECURSIVE ev AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  step AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS TIMESTAMP) AS ts,
      CAST([] AS TIMESTAMP[]) AS kept, false AS accepted FROM ev
    UNION ALL SELECT user_id, n, event_id, ts, CASE WHEN len(live) < 3 THEN list_append(live, ts) ELSE live END, len(live) < 3 FROM (
      SELECT e.*, list_filter(s.kept, lambda t: t >= e.ts - INTERVAL 10 HOUR) AS live FROM step s JOIN ev e ON e.user_id = s.user_id AND e.n = s.n + 1))
  SELECT {columns} FROM step WHERE n > 0"""

@query("stream_rate_limit", _LIMITER.format(columns="user_id, event_id, ts, accepted"))
def _limited(spark, sf):
    base = J.shared_folder(spark)
    J.run_batches(J.read_stream(spark, sf, "events"), J.limit_writer(f"{base}/out", "user_id", "event_id", limit=3, seconds=36_000), base)
    return spark.read.parquet(f"{base}/out").drop("batch")


query("rate_limit_batch", _LIMITER.format(columns="user_id, event_id, accepted"))(
    lambda spark, sf: L.rate_limit(T.read(spark, sf, "events"), "user_id", "event_id", limit=3, seconds=36_000).select(
        "user_id", "event_id", "accepted"))
query("hits_in_window", """
  SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 10 HOUR PRECEDING AND CURRENT ROW) AS hits FROM events""")(
    lambda spark, sf: L.hits_in_window(T.read(spark, sf, "events"), "user_id", seconds=36_000).select("event_id", "hits"))
query("daily_budget", """
  SELECT event_id, day, CAST(position AS INT) AS position FROM (SELECT event_id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS position FROM events)
  WHERE position <= 100""")(
    lambda spark, sf: L.running_budget(T.read(spark, sf, "events"), budget=100).select("event_id", "day", "position"))


@query("stream_daily_budget", """
  SELECT event_id, day FROM (SELECT event_id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS position FROM events)
  WHERE position <= 100""")
def _budget(spark, sf):
    base = J.shared_folder(spark)
    J.run_batches(J.read_stream(spark, sf, "events"), J.budget_writer(f"{base}/accepted", "ts", "event_id", 100), base)
    return spark.read.parquet(f"{base}/accepted").select("event_id", "day")


@query("stream_customer_rollup", oracle("bookings", f"""
  SELECT customer_id, count(*) AS total_trips, {money()} AS total_spent_idr, max(booking_date) AS last_purchase_date, count(*) > 1 AS is_repeat_customer
  FROM bookings WHERE {COMMIT} GROUP BY 1"""))
def _rollup(spark, sf):
    committed = F.col("o_orderstatus").isin("F", "O")
    stream = J.read_stream(spark, sf, "orders").where(committed).select(
        F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").alias("total_price_idr"), F.col("o_orderdate").alias("booking_date"))
    base = J.shared_folder(spark)
    J.run_batches(stream, J.rollup_writer(f"{base}/sums"), base)
    return J.rollup_of(spark, f"{base}/sums")


# The events arrive in four parts, so rows of the later ones are late.
@query("stream_late_data", """
  WITH e AS (SELECT event_id, ts, CAST(event_id % 4 AS INT) AS batch FROM events),
  m AS (SELECT b.batch, max(ts) AS newest FROM (SELECT unnest([0, 1, 2, 3]) AS batch) b JOIN e ON e.batch < b.batch GROUP BY 1)
  SELECT e.batch, coalesce(ts < newest - INTERVAL 1 HOUR, false) AS is_late, count(*) AS n FROM e LEFT JOIN m USING (batch) GROUP BY 1, 2""")
def _late(spark, sf):
    base = J.shared_folder(spark)
    events = T.read(spark, sf, "events")
    for k in range(4):
        # A part in as many files as it has; each run of the stream takes what is new, as one micro-batch.
        events.where(F.col("event_id") % 4 == k).write.parquet(f"{base}/in/p{k}")
        J.run_batches(spark.readStream.schema(events.schema).parquet(f"{base}/in/*"), J.late_splitter(base, "ts", 3600), base)
    rows = spark.read.parquet(f"{base}/rows")
    return rows.groupBy(F.col("batch").cast("int").alias("batch"), "is_late").agg(F.count(F.lit(1)).alias("n"))


# Greetings, thanks and repeated texts come back; a repeat is kept once the time to live of the last kept one is over.
query("stream_dedup_questions", oracle("questions", """
  SELECT q.question_id, q.query_key, q.asked_at FROM kept q""", keyed=f"""
  SELECT question_id, md5({_STRIP.format(t="lower(text)")}) AS query_key, asked_at FROM questions""", placed="""
  SELECT *, row_number() OVER (PARTITION BY query_key ORDER BY asked_at, question_id) AS n FROM keyed""", walk="""
  SELECT question_id, query_key, asked_at, n, asked_at AS last, true AS keep FROM placed WHERE n = 1 UNION ALL
  SELECT p.question_id, p.query_key, p.asked_at, p.n, CASE WHEN p.asked_at - w.last >= INTERVAL 36 HOUR THEN p.asked_at ELSE w.last END, p.asked_at - w.last >= INTERVAL 36 HOUR
  FROM walk w JOIN placed p ON p.query_key = w.query_key AND p.n = w.n + 1""", kept="SELECT * FROM walk WHERE keep").replace("WITH ", "WITH RECURSIVE ", 1))(
    lambda spark, sf: J.drain(ST.first_questions(T.questions_of(J.read_stream(spark, sf, "conversations")), "question_id", ttl="36 hours")).withColumn(
        "asked_at", F.col("asked_at").cast("timestamp_ntz")))
