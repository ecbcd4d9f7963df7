"""Dashboard queries over the supplied tables."""

from __future__ import annotations

from tidemark.operators import bookings as B
from tidemark.operators import customers as C
from tidemark.operators import facts as X
from tidemark.operators import inventory as I
from tidemark.operators import marketing as M
from tidemark.operators import revenue as R
from tidemark.operators import reviews as V
from tidemark.plans.registry import query
from tidemark.sources import driver_tables as T
from tidemark.sources.driver_tables import oracle

START, END = "1996-01-01", "1999-12-31"
YEAR_START, YEAR_END = "1997-01-01", "1997-12-31"
EVENTS_START, EVENTS_END = "2024-01-05", "2024-01-25"
AS_OF = "2001-05-17"


def span(column: str, start: str = START, end: str = END) -> str:
    return f"{column} >= DATE '{start}' AND {column} < DATE '{end}' + INTERVAL 1 DAY"


REAL = "status = 'Completed' AND payment_status = 'Paid'"
COMMIT = "status IN ('Completed', 'Confirmed')"
COMMIT_PAID = COMMIT + " AND payment_status = 'Paid'"


def money(expr: str = "total_price_idr", where: str | None = None) -> str:
    f = f" FILTER ({where})" if where else ""
    return f"coalesce(CAST(sum(CAST({expr} AS DECIMAL(18,2))){f} AS DOUBLE), 0.0)"


def days(start: str, end: str) -> str:
    return f"SELECT CAST(range AS DATE) AS date FROM range(DATE '{start}', DATE '{end}' + INTERVAL 1 DAY, INTERVAL 1 DAY)"


query("revenue_current", oracle("bookings", f"""
  SELECT {money(where="created_at >= DATE '2001-05-17'")} AS today,
    {money(where="created_at >= DATE '2001-05-10'")} AS last_seven_days,
    {money(where="created_at >= DATE '2001-05-01'")} AS current_month,
    {money(where="created_at >= DATE '2001-01-01'")} AS this_year FROM bookings WHERE {REAL}"""))(
    lambda spark, sf: R.current(T.bookings(spark, sf), AS_OF))

for _name, _gran, _unit in (("revenue_by_period", "monthly", "month"), ("revenue_by_period_weekly", "weekly", "week"),
                            ("revenue_by_period_annually", "annually", "year")):
    query(_name, oracle("bookings", f"""
      SELECT CAST(date_trunc('{_unit}', created_at) AS DATE) AS period, '{_gran}' AS granularity, {money()} AS revenue
      FROM bookings WHERE {REAL} AND {span('created_at')} GROUP BY 1"""))(
        lambda spark, sf, g=_gran: R.by_period(T.bookings(spark, sf), START, END, g))

query("revenue_daily", oracle("bookings", f"""
  SELECT date, coalesce(r, 0.0) AS revenue FROM ({days(YEAR_START, YEAR_END)}) d LEFT JOIN (
    SELECT CAST(created_at AS DATE) AS date, {money()} AS r FROM bookings
    WHERE {REAL} AND {span('created_at', YEAR_START, YEAR_END)} GROUP BY 1) b USING (date)"""))(
    lambda spark, sf: R.daily(T.bookings(spark, sf), YEAR_START, YEAR_END))


def _by(name: str, column: str, out: str, dimension: bool = False) -> None:
    def run(spark, sf):
        if dimension:
            return R.by_dimension(T.bookings(spark, sf), T.homes(spark, sf), "customer_id", START, END, column, out)
        return R.by_key(T.bookings(spark, sf), START, END, column, out)

    query(name, oracle("bookings", f"""
      SELECT coalesce(nullif(CAST({column} AS VARCHAR), ''), 'Unknown') AS {out}, {money()} AS revenue,
        count(*) AS booking_count FROM bookings WHERE {REAL} AND {span('created_at')} GROUP BY 1"""))(run)


_by("revenue_by_destination", "destination_name", "destination_name", dimension=True)
_by("revenue_by_package_type", "package_type", "package_type")
_by("revenue_by_channel", "channel", "channel")
_by("revenue_by_payment_method", "payment_method", "payment_method")
_by("revenue_by_segment", "customer_segment", "segment", dimension=True)
_by("agent_performance", "agent_id", "agent_id")

query("customer_type_revenue", oracle("bookings", f"""
  SELECT coalesce(is_repeat_customer, false) AS is_repeat_customer, {money()} AS revenue, count(*) AS booking_count
  FROM bookings WHERE {REAL} AND {span('created_at')} GROUP BY 1"""))(
    lambda spark, sf: R.by_customer_type(T.bookings(spark, sf), START, END, T.first_dates(spark, sf)))

query("discount_impact", oracle("bookings", f"""
  SELECT *, coalesce(total_discount / nullif(total_revenue + total_discount, 0), 0.0) AS discount_rate FROM (
    SELECT {money('discount_idr')} AS total_discount, {money()} AS total_revenue
    FROM bookings WHERE {REAL} AND {span('created_at')})"""))(
    lambda spark, sf: R.discount_impact(T.bookings(spark, sf, discount=True), START, END))

query("payment_status_summary", oracle("bookings", f"""
  SELECT payment_status, {money()} AS total_amount, count(*) AS booking_count
  FROM bookings WHERE {span('created_at')} GROUP BY 1"""))(
    lambda spark, sf: R.payment_status_summary(T.bookings(spark, sf), START, END))

query("revenue_facets", oracle("bookings", " UNION ALL ".join(f"""
  SELECT '{f}' AS facet, CAST({c} AS VARCHAR) AS key, {money()} AS revenue, count(*) AS booking_count
  FROM bookings WHERE {REAL} AND {span('created_at')} GROUP BY 2""" for f, c in R.FACETS.items())))(
    lambda spark, sf: R.facets(T.bookings(spark, sf), START, END, dimension=T.homes(spark, sf)))

query("customer_segment_distribution", oracle("customers", f"""
  SELECT coalesce(segment, 'Unknown') AS segment, count(*) AS customer_count, {money('total_spent_idr')} AS total_spent_idr
  FROM customers GROUP BY 1"""))(lambda spark, sf: C.segment_distribution(T.customers(spark, sf)))

query("customer_age_distribution", oracle("customers", """
  SELECT age_group, count(*) AS customer_count FROM customers GROUP BY 1"""))(
    lambda spark, sf: C.age_distribution(T.customers(spark, sf)))

query("customer_city_distribution", oracle("customers", """
  SELECT city, count(*) AS customer_count FROM customers GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""))(
    lambda spark, sf: C.city_distribution(T.customers(spark, sf), 10))

query("customer_acquisition_channel", oracle("customers", """
  SELECT acquisition_channel, count(*) AS customer_count FROM customers GROUP BY 1"""))(
    lambda spark, sf: C.acquisition_channels(T.customers(spark, sf)))

query("customer_top_spenders", oracle("customers", """
  SELECT customer_code, name, segment, coalesce(total_trips, 0) AS total_trips,
    coalesce(total_spent_idr, 0.0) AS total_spent_idr FROM customers ORDER BY 5 DESC, 1 LIMIT 10"""))(
    lambda spark, sf: C.top_spenders(T.customers(spark, sf), 10))

query("customer_new_by_day", oracle("customers", f"""
  SELECT date, coalesce(n, 0) AS new_customer_count FROM ({days('1995-01-01', '1996-12-31')}) d LEFT JOIN (
    SELECT CAST(join_date AS DATE) AS date, count(*) AS n FROM customers GROUP BY 1) c USING (date)"""))(
    lambda spark, sf: C.new_by_day(T.customers(spark, sf), "1995-01-01", "1996-12-31"))

query("customer_repeat_ratio", oracle("customers", """
  SELECT *, coalesce(repeat_customer_count / nullif(repeat_customer_count + new_customer_count, 0), 0.0) AS repeat_rate
  FROM (SELECT count(*) FILTER (is_repeat_customer) AS repeat_customer_count,
    count(*) FILTER (NOT is_repeat_customer) AS new_customer_count FROM customers)"""))(
    lambda spark, sf: C.repeat_ratio(T.customers(spark, sf)))

query("customer_search", oracle("customers", """
  SELECT customer_id, customer_code, name, segment, coalesce(total_trips, 0) AS total_trips,
    coalesce(total_spent_idr, 0.0) AS total_spent_idr FROM customers
  WHERE lower(name) LIKE '%r#00000001%' OR lower(customer_code) LIKE '%r#00000001%' ORDER BY customer_code LIMIT 10"""))(
    lambda spark, sf: C.search(T.customers(spark, sf), "R#00000001", 10))

query("customer_churn_risk", oracle("customers churn_scores", """
  SELECT s.customer_id, customer_code, name, segment, churn_proba, risk_bucket, track, monetary_total, tenure_days
  FROM (SELECT * FROM churn_scores WHERE risk_bucket = 'High' ORDER BY churn_proba DESC, monetary_total DESC, customer_id
    LIMIT 25) s LEFT JOIN customers c ON c.customer_id = s.customer_id"""))(
    lambda spark, sf: C.churn_risk(T.churn_scores(spark, sf), T.customers(spark, sf), "High", 25))

query("booking_status_summary", oracle("bookings", f"""
  SELECT status, count(*) AS booking_count FROM bookings WHERE {span('created_at')} GROUP BY 1"""))(
    lambda spark, sf: B.status_summary(T.bookings(spark, sf), START, END))

query("booking_volume", oracle("bookings", f"""
  SELECT date, coalesce(n, 0) AS booking_count FROM ({days(YEAR_START, YEAR_END)}) d LEFT JOIN (
    SELECT CAST(created_at AS DATE) AS date, count(*) AS n FROM bookings GROUP BY 1) b USING (date)"""))(
    lambda spark, sf: B.volume(T.bookings(spark, sf), YEAR_START, YEAR_END))

query("booking_lead_time", oracle("trips", f"""
  SELECT round_even(CAST(sum(epoch_us(travel_date) - epoch_us(booking_date)) AS DOUBLE)
      / count(travel_date) / 86400000000, 1) AS avg_lead_time_days,
    CAST(trunc(min((epoch_us(travel_date) - epoch_us(booking_date)) / 86400000000)) AS INT) AS min_lead_time_days,
    CAST(trunc(max((epoch_us(travel_date) - epoch_us(booking_date)) / 86400000000)) AS INT) AS max_lead_time_days
  FROM trips WHERE {span('created_at')}"""))(lambda spark, sf: B.lead_time(T.trips(spark, sf), START, END))

query("booking_cancellation_rate", oracle("bookings", f"""
  SELECT *, cancelled_bookings / total_bookings AS cancellation_rate FROM (
    SELECT count(*) AS total_bookings, count(*) FILTER (status = 'Cancelled') AS cancelled_bookings
    FROM bookings WHERE {span('created_at')})"""))(
    lambda spark, sf: B.cancellation_rate(T.bookings(spark, sf), START, END))

query("booking_payment_gateway", oracle("transactions", f"""
  SELECT payment_method, count(*) FILTER (status = 'Success') AS success_count,
    count(*) FILTER (status <> 'Success') AS failed_count, {money('amount_idr', "status = 'Success'")} AS total_amount_idr
  FROM transactions WHERE {span('transaction_date')} GROUP BY 1"""))(
    lambda spark, sf: B.payment_gateways(T.transactions(spark, sf), START, END))

_ALL_JAN = ("2024-01-01", "2024-01-31")
_CAMPAIGN_RANGE = span("start_date", *_ALL_JAN)

query("campaign_performance", oracle("campaigns", f"""
  SELECT campaign_code, name, type, spend_idr, revenue_generated_idr, coalesce(roi, 0.0) AS roi,
    coalesce(conversion_rate, 0.0) AS conversion_rate, spend_idr / nullif(conversions, 0) AS cpa_idr
  FROM campaigns WHERE {_CAMPAIGN_RANGE} ORDER BY roi DESC, campaign_code LIMIT 20"""))(
    lambda spark, sf: M.performance(T.campaigns(spark, sf), *_ALL_JAN, 20))

query("campaign_type_summary", oracle("campaigns", f"""
  SELECT type, {money('spend_idr')} AS total_spend_idr, {money('revenue_generated_idr')} AS total_revenue_idr,
    round(CAST(sum(CAST(roi AS DECIMAL(28,10))) AS DOUBLE) / count(roi), 6) AS avg_roi
  FROM campaigns WHERE {_CAMPAIGN_RANGE} GROUP BY 1"""))(
    lambda spark, sf: M.type_summary(T.campaigns(spark, sf), *_ALL_JAN))

query("campaign_funnel", oracle("campaigns", f"""
  SELECT campaign_code, name, reach, impressions, clicks, conversions FROM campaigns WHERE {_CAMPAIGN_RANGE}"""))(
    lambda spark, sf: M.funnel(T.campaigns(spark, sf), *_ALL_JAN))

query("campaign_cpa", oracle("campaigns", """
  SELECT type, count(*) AS campaigns, round(quantile_cont(spend_idr / conversions, 0.5), 6) AS median_cpa_idr
  FROM campaigns WHERE conversions > 0 GROUP BY 1"""))(
    lambda spark, sf: M.cost_per_conversion(T.campaigns(spark, sf)))

query("destination_popularity", oracle("destinations bookings", f"""
  SELECT coalesce(d.name, b.name) AS destination_name, coalesce(popularity_score, 0.0) AS popularity_score,
    coalesce(n, 0) AS actual_booking_count, coalesce(r, 0.0) AS actual_revenue_idr
  FROM destinations d FULL JOIN (SELECT destination_name AS name, count(*) AS n, {money()} AS r FROM bookings
    WHERE {REAL} AND {span('created_at')} GROUP BY 1) b ON d.name = b.name"""))(
    lambda spark, sf: I.popularity(T.destinations(spark, sf), T.bookings(spark, sf), START, END, T.homes(spark, sf)))

_MEAN = "round(CAST(sum(CAST({c} AS DECIMAL(28,10))) AS DOUBLE) / count({c}), 6)"

query("destination_region_summary", oracle("destinations", f"""
  SELECT region, count(*) AS destination_count, {_MEAN.format(c='avg_rating')} AS avg_rating
  FROM destinations GROUP BY 1"""))(lambda spark, sf: I.region_summary(T.destinations(spark, sf)))

query("package_type_summary", oracle("packages", f"""
  SELECT type, count(*) AS package_count, CAST(sum(total_bookings) AS BIGINT) AS total_bookings,
    {_MEAN.format(c='rating')} AS avg_rating, {_MEAN.format(c='price_per_pax_idr')} AS avg_price_idr
  FROM packages GROUP BY 1"""))(lambda spark, sf: I.package_types(T.packages(spark, sf)))

for _name, _kind, _binding in (("package_top_packages", "packages", T.packages), ("partner_top_hotels", "hotels", T.hotels),
                               ("partner_top_flight_routes", "flights", T.flights)):
    _sort, _code, _fields = I.TOP_SHAPES[_kind]
    query(_name, oracle(_kind, f"""
      SELECT {', '.join(_fields)} FROM {_kind} ORDER BY {_sort} DESC, {_code} LIMIT 10"""))(
        lambda spark, sf, k=_kind, b=_binding: I.top(b(spark, sf), k, 10))

_REV = span("review_date", EVENTS_START, EVENTS_END)

query("review_sentiment_summary", oracle("reviews", f"""
  SELECT sentiment, count(*) AS review_count, avg(rating) AS avg_rating FROM reviews WHERE {_REV} GROUP BY 1"""))(
    lambda spark, sf: V.sentiment_summary(T.reviews(spark, sf), EVENTS_START, EVENTS_END))

query("review_rating_trend", oracle("reviews", f"""
  SELECT CAST(date_trunc('week', review_date) AS DATE) AS period, 'weekly' AS granularity, avg(rating) AS avg_rating,
    count(*) AS review_count FROM reviews WHERE {_REV} GROUP BY 1"""))(
    lambda spark, sf: V.rating_trend(T.reviews(spark, sf), EVENTS_START, EVENTS_END, "weekly"))

query("review_destination_rating", oracle("reviews", f"""
  SELECT coalesce(destination_name, 'Unknown') AS destination_name, avg(rating) AS avg_rating, count(*) AS review_count
  FROM reviews WHERE {_REV} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""))(
    lambda spark, sf: V.destination_ratings(T.reviews(spark, sf), EVENTS_START, EVENTS_END, 10, T.homes(spark, sf)))

_BOOKED = span("booking_date")

query("revenue_total", oracle("bookings", f"""
  SELECT {money()} AS total_idr FROM bookings WHERE {COMMIT_PAID} AND {_BOOKED}"""))(
    lambda spark, sf: X.revenue_total(T.bookings(spark, sf), START, END))

for _gran, _unit, _label in (("daily", "day", "%Y-%m-%d"), ("weekly", "week", "%G-W%V"), ("monthly", "month", "%Y-%m")):
    query("revenue_period_breakdown" + ("" if _gran == "monthly" else f"_{_gran}"), oracle("bookings", f"""
      SELECT strftime(date_trunc('{_unit}', booking_date), '{_label}') AS period, round_even({money()}, 2) AS revenue_idr,
        count(*) AS booking_count FROM bookings WHERE {COMMIT_PAID} AND {_BOOKED} GROUP BY 1"""))(
        lambda spark, sf, g=_gran: X.period_breakdown(T.bookings(spark, sf), START, END, g))

query("channel_performance", oracle("bookings", f"""
  SELECT channel, count(*) AS total_bookings, round_even(count(*) FILTER ({COMMIT}) / count(*), 3) AS completion_rate,
    {money(where="payment_status = 'Paid'")} AS revenue_idr FROM bookings WHERE {_BOOKED} GROUP BY 1"""))(
    lambda spark, sf: X.channel_performance(T.bookings(spark, sf), START, END))

query("booking_count", oracle("bookings", f"""
  SELECT count(*) AS booking_count FROM bookings WHERE {COMMIT} AND {_BOOKED}"""))(
    lambda spark, sf: X.booking_count(T.bookings(spark, sf), START, END))

query("churn_bucket_distribution", oracle("churn_scores", """
  SELECT risk_bucket, count(*) AS customers FROM churn_scores GROUP BY 1"""))(
    lambda spark, sf: X.churn_buckets(T.churn_scores(spark, sf)))

query("top_destinations", oracle("bookings", f"""
  SELECT destination_name AS destination, count(*) AS bookings, {money()} AS revenue_idr FROM bookings
  WHERE {COMMIT} AND {_BOOKED} GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 5"""))(
    lambda spark, sf: X.top_destinations(T.bookings(spark, sf), START, END, 5, T.homes(spark, sf)))

query("top_customers_in_period", oracle("bookings", f"""
  SELECT customer_id, arg_min(customer_name, (booking_date, booking_id)) AS customer_name,
    arg_min(customer_segment, (booking_date, booking_id)) AS segment, {money()} AS total_spent_idr,
    count(*) AS booking_count FROM bookings WHERE {COMMIT_PAID} AND {_BOOKED}
  GROUP BY 1 ORDER BY total_spent_idr DESC, customer_id LIMIT 25"""))(
    lambda spark, sf: X.top_customers(T.bookings(spark, sf), START, END, 25, T.people(spark, sf)))

_NOW, _BEFORE = span("booking_date", YEAR_START, YEAR_END), span("booking_date", "1996-01-02", "1996-12-31")

query("period_comparison", oracle("bookings", f"""
  SELECT metric, current, previous, round(current - previous, 2) AS change,
    CASE WHEN previous <> 0 THEN round_even((current - previous) / previous * 100, 2) END AS change_pct
  FROM (SELECT 'revenue_idr' AS metric, {money(where=f"{COMMIT_PAID} AND {_NOW}")} AS current,
      {money(where=f"{COMMIT_PAID} AND {_BEFORE}")} AS previous FROM bookings
    UNION ALL SELECT 'booking_count', CAST(count(*) FILTER ({COMMIT} AND {_NOW}) AS DOUBLE),
      CAST(count(*) FILTER ({COMMIT} AND {_BEFORE}) AS DOUBLE) FROM bookings)"""))(
    lambda spark, sf: X.period_comparison(T.bookings(spark, sf), YEAR_START, YEAR_END))

query("shifted_totals", oracle("bookings", f"""
  SELECT {money(where=_NOW)} AS total_idr, {money(where=_BEFORE)} AS previous_idr,
    {money(where=span('booking_date', '1996-01-02', '1996-12-31'))} AS last_year_idr
  FROM bookings WHERE {COMMIT_PAID}"""))(
    lambda spark, sf: X.shifted_totals(T.bookings(spark, sf), YEAR_START, YEAR_END))

query("monthly_revenue_trend", oracle("bookings", f"""
  SELECT strftime(m, '%Y-%m') AS period, revenue_idr, booking_count FROM (
    SELECT date_trunc('month', booking_date) AS m, {money()} AS revenue_idr, count(*) AS booking_count FROM bookings
    WHERE {COMMIT_PAID} AND {_BOOKED} GROUP BY 1 ORDER BY 1 DESC LIMIT 24)"""))(
    lambda spark, sf: X.monthly_trend(T.bookings(spark, sf), START, END))

query("booking_value_distribution", oracle("bookings", f"""
  SELECT count(total_price_idr) AS total_bookings, {', '.join(
      f"round(quantile_cont(total_price_idr, {p}), 4) AS {n}" for n, p in
      (("min_idr", 0.0), ("p25_idr", 0.25), ("median_idr", 0.5), ("p75_idr", 0.75), ("p95_idr", 0.95), ("max_idr", 1.0)))}
  FROM bookings WHERE {COMMIT} AND {_BOOKED}"""))(
    lambda spark, sf: X.value_distribution(T.bookings(spark, sf), START, END))

query("segment_composition", oracle("customers", """
  SELECT segment, count(*) AS customers, round(quantile_cont(total_spent_idr, 0.5), 4) AS median_spend_idr
  FROM customers GROUP BY 1"""))(lambda spark, sf: X.segment_composition(T.customers(spark, sf)))

query("data_quality_snapshot", oracle("bookings customers", """
  SELECT total_bookings, (SELECT count(*) FROM customers) AS total_customers, organic_bookings_no_campaign,
    round_even(organic_bookings_no_campaign / total_bookings, 3) AS organic_share
  FROM (SELECT count(*) AS total_bookings, count(*) FILTER (campaign_id IS NULL) AS organic_bookings_no_campaign
    FROM bookings)"""))(lambda spark, sf: X.quality_snapshot(T.bookings(spark, sf), T.customers(spark, sf)))
