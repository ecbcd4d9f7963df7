"""Cross-cutting rules on hand-made edge rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from helpers import bookings, pairs, ts
from tidemark.functions import semantics as S
from tidemark.operators import bookings as B
from tidemark.operators import facts as X
from tidemark.operators import revenue as R


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_range_ends_are_inclusive_days(spark):
    b = bookings(spark, [{"created_at": "2024-01-31T23:59:59.999000"}, {"created_at": "2024-02-01T00:00:00"},
                         {"created_at": "2024-01-01T00:00:00"}, {"created_at": "2023-12-31T23:59:59"}])
    assert B.status_summary(b, "2024-01-01", "2024-01-31").first()["booking_count"] == 2


def test_range_filter_reaches_the_parquet_reader(spark, tmp_path, capsys):
    bookings(spark, [{"created_at": "2024-01-31"}]).write.parquet(str(tmp_path / "b"))
    b = spark.read.parquet(str(tmp_path / "b"))
    R.by_key(b, "2024-01-01", "2024-01-31", "channel").explain("formatted")
    lines = capsys.readouterr().out.splitlines()
    pushed = next(line for line in lines if line.startswith("PushedFilters"))
    assert "GreaterThanOrEqual(created_at" in pushed and "LessThan(created_at" in pushed and "EqualTo(status" in pushed
    assert "destination_name" not in next(line for line in lines if line.startswith("ReadSchema"))


def test_three_revenue_definitions_differ(spark):
    rows = [{"status": s, "payment_status": p, "total_price_idr": float(10 ** i)} for i, (s, p) in enumerate(
        (s, p) for s in ("Completed", "Confirmed", "Cancelled") for p in ("Paid", "Unpaid"))]
    b = bookings(spark, rows)
    total = lambda c: b.where(c).agg(S.money_sum("total_price_idr")).first()[0]
    assert total(S.realised()) == 1.0
    assert total(S.committed_paid()) == 101.0
    assert total(S.committed()) == 1111.0


def test_missing_keys_make_one_unknown_row(spark):
    b = bookings(spark, [{"channel": None}, {"channel": ""}, {"channel": "Unknown"}, {"channel": "Web"}])
    got = dict(pairs(R.by_key(b, "2024-01-01", "2024-01-01", "channel"), "channel", "booking_count"))
    assert got == {"Unknown": 3, "Web": 1}


def test_null_amounts_and_empty_ranges(spark):
    b = bookings(spark, [{"total_price_idr": None}, {"total_price_idr": 5.0}])
    assert X.revenue_total(b, "2024-01-01", "2024-01-01").first()[0] == 5.0
    assert X.revenue_total(b, "2030-01-01", "2030-01-02").first()[0] == 0.0
    assert B.cancellation_rate(b, "2030-01-01", "2030-01-02").first().asDict() == {
        "total_bookings": 0, "cancelled_bookings": 0, "cancellation_rate": 0.0}
    assert R.by_key(b, "2030-01-01", "2030-01-02", "channel").count() == 0
    assert R.discount_impact(b.withColumn("discount_idr", F.lit(None).cast("double")), "2030-01-01", "2030-01-01").first()[2] == 0.0


def test_daily_series_fill_gaps_and_period_series_do_not(spark):
    b = bookings(spark, [{"created_at": "2024-01-01"}, {"created_at": "2024-01-05T10:00:00"}])
    assert pairs(R.daily(b, "2024-01-01", "2024-01-05"), "revenue") == [(100.0,), (0.0,), (0.0,), (0.0,), (100.0,)]
    assert R.by_period(b, "2024-01-01", "2024-01-05", "daily").count() == 2


def test_iso_week_labels(spark):
    days = [date(2024, 12, 30), date(2021, 1, 3), date(2020, 12, 31)]
    rows = spark.createDataFrame([(d,) for d in days], "d date").select(S.period_label(F.col("d"), "weekly")).collect()
    assert [r[0] for r in rows] == ["2025-W01", "2020-W53", "2020-W53"]


def test_days_are_elapsed_not_calendar(spark):
    df = spark.createDataFrame([(ts("2024-01-02T01:00:00"), ts("2024-01-01T23:00:00"))], "a timestamp, b timestamp")
    assert df.select(S.whole_days("a", "b")).first()[0] == 0
    assert df.select(S.whole_days("b", "a")).first()[0] == -1


def test_lead_time_extremes_cut_toward_zero(spark):
    b = bookings(spark, [{"booking_date": "2024-01-02T00:00:00"}, {"booking_date": "2024-01-01T00:00:00"}])
    b = b.withColumn("travel_date", F.lit(ts("2024-01-01T12:00:00")))
    assert tuple(B.lead_time(b, "2024-01-01", "2024-01-03").first()) == (0.0, 0, 0)


def test_growth_modes(spark):
    r = one(spark, S.growth_vs_positive_base(F.lit(5.0), F.lit(0.0)), S.growth_vs_positive_base(F.lit(5.0), F.lit(-4.0)),
            S.growth_vs_nonzero_base(F.lit(5.0), F.lit(0.0)), S.growth_vs_nonzero_base(F.lit(6.0), F.lit(-4.0)),
            S.growth_vs_positive_base(F.lit(110.0), F.lit(100.0)))
    assert tuple(r) == (None, None, None, -250.0, 10.0)


def test_ties_are_ordered_by_key(spark):
    b = bookings(spark, [{"channel": c} for c in "dbca"])
    assert [r[0] for r in R.by_key(b, "2024-01-01", "2024-01-01", "channel").collect()] == ["a", "b", "c", "d"]


def test_current_revenue_has_no_upper_bound(spark):
    b = bookings(spark, [{"created_at": d} for d in ("2024-05-17", "2024-05-10", "2024-05-09", "2024-05-01", "2024-01-01", "2025-01-01")])
    assert tuple(R.current(b, "2024-05-17").first()) == (200.0, 300.0, 500.0, 600.0)


def test_facets_sum_to_the_total(spark):
    b = bookings(spark, [{"channel": c, "destination_name": d} for c in ("Web", None) for d in ("Bali", "Bromo", "Jakarta")])
    facets = R.facets(b, "2024-01-01", "2024-01-01")
    sums = facets.groupBy("facet").agg(F.sum("revenue").alias("r")).collect()
    assert len(sums) == 5 and {r["r"] for r in sums} == {600.0}


def test_previous_period_and_spans():
    assert S.previous_period("2024-03-01", "2024-03-31") == (date(2024, 1, 30), date(2024, 2, 29))
    assert [S.granularity_for_span(n) for n in (1, 30, 31, 84, 85)] == ["daily", "daily", "weekly", "weekly", "monthly"]
    with pytest.raises(ValueError):
        S.checked_range("2024-02-01", "2024-01-01")


def test_horizon_rank(spark):
    df = spark.createDataFrame([("daily",), ("weekly",), ("monthly",), ("yearly",)], "h string")
    order = lambda first, days: [r["h"] for r in df.withColumn("r", S.horizon_rank(F.col("h"), first, days)).where("r IS NOT NULL").orderBy("r").collect()]
    assert order("monthly", 10) == ["monthly", "daily", "weekly"]
    assert order("daily", 60) == ["daily", "weekly", "monthly"]
    assert order("monthly", 200) == ["monthly"] and order("weekly", 200) == ["weekly", "monthly"]


def test_overlap_fraction(spark):
    d = lambda s: F.lit(date.fromisoformat(s))
    f = lambda *a: one(spark, S.overlap_fraction(*[d(x) for x in a]))[0]
    assert f("2024-02-01", "2024-02-29", "2024-02-15", "2024-03-15") == 15 / 29
    assert f("2024-02-01", "2024-02-29", "2024-03-01", "2024-03-15") == 0.0
    assert f("2024-02-01", "2024-02-29", "2024-01-01", "2024-12-31") == 1.0


def test_small_scalar_rules(spark):
    r = one(spark, S.code_number(F.lit("BK-000123"), "BK"), S.code_number(F.lit("nope"), "BK"), S.email_domain(F.lit("a@b.co")),
            S.email_domain(F.lit("broken")), S.clean_input(F.lit(" a\u0000b\tc\n ")), S.object_id(F.lit("x" * 24)),
            S.object_id(F.lit("a" * 24)), S.risk_bucket(F.lit(0.75)), S.risk_bucket(F.lit(0.4999)), S.age_band(F.lit(25)),
            S.rating_sentiment(F.lit(3)), S.trimmed_period_label(F.lit("2024-05-01"), "monthly"))
    assert tuple(r) == (123, None, "b.co", None, "ab\tc", None, "a" * 24, "Very High", "Medium", "18-25", "Neutral", "2024-05")


def test_comparison_and_shifted_totals(spark):
    b = bookings(spark, [{"booking_date": "2024-02-10", "total_price_idr": 300.0}, {"booking_date": "2024-01-20", "total_price_idr": 200.0},
                         {"booking_date": "2023-02-10", "total_price_idr": 100.0},
                         {"booking_date": "2024-02-11", "payment_status": "Unpaid"}])
    got = {r["metric"]: r.asDict() for r in X.period_comparison(b, "2024-02-01", "2024-02-28").collect()}
    assert got["revenue_idr"]["change_pct"] == 50.0 and got["booking_count"]["current"] == 2.0
    assert tuple(X.shifted_totals(b, "2024-02-01", "2024-02-28").first()) == (300.0, 200.0, 100.0)


def test_top_customers_named_by_earliest_booking(spark):
    b = bookings(spark, [{"booking_date": "2024-01-05", "customer_name": "New"}, {"booking_date": "2024-01-02", "customer_name": "Old"}])
    row = X.top_customers(b, "2024-01-01", "2024-01-31", 99).first()
    assert (row["customer_name"], row["booking_count"]) == ("Old", 2)


def test_by_dimension_equals_by_key(spark):
    """Half of the bookings belong to one customer, one customer is unknown to the other table."""
    b = bookings(spark, [{"customer_id": "hot" if i % 2 else f"c{i % 7}", "total_price_idr": i + 0.25,
                          "destination_name": None if i % 14 == 0 and i % 2 == 0 else "D" + ("hot" if i % 2 else str(i % 7))} for i in range(70)])
    homes = spark.createDataFrame([("hot", "Dhot")] + [(f"c{k}", f"D{k}") for k in range(1, 7)], "customer_id string, home string")
    got = pairs(R.by_dimension(b, homes, "customer_id", "2024-01-01", "2024-01-01", "home"), "home", "revenue", "booking_count")
    assert got == pairs(R.by_key(b, "2024-01-01", "2024-01-01", "destination_name"), "destination_name", "revenue", "booking_count")


def test_sums_before_the_join_equal_joined_rows(spark):
    """Names in another table: unknown customers, customers without a name, one with most bookings."""
    rows = [{"customer_id": c, "total_price_idr": 10.0 + i, "booking_date": f"2024-01-{1 + i % 28:02d}", "channel": "Web" if i % 3 else None} for i, c in enumerate(["hot"] * 30 + ["a", "b", "c", "d", "a"])]
    b = bookings(spark, rows)
    homes = spark.createDataFrame([("hot", "Bali", "Gold"), ("a", "Bali", "Silver"), ("b", "", "Gold"), ("c", "Lombok", None)], "customer_id string, destination_name string, customer_segment string")
    joined = b.drop("destination_name", "customer_segment").join(homes, "customer_id", "left")
    slim = b.drop("destination_name", "customer_segment", "customer_name")
    span = ("2024-01-01", "2024-12-31")
    same = lambda one, other: sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect())) != []
    columns = {"destination": "destination_name", "channel": "channel", "segment": "customer_segment"}
    assert same(R.facets(slim, *span, columns, dimension=homes), R.facets(joined, *span, columns))
    assert same(R.facets(slim, *span, {"destination": "destination_name"}, dimension=homes), R.facets(joined, *span, {"destination": "destination_name"}))
    assert same(R.by_dimension(slim, homes, "customer_id", *span, "destination_name"), R.by_key(joined, *span, "destination_name"))
    assert same(X.top_destinations(slim, *span, 9, homes), X.top_destinations(joined, *span, 9))
    people = spark.createDataFrame([("hot", "H", "Gold"), ("a", "A", "Silver")], "customer_id string, customer_name string, customer_segment string")
    got = X.top_customers(slim, *span, 4, people).collect()
    assert [(r["customer_id"], r["customer_name"], r["booking_count"]) for r in got][:2] == [("hot", "H", 30), ("a", "A", 2)] and len(got) == 4 and got[3]["segment"] is None


def test_customer_type_from_first_dates(spark):
    rows = [{"customer_id": "hot" if i % 3 else f"c{i % 4}", "total_price_idr": 5.0 + i, "booking_date": f"2024-01-{1 + i % 9:02d}"} for i in range(40)]
    b = bookings(spark, rows)
    firsts = b.groupBy("customer_id").agg(F.min("booking_date").alias("first_date")).where("customer_id != 'c1'")
    flagged = b.drop("is_repeat_customer").join(firsts, "customer_id", "left").withColumn("is_repeat_customer", F.col("booking_date") > F.col("first_date"))
    got = R.by_customer_type(b.drop("is_repeat_customer"), "2024-01-01", "2024-12-31", firsts).collect()
    assert got == R.by_customer_type(flagged, "2024-01-01", "2024-12-31").collect() and len(got) == 2
