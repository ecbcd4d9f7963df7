"""Readers, audits, profiles, sinks, catalogue and streams."""

import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import bookings, pairs, ts
from tidemark.functions.keywords import METRIC_WORDS
from tidemark.operators import inventory as I
from tidemark.operators import profiles as P
from tidemark.operators import quality as QA
from tidemark.plans import catalog
from tidemark.sources import readers as RD
from tidemark.sources import sinks
from tidemark.streaming import events as E
from tidemark.streaming import jobs as J
from tidemark.streaming import limits as L


def test_dates_in_every_format(spark):
    cases = {"1704153600000": "2024-01-02", "2024-01-02": "2024-01-02", "2024-01-02T03:04:05Z": "2024-01-02T03:04:05",
             "01/02/2024": "2024-01-02", "13/02/2024": "2024-02-13", "2 Jan 2024": "2024-01-02", "January 2, 2024": "2024-01-02",
             "31.12.2023": "2023-12-31", "02/01/2024 10:30": "2024-02-01T10:30:00", "nope": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "d string")
    got = {r["d"]: r["p"] for r in df.select("d", RD.parse_date("d").alias("p")).collect()}
    assert got == {k: ts(v) if v else None for k, v in cases.items()}


def test_too_many_bad_dates_stop_the_job(spark):
    good = [("2024-01-02",)] * 96
    assert RD.parse_dates(spark.createDataFrame(good + [("x",)] * 4, "d string"), ["d"]).where("d IS NULL").count() == 4
    with pytest.raises(ValueError):
        RD.parse_dates(spark.createDataFrame(good + [("x",)] * 6, "d string"), ["d"])


def test_export_is_unwrapped_and_flattened(spark, tmp_path):
    records = [{"_id": {"$oid": "a" * 24}, "d": {"$date": "2024-01-02T00:00:00Z"}, "aspects": {"hotel": 4, "more": {"x": {"$numberLong": "7"}}},
                "list": [{"$oid": "b"}]},
               {"_id": {"$oid": "c" * 24}, "d": {"$date": "2024-01-03T00:00:00Z"}, "aspects": None, "list": []}]
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, records)))
    (tmp_path / "array.json").write_text(json.dumps(records))
    for name, lines in (("lines.json", True), ("array.json", False)):
        df = RD.read_export(spark, str(tmp_path / name), lines=lines)
        assert set(df.columns) == {"_id", "d", "aspects_hotel", "aspects_more_x", "list"}
        row = df.orderBy("_id").first()
        assert (row["_id"], row["aspects_hotel"], row["aspects_more_x"], row["list"]) == ("a" * 24, 4, "7", ["b"])


def test_record_file_checks(spark, tmp_path):
    (tmp_path / "ok.json").write_text(json.dumps([{"id": "1", "text": "x"}]))
    (tmp_path / "gap.json").write_text(json.dumps([{"id": "1", "text": ""}]))
    assert "updated_at" in RD.load_records(spark, str(tmp_path / "ok.json"), "id string, text string", ["id", "text"], "2024-01-01").columns
    with pytest.raises(ValueError):
        RD.load_records(spark, str(tmp_path / "gap.json"), "id string, text string", ["id", "text"], "2024-01-01")


def test_numbers_defaults_and_codes(spark):
    df = spark.createDataFrame([("BK-0007", "1.5"), ("x", "n/a"), (None, None)], "code string, n string")
    assert pairs(df.select(RD.to_number("n").alias("n")), "n") == [(1.5,), (None,), (None,)]
    assert RD.next_number(df, "code", "BK").first()[0] == 8 and RD.next_number(df.where("false"), "code", "BK").first()[0] == 1
    assert pairs(RD.with_defaults(df, {"code": "-", "extra": 3}), "code", "extra")[2] == ("-", 3)


def test_audits_count_planted_defects(spark):
    df = spark.createDataFrame([("5", "a", "x"), ("-1", "b", "x"), ("oops", "z", "y"), ("99", None, "x"), (None, "a", None)], "n string, c string, k string")
    got = {(r["column_name"], r["issue"]): r["rows"] for part in (
        QA.audit_numeric(df, {"n": (0, 10)}), QA.audit_category(df, {"c": ["a", "b"]}), QA.audit_duplicates(df, "k"), QA.audit_nulls(df, ["c"]))
        for r in part.collect()}
    assert got == {("n", "coerced_to_null"): 1, ("n", "negative"): 1, ("n", "out_of_domain"): 1, ("c", "unknown_category"): 1,
                   ("k", "duplicate"): 2, ("c", "missing"): 1}
    assert [r[0] for r in QA.clean_numeric(df, {"n": (0, 10)}).select("n").collect()] == [5.0, None, None, None, None]


def test_consistency_and_repair(spark):
    rows = [(ts("2024-01-01"), ts("2024-01-05"), ts("2024-01-08"), 3, 100.0, 10.0, 5.0, 95.0),
            (ts("2024-01-06"), ts("2024-01-05"), ts("2024-01-08"), 9, 100.0, 10.0, 5.0, 99.0),
            (ts("2024-01-01"), ts("2024-01-05"), ts("2024-01-04"), 1, 100.0, 10.0, 5.0, 95.5)]
    df = spark.createDataFrame(rows, "booking_date timestamp, travel_date timestamp, return_date timestamp, nights int, base_price_idr double,"
                                     " discount_idr double, tax_idr double, total_price_idr double")
    assert [r["rows"] for r in QA.audit_consistency(df).collect()] == [1, 1, 2, 1]
    assert [r["nights"] for r in QA.repair_nights(df).collect()] == [3, 3, 1]


def test_parity(spark):
    a = spark.createDataFrame([(i, i / 10) for i in range(10)], "customer_id int, churn_proba double")
    b = a.where("customer_id < 9").withColumn("churn_proba", F.col("churn_proba") + F.when(F.col("customer_id") == 3, 0.2).otherwise(0.0))
    summary, worst = QA.score_parity(a, b)
    assert tuple(summary.first()) == (9, 0.9, 0.2, round(0.2 / 9, 6), 1) and worst.first()["customer_id"] == 3


def test_profiles(spark):
    b = bookings(spark, [{"booking_date": "2024-01-01", "channel": "a"}, {"booking_date": "2024-01-15", "channel": "a"},
                         {"booking_date": "2024-01-10", "channel": None}])
    assert pairs(P.category_share(b, "channel"), "channel", "share") == [("a", 1.0)]
    monday = P.seasonal_volume(b).where("weekday = 0").first()
    assert (monday["days"], monday["mean_bookings"]) == (3, round(2 / 3, 6))
    texts = spark.createDataFrame([(i, "hot" if i % 3 else "cold", f"t{i}") for i in range(900)], "id int, g string, t string")
    counts = dict(pairs(P.text_sample(texts, "t", "g", "id", 50).groupBy("g").count(), "g", "count"))
    assert counts == {"hot": 50, "cold": 50}


def test_popularity_keeps_both_sides(spark):
    master = spark.createDataFrame([("Bali", 9.0), ("Komodo", 5.0)], "name string, popularity_score double")
    b = bookings(spark, [{"destination_name": "Bali"}, {"destination_name": "Bromo"}])
    assert pairs(I.popularity(master, b, "2024-01-01", "2024-01-01"), "destination_name", "popularity_score", "actual_booking_count") == [
        ("Bali", 9.0, 1), ("Bromo", 0.0, 1), ("Komodo", 5.0, 0)]


def test_upsert_mirror_and_append(spark, tmp_path):
    base = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    assert pairs(sinks.upserted(None, rows((1, "a")), ["k"]), "k", "v") == [(1, "a")]
    table = sinks.saved(rows((1, "a"), (2, "b")), base)
    table = sinks.saved(sinks.upserted(table, rows((2, "B"), (3, "c")), ["k"]), base)
    assert sorted(pairs(table, "k", "v")) == [(1, "a"), (2, "B"), (3, "c")]
    assert tuple(sinks.mirror_counts(table, rows((3, "C"), (4, "d")), ["k"]).first()) == (1, 1, 2)
    table = sinks.saved(rows((3, "C"), (4, "d")), base)
    assert len(list((tmp_path / "t").iterdir())) == 3  # earlier folders stay as they were
    log = sinks.saved(table.withColumn("tag", F.lit("one")), base)
    for _ in range(2):
        log = sinks.saved(sinks.appended(log, rows((5, "e")).withColumn("tag", F.lit("two"))), base)
    assert sorted(pairs(log, "k", "tag")) == [(3, "one"), (4, "one"), (5, "two")]
    assert sinks.appended(log, log.where("false")).count() == 3
    assert sinks.appended(log, log.where("k = 5").withColumn("tag", F.lit(None).cast("string"))).count() == 4


def test_latest_run_and_backlog(spark):
    runs = spark.createDataFrame([("j", "2024-01-01", 0.7, True), ("j", "2024-02-01", 0.6, False), ("k", "2025-01-01", 0.9, True)],
                                 "job string, ran_at string, auc double, deployed boolean")
    assert sinks.latest_run(runs, "j").first()["auc"] == 0.7 and sinks.latest_run(runs, "none").count() == 0
    gated = spark.createDataFrame([("q1", 0.1, "not_found"), ("q2", 0.9, "answer")], "text string, top_score double, response_type string")
    assert pairs(sinks.unanswered(gated, "2024-01-01"), "question") == [("q1",)]


def test_wide_export(spark, tmp_path):
    f = spark.createDataFrame([("2024-01-01", "monthly", 1.0), ("2024-01-01", "weekly", 2.0), ("2024-01-08", "weekly", 3.0)],
                              "period string, horizon string, forecast_idr double")
    sinks.export_csv(sinks.wide_forecast(f).coalesce(1), str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv")).orderBy("period").collect()
    assert [tuple(r) for r in back] == [("2024-01-01", "1.0", "2.0"), ("2024-01-08", None, "3.0")]


def test_rollup_and_codes(spark):
    people = spark.createDataFrame([("c1", 0), ("c2", 5)], "customer_id string, total_trips int")
    b = bookings(spark, [{"customer_id": "c1"}, {"customer_id": "c1", "status": "Confirmed"}, {"customer_id": "c2", "status": "Cancelled"}])
    got = pairs(sinks.with_rollup(people, sinks.customer_rollup(b)).orderBy("customer_id"), "customer_id", "total_trips", "is_repeat_customer")
    assert got == [("c1", 2, True), ("c2", 0, False)]


def test_catalogue(spark):
    assert len(catalog.ENTRIES) == 38 and set(catalog.BY_ID) == set(METRIC_WORDS)
    t = {"bookings": bookings(spark, [{}])}
    assert catalog.run("booking_volume", t, start="2024-01-01", end="2024-01-02").count() == 2
    with pytest.raises(KeyError):
        catalog.run("nope", t)
    with pytest.raises(TypeError):
        catalog.run("customer_search", t)
    out = catalog.run_selected(["customer_age_distribution", "bad id", "booking_status_summary", "booking_volume"], t,
                               start="2024-01-01", end="2024-01-02")
    assert [o.id for o in out] == ["customer_age_distribution", "bad id", "booking_status_summary", "booking_volume"]
    assert all(isinstance(o.error, KeyError) and o.act(lambda p: p.count()) == (None, o.error) for o in out[:2])
    assert [o.act(lambda p: p.count())[0] for o in out[2:]] == [1, 2]
    broken = catalog.Outcome("x", t["bookings"].selectExpr("raise_error('no')"))
    result, error = broken.act(lambda p: p.collect())
    assert result is None and "no" in str(error)


def hits(spark, n=1500, seed=4):
    """One key has a third of all hits."""
    rng = np.random.default_rng(seed)
    rows = [(i, "hot" if rng.random() < 0.34 else f"k{int(rng.integers(0, 20))}", int(t)) for i, t in enumerate(rng.integers(0, 6000, n))]
    return rows, spark.createDataFrame(rows, "event_id int, user string, s long").select("event_id", "user", F.timestamp_seconds("s").alias("ts"))


def greedy(rows, limit, seconds):
    kept, out = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        live = [u for u in kept.get(k, []) if u >= t - seconds]
        out[i] = len(live) < limit
        kept[k] = live + ([t] if out[i] else [])
    return out


def test_rate_limit_batch_equals_brute_force(spark):
    rows, df = hits(spark)
    got = dict(pairs(L.rate_limit(df, "user", "event_id", limit=5, seconds=60), "event_id", "accepted"))
    assert got == greedy(rows, 5, 60)


def test_rate_limit_over_micro_batches_equals_one_batch(spark, tmp_path):
    rows, df = hits(spark, 600)
    ordered = sorted(rows, key=lambda r: (r[2], r[0]))
    cuts = [ordered[i][2] for i in (200, 400)]
    at = F.unix_micros("ts") / 1_000_000 if dict(df.dtypes)["ts"] == "timestamp" else F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    first = df.agg(F.min(at)).first()[0] - min(r[2] for r in rows)
    parts = [at - first < cuts[0], (at - first >= cuts[0]) & (at - first < cuts[1]), at - first >= cuts[1]]
    write = J.limit_writer(str(tmp_path / "out"), "user", "event_id", limit=5, seconds=60)
    for number, part in enumerate(parts):
        write(df.where(part), number)
    write(df.where(parts[1]), 1)  # replayed
    got = dict(pairs(spark.read.parquet(str(tmp_path / "out")), "event_id", "accepted"))
    assert got == greedy(rows, 5, 60)


@pytest.mark.parametrize("segment", [60, 150])
def test_segments_agree_with_one_pass(spark, segment):
    """One key with most rows and no pause, so its segments depend on each other."""
    rng = np.random.default_rng(segment)
    rows = [(i, "hot" if rng.random() < 0.8 else f"u{i % 5}", float(t)) for i, t in enumerate(np.sort(rng.integers(0, 500, 350)))]
    df = spark.createDataFrame([(i, u, ts("2024-01-01") + timedelta(seconds=t)) for i, u, t in rows], "event_id int, user string, ts timestamp").repartition(3)
    got = dict(pairs(L.rate_limit(df, "user", "event_id", limit=4, seconds=30, segment=segment), "event_id", "accepted"))
    assert got == greedy(rows, 4, 30)


def test_hits_in_window(spark):
    rows, df = hits(spark, 400)
    got = dict(pairs(L.hits_in_window(df, "user", seconds=60), "event_id", "hits"))
    assert got == {i: sum(1 for _, k2, u in rows if k2 == k and t - 60 <= u <= t) for i, k, t in rows}


def test_budget_with_amounts(spark):
    df = spark.createDataFrame([(i, ts("2024-01-01") + timedelta(minutes=i), 2) for i in range(10)], "event_id int, ts timestamp, amount int")
    assert L.running_budget(df, amount="amount", budget=7).count() == 3
    assert L.running_budget(df, budget=7).count() == 7


def test_refused_amounts_consume_nothing(spark):
    rng = np.random.default_rng(2)
    rows = [(i, ts("2024-01-01") + timedelta(minutes=37 * i), float(a)) for i, a in enumerate(rng.choice([0.25, 1, 3, 6, 12], 200))] + [(900, None, 2.0), (901, ts("2024-01-01"), None)]
    df = spark.createDataFrame(rows, "event_id int, ts timestamp, amount double")
    want, spent = set(), {}
    for i, t, a in sorted(rows, key=lambda r: (str(r[1]), r[0])):
        day = t and t.date()
        if spent.get(day, 0.0) + (a or 0.0) <= 10:
            spent[day] = spent.get(day, 0.0) + (a or 0.0)
            want.add(i)
    for segment in (200_000, 30):
        got = L.running_budget(df, amount="amount", budget=10, segment=segment).collect()
        assert {r["event_id"] for r in got} == want and all(r["spent"] <= 10 for r in got)
    three = spark.createDataFrame([(i, ts("2024-01-01") + timedelta(minutes=i), a) for i, a in enumerate([6, 6, 4])], "event_id int, ts timestamp, amount int")
    assert {r["event_id"] for r in L.running_budget(three, amount="amount", budget=10).collect()} == {0, 2}


def test_limits_keep_null_keys_and_times(spark):
    rows = [(1, None, ts("2024-01-01")), (2, None, ts("2024-01-01") + timedelta(seconds=1)), (3, "a", None), (4, "a", ts("2024-01-01")), (5, None, None)]
    df = spark.createDataFrame(rows, "event_id int, user string, ts timestamp")
    got = {r["event_id"]: r["accepted"] for r in L.rate_limit(df, "user", "event_id", limit=1).collect()}
    assert got == {1: True, 2: False, 3: None, 4: True, 5: None}


def test_batch_dedup_of_questions_follows_the_ttl(spark):
    at = ts("2024-01-01")
    rows = [("Hi?", at), ("hi?", at + timedelta(minutes=59)), ("hi?", at + timedelta(minutes=60)), ("hi?", at + timedelta(days=4)), (None, at), (None, at + timedelta(minutes=1)), ("other", at)]
    df = spark.createDataFrame(rows, "text string, asked_at timestamp")
    got = sorted(((r["text"] or "").lower(), (r["asked_at"] - at).total_seconds() / 60) for r in E.distinct_questions(df).collect())
    assert got == [("", 0.0), ("hi?", 0.0), ("hi?", 60.0), ("hi?", 4 * 24 * 60.0), ("other", 0.0)]


def split_files(spark, df, folder, parts):
    for i, part in enumerate(parts):
        df.where(part).coalesce(1).write.parquet(str(folder / f"f{i}"))


def test_rollup_stream_equals_batch_and_survives_replay(spark, tmp_path):
    b = bookings(spark, [{"customer_id": f"c{i % 5}", "total_price_idr": float(i)} for i in range(40)])
    slim = b.select("booking_id", "customer_id", "total_price_idr", "booking_date")
    split_files(spark, slim, tmp_path, ["booking_id < 20", "booking_id >= 20"])
    target = str(tmp_path / "roll")
    write = J.rollup_writer(target)
    stream = spark.readStream.schema(slim.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/f*")
    J.run_batches(stream, write, str(tmp_path / "job"))
    write(slim.where("booking_id >= 20"), 1)  # replayed
    got = pairs(J.rollup_of(spark, target).orderBy("customer_id"), "customer_id", "total_trips", "total_spent_idr")
    want = pairs(sinks.customer_rollup(b).orderBy("customer_id"), "customer_id", "total_trips", "total_spent_idr")
    assert got == want


def test_budget_stream_over_batches(spark, tmp_path):
    rows = spark.createDataFrame([(i, ts("2024-01-01") + timedelta(hours=i)) for i in range(48)], "event_id int, ts timestamp")
    split_files(spark, rows, tmp_path, ["event_id < 10", "event_id >= 10"])
    target = str(tmp_path / "budget")
    write = J.budget_writer(target, "ts", "event_id", 15)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/f*")
    J.run_batches(stream, write, str(tmp_path / "job"))
    for _ in range(2):
        assert sorted(r[0] for r in spark.read.parquet(target).select("event_id").collect()) == list(range(15)) + list(range(24, 39))
        write(rows.where("event_id >= 10"), 1)  # replayed


def test_late_rows_are_set_aside(spark, tmp_path):
    at = lambda h: datetime(2024, 1, 1, h)
    first = spark.createDataFrame([(1, at(10)), (2, at(12))], "event_id int, ts timestamp")
    second = spark.createDataFrame([(3, at(13)), (4, at(11)), (5, at(8))], "event_id int, ts timestamp")
    write = J.late_splitter(str(tmp_path), "ts", 3600)
    write(first, 0)
    write(second, 1)
    write(second, 1)
    rows = spark.read.parquet(f"{tmp_path}/rows")
    assert sorted(pairs(rows, "event_id", "is_late", "batch")) == [(1, False, 0), (2, False, 0), (3, False, 1), (4, False, 1), (5, True, 1)]


def test_windowed_operators_on_batch_input(spark):
    df = spark.createDataFrame([("u", ts("2024-01-01T00:00:00"), 1.0), ("u", ts("2024-01-01T00:20:00"), 2.0), ("u", ts("2024-01-01T01:00:00"), 3.0)],
                               "user string, ts timestamp, value double")
    assert E.sessions(df, "user").count() == 2
    assert E.revenue_tumbling(df, "user").first()["revenue"] == 6.0
    assert E.activity_sliding(df, "user").count() == 4
