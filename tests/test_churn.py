"""Features, labels, split, training and the gate on a small table of customers."""

from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import bookings, ts
from tidemark.operators import churn as H
from tidemark.operators import clusters as K
from tidemark.operators import quality as QA
from tidemark.sources import sinks

SNAP = "2024-06-30"


@pytest.fixture(scope="module")
def table(spark):
    return bookings(spark, [
        {"customer_id": "single", "booking_date": "2024-06-01"},
        {"customer_id": "sameday", "booking_date": "2024-05-01T09:00:00"},
        {"customer_id": "sameday", "booking_date": "2024-05-01T18:00:00"},
        {"customer_id": "three", "booking_date": "2024-01-01", "total_price_idr": 10.0},
        {"customer_id": "three", "booking_date": "2024-02-01", "status": "Confirmed", "total_price_idr": 20.0},
        {"customer_id": "three", "booking_date": "2024-03-02", "total_price_idr": None},
        {"customer_id": "three", "booking_date": "2024-03-03", "status": "Cancelled"},
        {"customer_id": "three", "booking_date": "2024-08-01"},
        {"customer_id": "gone", "booking_date": "2024-03-03", "status": "Cancelled"},
        {"customer_id": "slow", "booking_date": "2021-01-01"},
        {"customer_id": "slow", "booking_date": "2024-01-01"},
        {"customer_id": "fast", "booking_date": "2023-01-01"},
        {"customer_id": "fast", "booking_date": "2023-01-11"},
    ])


@pytest.fixture(scope="module")
def reviews(spark):
    rows = [("r1", "three", 5, "Positive", ts("2024-02-01"), (4,)), ("r2", "three", None, None, ts("2024-03-01"), (2,)),
            ("r3", "single", 3, "Neutral", ts("2024-07-15"), (1,))]
    return spark.createDataFrame(rows, "review_id string, customer_id string, rating int, sentiment string, review_date timestamp,"
                                       " aspects struct<value_for_money:int>")


@pytest.fixture(scope="module")
def customers(spark):
    return spark.createDataFrame(
        [("single", 30, "Gold", "Email"), ("three", 41, "Odd", "Walk-in"), ("fast", None, None, None)],
        "customer_id string, age int, segment string, acquisition_channel string")


def by_id(df):
    return {r["customer_id"]: r.asDict() for r in df.collect()}


def test_features(table, reviews, customers):
    f = by_id(H.churn_features(table, reviews, customers, SNAP))
    assert "gone" not in f
    assert f["single"]["avg_interval"] is None and f["single"]["track"] == "single" and f["single"]["recency_days"] == 29
    assert f["sameday"]["avg_interval"] == 0.0 and f["sameday"]["recency_ratio"] is None
    three = f["three"]
    assert three["frequency"] == 3 and three["avg_interval"] == 61 / 2 and three["recency_days"] == 120
    assert three["monetary_total"] == 30.0 and three["monetary_avg"] == 15.0 and three["cancel_rate"] == 0.25
    assert three["recency_ratio"] == pytest.approx(120 / 30.5)
    # The latest review has no rating: the serving rule keeps the null.
    assert three["review_rating"] is None and three["has_review"] == 0 and three["review_sentiment"] == "No Review"
    assert three["aspect_value"] == 3.0
    assert f["single"]["review_sentiment"] == "No Review"


def test_null_policy_skip_takes_the_last_known_value(table, reviews, customers):
    f = by_id(H.churn_features(table, reviews, customers, SNAP, null_policy="skip"))
    assert (f["three"]["review_rating"], f["three"]["review_sentiment"]) == (5, "Positive")


def test_snapshot_day_counts_up_to_midnight(spark):
    b = bookings(spark, [{"booking_date": "2024-06-30T00:00:00"}, {"booking_date": "2024-06-30T00:00:01"}])
    assert H.rfm(b, SNAP).first()["frequency"] == 1


def test_labels(table):
    label = {k: v["label"] for k, v in by_id(H.churn_labels(table, SNAP)).items()}
    assert label == {"single": 1, "sameday": 1, "three": 0, "slow": 0, "fast": 1}


def test_alignment(table, reviews, customers):
    features = H.churn_features(table, reviews, customers, SNAP)
    aligned = H.align_features(features)
    assert aligned.columns[2:] == H.CONTRACT and len(H.CONTRACT) == 33
    rows = by_id(aligned)
    assert rows["single"]["segment_Gold"] == 1 and rows["single"]["acquisition_channel_Email"] == 1
    assert sum(v for k, v in rows["three"].items() if k.startswith("segment_")) == 0
    assert sum(v for k, v in rows["fast"].items() if k.startswith("acquisition_channel_")) == 0
    assert [tuple(r) for r in H.unseen_categories(features).collect()] == [("segment", "Odd", 1)]
    with pytest.raises(ValueError):
        H.align_features(features.drop("age"))
    assert sum(r["rows"] for r in QA.feature_sanity(features).collect()) == 0


def test_split_is_exact_and_stable(spark):
    df = spark.range(1000).select(F.col("id").alias("customer_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    counts = {(r["label"], r["is_test"]): r["count"] for r in H.stratified_split(df).groupBy("label", "is_test").count().collect()}
    assert counts == {(0, True): 180, (0, False): 720, (1, True): 20, (1, False): 80}
    again = H.stratified_split(df.repartition(7)).where("is_test").select("customer_id").collect()
    assert {r[0] for r in again} == {r[0] for r in H.stratified_split(df).where("is_test").select("customer_id").collect()}


def test_auc_equals_pair_counting(spark):
    rng = np.random.default_rng(3)
    rows = [(float(s), int(l)) for s, l in zip(rng.integers(0, 20, 200) / 20, rng.integers(0, 2, 200))]
    got = H.auc(spark.createDataFrame(rows, "churn_proba double, label int")).first()["auc"]
    pos, neg = [s for s, l in rows if l], [s for s, l in rows if not l]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert got == pytest.approx(want, abs=1e-6)


def test_auc_of_many_different_scores_over_many_ranges(spark):
    """Scores that differ in the last digits, ties across ranges, tracks, and a track without one class."""
    rng = np.random.default_rng(4)
    rows = [(f"t{i % 3}", float(0.5 + rng.integers(0, 4000) * 1e-12), int(rng.random() < 0.3)) for i in range(5000)] + [("one", 0.1, 1), ("one", 0.2, 1)]
    df = spark.createDataFrame(rows, "track string, churn_proba double, label int")
    got = {r["track"]: r["auc"] for r in H.auc(df, by="track").collect()}
    for track in ("t0", "t1", "t2"):
        pos, neg = (np.array([s for t, s, l in rows if t == track and l == c]) for c in (1, 0))
        assert got[track] == pytest.approx(np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)), abs=1e-6)
    assert got["one"] is None


def test_trees_split_on_absence(spark):
    """Only whether a value is missing tells the label; its median says nothing."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(600):
        gone = i % 2 == 0
        rows.append((f"c{i}", "single", int(gone), None if gone else float(rng.normal(100, 10)), float(rng.normal())))
    df = spark.createDataFrame(rows, "customer_id string, track string, label int, recency_days double, frequency double")
    contract = ["recency_days", "frequency"]
    model = H.train_churn(df, contract, rounds=3)
    assert H.auc(H.score(model, df, contract, keep=("label",))).first()["auc"] == 1.0
    none = df.withColumn("frequency", F.lit(None).cast("double"))
    assert H.auc(H.score(H.train_churn(none, contract, rounds=2), df, contract, keep=("label",))).first()["auc"] == 1.0


def test_gate():
    assert H.champion_gate(0.7, None).deploy
    assert H.champion_gate(0.70, 0.71).deploy
    assert not H.champion_gate(0.69, 0.71).deploy


def test_ids(spark, table):
    assert H.only_ids(table, ["three"]).count() == 5
    with pytest.raises(ValueError):
        H.only_ids(table, [str(i) for i in range(101)])
    good = spark.createDataFrame([("a" * 24,)], "customer_id string")
    assert H.valid_ids(good).count() == 1
    with pytest.raises(ValueError):
        H.valid_ids(spark.createDataFrame([("short",)], "customer_id string"))


def synthetic(spark, n=160):
    rows = []
    start = ts("2022-01-01")
    for c in range(n):
        for k in range(1 + c % 4):
            rows.append({"customer_id": f"c{c}", "booking_date": (start + timedelta(days=(c * 7 + k * (40 + c % 50)) % 900)).isoformat(),
                         "total_price_idr": 100.0 + c, "status": ("Completed", "Confirmed", "Cancelled")[(c + k) % 3]})
    return bookings(spark, rows)


def test_retrain_round_trip(spark, customers, reviews, tmp_path):
    from pyspark.ml import PipelineModel

    b = synthetic(spark)
    model, record, gate = H.retrain(b, reviews, customers, "2024-06-30", model_path=str(tmp_path / "m"))
    assert gate.deploy and gate.previous is None
    row = record.first()
    assert 0 <= row["auc"] <= 1 and row["deployed"] and row["population"] > 50
    scores = H.rescore_all(PipelineModel.load(str(tmp_path / "m")), b, reviews, customers, "2024-06-30")
    stats = scores.agg(F.min("churn_proba"), F.max("churn_proba"), F.count("*")).first()
    assert 0 <= stats[0] <= stats[1] <= 1 and stats[2] == H.rfm(b, "2024-06-30").count()
    scored, missing = H.predict_churn(model, ["c1", "nobody"], b, reviews, customers, "2024-06-30")
    assert [r[0] for r in missing.collect()] == ["nobody"] and scored.count() == 1
    assert sinks.latest_run(record, "retrain_churn").first()["auc"] == row["auc"]
    assert "AUC" in H.overview_insight(record).first()["text"]


def test_clusters(spark):
    rfm = H.rfm(synthetic(spark), "2024-12-31")
    model = K.fit_clusters(rfm, k=3)
    assigned = K.assign_clusters(model, rfm)
    assert assigned.count() == rfm.count() and set(assigned.columns) == set(rfm.columns) | {"cluster"}
    assert -1 <= K.silhouette(model, rfm) <= 1
    profile = K.cluster_profile(assigned)
    assert profile.agg(F.sum("customers")).first()[0] == rfm.count()


def test_due_to_return_peaks_at_the_usual_interval(spark):
    b = bookings(spark, [{"customer_id": "due", "booking_date": "2024-01-01"}, {"customer_id": "due", "booking_date": "2024-03-31"},
                         {"customer_id": "early", "booking_date": "2024-01-01"}, {"customer_id": "early", "booking_date": "2024-06-28"},
                         {"customer_id": "once", "booking_date": "2024-01-01"}])
    rows = H.due_to_return(b, "2024-06-29").collect()
    assert [r["customer_id"] for r in rows] == ["due", "early"] and rows[0]["weight"] == pytest.approx(1.000001)


def test_rows_without_a_label_stay(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(100)], "customer_id int, label int")
    split = H.stratified_split(df)
    assert split.count() == 100 and split.where("label IS NULL AND is_test").count() == 4
    assert {r["label"]: round(r["weight"], 4) for r in H.balanced_weights(df).collect()} == {None: 2.5, 0: 1.25, 1: 1.25}
