"""Exact quantiles against numpy, with one value holding a third of the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.quantiles import approx_quantiles, quantiles, quantiles_of, values_at_ranks


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    data = []
    for g, n in (("a", 3000), ("b", 7), ("c", 1)):
        values = rng.lognormal(3, 2, n).round(2)
        values[: n // 3] = 12.5
        data += [(g, float(v)) for v in values] + [(g, None)]
    return data, spark.createDataFrame(data, "g string, v double")


def test_grouped_quantiles_equal_numpy(skewed):
    data, df = skewed
    probs = {"lo": 0.0, "q1": 0.25, "q2": 0.5, "q95": 0.95, "hi": 1.0}
    for row in quantiles(df, "v", probs, ["g"]).collect():
        values = [v for g, v in data if g == row["g"] and v is not None]
        assert row["n"] == len(values)
        assert [row[p] for p in probs] == pytest.approx(list(np.quantile(values, list(probs.values()))))


def test_global_quantiles_equal_numpy(skewed):
    data, df = skewed
    row = quantiles(df, "v", {"m": 0.5, "p": 0.9}).first()
    values = [v for _, v in data if v is not None]
    assert (row["m"], row["p"]) == pytest.approx(tuple(np.quantile(values, [0.5, 0.9])))


def test_every_rank_is_found(skewed):
    data, df = skewed
    found = values_at_ranks(df, "v", F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), ["g"])
    got = [r["value"] for r in found.where("g = 'a'").orderBy("rank").collect()]
    assert got == sorted(v for g, v in data if g == "a" and v is not None)


def test_sketch_version_is_close(skewed):
    data, df = skewed
    row = approx_quantiles(df.where("g = 'a'"), "v", {"m": 0.5}).first()
    assert row["m"] == pytest.approx(np.quantile([v for g, v in data if g == "a" and v], 0.5), rel=0.05)


def test_no_rows(skewed):
    assert quantiles(skewed[1].where("g = 'zz'"), "v", {"m": 0.5}, ["g"]).count() == 0


def test_several_measures_of_all_kinds_at_once(spark):
    """Negative numbers, both zeros, infinities, tiny ones, whole numbers, nulls in one measure, a null group."""
    rng = np.random.default_rng(9)
    rows = []
    for g, n in (("a", 2000), (None, 60), ("b", 1)):
        x = np.concatenate([rng.standard_normal(n) * 10.0 ** rng.integers(-300, 300, n), [0.0, -0.0, 5e-324, -5e-324, 1e308]])
        rows += [(g, float(v), int(k), None if g == "b" else float(v)) for v, k in zip(x, rng.integers(-(2**62), 2**62, len(x)))]
    df = spark.createDataFrame(rows, "g string, v double, k long, w double").repartition(4)
    probs = {"v": {"v0": 0.0, "v3": 0.3, "v1": 1.0}, "k": {"k5": 0.5}, "w": {"w9": 0.9}}
    got = {r["g"]: r for r in quantiles_of(df, probs, ["g"]).collect()}
    assert got.keys() == {"a", None, "b"} and got["b"]["n_w"] == 0 and got["b"]["w9"] is None
    for g, r in got.items():
        v, k = (np.array([x[i] for x in rows if x[0] == g], float) for i in (1, 2))
        assert (r["n_v"], r["n_k"]) == (len(v), len(v))
        assert (r["v0"], r["v1"], r["k5"]) == pytest.approx((v.min(), v.max(), np.quantile(k, 0.5)))
        assert r["v3"] == pytest.approx(np.quantile(v, 0.3), rel=1e-9, abs=1e-320)


@pytest.mark.parametrize("most", [10**6, 3])
def test_many_groups_are_joined_not_sent(spark, monkeypatch, most):
    from tidemark.functions import quantiles as Q

    monkeypatch.setattr(Q, "BROADCAST_ROWS", most)
    rng = np.random.default_rng(4)
    rows = [(int(g), float(v)) for g, v in zip(np.where(rng.random(3000) < 0.4, 0, rng.integers(0, 40, 3000)), rng.lognormal(0, 3, 3000))]
    got = {r["g"]: r["m"] for r in quantiles(spark.createDataFrame(rows, "g int, v double"), "v", {"m": 0.5}, ["g"]).collect()}
    assert got == pytest.approx({g: np.median([v for h, v in rows if h == g]) for g in {g for g, _ in rows}})


def test_whole_numbers_stay_whole(spark):
    df = spark.createDataFrame([(2**62 + i,) for i in range(5)] + [(-(2**62),)], "v long")
    assert [r["value"] for r in values_at_ranks(df, "v", F.array(F.lit(0).cast("bigint"), F.col("n") - 1)).orderBy("rank").collect()] == [-(2**62), 2**62 + 4]
