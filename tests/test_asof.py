import random
from datetime import date, timedelta

import pytest

from tests.helpers import pairs
from tidemark.operators import resolver as RS
from tidemark.operators.asof import asof_join

DAY = date(2024, 1, 1)


@pytest.mark.parametrize("bucket_days, parts", [(31, 16), (3, 1), (4000, 2)])
def test_asof_equals_brute_force(spark, bucket_days, parts):
    """Gaps longer than a stretch, ties, null keys and dates, a key with most rows."""
    r = random.Random(bucket_days)
    key = lambda: r.choice(["hot", "hot", "hot", "cold", None, "only left"])
    left = [(i, key(), None if r.random() < 0.05 else DAY + timedelta(days=r.randrange(-900, 900))) for i in range(300)]
    right = [(k if (k := key()) != "only left" else "only right", None if r.random() < 0.05 else DAY + timedelta(days=r.choice([-700, 0, 1, 2, 300]) + r.randrange(9)), i) for i in range(60)]
    a, b = spark.createDataFrame(left, "id int, k string, at date"), spark.createDataFrame(right, "k string, since date, v int")
    got = {x["id"]: (x["asof"] and (x["asof"]["since"], x["asof"]["v"])) for x in asof_join(a, b, ["k"], "at", "since", bucket_days=bucket_days, parts=parts).collect()}
    assert len(got) == len(left)
    for i, k, at in left:
        found = [(s, v) for kk, s, v in right if k is not None and at and kk == k and s and s <= at]
        assert got[i] == max(found, default=None)


def test_asof_without_right_rows(spark):
    a = spark.createDataFrame([(1, "x", DAY)], "id int, k string, at date")
    b = spark.createDataFrame([], "k string, since date")
    assert pairs(asof_join(a, b, ["k"], "at", "since"), "id", "asof") == [(1, None)]


def test_ranges_equal_adding_up_the_periods(spark):
    """Weekly periods with gaps and nulls, ranges inside one period, across gaps, before and after all, and of ten years."""
    r = random.Random(2)
    monday = date(2024, 1, 1)
    periods = [("weekly", monday + timedelta(days=7 * i), None if i == 5 else 100.0 + i * 1.1) for i in range(40) if i not in (11, 12, 30)]
    periods += [("daily", monday + timedelta(days=i), float(i)) for i in range(3650)]
    horizon = {"weekly": 6, "daily": 0}
    ranges = [(i, (s := monday + timedelta(days=r.randrange(-30, 320))), s + timedelta(days=r.choice([0, 0, 2, 6, 13, 40, 400])), r.choice(["weekly", "weekly", "daily"])) for i in range(200)]
    ranges += [(900, monday, monday + timedelta(days=3649), "daily"), (901, monday - timedelta(days=99), monday - timedelta(days=1), "weekly"), (902, monday, monday, "monthly")]
    got = {x["request_id"]: x for x in RS.forecast_for_ranges(
        spark.createDataFrame(ranges, "request_id int, start date, end date, horizon string"), spark.createDataFrame(periods, "horizon string, period date, forecast_idr double")).collect()}
    for i, start, end, h in ranges:
        total, n, partial, last = 0.0, 0, False, None
        for hh, p, v in periods:
            if hh == h and v is not None and p <= end and (pe := p + timedelta(days=horizon[h])) >= start:
                share = ((min(pe, end) - max(p, start)).days + 1) / (horizon[h] + 1)
                total, n, partial, last = total + v * share, n + 1, partial or share < 1, pe
        assert (got[i]["periods"], got[i]["partial"], got[i]["beyond_horizon"]) == (n, partial, last is None or last < end), (i, start, end, h)
        assert got[i]["total_idr"] == pytest.approx(total, abs=0.01)
