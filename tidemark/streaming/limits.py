"""Rate limits and daily budgets; `jobs` runs them over micro-batches."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.streaming.segments import segment_of, simulate

# Requests per window and per day.
MAX_REQUESTS = 50
WINDOW_SECONDS = 60
DAILY_BUDGET = 400
# Rows of one group that run in one task.
SEGMENT = 200_000


def hits_in_window(events: DataFrame, key: str, ts: str = "ts", seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Hits of the same key in the window that ends at each event, refused or not.

    Time is cut into buckets of one window length: an event counts its own and
    the previous bucket, so the partition of the window is (key, bucket) and a
    hot key spreads over its buckets.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    width = seconds * 1_000_000
    rows = events.withColumn("_at", at).withColumn("_bucket", F.floor(at / width))
    copies = rows.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_bucket", F.col("_bucket") + F.col("_copy"))
    recent = Window.partitionBy(key, "_bucket").orderBy("_at").rangeBetween(-width, 0)
    return copies.withColumn("hits", F.count(F.lit(1)).over(recent)).where("_copy = 0").drop("_at", "_bucket", "_copy")


def _admit(t: int, accepted: deque, limit: int, width: int) -> bool:
    """Greedy limiter: an event passes when fewer than `limit` accepted ones lie in the window before it."""
    while accepted and accepted[0] < t - width:
        accepted.popleft()
    if len(accepted) >= limit:
        return False
    accepted.append(t)
    return True


class Limiter:
    """Accepts an event when fewer than `limit` accepted ones lie in the window before it; the state is their times."""

    inputs = ("_at", "_given")
    outputs = (T.StructField("accepted", T.BooleanType()),)

    def __init__(self, limit: int, width: int):
        self.limit, self.width, self.last, self.accepted = limit, width, None, deque()

    def begin(self, state: list[float]) -> None:
        self.accepted, self.last = deque(int(t) for t in state), None

    def feed(self, t: int | None, given: bool) -> tuple[bool | None]:
        if t is None:
            return (None,)
        self.last = int(t)
        if given:  # was accepted earlier
            self.accepted.append(self.last)
            return (True,)
        return (_admit(self.last, self.accepted, self.limit, self.width),)

    def end(self) -> list[float]:
        # Only what the next row can still see, so that equal pasts give equal states.
        return [float(t) for t in self.accepted if self.last is None or t >= self.last - self.width]


def rate_limit(events: DataFrame, key: str, ident: str, ts: str = "ts", limit: int = MAX_REQUESTS,
               seconds: float = WINDOW_SECONDS, inclusive: bool = True, given: DataFrame | None = None, segment: int = SEGMENT) -> DataFrame:
    """Accept or refuse every event; refused events do not count.

    `inclusive`: an event exactly one window ago still counts.  `given`: events (key, ts) that were accepted before and
    count, in front of others of their time.

    After an empty window the limiter has forgotten everything, so each run of non-empty time buckets of a key is a group
    of its own, and a run of more than `segment` rows is cut into segments (see `segments`).  Rows stream through sorted
    partitions; only the accepted times of the running window are kept.  A null key is a key; an event without a time
    can't be placed, so `accepted` is null.
    """
    width = int(seconds * 1_000_000) - (not inclusive)
    rows = events.withColumn("_given", F.lit(False))
    if given is not None:
        before = given.select(F.col(key), F.col(ts).cast(events.schema[ts].dataType).alias(ts), F.lit(True).alias("_given"))
        rows = rows.unionByName(before, allowMissingColumns=True)
    rows = rows.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")))
    rows = rows.withColumn("_bucket", F.floor(F.col("_at") / width))
    # One row per non-empty bucket; their number per key is bounded by the calendar.
    order = Window.partitionBy(key).orderBy("_bucket")
    used = rows.groupBy(key, "_bucket").agg(F.count("*").alias("_rows"))
    fresh = (F.col("_bucket") - F.lag("_bucket").over(order) > 1).cast("int")
    runs = used.withColumn("_new", F.coalesce(fresh, F.lit(1))).withColumn("_run", F.sum("_new").over(order))
    earlier = Window.partitionBy(key, "_run").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_cut", segment_of(F.coalesce(F.sum("_rows").over(earlier), F.lit(0)), segment))
    # Segments are numbered without gaps: a long bucket may leave some out.
    runs = runs.withColumn("_seg", (F.dense_rank().over(Window.partitionBy(key, "_run").orderBy("_cut")) - 1).cast("long"))
    runs = runs.select(F.col(key).alias("_k"), F.col("_bucket").alias("_b"), F.col("_run").cast("long").alias("_run"), "_seg")
    placed = rows.join(runs, F.col(key).eqNullSafe(F.col("_k")) & F.col("_bucket").eqNullSafe(F.col("_b"))).drop("_bucket", "_k", "_b")
    done = simulate(placed, lambda: Limiter(limit, width), [key, "_run"], ["_at", F.desc("_given"), ident])
    return done.where("NOT _given").drop("_at", "_run", "_seg", "_given")


class Budget:
    """Lets a request pass if it still fits; the state is what is spent and how many passed."""

    inputs = ("_amount",)
    outputs = (T.StructField("passes", T.BooleanType()), T.StructField("position", T.IntegerType()), T.StructField("spent", T.DoubleType()))

    def __init__(self, budget: float):
        self.budget, self.spent, self.taken = budget, 0.0, 0

    def begin(self, state: list[float]) -> None:
        self.spent, self.taken = (state[0], int(state[1])) if state else (0.0, 0)

    def feed(self, cost: float) -> tuple[bool, int, float]:
        passes = self.spent + cost <= self.budget
        if passes:
            self.spent, self.taken = self.spent + cost, self.taken + 1
        return passes, self.taken, self.spent

    def end(self) -> list[float]:
        return [self.spent, float(self.taken)]


def running_budget(events: DataFrame, ts: str = "ts", ident: str = "event_id", amount: str | None = None,
                   budget: int = DAILY_BUDGET, segment: int = SEGMENT) -> DataFrame:
    """Accepted requests of every UTC day, in order, as long as the budget lasts.

    With unit amounts these are the first `budget` requests, found by a
    group limit in every task before the shuffle.  With other amounts a
    request passes if it still fits; a refused one consumes nothing, so later
    smaller ones may pass.  A day of more than `segment` rows is cut into
    segments (see `segments`); `spent` is the sum so far.  A null amount
    counts as 0; rows without a time belong to a day of their own.
    """
    order = Window.partitionBy("day").orderBy(ts, ident)
    rows = events.withColumn("day", F.col(ts).cast("date"))
    if amount is None:
        return rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= budget)
    # What alone exceeds the budget never passes and consumes nothing.
    fits = rows.withColumn("_amount", F.coalesce(F.col(amount).cast("double"), F.lit(0.0))).where(F.col("_amount") <= budget)
    # A day is cut by the hour, several hours to a segment of some `segment` rows.
    hours = fits.withColumn("_hour", F.hour(F.col(ts).cast("timestamp"))).groupBy("day", "_hour").agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy("day").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    cuts = hours.withColumn("_cut", segment_of(F.coalesce(F.sum("_rows").over(earlier), F.lit(0)), segment))
    cuts = cuts.withColumn("_seg", (F.dense_rank().over(Window.partitionBy("day").orderBy("_cut")) - 1).cast("long"))
    cuts = cuts.select(F.col("day").alias("_d"), F.col("_hour").alias("_h"), "_seg")
    hour = F.hour(F.col(ts).cast("timestamp"))
    placed = fits.join(cuts, F.col("day").eqNullSafe(F.col("_d")) & hour.eqNullSafe(F.col("_h"))).drop("_d", "_h")
    done = simulate(placed, lambda: Budget(budget), ["day"], [ts, ident])
    return done.where("passes").drop("_amount", "_seg", "passes")
