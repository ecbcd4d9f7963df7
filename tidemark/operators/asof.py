"""As-of join: each row with the latest row of another table at or before its date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.session import broadcast_if_small

EPOCH = "1970-01-01"


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, since: str, name: str = "asof", bucket_days: int = 31, parts: int = 16) -> DataFrame:
    """All rows and columns of `left`, and as struct `name` the `right` row with the greatest `since` <= `at`, per `by`.

    Null where there is none, where a key is null or the date is null; of several rows with one date the greatest.  Rows
    of both sides meet by key and stretch of days, in one sort; a stretch without an earlier row takes the last row of
    the stretches before it, from a table with one row per key and stretch.  So a key that holds most rows is sorted in
    many tasks: by stretch, and by `parts` salts, for each of which the few right rows of a stretch are repeated.
    """
    stretch = lambda day: F.floor(F.datediff(day, F.lit(EPOCH).cast("date")) / bucket_days)
    keys = [*by, "_b"]
    row_type, found_type = left.select(F.struct("*").alias("r")).schema["r"].dataType, right.select(F.struct("*").alias("r")).schema["r"].dataType
    asking = left.select(
        *by, stretch(F.col(at)).alias("_b"), F.col(at).alias("_t"), F.lit(1).alias("_side"), F.pmod(F.xxhash64(*left.columns), F.lit(parts)).cast("int").alias("_salt"),
        F.struct("*").alias("_row"), F.lit(None).cast(found_type).alias("_found"))
    known = right.dropna(subset=[since, *by]).select(*by, stretch(F.col(since)).alias("_b"), F.col(since).alias("_t"), F.struct("*").alias("_found"))
    repeated = known.select(
        *keys, "_t", F.lit(0).alias("_side"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_salt"), F.lit(None).cast(row_type).alias("_row"), "_found")
    order = Window.partitionBy(*keys, "_salt").orderBy("_t", "_side", "_found").rowsBetween(Window.unboundedPreceding, 0)
    met = asking.unionByName(repeated).withColumn("_near", F.last("_found", ignorenulls=True).over(order)).where("_side = 1")
    # The last row before each stretch, for every stretch that the right rows span and the one after.
    low, high = known.agg(F.min("_b"), F.max("_b")).first()
    if low is None:
        return met.select("_row.*", F.lit(None).cast(found_type).alias(name))
    last = known.groupBy(*keys).agg(F.max(F.struct("_t", "_found")).alias("_last"))
    stretches = known.select(*by).distinct().withColumn("_b", F.explode(F.sequence(F.lit(low), F.lit(high + 1)))).join(last, keys, "left")
    earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = stretches.select(*keys, F.last("_last._found", ignorenulls=True).over(earlier).alias("_before")).where("_before IS NOT NULL")
    met = met.withColumn("_b", F.when(F.col("_b").isNotNull(), F.least(F.greatest("_b", F.lit(low)), F.lit(high + 1))))
    return met.join(broadcast_if_small(before), keys, "left").select("_row.*", F.coalesce("_near", "_before").alias(name))
