"""Writes.

Plain parquet has no row-level update: what a table holds after an upsert, a mirror or an append is a DataFrame, and it is
written to a new folder.  So the folder that is being read is never overwritten, and a job that dies leaves an unused
folder behind and nothing else.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def saved(df: DataFrame, base: str) -> DataFrame:
    """Written to a fresh folder below `base`, and read from there."""
    folder = f"{base.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def appended(log: DataFrame, rows: DataFrame, tag: str = "tag") -> DataFrame:
    """The log with the rows whose tag it doesn't hold yet, so a run that is delivered twice counts once.

    Rows without a tag are always added.
    """
    known = log.select(F.col(tag).alias("_tag")).where("_tag IS NOT NULL").distinct()
    return log.unionByName(rows.join(known, rows[tag] == F.col("_tag"), "left_anti"), allowMissingColumns=True)


def upserted(target: DataFrame | None, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What the target holds after the upsert; duplicate keys in `rows` are an error of the caller."""
    if target is None:
        return rows
    kept = target.join(rows.select(*keys), list(keys), "left_anti")
    return kept.unionByName(rows, allowMissingColumns=True)


def mirror_counts(target: DataFrame | None, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    if target is None:
        return rows.agg(F.count(F.lit(1)).alias("added"), F.lit(0).cast("bigint").alias("replaced"),
                        F.lit(0).cast("bigint").alias("deleted"))
    old = target.select(*keys, F.lit(1).alias("_old"))
    new = rows.select(*keys, F.lit(1).alias("_new"))
    both = old.join(new, list(keys), "full_outer")
    return both.agg(
        F.count_if(F.col("_old").isNull()).alias("added"),
        F.count_if(F.col("_old").isNotNull() & F.col("_new").isNotNull()).alias("replaced"),
        F.count_if(F.col("_new").isNull()).alias("deleted"))


def latest_run(runs: DataFrame, job: str, deployed: bool = True) -> DataFrame:
    """The newest (deployed) run of a job; empty when there is none."""
    rows = runs.where(F.col("job") == job)
    if deployed:
        rows = rows.where("deployed")
    newest = rows.agg(F.max_by(F.struct("*"), "ran_at").alias("r")).where("r IS NOT NULL")
    return newest.select("r.*")


def wide_forecast(forecast: DataFrame, horizons: Sequence[str] = ("monthly", "weekly")) -> DataFrame:
    """One row per period, one column per horizon, null where the horizon has no such period."""
    return (
        forecast.groupBy("period").pivot("horizon", list(horizons)).agg(F.first("forecast_idr")).orderBy("period")
    )


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).option("nullValue", "").csv(path)


def unanswered(gated: DataFrame, at) -> DataFrame:
    """Questions that fell below the relevance gate, as backlog rows."""
    return gated.where(F.col("response_type") == "not_found").select(
        F.col("text").alias("question"), "top_score", F.lit(at).cast("timestamp").alias("recorded_at"))


def customer_rollup(bookings: DataFrame) -> DataFrame:
    """Trips, spend and last purchase per customer, recomputed from committed bookings."""
    from tidemark.functions.semantics import committed, money_sum

    return bookings.where(committed()).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_trips"), money_sum("total_price_idr").alias("total_spent_idr"),
        F.max("booking_date").alias("last_purchase_date"),
    ).withColumn("is_repeat_customer", F.col("total_trips") > 1)


def with_rollup(customers: DataFrame, rollup: DataFrame) -> DataFrame:
    """Customers carrying the fresh rollup; those without bookings have zeros."""
    fields = ["total_trips", "total_spent_idr", "last_purchase_date", "is_repeat_customer"]
    rest = customers.drop(*fields)
    return rest.join(rollup, "customer_id", "left").fillna({"total_trips": 0, "total_spent_idr": 0.0,
                                                            "is_repeat_customer": False})


def resolve_codes(rows: DataFrame, bookings: DataFrame, code: str = "booking_code") -> DataFrame:
    """Swap the business code of new rows for the stored surrogate id; unknown codes keep a null id."""
    return rows.join(bookings.select(code, "booking_id"), code, "left").drop(code)
