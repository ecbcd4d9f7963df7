"""Running streams to completion, and micro-batch writers that can be replayed safely."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.semantics import money_sum
from tidemark.plans.session import shared_base
from tidemark.streaming.limits import DAILY_BUDGET, MAX_REQUESTS, WINDOW_SECONDS, rate_limit, running_budget


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the one the cluster names."""
    return f"{shared_base(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of one table as a stream, whether the table is one file or a folder of files."""
    reader = spark.readStream.schema(spark.read.parquet(f"{folder}/{name}.parquet").schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # A pattern that only this name meets: a stream's plain path must be a folder.
    return reader.parquet(f"{folder}/{name}.parque[t]")


def drain(stream: DataFrame, mode: str = "append", folder: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Process all available input and read back what was written; nothing passes the driver.

    Append output goes to the file sink.  Update output adds the changed rows
    of each micro-batch, and the latest row of each of `keys` is the answer: a
    closed window is written no more.  Complete output replaces one folder per
    micro-batch, and the last batch is the answer.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark)
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{folder}/out")
    else:
        writer = stream.writeStream.foreachBatch(
            lambda df, batch: df.write.mode("overwrite").parquet(f"{folder}/out/batch={batch:09d}"))
    run = writer.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(f"{folder}/out")
    written = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{folder}/out")
    if mode == "update":
        newest = F.max_by(F.struct(*stream.columns), "batch")
        return written.groupBy(*keys).agg(newest.alias("_row")).select("_row.*")
    last = written.agg(F.max("batch")).first()[0]
    return spark.read.schema(stream.schema).parquet(f"{folder}/out/batch={int(last):09d}")


def drain_closed(events: DataFrame, operator: Callable[[DataFrame], DataFrame], ts: str, folder: str | None = None) -> DataFrame:
    """Append output of an operator over a finite stream, with what its last watermark leaves open flushed at the end.

    The stream runs until its input is read; then one row of nulls, far later than all others, moves the watermark past
    every timer.  So all groups are closed and the state is empty but for that row, for which nothing comes out.
    """
    spark = events.sparkSession
    folder = folder or shared_folder(spark)
    schema = T.StructType([*events.schema.fields, T.StructField("_flush", T.BooleanType())])
    spark.createDataFrame([], schema).write.parquet(f"{folder}/flush/none")
    marks = spark.readStream.schema(schema).parquet(f"{folder}/flush/*")
    out = operator(events.withColumn("_flush", F.lit(False)).unionByName(marks))
    run = lambda: out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    run().awaitTermination()
    newest = F.lit("2100-01-01 00:00:00").cast(events.schema[ts].dataType)
    spark.range(1).select(*[(newest if f.name == ts else F.lit(None).cast(f.dataType)).alias(f.name) for f in events.schema], F.lit(True).alias("_flush")).write.parquet(f"{folder}/flush/last")
    run().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], folder: str) -> None:
    """Feed every available micro-batch to `write`."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(
        availableNow=True).start().awaitTermination()


def of_batch(root: str, number: int) -> str:
    """The folder of a micro-batch; a batch that is replayed after a lost driver overwrites its own folder."""
    return f"{root.rstrip('/')}/batch={number}"


def batches(spark: SparkSession, root: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """The rows of all micro-batches (of those before one) with their number as `batch`; none is an empty table."""
    # An empty batch, so that the folder exists; written once.
    spark.createDataFrame([], schema).write.mode("ignore").parquet(of_batch(root, -1))
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])).parquet(root)
    return rows if before is None else rows.where(F.col("batch") < before)


def rollup_writer(root: str) -> Callable[[DataFrame, int], None]:
    """Write the sums of each micro-batch of committed bookings to its own folder; `rollup_of` adds them up when read."""

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("customer_id").agg(
            F.count(F.lit(1)).alias("total_trips"), money_sum("total_price_idr").alias("total_spent_idr"),
            F.max("booking_date").alias("last_purchase_date")).write.mode("overwrite").parquet(of_batch(root, number))

    return write


def rollup_of(spark: SparkSession, root: str) -> DataFrame:
    """The current rollup of everything written so far."""
    rows = spark.read.parquet(root)
    return rows.groupBy("customer_id").agg(
        F.sum("total_trips").alias("total_trips"), money_sum("total_spent_idr").alias("total_spent_idr"),
        F.max("last_purchase_date").alias("last_purchase_date")).withColumn("is_repeat_customer", F.col("total_trips") > 1)


def limit_writer(root: str, key: str, ident: str, ts: str = "ts", limit: int = MAX_REQUESTS, seconds: int = WINDOW_SECONDS) -> Callable[[DataFrame, int], None]:
    """Accept or refuse the events of each micro-batch, with those accepted in earlier batches before them.

    A micro-batch is limited as a table, so its events of one key stream through sorted segments and never meet in a
    frame; of the earlier batches only the accepted events of the window before the batch are read.
    """

    def write(batch: DataFrame, number: int) -> None:
        at = F.unix_micros(F.col(ts).cast("timestamp"))
        rows = batch.select(key, ident, ts)
        stored = batches(batch.sparkSession, root, T.StructType([*rows.schema.fields, T.StructField("accepted", T.BooleanType())]), number)
        oldest = rows.agg(F.min(at)).first()[0]
        given = stored.where(F.col("accepted") & (at >= F.lit((oldest or 0) - seconds * 1_000_000)))
        rate_limit(rows, key, ident, ts, limit, seconds, given=given).write.mode("overwrite").parquet(of_batch(root, number))

    return write


def budget_writer(root: str, ts: str, ident: str, budget: int = DAILY_BUDGET) -> Callable[[DataFrame, int], None]:
    """Accept the first requests of every day until the budget is spent, over micro-batches.

    Only accepted rows are stored, at most one budget per day.
    """

    def write(batch: DataFrame, number: int) -> None:
        fresh = running_budget(batch, ts, ident, budget=budget)
        spent = batches(batch.sparkSession, root, fresh.schema, number).groupBy("day").agg(F.count(F.lit(1)).alias("spent"))
        room = F.col("position") + F.coalesce("spent", F.lit(0)) <= budget
        # A day without a date is a day too.
        left = fresh.join(spent.withColumnRenamed("day", "_day"), F.col("day").eqNullSafe(F.col("_day")), "left").where(room)
        left.drop("spent", "_day").write.mode("overwrite").parquet(of_batch(root, number))

    return write


MARKS = T.StructType([T.StructField("newest", T.LongType())])


def late_splitter(root: str, ts: str, delay_seconds: int) -> Callable[[DataFrame, int], None]:
    """Rows older than the newest time of earlier batches minus the delay are marked late: column `is_late`.

    `{root}/marks` keeps one row per batch with its newest time, so no batch has to scan the stored events.
    """

    def write(batch: DataFrame, number: int) -> None:
        at = F.unix_micros(F.col(ts).cast("timestamp"))
        newest = batches(batch.sparkSession, f"{root}/marks", MARKS, number).agg(F.max("newest")).first()[0]
        is_late = F.lit(False) if newest is None else F.coalesce(at < newest - delay_seconds * 1_000_000, F.lit(False))
        batch.withColumn("is_late", is_late).write.mode("overwrite").parquet(of_batch(f"{root}/rows", number))
        batch.agg(F.max(at).alias("newest")).write.mode("overwrite").parquet(of_batch(f"{root}/marks", number))

    return write
