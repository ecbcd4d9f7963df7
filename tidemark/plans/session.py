"""Session settings and the few choices a plan must make from a measured size."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 50_000
_SHIPPED: set[str] = set()


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """AQE on (coalescing, skew-join splitting), UTC; everything else is the cluster's business."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application; they may not have it installed."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="run-", dir="/tmp")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, source.relative_to(package.parent))
        # Spark copies the file to every executor.
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)
    return spark


def text_batches(spark: SparkSession) -> None:
    """Rows that carry whole texts go to Python in Arrow batches of 1,000, as their size follows the texts.

    A value that the user has set stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Measured, not assumed: reads at most rows + 1 rows."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast behind the row check; otherwise leave the join to AQE."""
    return F.broadcast(df) if small_enough(df, rows) else df


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], salt_from: str, how: str = "left", parts: int = 16) -> DataFrame:
    """Join rows to a per-key table when one key may hold a large share of the rows.

    AQE splits a skewed join only when both sides come straight from a shuffle;
    an aggregate on the join key does not.  The rows of a key are spread over
    `parts` salts and the per-key table, one row per key, is repeated for each.
    """
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(salt_from), F.lit(parts)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return spread.join(repeated, [*keys, "_salt"], how).drop("_salt")


def shared_base(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where everything runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="run-", dir="/tmp")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names; survives lost executors."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint(eager=True)
