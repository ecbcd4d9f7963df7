"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.session import shared_base

# Bytes that separate words: blank and \x09-\x0D, as bytes.split() has them.
BLANKS = b" \t\n\x0b\x0c\r"
# Rows that a function of per_batch gets at once.
AT_ONCE = 1000


#: The operator whose tables and caches this Python worker holds, and how to drop them.
_HOLDER: list = ["", lambda: None]


def holds(owner: str, drop: Callable[[], object] = lambda: None) -> None:
    """Say in a task that this worker now works for `owner`; what it holds for another operator goes first.

    Spark hands workers from stage to stage, so without this a worker would hold the tables of every operator it served.
    """
    if _HOLDER[0] == owner:
        return
    _HOLDER[1]()
    _HOLDER[:] = [owner, drop]
    gc.collect()
    try:  # give freed memory back, where the C library can
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


class Kept(dict):
    """A cache bounded by bytes, not by entries, for results that can always be made again.

    Entries have two ages: when the younger ones fill half the bound they become the older ones, which go.  `known` also
    looks there, and makes young what it finds.  Long keys, which are hardly ever met again, are not kept at all.
    """

    LONGEST = 64

    def __init__(self, most: int = 48_000_000, overhead: int = 180):
        super().__init__()
        # What an entry takes besides its characters: the objects and its place in the table.
        self.most, self.overhead, self.held = most, overhead, 0
        self.old: dict = {}

    def keep(self, key, value) -> None:
        size = len(key)
        if size > self.LONGEST:
            return
        if self.held > self.most // 2:
            self.old, self.held = dict(self), 0
            self.clear()
        # A character of a text takes up to four bytes, as does a packed id.
        self.held += self.overhead + 4 * size
        self[key] = value

    def known(self, key):
        """The entry, or None."""
        if (value := self.get(key)) is None and (value := self.old.get(key)) is not None:
            self.keep(key, value)
        return value


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Rows carry whole texts, so Arrow batches of Spark's default 10,000 rows are large: both sides hold several of them.

    A value that the user has set stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(AT_ONCE))


def stored(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_base(spark)}/llm-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts_of(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def per_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType | str) -> DataFrame:
    """Apply a function from record batch to record batch, on a bounded number of rows at once."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                yield fn(batch.slice(at, AT_ONCE))

    return df.mapInArrow(run, schema)


def key_and_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """Only the two columns an operator reads, so other columns can't clash with its own."""
    small_batches(df.sparkSession)
    return df.select(F.col(key), F.col(text).cast("string").alias("text"))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (published splitmix64 constants), on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(ids: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A 64-bit key for each run of n neighbours in an array of uint64 values; shorter arrays have none."""
    count = len(ids) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    h = np.full(count, np.uint64(seed * 2 + 1), np.uint64)
    for i in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + count])
    return h
