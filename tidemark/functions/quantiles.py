"""Exact order statistics by radix selection: counted passes over an order-preserving 64-bit key, no sort of values.

Every value becomes a whole number whose order is that of the values (of a double its bit pattern, with the negative
ones turned round).  A pass counts the next 16 bits of the keys that share a wanted prefix, by partial aggregation, and
the running sums of at most 65,536 counts say which digit holds each wanted rank.  Four passes give the keys themselves.
So no value is sorted or shuffled, a value repeated a billion times costs nothing extra, and the number of passes is the
same at every size.  Several measures share the passes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.session import BROADCAST_ROWS, cut_lineage, salted_join

PASSES, BITS = 4, 16
_TURNED = (1 << 63) - 1


def _turned(bits: np.ndarray) -> np.ndarray:
    """Bit patterns of doubles to numbers of the same order, and back."""
    return bits ^ ((bits >> 63) & _TURNED)


@F.arrow_udf(T.LongType())
def _key_of_double(values: pa.Array) -> pa.Array:
    x = values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # no negative zero
    x[np.isnan(x)] = np.nan  # one pattern, above all others
    return pa.array(_turned(x.view(np.int64)))


@F.arrow_udf(T.DoubleType())
def _double_of_key(keys: pa.Array) -> pa.Array:
    return pa.array(_turned(np.array(keys.to_numpy(zero_copy_only=False), np.int64)).view(np.float64))


def _key(value: Column, kind: T.DataType) -> Column:
    return value.cast("bigint") if isinstance(kind, T.IntegralType) else _key_of_double(value.cast("double"))


def select_ranks(df: DataFrame, measures: Sequence[str], ranks: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by..., measure, rank, key, n): the key of the value at each zero-based rank of each measure in each group.

    `ranks` is an array<bigint> expression over `n`, the non-null count of a measure in its group.
    """
    by, spark = list(by), df.sparkSession
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), _key(F.col(f"_v{i}"), df.schema[m].dataType).alias("key")) for i, m in enumerate(measures)])
    # Read once in each pass: only groups and keys are written.
    values = df.select(*by, *[F.col(m).alias(f"_v{i}") for i, m in enumerate(measures)])
    if len(measures) == 1:
        values = values.where("_v0 IS NOT NULL").select(*by, F.lit(measures[0]).alias("measure"), _key(F.col("_v0"), df.schema[measures[0]].dataType).alias("key"))
    else:
        filled = [F.when(F.col(f"_v{i}").isNotNull(), p) for i, p in enumerate([pairs[i] for i in range(len(measures))])]
        values = values.select(*by, F.explode(F.array_compact(F.array(*filled))).alias("x")).select(*by, "x.measure", "x.key")
    values = cut_lineage(values)
    group = [*by, "measure"]
    held, wanted = values, None
    for step in range(PASSES):
        shift = 64 - BITS * (step + 1)
        prefix = F.shiftright("key", shift + BITS) if step else F.lit(0).cast("bigint")
        if step:
            keyed = values.withColumn("prefix", prefix)
            few = wanted.select(*group, "prefix")
            # The wanted prefixes are measured; of a hot prefix of many the rows are spread.
            held = _matching(keyed, few, [*group, "prefix"], small)
        else:
            held = values.withColumn("prefix", prefix)
        counts = held.groupBy(*group, "prefix", F.shiftright("key", shift).alias("digit")).agg(F.count("*").alias("c"))
        running = Window.partitionBy(*group, "prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        sums = counts.withColumn("upto", F.sum("c").over(running))
        if step:
            sums = _paired(sums, wanted, [*group, "prefix"])
        else:
            sums = sums.withColumn("n", F.sum("c").over(Window.partitionBy(*group, "prefix"))).withColumn("asked", F.transform(F.array_distinct(ranks), lambda r: F.struct(r.alias("rank"), r.alias("place"))))
        low = F.col("upto") - F.col("c")
        inside = F.filter("asked", lambda r: (r["place"] >= low) & (r["place"] < F.col("upto")))
        left = F.transform(inside, lambda r: F.struct(r["rank"].alias("rank"), (r["place"] - low).alias("place")))
        wanted = sums.select(*group, F.col("digit").alias("prefix"), "n", left.alias("asked")).where(F.size("asked") > 0)
        if step < PASSES - 1:
            head = wanted.limit(BROADCAST_ROWS + 1).collect()
            small = len(head) <= BROADCAST_ROWS
            wanted = spark.createDataFrame(head, wanted.schema) if small else cut_lineage(wanted)
            wanted = F.broadcast(wanted) if small else wanted
    return wanted.select(*group, F.explode("asked").alias("r"), F.col("prefix").alias("key"), "n").select(*group, "r.rank", "key", "n")


def _matching(rows: DataFrame, prefixes: DataFrame, on: list[str], small: bool) -> DataFrame:
    same = [rows[c].eqNullSafe(prefixes[c]) for c in on]
    if small:
        return rows.join(F.broadcast(prefixes), same, "left_semi")
    shown = lambda df: df.withColumn("_on", F.to_json(F.struct(*on), {"ignoreNullFields": "false"}))
    return salted_join(shown(rows), shown(prefixes).select("_on"), ["_on"], "key", "left_semi").drop("_on")


def _paired(sums: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """Counts of digits with the ranks asked of their prefix."""
    other = wanted.select(*[F.col(c).alias(f"_{c}") for c in on], "n", "asked")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]
    return sums.join(other, same).drop(*[f"_{c}" for c in on])


def values_at_ranks(df: DataFrame, value: str, ranks: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by..., rank, value, n): the value at each zero-based rank of its group; whole numbers stay so, others are doubles.

    `ranks` is an array<bigint> expression over `n`, the non-null count of the group.
    """
    kind = df.schema[value].dataType
    back = F.col("key").cast(kind) if isinstance(kind, T.IntegralType) else _double_of_key(F.col("key"))
    return select_ranks(df, [value], ranks, by).select(*by, "rank", back.alias("value"), "n")


def quantiles_of(df: DataFrame, probs: dict[str, dict[str, float]], by: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles of several measures at once: `probs` maps a measure to output columns and shares.

    One row per group with a value of any measure; per measure also `n_<measure>`, its number of values.
    """
    by = list(by)
    shares = sorted({p for names in probs.values() for p in names.values()})
    places = [r.cast("bigint") for p in shares for r in (F.floor(F.lit(p) * (F.col("n") - 1)), F.ceil(F.lit(p) * (F.col("n") - 1)))]
    found = select_ranks(df, list(probs), F.array(*places), by)
    whole = [m for m in probs if isinstance(df.schema[m].dataType, T.IntegralType)]
    value = F.when(F.col("measure").isin(whole), F.col("key").cast("double")).otherwise(_double_of_key(F.col("key"))) if whole else _double_of_key(F.col("key"))
    at = found.select(*by, "measure", "n", "rank", value.alias("value"))
    mine = lambda m, c: F.when(F.col("measure") == m, c)
    table = at.groupBy(*by).agg(*[x for i, m in enumerate(probs) for x in (
        F.max(mine(m, F.col("n"))).alias(f"_n{i}"), F.map_from_entries(F.collect_list(mine(m, F.struct("rank", "value")))).alias(f"_m{i}"))])
    if not by:
        table = table.where(" OR ".join(f"_n{i} IS NOT NULL" for i in range(len(probs))))
    out = [F.col(b) for b in by]
    for i, (m, names) in enumerate(probs.items()):
        out.append(F.coalesce(f"_n{i}", F.lit(0)).cast("bigint").alias(f"n_{m}"))
        for name, p in names.items():
            pos = F.lit(p) * (F.col(f"_n{i}") - 1)
            low = F.element_at(f"_m{i}", F.floor(pos).cast("bigint"))
            high = F.element_at(f"_m{i}", F.ceil(pos).cast("bigint"))
            out.append((low + (high - low) * (pos - F.floor(pos))).alias(name))
    return table.select(*out)


def quantiles(
    df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (), digits: int | None = None
) -> DataFrame:
    """Linearly interpolated quantiles, one column per entry of `probs`, plus `n`."""
    table = quantiles_of(df.select(*by, value), {value: probs}, by)
    shown = [(F.round(name, digits) if digits is not None else F.col(name)).alias(name) for name in probs]
    return table.select(*by, F.col(f"n_{value}").alias("n"), *shown)


def approx_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (), accuracy: int = 10_000
) -> DataFrame:
    """Sketch version: one pass, returns elements of the data."""
    q = F.percentile_approx(value, list(probs.values()), accuracy)
    table = df.groupBy(*by).agg(F.count(value).alias("n"), q.alias("_q"))
    picks = [F.get("_q", F.lit(i)).cast("double").alias(name) for i, name in enumerate(probs)]
    return table.select(*by, "n", *picks)
