"""Sequential rules over long groups, in segments that run apart and are run again until they agree.

A rule such as a limiter or a budget needs its rows in order, each with the state the rows before it left.  A long group is
cut into segments; each is first run from an empty state, then again whenever the state that the segment before it ends
with is not the one it was run from.  What is run again is only what changed, and once nothing changes every segment has
seen the state it would have seen in one pass: the result is the sequential one.  The first segment of a group is right at
once, so there are at most as many rounds as segments; rules that forget, or that stop accepting, agree after a few.

Rows stream through sorted partitions; a state is a short array of numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.session import cut_lineage

STATE = T.ArrayType(T.DoubleType())


class Rule(Protocol):
    """A sequential rule; `inputs` are the columns it reads, `outputs` the fields it adds."""

    inputs: Sequence[str]
    outputs: Sequence[T.StructField]

    def begin(self, state: list[float]) -> None: ...

    def feed(self, *values) -> tuple: ...

    def end(self) -> list[float]: ...


def _scan(rule: Callable[[], Rule], group: list[str], columns: list[str], rows_too: bool):
    """Over rows ordered by group, segment, state row first: the rows with their outputs, or the end state of each segment."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        work, now, done = rule(), None, []
        names = [*group, "_seg"]
        for pdf in frames:
            keys = list(zip(*(pdf[c].astype(object).where(pdf[c].notna(), None) for c in names), strict=True))
            values = list(zip(*(pdf[c].astype(object).where(pdf[c].notna(), None) for c in work.inputs), strict=True))
            keep, out = [], []
            for key, kept, value in zip(keys, pdf["_kept"], values, strict=True):
                if key != now:
                    if now is not None:
                        done.append((*now, work.end()))
                    now = key
                    work.begin([])
                if kept is not None:
                    work.begin(list(kept))
                    keep.append(False)
                else:
                    keep.append(True)
                    out.append(work.feed(*value))
            if rows_too:
                held = pdf.loc[keep, columns].reset_index(drop=True)
                for i, f in enumerate(work.outputs):
                    held[f.name] = pd.Series([x[i] for x in out], dtype=object)
                yield held
                done = []
            elif len(done) >= 5000:
                yield pd.DataFrame(done, columns=[*names, "out"])
                done = []
        if not rows_too and now is not None:
            done.append((*now, work.end()))
        if not rows_too and done:
            yield pd.DataFrame(done, columns=[*names, "out"])

    return run


def simulate(rows: DataFrame, rule: Callable[[], Rule], group: list[str], order: Sequence[str]) -> DataFrame:
    """All rows with the outputs of the rule, run over each group in order.

    `rows` has a column `_seg`: the segments of a group, numbered in the order of its rows, without gaps.
    """
    columns, names = rows.columns, [*group, "_seg"]
    ordered = lambda some: some.repartition(*names).sortWithinPartitions(*names, F.col("_kept").isNull(), *order)
    none = F.lit(None)

    def with_states(some: DataFrame, states: DataFrame) -> DataFrame:
        marks = states.select(*[F.col(c) if c in names else none.cast(rows.schema[c].dataType).alias(c) for c in columns], F.col("state").alias("_kept"))
        return some.withColumn("_kept", none.cast(STATE)).unionByName(marks)

    def matched(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
        b = b.select(*[F.col(c).alias(f"_{c}") for c in names], *[c for c in b.columns if c not in names])
        return a.join(b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names], how)

    final = T.StructType([*rows.schema.fields, *rule().outputs])
    end = T.StructType([*(rows.schema[c] for c in names), T.StructField("out", STATE)])
    begin = rows.select(*names).distinct().select(*names, F.array().cast(STATE).alias("state"))
    if not rows.where("_seg > 0").isEmpty():
        rows = cut_lineage(rows)
        begin = cut_lineage(begin)
        todo, ends = begin, None
        while True:
            held = matched(rows, todo.drop("state"), "left_semi") if ends is not None else rows
            fresh = ordered(with_states(held, todo)).mapInPandas(_scan(rule, group, columns, False), end)
            if ends is not None:
                fresh = fresh.unionByName(matched(ends, todo.drop("state"), "left_anti"))
            ends = cut_lineage(fresh)
            # What each segment should have begun with, and those that began with something else.
            due = matched(begin, ends.withColumn("_seg", F.col("_seg") + 1), "left").select(*names, "state", F.coalesce("out", F.array().cast(STATE)).alias("due"))
            todo = cut_lineage(due.where("state != due").select(*names, F.col("due").alias("state")))
            begin = cut_lineage(due.select(*names, F.col("due").alias("state")))
            if todo.isEmpty():
                break
    return ordered(with_states(rows, begin)).mapInPandas(_scan(rule, group, columns, True), final)


def segment_of(counts: Column, size: int) -> Column:
    """The segment of a stretch of rows, from the number of rows of its group before it."""
    return F.floor(counts / size).cast("long")
