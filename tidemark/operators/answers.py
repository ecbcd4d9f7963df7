"""Checking answers against their context, and reusing earlier answers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import similarity
from tidemark.functions.text import query_key, sentences, unverified_numbers
from tidemark.functions.vectors import hashed_embedding, hashed_embeddings
from tidemark.plans.session import text_batches

# Fixed values of the checks.
SENTENCE_SIMILARITY = 0.55
GROUNDED_SCORE = 0.35
MAX_UNVERIFIED = 2
STRICT_SCORE = 0.6
ANSWER_TTL_SECONDS = 3600
SAME_QUESTION = 0.93
FINE_SECONDS = 60
#: Rows whose sentences are compared at once.
ROWS_AT_ONCE = 256


def numbers_report(answers: DataFrame) -> DataFrame:
    """answers: answer_id, answer, context."""
    return answers.select("answer_id", unverified_numbers(F.col("answer"), F.col("context")).alias("unverified_numbers"))


def _vectors(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The unit vectors of all rows in one matrix, and where those of each row begin; no vector becomes Python objects."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    inner = lists.flatten()
    m = inner.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(inner), -1) if len(inner) else np.zeros((0, 1))
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0), np.r_[0, np.cumsum(lengths)]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _best_matches(said: pa.Array, known: pa.Array) -> pa.Array:
    """For each vector of the first list its highest cosine with one of the second; both lie in one row."""
    out = []
    for at in range(0, len(said), ROWS_AT_ONCE):
        (a, x), (b, y) = (_vectors(side.slice(at, ROWS_AT_ONCE)) for side in (said, known))
        for i in range(len(x) - 1):
            mine, theirs = a[x[i]:x[i + 1]], b[y[i]:y[i + 1]]
            out.append(np.round((mine @ theirs.T).max(axis=1), similarity.DIGITS) if len(mine) and len(theirs) else np.empty(0))
    ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0), *out])))


def groundedness(answers: DataFrame, embed: Callable[[Column], Column] | None = hashed_embeddings,
                 similar: float = SENTENCE_SIMILARITY, overall: float = GROUNDED_SCORE) -> DataFrame:
    """Share of answer sentences that resemble some context sentence, and the verdict.

    No sentence to check is grounded, no context sentence is not, and without
    an embedder the answer counts as unchecked and grounded.  `embed` turns a
    column of text arrays into one of vector arrays; both texts of an answer
    lie in its row, so nothing is shuffled.
    """
    text_batches(answers.sparkSession)
    base = answers.select(
        "answer_id", sentences(F.col("answer")).alias("said"), sentences(F.col("context")).alias("known"),
        unverified_numbers(F.col("answer"), F.col("context")).alias("unverified_numbers"))
    best = F.array().cast("array<double>") if embed is None else _best_matches(embed(F.col("said")), embed(F.col("known")))
    joined = base.select(
        "answer_id", F.size("said").alias("total"), F.size("known").alias("context_total"), "unverified_numbers",
        F.size(F.filter(best, lambda x: x >= similar)).cast("bigint").alias("supported"))
    checked = F.lit(embed is not None) | (F.col("total") == 0) | (F.col("context_total") == 0)
    score = (
        F.when(F.col("total") == 0, 1.0).when(F.col("context_total") == 0, 0.0)
        .when(~checked, 1.0).otherwise(F.col("supported") / F.col("total")))
    loose = F.size("unverified_numbers")
    verdict = (
        F.when(F.col("total") == 0, True).when(F.col("context_total") == 0, False).when(~checked, True)
        .otherwise((F.col("score") >= overall) & ~((loose > MAX_UNVERIFIED) & (F.col("score") < STRICT_SCORE))))
    early = (F.col("total") == 0) | (F.col("context_total") == 0) | ~checked
    return joined.withColumn("score", score).select(
        "answer_id", F.round("score", 3).alias("score"), verdict.alias("is_grounded"), "supported", "total",
        F.when(early, F.array().cast("array<string>")).otherwise(F.col("unverified_numbers")).alias("unverified_numbers"),
        checked.alias("checked"))


def exact_reuse(questions: DataFrame, ttl: int = ANSWER_TTL_SECONDS, same: Sequence[str] = ()) -> DataFrame:
    """Age in seconds of the latest earlier question with the same normalised text, when below the ttl.

    questions: question_id, text, asked_at and the `same` columns (language,
    filters).  A very common question is cut by minute: only minute summaries,
    whose number the calendar bounds, are ordered per question text.
    """
    at = F.unix_micros(F.col("asked_at").cast("timestamp"))
    rows = questions.select(
        "question_id", *same, query_key(F.col("text")).alias("query_key"), at.alias("_at"),
        F.floor(at / (FINE_SECONDS * 1_000_000)).alias("_minute"))
    group = [*same, "query_key"]
    minutes = rows.groupBy(*group, "_minute").agg(F.max("_at").alias("_last"))
    previous = F.lag("_last").over(Window.partitionBy(*group).orderBy("_minute"))
    minutes = minutes.select(*group, "_minute", previous.alias("_before"))
    inside = F.max("_at").over(Window.partitionBy(*group, "_minute").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1))
    # Null-safe keys: a missing language or filter equals another missing one.
    left, right = rows.withColumn("_inside", inside).alias("l"), minutes.alias("r")
    condition = F.lit(True)
    for c in [*group, "_minute"]:
        condition = condition & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    joined = left.join(right, condition).select("l.*", "r._before")
    age = (F.col("_at") - F.coalesce("_inside", "_before")) / 1_000_000.0
    return joined.select("question_id", "query_key", F.when(age < ttl, age).alias("reused_age_seconds"))


def semantic_reuse(questions: DataFrame, ttl: int = ANSWER_TTL_SECONDS, threshold: float = SAME_QUESTION,
                   same: Sequence[str] = ()) -> DataFrame:
    """The most similar earlier question below the ttl whose cosine reaches the threshold.

    questions: question_id, vector, asked_at and the `same` columns.  Time is
    cut into buckets of one ttl; a question meets its own and the previous
    bucket only, and large buckets are cut further by the block grid.
    """
    at = F.unix_micros(F.col("asked_at").cast("timestamp")) / 1_000_000.0
    same = list(same)
    rows = questions.select(F.col("question_id").alias("query_id"), F.col("question_id").alias("chunk_id"), "vector", *same,
                            at.alias("at"), F.floor(at / ttl).alias("bucket"), F.lit(1).alias("k"))
    stored = rows.withColumn("bucket", F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)))
    hits = similarity.topk(rows, stored, on=[*same, "bucket"], ttl_seconds=float(ttl), floor=threshold)
    return hits.select(F.col("query_id").alias("question_id"), F.col("chunk_id").alias("reused_question_id"), "score")
