"""Vectors as array<float> columns, and the injectable text embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import tokens
from tidemark.plans.session import text_batches

DIMENSION = 64
#: Tokens whose counts are made at once: a batch may hold many long texts.
TOKENS_AT_ONCE = 500_000


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 when either vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


@F.arrow_udf(T.DoubleType())
def cosines(a: pa.Array, b: pa.Array) -> pa.Array:
    """The same for vectors without nulls, all of one length, a batch at a time."""
    x, y = (v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1) if len(v) else np.zeros((0, 1)) for v in (a, b))
    lengths = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    return pa.array(np.divide((x * y).sum(axis=1), lengths, out=np.zeros(len(x)), where=lengths > 0))


def unit(a: Column) -> Column:
    """L2-normalised; a zero vector stays zero."""
    length = norm(a)
    return F.transform(a, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(0.0))


def require_dimension(df: DataFrame, column: str, size: int) -> DataFrame:
    """Fail while reading when a vector has another length."""
    message = F.concat(F.lit("embedding dimension "), F.size(column).cast("string"), F.lit(f" is not {size}"))
    checked = F.when(F.size(column) == size, F.col(column)).when(F.col(column).isNull(), F.col(column)).otherwise(
        F.raise_error(message))
    return df.withColumn(column, checked)


@lru_cache(maxsize=50_000)
def _slot(token: str) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % DIMENSION


def _runs(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of rows that hold at most so many elements together, or one row; `ends` are the running totals."""
    at = 0
    while at < len(ends):
        start = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, start + most, "right")))
        yield at, to
        at = to


def _counted(lists: pa.Array) -> np.ndarray:
    """L2-normalised token counts in hashed slots, a row for each list."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), DIMENSION))
    for a, b in _runs(np.cumsum(lengths), TOKENS_AT_ONCE):
        coded = lists.slice(a, b - a).flatten().dictionary_encode()
        slots = np.array([_slot(t) for t in coded.dictionary.to_pylist()], dtype=np.int64)
        place = np.repeat(np.arange(b - a) * DIMENSION, lengths[a:b])
        place += slots[coded.indices.to_numpy(zero_copy_only=False)] if len(place) else 0
        out[a:b] = np.bincount(place, minlength=(b - a) * DIMENSION).reshape(-1, DIMENSION)
        norms = np.sqrt((out[a:b] * out[a:b]).sum(axis=1, keepdims=True))
        np.divide(out[a:b], norms, out=out[a:b], where=norms > 0)
    return out


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _hashed_counts(lists: pa.Array) -> pa.Array:
    """The counts of token lists, one Arrow batch at a time."""
    offsets = np.arange(0, (len(lists) + 1) * DIMENSION, DIMENSION, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(_counted(lists).ravel()), mask=pc.is_null(lists))


@F.arrow_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _hashed_lists(lists: pa.Array) -> pa.Array:
    """The same for each token list of a row."""
    flat = _hashed_counts.func(lists.flatten())
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), flat, mask=pc.is_null(lists))


def hashed_embeddings(texts: Column) -> Column:
    """A vector for each text of an array."""
    text_batches(SparkSession.active())
    return _hashed_lists(F.transform(texts, tokens))


def hashed_embedding(text: Column) -> Column:
    """Deterministic stand-in for an embedding model; the text is tokenised on the JVM side.

    A column knows no session, so the batches are set in the active one; `embedded` sets them where the rows are.
    """
    text_batches(SparkSession.active())
    return _hashed_counts(tokens(text))


def embedded(df: DataFrame, name: str = "embedding", text: str = "text", embed: Callable[[Column], Column] = hashed_embedding) -> DataFrame:
    """The rows with the vector of their text; batches are small in the session of `df`, be it the active one or not."""
    text_batches(df.sparkSession)
    return df.withColumn(name, embed(F.col(text)))
