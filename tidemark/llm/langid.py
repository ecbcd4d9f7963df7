"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  A trigram is the product of its letters' vectors, the first rotated by
two places, the second by one (binding); a text is the sum of its distinct trigrams' vectors (bundling); a language is
the sum over all trigrams of its training texts.  The language with the largest cosine is predicted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.base import per_batch, texts_of

DIMENSIONS = 1024
AT_ONCE = 1_000_000
BITS = 21  # of a code point
MAX_LANGUAGES = 2000
# Trigram vectors that a task holds at once.
HELD = 30_000

_LETTERS: dict[int, np.ndarray] = {}
_IS_LETTER: list[np.ndarray] = []


def letter_vector(code: int, dimensions: int) -> np.ndarray:
    """The random vector of a code point; 0 is the border of words."""
    if (v := _LETTERS.get(code)) is None or len(v) != dimensions:
        v = _LETTERS[code] = (np.random.default_rng(code).integers(0, 2, dimensions) * 2 - 1).astype(np.int8)
    return v


def trigram_vectors(keys: np.ndarray, dimensions: int) -> np.ndarray:
    """The bound vectors of trigrams, a row each."""
    mask = np.uint64((1 << BITS) - 1)
    parts = [(keys >> np.uint64(s)) & mask for s in (2 * BITS, BITS, 0)]
    out = np.ones((len(keys), dimensions), np.int8)
    for part, turn in zip(parts, (2, 1, 0), strict=True):
        codes, at = np.unique(part, return_inverse=True)
        out *= np.array([np.roll(letter_vector(int(c), dimensions), turn) for c in codes], np.int8).reshape(-1, dimensions)[at]
    return out


def is_letter() -> np.ndarray:
    if not _IS_LETTER:
        _IS_LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _IS_LETTER[0]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and key of each of its trigrams, in lower case; all that isn't a letter is one border."""
    codes = [np.frombuffer(("\0" + t.lower() + "\0").encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(c) for c in codes])
    flat = np.concatenate(codes) if codes else np.empty(0, "<u4")
    flat = np.where(is_letter()[flat], flat, 0).astype(np.uint64)
    keep = np.ones(len(flat), bool)
    keep[1:] = (flat[1:] != 0) | (flat[:-1] != 0) | (owner[1:] != owner[:-1])
    flat, owner = flat[keep], owner[keep]
    if len(flat) < 3:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    a, b, c = flat[:-2], flat[1:-1], flat[2:]
    sure = (b != 0) & (owner[:-2] == owner[2:])
    keys = (a << np.uint64(2 * BITS)) | (b << np.uint64(BITS)) | c
    return owner[:-2][sure], keys[sure]


def groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Parts of a list with a bounded number of characters, and where each begins."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > AT_ONCE:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def profiles(train: DataFrame, text: str, lang: str, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """The bundled vector of each language: its trigrams are counted over all training texts, then bound and summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = texts_of(batch.column(0)), batch.column(1).to_pylist()
            for start, part in groups(texts):
                owner, keys = trigrams(part)
                names, of = np.unique(np.array(langs[start : start + len(part)], object).astype(str), return_inverse=True)
                for i, name in enumerate(names):
                    found, n = np.unique(keys[of[owner] == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([str(name)] * len(found)), pa.array(found.astype(np.int64)), pa.array(n, pa.int64())], names=["lang", "key", "n"])

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            keys, n = batch.column(1).to_numpy().astype(np.uint64), batch.column(2).to_numpy()
            langs = np.array(batch.column(0).to_pylist(), object)
            for at in range(0, len(keys), 4096):
                vectors, part = trigram_vectors(keys[at : at + 4096], dimensions), langs[at : at + 4096]
                for name in set(part.tolist()):
                    mine = part == name
                    sums[name] = sums.get(name, 0) + n[at : at + 4096][mine] @ vectors[mine].astype(np.int64)
        for name, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dimensions), pa.array(np.arange(dimensions)), pa.array(v)], names=["lang", "at", "v"])

    counts = train.select(F.col(text), F.col(lang)).mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    sums = counts.mapInArrow(bundle, "lang string, at long, v long").groupBy("lang", "at").agg(F.sum("v").alias("v"))
    rows = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("v")).limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} values of {lang}: not a language column")
    return {r["lang"]: np.array([x["v"] for x in r["v"]], np.float64) for r in rows}


def score_texts(texts: list[str], names: list[str], prototypes: np.ndarray) -> tuple[list[str], list[float]]:
    """Best language and cosine of each text; `und` and 0 for a text without a letter."""
    best, scores = ["und"] * len(texts), [0.0] * len(texts)
    dimensions = prototypes.shape[1]
    for start, part in groups(texts):
        owner, keys = trigrams(part)
        if not len(keys):
            continue
        known, at = np.unique(keys, return_inverse=True)
        pairs = np.unique(owner * len(known) + at)
        owner, at = pairs // len(known), pairs % len(known)
        vectors = trigram_vectors(known, dimensions) if len(known) <= HELD else None
        firsts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        ends = np.r_[firsts[1:], len(owner)]
        for s, e in zip(firsts.tolist(), ends.tolist(), strict=True):
            if vectors is not None:
                bundle = vectors[at[s:e]].sum(axis=0, dtype=np.int64).astype(np.float64)
            else:  # a large alphabet: bind and add block by block
                bundle = sum(trigram_vectors(known[at[i : min(e, i + HELD // 8)]], dimensions).sum(axis=0, dtype=np.int64) for i in range(s, e, HELD // 8)).astype(np.float64)
            norm = math.sqrt(float(bundle @ bundle))
            cosines = prototypes @ bundle / norm if norm else np.zeros(len(names))
            top = int(cosines.argmax())
            best[start + owner[s]], scores[start + owner[s]] = names[top], float(min(1.0, max(0.0, cosines[top])))
    return best, scores


def predict(df: DataFrame, learned: dict[str, np.ndarray], key: str = "doc_id", text: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """key, lang_pred and score (cosine, 0 to 1) of every whole text; further columns of df by `carry`.

    `und` with score 0 for a null or empty text, one without a letter, and if no language was learned.  Equal cosines
    go to the first language by name.  One row per input row, repeated rows too.
    """
    carry = carry or {}
    names = sorted(learned)
    matrix = np.array([learned[n] / (np.linalg.norm(learned[n]) or 1.0) for n in names]) if names else np.zeros((0, DIMENSIONS))
    held = df.select(F.col(key), F.col(text).cast("string").alias("_text"), *(c.alias(n) for n, c in carry.items()))
    schema = T.StructType([held.schema[key], *(held.schema[n] for n in carry), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    # A vector for each language, at most MAX_LANGUAGES.
    shared = df.sparkSession.sparkContext.broadcast((names, matrix))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column(1))
        best, scores = score_texts(texts, *shared.value) if shared.value[0] else (["und"] * len(texts), [0.0] * len(texts))
        return pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(best, pa.string()), pa.array(scores, pa.float64())], names=schema.fieldNames())

    return per_batch(held, run, schema)
