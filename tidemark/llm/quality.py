"""Quality rules: word and line counts, and compression bands that reject repetitive or incompressible text."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.base import BLANKS, holds, per_batch, texts_of, windows

SYMBOLS = b"#*$%&|<>"
RUN = 8


@dataclass(frozen=True)
class Bands:
    """Allowed zstandard ratio (compressed over raw bytes) from a byte length on, for whole texts and for chunks.

    Prose needs some length before it compresses, so both limits fall with the length.  Texts below the first length
    have no band.  A text also fails if more than `chunk_share` of its chunks leave the chunk band: that finds
    repetition and noise that a long text hides in its mean.  The last, partial chunk joins the one before it.
    """

    level: int = 3
    whole: tuple[tuple[int, float, float], ...] = (
        (128, 0.30, 1.05), (256, 0.25, 0.90), (512, 0.25, 0.80), (1024, 0.20, 0.74), (4096, 0.18, 0.70), (16384, 0.15, 0.68))
    chunk_bytes: int = 2048
    chunk: tuple[float, float] = (0.15, 0.74)
    chunk_share: float = 0.3
    min_words: int = 20
    repeat_percent: int = 30
    chunked_from: int = field(default=4096)

    def limits(self, size: int) -> tuple[float, float]:
        low, high = 0.0, float("inf")
        for start, lo, hi in self.whole:
            if size >= start:
                low, high = lo, hi
        return low, high


def repeat_words(words: list[bytes]) -> int:
    """Words inside runs of eight words that occur twice or more in the text, the first copy included."""
    if len(words) <= RUN:
        return 0
    keys = windows(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64), RUN)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    twice = np.unique(np.concatenate([order[1:][same], order[:-1][same]])).tolist()
    # Equal keys are only candidates; the words decide.
    runs = {i: tuple(words[i : i + RUN]) for i in twice}
    count = Counter(runs.values())
    edges = np.zeros(len(words) + 1, np.int64)
    for i, run in runs.items():
        if count[run] > 1:
            edges[i] += 1
            edges[i + RUN] -= 1
    return int((np.cumsum(edges[:-1]) > 0).sum())


def ratios(raw: bytes, bands: Bands, compressor: zstandard.ZstdCompressor) -> tuple[float, float]:
    """Ratio of the whole text and share of its chunks outside the chunk band."""
    if not raw:
        return 0.0, 0.0
    whole = len(compressor.compress(raw)) / len(raw)
    if len(raw) < bands.chunked_from:
        return whole, 0.0
    starts = range(0, len(raw) - bands.chunk_bytes + 1, bands.chunk_bytes)
    low, high = bands.chunk
    outside = 0
    for s in starts:
        part = raw[s : s + bands.chunk_bytes] if s != starts[-1] else raw[s:]
        outside += not low <= len(compressor.compress(part)) / len(part) <= high
    return whole, outside / len(starts)


def measure(text: str, bands: Bands, compressor: zstandard.ZstdCompressor) -> tuple:
    """The columns of `rules` after the key, for one text."""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = repeat_words(words)
    failed = len(words) < bands.min_words or 100 * repeated > bands.repeat_percent * len(words)
    whole, outside = ratios(raw, bands, compressor)
    low, high = bands.limits(len(raw))
    kept = not failed and low <= whole <= high and outside <= bands.chunk_share
    blanks = len(raw) - len(raw.translate(None, BLANKS))
    return (len(words), len(text) - blanks, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated,
            failed, kept, whole, outside)


COLUMNS = [
    ("n_words", pa.int64(), "long"), ("word_chars", pa.int64(), "long"), ("n_symbols", pa.int64(), "long"), ("n_dup_lines", pa.int64(), "long"),
    ("n_repeat_words", pa.int64(), "long"), ("base_failed", pa.bool_(), "boolean"), ("kept", pa.bool_(), "boolean"),
    ("ratio", pa.float64(), "double"), ("chunks_outside", pa.float64(), "double")]


def rules(df: DataFrame, bands: Bands = Bands(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, compression ratios and the verdict of every text, one row per input row (repeated rows and null keys too).

    A null or empty text has no words, so it fails the base rule.  Only key and text are read; other columns are left out.
    """
    schema = T.StructType([df.schema[key], *(T.StructField(n, T._parse_datatype_string(t)) for n, _, t in COLUMNS)])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        holds("quality")
        compressor = zstandard.ZstdCompressor(level=bands.level, write_content_size=False)
        rows = [measure(t, bands, compressor) for t in texts_of(batch.column(1))]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array([r[i] for r in rows], kind) for i, (_, kind, _) in enumerate(COLUMNS))], names=[key, *(n for n, _, _ in COLUMNS)])

    return per_batch(df.select(F.col(key), F.col(text).cast("string")), run, schema)


def keep(docs: DataFrame, bands: Bands = Bands(), text: str = "text") -> DataFrame:
    """The rows of `docs` whose text passes, all their columns unchanged; nothing is shuffled."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        holds("quality")
        compressor = zstandard.ZstdCompressor(level=bands.level, write_content_size=False)
        texts = texts_of(batch.column(batch.schema.get_field_index(text)))
        return batch.filter(pa.array([measure(t, bands, compressor)[6] for t in texts], pa.bool_()))

    return per_batch(docs, run, docs.schema)
