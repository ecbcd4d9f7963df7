"""Runs of periodic text, by recompression.

A run is a maximal stretch of words with smallest period q that is at least `times` periods and `least` words long.

Candidates: within a run of three periods the words at k*q, (k+1)*q and (k+2)*q are equal for some k, so the grids of all
periods, n/1 + n/2 + ... points (a harmonic sum), show every run.  Exact extensions of a candidate are longest common
extensions of the two places i and i+q, to both sides.  They come from a run-length grammar of the text: rounds of block
compression (equal neighbours become one symbol) and pair compression (symbols are dealt to two sides, each pair from the
first to the second becomes one symbol) until nothing is left to join.  The parse depends on the symbols alone, so equal
stretches have equal symbols but near their ends, and a query climbs and descends the rounds in a few steps each.
All of it runs in numpy on the words of a bounded number of texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.base import mix, small_batches

LEAST, TIMES = 24, 3
#: Words of the texts dealt with at once (a longer text alone), candidates extended at once, and the words whose grid is kept.
AT_ONCE, SLICE, GRID = 200_000, 400_000, 1 << 15
ROW = "array<struct<start: bigint, length: bigint, period: bigint>>"


# ---- the grammar ----


@dataclass
class Level:
    """A round's symbols; for each the place of its first child in the round below (one more at the end); who holds it above."""

    symbols: np.ndarray
    first: np.ndarray
    blocks: bool = False  # do the symbols above stand for blocks?
    above: np.ndarray | None = None


def _join(level: Level, starts: np.ndarray, symbols: np.ndarray, blocks: bool) -> Level:
    """The next round: symbols that begin at the given places."""
    held = np.zeros(len(level.symbols), np.int64)
    held[starts] = 1
    level.above, level.blocks = np.cumsum(held) - 1, blocks
    return Level(symbols, np.append(starts, len(level.symbols)))


def grammar(symbols: np.ndarray, fixed: int) -> list[Level]:
    """The rounds over a sequence of symbols; those below `fixed` are separators, each used once and never joined."""
    levels, named, rounds = [Level(symbols, np.empty(0, np.int64))], int(symbols.max(initial=0)) + 1, 0
    while True:
        level = levels[-1]
        s = level.symbols
        before = len(s)
        starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.empty(0, np.int64)
        if len(starts) < len(s):
            sizes = np.diff(np.append(starts, len(s)))
            new, many = s[starts].copy(), sizes > 1
            distinct, names = np.unique((new[many] << 32) | sizes[many], return_inverse=True)
            new[many] = named + names
            named += len(distinct)
            levels.append(_join(level, starts, new, True))
            level = levels[-1]
            s = level.symbols
        # Two sides at random; the direction with more pairs.
        rounds += 1
        side = (mix(s.astype(np.uint64) * np.uint64(2 * rounds + 1) + np.uint64(rounds)) & np.uint64(1)).astype(bool)
        free = s >= fixed
        joined = (side[:-1] != side[1:]) & free[:-1] & free[1:]
        up = joined & side[:-1]
        down = joined & side[1:]
        at = np.flatnonzero(up if up.sum() >= down.sum() else down)
        if len(at):
            distinct, names = np.unique((s[at] << 32) | s[at + 1], return_inverse=True)
            new = s.copy()
            new[at] = named + names
            named += len(distinct)
            stays = np.ones(len(s), bool)
            stays[at + 1] = False
            starts = np.flatnonzero(stays)
            levels.append(_join(level, starts, new[starts], False))
        if len(levels[-1].symbols) == before and not joined.any():
            return levels


def common(levels: list[Level], a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
    """How many symbols from places a and b on (backward: from there back) are equal; a < b, and separators stop it."""
    begin, way = a, 1 if forward else -1
    a, b = a.copy(), b.copy()

    def edge(k: int, above: np.ndarray) -> np.ndarray:
        """The outermost child of a symbol of round k+1, on the side from which one comes."""
        first = levels[k + 1].first
        return first[above] if forward else first[above + 1] - 1

    def step(k: int, at: np.ndarray) -> None:
        """Go on past equal symbols: by one, or by what both blocks still hold."""
        level = levels[k]
        n = 1
        if level.above is not None and level.blocks:
            first = levels[k + 1].first
            left = [first[level.above[x[at]] + 1] - x[at] if forward else x[at] - first[level.above[x[at]]] + 1 for x in (a, b)]
            n = np.minimum(*left)
        a[at] += way * n
        b[at] += way * n

    live = np.arange(len(a))
    stopped: list[np.ndarray] = []
    for k, level in enumerate(levels):
        climbed, stop = [], []
        while len(live):
            same = level.symbols[a[live]] == level.symbols[b[live]]
            stop.append(live[~same])
            live = live[same]
            if level.above is not None:
                pa_, pb = level.above[a[live]], level.above[b[live]]
                whole = (edge(k, pa_) == a[live]) & (edge(k, pb) == b[live]) & (levels[k + 1].symbols[pa_] == levels[k + 1].symbols[pb])
                up = live[whole]
                a[up], b[up] = pa_[whole], pb[whole]
                climbed.append(up)
                live = live[~whole]
            step(k, live)
        stopped.append(np.concatenate(stop) if stop else live)
        live = np.concatenate(climbed) if climbed else live
    down = np.empty(0, np.int64)
    for k in range(len(levels) - 1, 0, -1):
        down = np.concatenate([down, stopped[k]])
        first = levels[k].first
        for x in (a, b):
            x[down] = first[x[down]] if forward else first[x[down] + 1] - 1
        same = down
        below = levels[k - 1].symbols
        while len(same):
            same = same[below[a[same]] == below[b[same]]]
            step(k - 1, same)
    return np.abs(a - begin)


# ---- candidates ----


@lru_cache(maxsize=1)
def _grid(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places i and periods q of all grids in texts of up to n words, and the words a text needs to hold i, i+q and i+2q."""
    places = [np.arange(0, n - 2 * q, q, dtype=np.int32) for q in range(1, n // TIMES + 1)]
    i, q = np.concatenate(places), np.repeat(np.arange(1, len(places) + 1, dtype=np.int32), [len(p) for p in places])
    needs = np.maximum(i + 2 * q + 1, TIMES * q)
    order = np.argsort(needs, kind="stable")
    return i[order], q[order], needs[order]


def _tested(x: np.ndarray, i: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those grid points that a run can hold: what must be equal between i and i + 2q, at some places."""
    for ahead, times in ((0, 0), (0, 1), (1, 0), (0, 0.5)):
        at = i + ahead + (q * times).astype(i.dtype)
        equal = x.take(at) == x.take(at + q)
        i, q = i[equal], q[equal]
    return i, q


def candidates(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods that may lie in a run, in slices; every run is among them with its smallest period."""
    n = len(x)
    if n <= GRID:
        i, q, needs = _grid(GRID)
        upto = int(np.searchsorted(needs, n, "right"))
        yield _tested(x, i[:upto], q[:upto])
        return
    for period in range(1, n // TIMES + 1):
        for begin in range(0, n - 2 * period, period * SLICE):
            i = np.arange(begin, min(n - 2 * period, begin + period * SLICE), period)
            yield _tested(x, i, np.full(len(i), period))


def _slices(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs, in arrays of about SLICE."""
    held, size = [], 0
    for pair in found:
        held.append(pair)
        size += len(pair[0])
        if size >= SLICE:
            yield tuple(np.concatenate(x).astype(np.int64) for x in zip(*held, strict=True))
            held, size = [], 0
    if size:
        yield tuple(np.concatenate(x).astype(np.int64) for x in zip(*held, strict=True))


def runs_of(texts: list[np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """For each sequence of word ids its runs: rows of start, length, smallest period, by start and period."""
    none = np.empty((0, 3), np.int64)
    out = [none] * len(texts)
    hits = []  # sequences with candidates
    for t, x in enumerate(texts):
        if len(x) >= least and any(len(i) for i, _ in candidates(x)):
            hits.append(t)
    if not hits:
        return out
    # One sequence: a separator, then a text and a separator each; separators are numbers below the ids of words.
    fixed = len(hits) + 1
    parts, begins, at = [np.array([0])], [], 1
    for k, t in enumerate(hits):
        begins.append(at)
        parts += [texts[t].astype(np.int64) + fixed, np.array([k + 1])]
        at += len(texts[t]) + 1
    levels = grammar(np.concatenate(parts), fixed)
    begins_ = np.array(begins)
    kept = none
    moved = ((i.astype(np.int64) + b, q) for b, t in zip(begins, hits, strict=True) for i, q in candidates(texts[t]))
    for i, q in _slices(moved):
        ahead, back = common(levels, i, i + q, True), common(levels, i - 1, i + q - 1, False)
        start, length = i - back, back + q + ahead
        sure = length >= np.maximum(least, TIMES * q)
        kept = np.unique(np.concatenate([kept, np.stack([start[sure], length[sure], q[sure]], axis=1)]), axis=0)
    # Of several periods of one stretch all are multiples of the smallest.
    kept = kept[np.r_[True, (kept[1:, :2] != kept[:-1, :2]).any(axis=1)]] if len(kept) else kept
    owner = np.searchsorted(begins_, kept[:, 0], "right") - 1
    for k in np.unique(owner):
        mine = kept[owner == k] - np.array([begins[k], 0, 0])
        out[hits[k]] = mine[np.lexsort((mine[:, 2], mine[:, 0]))]
    return out


# ---- tables ----


def find(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """key, runs (array of start, length, period in words, by start and period) and collapsed of every row.

    Words are stretches without blanks and \\x09-\\x0D, numbered from 0.  `collapsed` joins by one blank the words that no
    run holds after its first period.  One row per input row, repeated rows and null keys too; a null text has no word,
    no run and an empty collapsed text.  Rows are dealt with on their own, so nothing is shuffled.
    """
    small_batches(df.sparkSession)
    schema = T.StructType([df.schema[key], T.StructField("runs", T._parse_datatype_string(ROW)), T.StructField("collapsed", T.StringType())])

    def deal(keys: list[pa.Array], words: list[list[bytes]]) -> pa.RecordBatch:
        ids: dict[bytes, int] = {}
        found = runs_of([np.fromiter((ids.setdefault(w, len(ids)) for w in ws), np.int32, len(ws)) for ws in words], least)
        collapsed = []
        for ws, runs in zip(words, found, strict=True):
            if len(runs):
                keep = np.ones(len(ws), bool)
                for start, length, period in runs.tolist():
                    keep[start + period : start + length] = False
                ws = [ws[i] for i in np.flatnonzero(keep).tolist()]
            collapsed.append(b" ".join(ws).decode())
        flat = np.concatenate(found)
        rows = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), rows)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), lists, pa.array(collapsed, pa.string())], names=schema.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, words, size = [], [], 0
            for at in range(batch.num_rows):
                keys.append(batch.column(0).slice(at, 1))
                words.append((batch.column(1)[at].as_py() or "").encode().split())
                size += len(words[-1])
                if size > AT_ONCE:
                    yield deal(keys, words)
                    keys, words, size = [], [], 0
            if words:
                yield deal(keys, words)

    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, schema)


def planted(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and text, where every tenth text by the CRC of its id is made periodic from some word on; for tests of `find`."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = df.select(F.col(key), F.col(text).cast("string").alias("_text"), F.when(h % 10 == 0, words).alias("_words"), F.floor(h / 10).alias("_g"))
    n = F.size("_words").cast("long")
    a = F.col("_g") % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.col("_g") % 8))
    rows = rows.select(key, "_text", "_words", F.when(n > 0, n).alias("_n"), F.when(n > 0, a).alias("_a"), F.when(n > 0, p).alias("_p"))
    n, a, p = (F.col(c).cast("int") for c in ("_n", "_a", "_p"))
    again = F.slice(F.flatten(F.array_repeat(F.slice("_words", a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    changed = F.array_join(F.concat(F.slice("_words", F.lit(1), a), again), " ")
    return rows.select(key, F.when(F.col("_n").isNotNull(), changed).otherwise(F.col("_text")).alias(text))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The result columns of the query: counts, the run of the greatest exact exponent, digests."""
    row = "struct<start: bigint, length: bigint, period: bigint>"
    # Runs come by start and period, so of equal exponents the first stays.
    best = F.aggregate("runs", F.lit(None).cast(row), lambda top, r: F.when(top.isNull() | (r["length"] * top["period"] > top["length"] * r["period"]), r).otherwise(top))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"), )), "\n")
    shown = found.select(key, "runs", best.alias("best"), F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").alias("lines"), "collapsed")
    return shown.select(
        key, F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
