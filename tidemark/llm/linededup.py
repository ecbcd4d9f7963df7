"""Line dedup: later copies of repeated line runs are deleted.

A text is the sequence of its lines that have a word.  Suffixes (a text from some line on) get ranks by prefix
doubling: at level k two suffixes have one rank exactly if their first 2^k lines agree.  A rank is named by the first
place that has it, so no level needs a global order and a hot line is never sorted in one task.  Suffixes that share
a prefix of d lines are an interval of common prefix d; it is known by two overlapping ranks of the level below d.

A run counts from `min_words` words on.  Every line of a repeated run lies in a shortest such prefix from some line
on, or in a shortest such suffix up to some line, inside the run; so the intervals of these shortest runs show all
lines of all maximal repeated runs.  The first copy of an interval, by document and line, stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import holds, per_batch, stored
from tidemark.plans.session import salted_join

MIN_WORDS = 50
BLANK = " \t\n\x0b\x0c\r"
PLACE = ["_d", "_h", "i"]


def _identity(key: str, text: str) -> list[Column]:
    """A document is its id and text; rows equal in both are one document, with one decision."""
    return [F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("_d"), F.xxhash64(F.col(text)).alias("_h")]


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Lines with a word: place (_d, _h, i), number in the text, words, and 128 bits of the trimmed line as its id."""
    trimmed = F.transform(F.split(F.col(text), "\n", -1), lambda x, n: F.struct(n.alias("line"), F.btrim(x, F.lit(BLANK)).alias("text")))
    return docs.select(*_identity(key, text), F.posexplode(F.filter(trimmed, lambda x: x["text"] != "")).alias("i", "x")).select(
        *PLACE, "x.line", F.regexp_count("x.text", F.lit("[^ \\t-\\r]+")).alias("words"),
        F.xxhash64("x.text").alias("k1"), F.xxhash64(F.lit(1), "x.text").alias("k2"))


_RUNS = "_d long, _h long, i int, size int, first int, last int, rank struct<_d: long, _h: long, i: int>"


def _shortest_runs(min_words: int):
    """From the repeated lines of each document: its places (size 0) and its shortest runs with enough words."""

    def of(lines: list[dict]) -> Iterator[tuple[int, int, int, int, dict | None]]:
        start = 0
        for end in range(1, len(lines) + 1):
            if end < len(lines) and lines[end]["i"] == lines[end - 1]["i"] + 1:
                continue
            part, start = lines[start:end], end
            if sum(x["words"] for x in part) < min_words:
                continue
            runs = set()
            a = total = 0
            for b, x in enumerate(part):  # the shortest run up to each line
                total += x["words"]
                while total - part[a]["words"] >= min_words:
                    total -= part[a]["words"]
                    a += 1
                if total >= min_words:
                    runs.add((a, b))
            b, total = len(part) - 1, 0
            for a in range(len(part) - 1, -1, -1):  # and from each line on
                total += part[a]["words"]
                while total - part[b]["words"] >= min_words:
                    total -= part[b]["words"]
                    b -= 1
                if total >= min_words:
                    runs.add((a, b))
            for x in part:
                yield x["i"], 0, 0, 0, x["rank"]
            for a, b in sorted(runs):
                yield part[a]["i"], b - a + 1, part[a]["line"], part[b]["line"], None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds("linededup")
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.struct([("_d", pa.int64()), ("_h", pa.int64()), ("i", pa.int32())])]
        names = ["_d", "_h", "i", "size", "first", "last", "rank"]
        for batch in batches:
            rows = [(d, h, *r) for d, h, lines in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in of(lines)]
            for at in range(0, len(rows), 50_000):
                part = rows[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in part], kind) for c, kind in enumerate(kinds)], names=names)

    return run


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys occur at several places, with the first place as `rank`."""
    groups = rows.groupBy(*keys).agg(F.min(F.struct(*PLACE)).alias("rank"), F.max(F.struct(*PLACE)).alias("top")).where("rank != top").drop("top")
    return salted_join(rows, groups, keys, "_h", "inner", parts=8)


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Line ranges to delete of each document: _d, _h (see `_identity`), ranges (array of first, last; merged)."""
    repeated = _named(_lines(docs, key, text), ["k1", "k2"])
    per_doc = repeated.groupBy("_d", "_h").agg(F.sort_array(F.collect_set(F.struct("i", "line", "words", "rank"))).alias("lines"))
    both = stored(per_doc.mapInArrow(_shortest_runs(min_words), _RUNS))
    runs = both.where("size > 0").drop("rank")
    ranks = both.where("size = 0").select(*PLACE, "rank")
    longest = runs.agg(F.max("size")).first()[0] or 0  # at most min_words: each line has a word
    intervals, k = None, 1
    while k <= longest:
        a, b = (ranks.select("_d", "_h", F.col("i").alias("_at"), F.col("rank").alias(c)) for c in ("left", "right"))
        mine = runs.where((F.col("size") >= k) & (F.col("size") < 2 * k))
        pairs = mine.withColumn("_at", F.col("i")).join(a, ["_d", "_h", "_at"]).withColumn("_at", F.col("i") + F.col("size") - k).join(b, ["_d", "_h", "_at"])
        pairs = pairs.drop("_at")
        intervals = pairs if intervals is None else intervals.unionByName(pairs)
        if 2 * k <= longest:
            step = ranks.withColumnRenamed("rank", "left").withColumn("_at", F.col("i") + k).join(b, ["_d", "_h", "_at"]).drop("_at")
            ranks = stored(_named(step, ["left", "right"]).select(*PLACE, "rank"))
        k *= 2
    if intervals is None:
        return runs.select("_d", "_h", F.array(F.struct("first", "last")).alias("ranges")).limit(0)
    copies = _named(intervals, ["size", "left", "right"]).where(F.struct(*PLACE) != F.col("rank"))
    ranges = copies.groupBy("_d", "_h").agg(F.sort_array(F.collect_set(F.struct("i", (F.col("i") + F.col("size")).alias("end"), "first", "last"))).alias("ranges"))

    def merge(batch: pa.RecordBatch) -> pa.RecordBatch:
        holds("linededup")
        out = []
        for row in batch.column(2).to_pylist():
            merged: list[dict] = []
            for r in row:
                if merged and r["i"] <= merged[-1]["end"]:  # no line with a word lies between
                    merged[-1]["end"], merged[-1]["last"] = max(merged[-1]["end"], r["end"]), max(merged[-1]["last"], r["last"])
                else:
                    merged.append(dict(r))
            out.append([{"first": m["first"], "last": m["last"]} for m in merged])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))], names=["_d", "_h", "ranges"])

    return per_batch(ranges, merge, "_d long, _h long, ranges array<struct<first: int, last: int>>")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows of `docs` in the column `row`, with `cleaned` (the text without later copies) and `ranges` (deleted lines).

    Lines are compared without the white space around them.  Lines without a word are passed over; they go if the next
    lines with a word on both sides go.  `ranges` is null for a document that loses nothing; its text stays as it is, null too.  A document
    may lose all its lines and is then an empty text.  Rows of one id and different texts are different documents.
    """
    copies = later_copies(docs, min_words, key, text).select(F.col("_d").alias("_cd"), F.col("_h").alias("_ch"), "ranges")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_identity(key, text))
    joined = rows.join(copies, (F.col("_d") == F.col("_cd")) & (F.col("_h") == F.col("_ch")), "left")
    old = F.col("row")[text]
    kept = F.filter(F.split(old, "\n", -1), lambda x, n: ~F.exists("ranges", lambda r: (n >= r["first"]) & (n <= r["last"])))
    return joined.select("row", F.when(F.col("ranges").isNull(), old).otherwise(F.array_join(kept, "\n")).alias("cleaned"), "ranges")


def clean(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """`docs` with cleaned texts (and their length, if there is such a column); documents that lose all words go."""
    out = dedup(docs, min_words, key, text).where(F.col("ranges").isNull() | (F.btrim("cleaned", F.lit(BLANK)) != ""))
    new = {text: F.col("cleaned")}
    if length in docs.columns:
        new[length] = F.when(F.col("ranges").isNull(), F.col("row")[length]).otherwise(F.char_length("cleaned")).cast(docs.schema[length].dataType)
    return out.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
