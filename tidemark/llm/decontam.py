"""Benchmark decontamination by winnowing.

Of every run of neighbouring k-word hashes the least is kept, on both sides.  A span of ten shared words holds six
five-word hashes, so both sides keep the least of those six: no shared span of ten words can be missed.  A fingerprint
that both sides keep is then extended: every ten-word window around it is compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.base import holds, per_batch, stored, texts_of, windows

SPAN = 10
GRAM = 5
#: Words of a benchmark that is sent to the scan whole; fingerprints of a larger one are joined as tables.
BLOCK_WORDS = 2_000_000
#: Bits of the filter that says which windows of short items may occur.
FILTER = 1 << 26

#: Letters A-Z become lower case, all other ASCII but digits and letters separates words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


def winnowed(keys: np.ndarray, width: int) -> np.ndarray:
    """Places of the least key of each `width` neighbours."""
    if len(keys) < width:
        return np.empty(0, np.int64)
    least = np.lib.stride_tricks.sliding_window_view(keys, width).argmin(axis=1)
    return np.unique(least + np.arange(len(least)))


class Block:
    """The windows of some benchmark items, ready to be looked up."""

    def __init__(self, items: list[tuple[str | None, str]], span: int = SPAN, gram: int = GRAM):
        self.span, self.gram = span, gram
        texts = [words_of(t) for _, t in items]
        self.ids = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        found: dict[int, dict[tuple[int, ...], set[str]]] = {}
        prints = [np.empty(0, np.uint64)]
        for (item, _), words in zip(items, texts, strict=True):
            ids = [self.ids[w] for w in words]
            n = min(len(ids), span)
            for i in range(len(ids) - n + 1) if n else ():
                at = found.setdefault(n, {}).setdefault(tuple(ids[i : i + n]), set())
                if item is not None:
                    at.add(item)
            if n == span:
                keys = windows(np.array(ids, np.uint64), gram)
                prints.append(keys[winnowed(keys, span - gram + 1)])
        self.prints = np.unique(np.concatenate(prints))
        # By window length: sorted keys, the words of each window, the items that have it.
        self.tables = {n: self._table(n, at) for n, at in found.items()}

    @staticmethod
    def _table(n: int, at: dict[tuple[int, ...], set[str]]):
        rows, seed = np.array([*at], np.uint64), 0
        while True:
            keys = np.array([windows(r, n, seed)[0] for r in rows], np.uint64)
            order = np.argsort(keys)
            if len(np.unique(keys)) == len(keys):
                return seed, keys[order], rows[order], [[*at.values()][i] for i in order]
            seed += 1  # two windows share a key: take other keys

    def find(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        """Starts and ends (in pairs, merged) of the hit words, and the items found."""
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        hits, items = [], set()
        for n, (seed, keys, rows, owners) in self.tables.items():
            if len(ids) < n:
                continue
            if n == self.span:
                grams = windows(ids, self.gram)
                grams[windows_with_zero(ids, self.gram)] = np.uint64(0xFFFFFFFFFFFFFFFF)  # no benchmark has that word
                width = n - self.gram + 1
                kept = winnowed(grams, width)
                kept = kept[among(grams[kept], self.prints) >= 0]
                starts = np.unique(kept[:, None] - np.arange(width)[None, :])
                starts = starts[(starts >= 0) & (starts <= len(ids) - n)]
            else:
                starts = np.arange(len(ids) - n + 1)
            if not len(starts):
                continue
            mine = ids[starts[:, None] + np.arange(n)] if n == self.span else np.lib.stride_tricks.sliding_window_view(ids, n)
            at = among(row_keys(mine, seed), keys)
            sure = np.flatnonzero(at >= 0)
            sure = sure[(mine[sure] == rows[at[sure]]).all(axis=1)]
            hits.extend((int(s), int(s) + n) for s in starts[sure])
            for i in np.unique(at[sure]):
                items |= owners[i]
        return merged(hits), items


def row_keys(rows: np.ndarray, seed: int) -> np.ndarray:
    """windows() of each row of a matrix, as one window."""
    n = rows.shape[1]
    flat = windows(np.ascontiguousarray(rows).reshape(-1), n, seed)
    return flat[::n]


def windows_with_zero(ids: np.ndarray, n: int) -> np.ndarray:
    zeros = np.concatenate([[0], np.cumsum(ids == 0)])
    return zeros[n:] > zeros[:-n]


def among(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Place of each key in a sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def merged(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for s, e in sorted(spans):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


_BLOCKS: dict[str, Block] = {}


def _block(name: str, items, span: int, gram: int) -> Block:
    holds("decontam", _BLOCKS.clear)
    if name not in _BLOCKS:
        _BLOCKS.clear()
        _BLOCKS[name] = Block(items.value, span, gram)
    return _BLOCKS[name]


def _items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """Distinct items with a text."""
    return benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL").distinct()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _signed(keys: np.ndarray) -> pa.Array:
    return pa.array(keys.view(np.int64))


def _window_rows(words: list[bytes], starts: np.ndarray, n: int, keys: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    """start, n, key and words (joined by blanks) of some windows."""
    for i in starts.tolist():
        yield i, n, int(keys[i].view(np.int64)), b" ".join(words[i : i + n])


def hits(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
         span: int = SPAN, gram: int = GRAM, block_words: int = BLOCK_WORDS, carry: bool = False) -> DataFrame:
    """Every occurrence of a benchmark window in the texts: key, n_words, hit_spans, hit_items.

    A window is `span` neighbouring words of an item, or the whole item if it has fewer words (but not none).
    hit_spans: merged [start, end) word places, flat; hit_items: the ids, as strings, in their order, each once.  A
    benchmark of at most `block_words` words (measured) is sent to the scan, so the documents are never shuffled; beyond
    that the fingerprints of both sides are tables that are joined (`_joined`).  Both give the same rows.  One row per
    input row, repeated rows too; a null or empty text has no words; an item with a null id marks words but isn't listed.
    With `carry` the columns of df are kept (they must not have the names of the new ones).
    """
    spark, out = df.sparkSession, df if carry else df.select(F.col(key), F.col(text).cast("string").alias(text))
    new = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.LongType())), T.StructField("hit_items", T.ArrayType(T.StringType()))]
    items = _items(benchmark, item, item_text)
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > 2 * block_words:
        out = _joined(out, items, text, span, gram, T.StructType([*out.schema.fields, *new]))
        return out if carry else out.drop(text)
    shared = spark.sparkContext.broadcast([(r["item"], r["text"]) for r in items.collect()])  # measured above
    base, name = out.schema, uuid4().hex

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        block = _block(name, shared, span, gram)
        counts, spans, found = [], [], []
        for t in texts_of(batch.column(batch.schema.get_field_index(text))):
            words = words_of(t)
            s, i = block.find(words)
            counts.append(len(words))
            spans.append(s)
            found.append(sorted(i))
        own = [batch.column(batch.schema.get_field_index(f.name)) for f in base]
        return pa.RecordBatch.from_arrays(
            [*own, pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))], names=[*base.fieldNames(), *(f.name for f in new)])

    out = per_batch(out, run, T.StructType([*base.fields, *new]))
    return out if carry else out.drop(text)


def _joined(docs: DataFrame, items: DataFrame, text: str, span: int, gram: int, schema: T.StructType) -> DataFrame:
    """`hits` for a benchmark of any size: nothing of it passes the driver but a filter of fixed size.

    Winnowed fingerprints of documents and items meet in a join; around those that both have, the windows of the document
    meet the windows of the items by key, and are compared word by word.  Windows of items shorter than `span` have no
    fingerprint; which of the documents' short windows may be one is told by a bitmap of their keys, so only those meet.
    """
    spark, width, names = docs.sparkSession, span - gram + 1, docs.columns
    windows_schema, row = "item string, n int, key long, words binary", "_ref long, start long, n int, key long, words binary"

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                words = words_of(t)
                n = min(len(words), span)
                if n:
                    keys = windows(_hashes(words), n)
                    rows = [*_window_rows(words, np.arange(len(keys)), n, keys)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array([n] * len(rows), pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())],
                                                     names=["item", "n", "key", "words"])

    def prints(batches: Iterator[pa.RecordBatch], ref: int | None) -> Iterator[pa.RecordBatch]:
        """Fingerprints, of items each once (ref None), of documents with row and place."""
        for batch in batches:
            for at, t in enumerate(texts_of(batch.column(1))):
                keys = windows(_hashes(words_of(t)), gram)
                kept = winnowed(keys, width)
                refs = pa.array(np.full(len(kept), batch.column(0)[at].as_py() if ref is not None else 0), pa.int64())
                yield pa.RecordBatch.from_arrays([refs, _signed(keys[kept]), pa.array(kept, pa.int64())], names=["_ref", "print", "place"])

    def short_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER, bool)
        for batch in batches:
            bits[(batch.column(0).to_numpy().view(np.uint64) % np.uint64(FILTER)).astype(np.int64)] = True
        on = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int64())], names=["bit"])

    windows_ = stored(items.mapInArrow(of_items, windows_schema).distinct())
    lengths = [r["n"] for r in windows_.where(F.col("n") < span).select("n").distinct().collect()]  # fewer than span
    packed = np.zeros(FILTER // 8, np.uint8)
    if lengths:
        for r in windows_.where(F.col("n") < span).select("key").mapInArrow(short_bits, "bit long").distinct().toLocalIterator():
            packed[r["bit"] >> 3] |= 1 << (r["bit"] & 7)
    shared = spark.sparkContext.broadcast((sorted(lengths), packed))  # 8 MB
    rows = stored(docs.withColumn("_ref", F.monotonically_increasing_id()))
    texts = rows.select("_ref", F.col(f"`{text}`").cast("string").alias("text"))
    known = items.select(F.lit(0).cast("long").alias("_ref"), "text").mapInArrow(lambda b: prints(b, None), "_ref long, print long, place long").select("print").distinct()
    places = texts.mapInArrow(lambda b: prints(b, 0), "_ref long, print long, place long").join(known, "print").groupBy("_ref").agg(F.collect_list("place").alias("places"))

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, bits = shared.value
        for batch in batches:
            for ref, t, at in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words, out = words_of(t), []
                hashes = _hashes(words)
                for n in short:
                    keys = windows(hashes, n)
                    bit = (keys % np.uint64(FILTER)).astype(np.int64)
                    out += _window_rows(words, np.flatnonzero((bits[bit >> 3] >> (bit & 7)) & 1), n, keys)
                if at:
                    keys = windows(hashes, span)
                    starts = np.unique(np.array(at)[:, None] - np.arange(width)[None, :])
                    out += _window_rows(words, starts[(starts >= 0) & (starts < len(keys))], span, keys)
                yield pa.RecordBatch.from_arrays([pa.array([ref] * len(out), pa.int64()), *(pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary())))],
                                                 names=["_ref", "start", "n", "key", "words"])

    near = texts.join(places, "_ref", "left" if lengths else "inner").select("_ref", "text", "places")
    met = near.mapInArrow(of_docs, row).join(windows_, ["n", "key", "words"]).select("_ref", "start", "n", "item")
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end"))))
    found = met.groupBy("_ref").agg(spans.alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))

    def close(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = lambda c: batch.column(batch.schema.get_field_index(c))
        counts = [len(words_of(t)) for t in texts_of(column("_text"))]
        joined = [merged([(x["start"], x["end"]) for x in s or ()]) for s in column("spans").to_pylist()]
        listed = [sorted(x or ()) for x in column("items").to_pylist()]
        own = [column(c) for c in names]
        return pa.RecordBatch.from_arrays([*own, pa.array(counts, pa.int64()), pa.array(joined, pa.list_(pa.int64())), pa.array(listed, pa.list_(pa.string()))], names=schema.fieldNames())

    whole = rows.join(found, "_ref", "left").withColumn("_text", F.col(f"`{text}`").cast("string")).drop("_ref")
    return per_batch(whole, close, schema)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and the digest of the items, from `hits`."""
    pairs = F.transform(F.sequence(F.lit(1), F.floor(F.size("hit_spans") / 2).cast("int")), lambda i: F.element_at("hit_spans", 2 * i) - F.element_at("hit_spans", 2 * i - 1))
    n_hit = F.when(F.size("hit_spans") == 0, F.lit(0)).otherwise(F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + x)).cast("long")
    return found.select(
        key, "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of `docs` without any benchmark window, all their columns unchanged; nothing is shuffled."""
    names = docs.columns
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    return hits(held, benchmark, text="text", carry=True, **options).where(F.size("hit_spans") == 0).select("row.*")
