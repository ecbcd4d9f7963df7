"""BM25 over an inverted index with impact-ordered blocks: blocks that cannot reach a question's k-th score are skipped.

The index is a plain table, written once.  Chunks are taken in shards of bounded size; a shard has one row that describes
its chunks (term "") and one row for each term: places of the chunks and frequencies, the greatest impact first, cut into
blocks that carry their largest frequency and shortest length.  Both bound what a block can add whatever the average
length of the corpus turns out to be, so shards can be added later without touching older ones.

A question takes its terms in the order of what they can add at most.  While a chunk not seen so far could still reach
the k-th score, the leading blocks of a term are read, up to the first bound that is too small; chunks seen before are
looked up in the rest.  Once no new chunk can come up, only the remaining candidates are looked up.  Nothing is cut off:
the rows are those of scoring every chunk, ties included.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions.similarity import DIGITS
from tidemark.functions.text import tokens
from tidemark.plans.session import cut_lineage, small_enough, text_batches

# Fixed values of the ranking.
K1, B = 1.5, 0.75
#: Chunks of a shard, and postings of a block.
SHARD, BLOCK = 8192, 64
#: Chunks whose tokens are counted at once; of a shard only the counts are held.
AT_ONCE = 500
#: Distinct (question, term) rows that may be sent to every task: some 20 MB.
MAX_SENT_TERMS = 300_000
#: Scores closer than this may be equal once they are rounded.
MARGIN = 2 * 10.0**-DIGITS
CHUNKS = ""  # the term of the row that describes the chunks of a shard; no token is empty


# ---- index ----


def _binary(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Stretches of 32-bit values as binary cells."""
    flat = np.ascontiguousarray(values, np.int32)
    offsets = np.append(starts, len(flat)).astype(np.int32) * 4
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())])


def _counts(lists: pa.Array, only: pa.Array | None) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, and for each (term, chunk): number of the term, place, frequency; lengths of all chunks.  The tokens go then."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    if only is None:
        coded = flat.dictionary_encode()
        terms, codes = coded.dictionary, coded.indices
    else:
        terms, codes = only, pc.index_in(flat, value_set=only)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    known = pc.is_valid(codes).to_numpy(zero_copy_only=False)
    n = max(1, len(lengths))
    both, tf = np.unique(codes.drop_null().to_numpy(zero_copy_only=False).astype(np.int64) * n + owner[known], return_counts=True)
    return terms, both // n, both % n, tf, lengths


def _postings(parts: list[tuple], only: pa.Array | None):
    """Terms, and sorted by term then impact: where each begins, places, frequencies, block bounds; lengths of all chunks."""
    lengths = np.concatenate([np.empty(0, np.int64), *(p[4] for p in parts)])
    firsts = np.cumsum([0, *(len(p[4]) for p in parts)])
    place = np.concatenate([np.empty(0, np.int64), *(p[2] + first for p, first in zip(parts, firsts, strict=False))])
    tf = np.concatenate([np.empty(0, np.int64), *(p[3] for p in parts)])
    if only is None:
        coded = pa.concat_arrays([pa.array([], pa.string()), *(p[0].cast(pa.string()) for p in parts)]).dictionary_encode()
        terms, number = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        of = np.cumsum([0, *(len(p[0]) for p in parts)])
        term = np.concatenate([np.empty(0, np.int64), *(number[p[1] + first] for p, first in zip(parts, of, strict=False))])
    else:
        terms, term = only, np.concatenate([np.empty(0, np.int64), *(p[1] for p in parts)])
    average = lengths.mean() if len(lengths) else 1.0  # only orders the postings
    impact = tf / (tf + K1 * (1 - B + B * np.maximum(lengths[place], 1) / max(average, 1.0)))
    order = np.lexsort((place, -impact, term))
    term, place, tf = term[order], place[order], tf[order]
    starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.empty(0, np.int64)
    within = np.arange(len(term)) - np.repeat(starts, np.diff(np.append(starts, len(term))))
    blocks = np.flatnonzero(within % BLOCK == 0)
    most = np.maximum.reduceat(tf, blocks) if len(blocks) else blocks
    least = np.minimum.reduceat(lengths[place], blocks) if len(blocks) else blocks
    return terms.take(pa.array(term[starts])), starts, place, tf, np.searchsorted(blocks, starts), most, least, lengths


def build(chunks: DataFrame, only: Sequence[str] | None = None, shard: int = SHARD) -> DataFrame:
    """The index of chunks (chunk_id, t: list of tokens, further columns to carry): shard, term, n, length, places,
    frequencies, most, least, chunks.

    With `only` just those terms are indexed, for questions known beforehand; lengths and the number of chunks are those
    of the whole corpus anyway.  Chunks without tokens count.
    """
    carried = [f for f in chunks.schema if f.name != "t"]
    described = T.ArrayType(T.StructType(carried))
    binary = [T.StructField(c, T.BinaryType()) for c in ("places", "frequencies", "most", "least")]
    schema = T.StructType([
        T.StructField("shard", T.StringType()), T.StructField("term", T.StringType()), T.StructField("n", T.LongType()), T.StructField("length", T.LongType()), *binary, T.StructField("chunks", described)])
    arrow, part_of = to_arrow_schema(schema), uuid4().hex
    vocabulary = None if only is None else chunks.sparkSession.sparkContext.broadcast(list(only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names, wanted, number = [f.name for f in carried], None if vocabulary is None else pa.array(vocabulary.value, pa.string()), 0

        def rows(table: pa.Table, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            table = table.combine_chunks()
            terms, starts, place, tf, first, most, least, lengths = _postings(parts, wanted)
            name = f"{part_of}-{TaskContext.get().partitionId()}-{number}"
            number += 1
            about = pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), pa.StructArray.from_arrays([table[c].combine_chunks() for c in names], fields=list(arrow.field("chunks").type.value_type)))
            none = pa.nulls(1, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([CHUNKS]), pa.array([table.num_rows]), pa.array([int(lengths.sum())]), none, _binary(lengths, np.zeros(1, np.int64)), none, none, about], schema=arrow)
            counts = np.diff(np.append(starts, len(place)))
            if len(starts):
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * len(starts)), terms, pa.array(counts), pa.nulls(len(starts), pa.int64()), _binary(place, starts), _binary(tf, starts), _binary(most, first), _binary(least, first),
                    pa.nulls(len(starts), arrow.field("chunks").type)], schema=arrow)

        held, counted, size = [], [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, min(shard - size, AT_ONCE))
                counted.append(_counts(part.column("t"), wanted))
                held.append(part.select(names))
                size, at = size + part.num_rows, at + part.num_rows
                if size >= shard:
                    yield from rows(pa.Table.from_batches(held), counted)
                    held, counted, size = [], [], 0
        if size:
            yield from rows(pa.Table.from_batches(held), counted)

    text_batches(chunks.sparkSession)
    return cut_lineage(chunks.mapInArrow(run, schema))


def described(index: DataFrame) -> DataFrame:
    """The chunks of an index with the columns it carries."""
    return index.where(F.col("term") == CHUNKS).select(F.explode("chunks").alias("c")).select("c.*")


# ---- one shard ----


class Postings:
    """What a term adds to the chunks of a shard, the most first."""

    def __init__(self, places: np.ndarray, gains: np.ndarray, bounds: np.ndarray):
        self.places, self.gains = places, gains
        # What the blocks from here on can add at most.
        self.bounds = np.maximum.accumulate(bounds[::-1])[::-1]
        self.top = float(self.bounds[0]) if len(bounds) else 0.0
        self._sorted: tuple[np.ndarray, np.ndarray] | None = None

    def leading(self, needed: float) -> int:
        """Postings before the first block that can't add this much, nor any after it."""
        return min(len(self.places), BLOCK * int(np.searchsorted(-self.bounds, -needed, "right")))

    def behind(self, places: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the places have a posting from `begin` on, and what it adds."""
        if self._sorted is None:
            order = np.argsort(self.places, kind="stable")
            self._sorted = self.places[order], order
        known, order = self._sorted
        at = np.minimum(np.searchsorted(known, places), len(known) - 1)
        rank = order[at]
        hit = np.flatnonzero((known[at] == places) & (rank >= begin))
        return hit, self.gains[rank[hit]]


class Shard:
    def __init__(self, lengths: np.ndarray, ids: np.ndarray, usable: np.ndarray | None, average: float):
        self.norm = K1 * (1 - B + B * np.maximum(lengths, 1) / average)
        self.ids, self.usable, self.average = ids, usable, average
        self.terms: dict[str, Postings] = {}
        self.sums, self.seen = np.zeros(len(lengths)), np.zeros(len(lengths), bool)
        self.read = 0  # postings touched by leading blocks

    def add(self, term: str, places: np.ndarray, tf: np.ndarray, most: np.ndarray, least: np.ndarray) -> None:
        gains = tf * (K1 + 1) / (tf + self.norm[places])
        bounds = most * (K1 + 1) / (most + K1 * (1 - B + B * np.maximum(least, 1) / self.average))
        if self.usable is not None:
            keep = self.usable[places]
            places, gains = places[keep], gains[keep]
            bounds = np.maximum.reduceat(gains, np.arange(0, len(gains), BLOCK)) if len(gains) else gains
        self.terms[term] = Postings(places, gains, bounds)

    def best(self, terms: list[tuple[str, float]], k: int) -> list[tuple[float, object]]:
        """The k best (score, chunk id) of a question given as terms with weights; all scores are positive."""
        asked = sorted(((w, self.terms[t]) for t, w in terms if t in self.terms and len(self.terms[t].places)), key=lambda x: -x[0] * x[1].top)
        after = np.append(np.cumsum([w * p.top for w, p in asked][::-1])[::-1], 0.0)
        sums, seen, least = self.sums, self.seen, -math.inf
        live, touched, open_ = np.empty(0, np.int64), [], True
        for i, (w, p) in enumerate(asked):
            open_ = open_ and after[i] >= least - MARGIN
            begin = p.leading((least - after[i + 1] - MARGIN) / w) if open_ else 0
            before = live
            if begin:
                self.read += begin
                places = p.places[:begin]
                sums[places] += w * p.gains[:begin]
                new = places[~seen[places]]
                seen[new] = True
                touched.append(new)
                live = np.concatenate([live, new])
            if begin < len(p.places) and len(before):
                hit, gains = p.behind(before, begin)
                sums[before[hit]] += w * gains
            if len(live) >= k:
                mine = sums[live]
                least = np.partition(mine, len(mine) - k)[len(mine) - k]
                live = live[mine + after[i + 1] >= least - MARGIN]
        scores = np.round(sums[live], DIGITS)
        for t in touched:
            sums[t], seen[t] = 0.0, False
        good = scores > 0
        live, scores = live[good], scores[good]
        if len(live) > k:
            floor = np.partition(scores, len(scores) - k)[len(scores) - k]
            live, scores = live[scores >= floor], scores[scores >= floor]
        return sorted(zip(scores.tolist(), self.ids[live].tolist(), strict=True), key=lambda x: (-x[0], x[1]))[:k]


def _shards(rows: Iterator[dict], average: float) -> Iterator[Shard]:
    """From rows ordered by shard and term, the describing row first."""
    now, shard = None, None
    ints = lambda x: np.frombuffer(x, np.int32).astype(np.int64)
    for r in rows:
        if r["term"] == CHUNKS:
            if shard is not None:
                yield shard
            about = r["chunks"]
            usable = np.array([bool(c.get("usable", True)) for c in about], bool)
            ids = np.empty(len(about), object)
            ids[:] = [c["chunk_id"] for c in about]
            now, shard = r["shard"], Shard(ints(r["frequencies"]), ids, None if usable.all() else usable, average)
        elif r["shard"] == now:
            shard.add(r["term"], *(ints(r[c]) for c in ("places", "frequencies", "most", "least")))
    if shard is not None:
        yield shard


# ---- search ----


def query_terms(questions: DataFrame) -> DataFrame:
    """(query_id, k, term, qtf); a repeated term counts every time."""
    rows = questions.select("query_id", "k", F.explode(tokens(F.col("text"))).alias("term"))
    return rows.groupBy("query_id", "k", "term").agg(F.count(F.lit(1)).alias("qtf"))


def weight(n: float, df: float) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def _answers(asked: pd.DataFrame, shards: Iterator[Shard]) -> Iterator[list[tuple]]:
    """asked: query_id, k, term, w.  Rows (query_id, chunk_id, score, k) of each shard."""
    questions = [(q, int(g["k"].iloc[0]), list(zip(g["term"], g["w"], strict=True))) for q, g in asked.groupby("query_id", sort=False, dropna=False)]
    for shard in shards:
        yield [(None if pd.isna(q) else q, c, s, k) for q, k, terms in questions for s, c in shard.best(terms, k)]


def search(index: DataFrame, terms: DataFrame, max_terms: int = MAX_SENT_TERMS) -> DataFrame:
    """query_id, chunk_id, score, rank of the k best chunks per question, from `query_terms`.

    Rows of the terms asked meet by shard.  Up to `max_terms` rows of question terms (measured) are sent to every task;
    beyond that questions are dealt into blocks, and each (shards, block of questions) cell is a group of its own.  Both
    give the same rows.  A carried column `usable` restricts the result, not the statistics.
    """
    about = index.schema["chunks"].dataType.elementType
    spark, chunk = index.sparkSession, next(f for f in about if f.name == "chunk_id")
    # Vectors and other carried columns stay where they are.
    read = [f.name for f in about if f.name in ("chunk_id", "usable")]
    index = index.withColumn("chunks", F.transform("chunks", lambda c: F.struct(*[c[x].alias(x) for x in read])))
    schema = T.StructType([terms.schema["query_id"], chunk, T.StructField("score", T.DoubleType()), T.StructField("k", T.IntegerType())])
    arrow = to_arrow_schema(schema)
    about = index.where(F.col("term") == CHUNKS).agg(F.sum("n").alias("n"), F.sum("length").alias("length"), F.count("*").alias("shards")).first()
    n = about["n"] or 0
    average = about["length"] / n if n and about["length"] else 1.0
    words = terms.select("term").distinct()
    few = small_enough(terms, max_terms)
    rows = index.join(F.broadcast(words) if few else words, "term", "left_semi").unionByName(index.where(F.col("term") == CHUNKS))
    frequency = index.join(F.broadcast(words) if few else words, "term").groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = terms.join(frequency, "term").select("query_id", F.col("k").cast("int").alias("k"), "term", (F.col("qtf") * idf).alias("w"))
    as_batch = lambda found: pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(arrow)], schema=arrow)
    if few:
        sent = spark.sparkContext.broadcast(weighted.toPandas())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for found in _answers(sent.value, _shards((r for b in batches for r in b.to_pylist()), average)):
                yield as_batch(found)

        # Work grows with the questions, not with the bytes of a shard: AQE must not merge shards into one task.
        tasks = min(max(1, about["shards"]), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
        found = rows.repartition(tasks, "shard").sortWithinPartitions("shard", "term").mapInArrow(run, schema)
    else:
        blocks = max(1, -(-terms.count() // max(1, max_terms)))
        groups = max(1, about["shards"])
        block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
        dealt = weighted.withColumn("block", block).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        used = weighted.select(block.alias("block"), "term").distinct()
        of_cell = F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("int").alias("cell")
        held = index.join(used, "term").select("*", of_cell).unionByName(
            index.where(F.col("term") == CHUNKS).select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), of_cell))

        def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            ordered = b.sort_values(["shard", "term"], kind="stable")
            found = [r for part in _answers(a, _shards(iter(ordered.to_dict("records")), average)) for r in part]
            return pd.DataFrame(found, columns=["query_id", "chunk_id", "score", "k"])

        found = dealt.groupBy("block", "cell").cogroup(held.groupBy("block", "cell")).applyInPandas(meet, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("k")).drop("k")
