"""Approximate nearest neighbours by signed random projections: tables of codes, multi-probe, signatures.

Every vector has a long signature (the signs of projections on random directions) and, in several tables, a short code
(the signs on further directions).  Two vectors are compared only if in some table the code of one is among those the
other one probes: its own and the cheapest to reach, by the squares of the margins of the signs that must flip.  Pairs
that meet are ranked by the distance of their signatures, and only the best `rescored` per question get an exact score.

Directions are drawn orthogonally in groups, which halves the error of the distances.  They follow from the seed, so the
index is a plain table that is written once and can be read by any later session.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions import similarity
from tidemark.functions.vectors import cosines
from tidemark.plans.session import broadcast_if_small, cut_lineage

#: Questions that are sent to the scan at once; beyond, both sides are cut into blocks.
BLOCK = 4096
#: Questions that are compared at once with a piece of the chunks.
QUESTIONS = 2048
#: Vectors that are projected, or whose probes are made, at once.
ROWS = 512
#: Pairs whose signatures are compared at once.
AT_ONCE = 400_000
#: Signs whose products add up exactly in single precision for two questions at once, one of them times SECOND.
SIGNS, SECOND = 1024, 4096
#: Where more than this share of a tile may come in, all of it is worked on.
FEW = 0.05


@dataclass(frozen=True)
class Projections:
    """Parameters of an index; equal ones give equal signatures and codes."""

    dimension: int
    bits: int = 1024
    tables: int = 8
    width: int = 8
    seed: int = 42
    directions: np.ndarray = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        if self.bits % 64 or not 0 < self.width <= 16:
            raise ValueError("bits must be a multiple of 64 and width at most 16")
        rng, rows = np.random.default_rng(self.seed), []
        while len(rows) * self.dimension < self.bits + self.tables * self.width:
            rows.append(np.linalg.qr(rng.standard_normal((self.dimension, self.dimension)))[0].T)
        object.__setattr__(self, "directions", np.concatenate(rows)[: self.bits + self.tables * self.width])

    def project(self, vectors: list | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signatures (rows of 64-bit words) and the margins of the codes (row, table, sign)."""
        m = np.array(vectors, dtype=np.float64).reshape(len(vectors), self.dimension) @ self.directions.T
        signs = np.packbits(m[:, : self.bits] > 0, axis=1)
        return np.ascontiguousarray(signs).view(np.uint64), m[:, self.bits :].reshape(len(m), self.tables, self.width)

    def codes(self, margins: np.ndarray) -> np.ndarray:
        return (margins > 0) @ (1 << np.arange(self.width))

    def probes(self, margins: np.ndarray, n: int) -> np.ndarray:
        """The n cheapest codes of every row and table, its own first."""
        flips = np.arange(1 << self.width)
        cost = (margins**2) @ ((flips[:, None] >> np.arange(self.width)) & 1).T.astype(float)
        order = np.argsort(cost, axis=2, kind="stable")[:, :, :n]
        return self.codes(margins)[:, :, None] ^ flips[order]


@dataclass(frozen=True)
class Index:
    """rows: chunk_id, vector, signature (binary), codes (one for each table) and the other columns of the chunks."""

    rows: DataFrame
    projections: Projections

    def write(self, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(path)


def build(chunks: DataFrame, projections: Projections | None = None) -> Index:
    """Index every chunk (chunk_id, vector, …) that has a vector.  Without parameters the dimension is read from the data."""
    known = chunks.where("vector IS NOT NULL")
    if projections is None:
        first = known.select(F.size("vector").alias("n")).first()
        projections = Projections(first["n"] if first else 1)
    p = projections
    schema = T.StructType([*known.schema, T.StructField("signature", T.BinaryType()), T.StructField("codes", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, ROWS) for at in range(0, len(batch), ROWS)):
                signatures, margins = p.project(similarity.matrix(part.column("vector")))
                codes = pa.array(p.codes(margins).ravel().astype(np.int32))
                codes = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * p.tables), codes)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([s.tobytes() for s in signatures], pa.binary()), codes], names=schema.fieldNames())

    return Index(cut_lineage(known.mapInArrow(run, schema)), p)


def read(spark, path: str, projections: Projections) -> Index:
    return Index(spark.read.parquet(path), projections)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of different bits of rows of 64-bit words, pair by pair."""
    out = np.empty(len(a), np.int32)
    for at in range(0, len(a), AT_ONCE):
        part = slice(at, at + AT_ONCE)
        out[part] = np.bitwise_count(a[part] ^ b[part]).sum(axis=1)
    return out


def _signs(words: np.ndarray) -> np.ndarray:
    """The bits of rows of bytes as -1 and 1."""
    return np.unpackbits(words, axis=1).astype(np.float32) * 2 - 1


class _Tile:
    """Some questions: their signs, two questions packed in a number, and how soon each probes a code."""

    def __init__(self, p: Projections, vectors: np.ndarray, most: int):
        self.half, signs = -(-len(vectors) // 2), np.empty((len(vectors), p.bits), np.float32)
        # The place of a code among the probes of a question; `most` if it is not among them.
        self.turn = np.full((p.tables, 1 << p.width, len(vectors)), most, np.min_scalar_type(most))
        for at in range(0, len(vectors), ROWS):
            words, margins = p.project(vectors[at : at + ROWS])
            signs[at : at + ROWS] = _signs(words.view(np.uint8))
            probed, here = p.probes(margins, most), np.arange(at, at + len(words))
            n = probed.shape[2]
            for t in range(p.tables):
                self.turn[t, probed[:, t].ravel(), np.repeat(here, n)] = np.tile(np.arange(n), len(here))
        self.packed = signs[: self.half].copy()
        self.packed[: len(signs) - self.half] += SECOND * signs[self.half :]

    def products(self, signs: np.ndarray, space: list[np.ndarray]) -> np.ndarray:
        """Signs in common less signs that differ, of every question and every chunk; whole numbers, so exact.

        They lie in `space`, two arrays that the next call writes again.
        """
        halves = 4 if signs.shape[1] > SIGNS else 2
        both, out = (x[: n * len(signs)].reshape(n, len(signs)) for x, n in zip(space, (self.half, halves * self.half), strict=True))
        first, second, more = out[: self.half], out[self.half : 2 * self.half], out[2 * self.half :]
        for at in range(0, signs.shape[1], SIGNS):
            if at:
                first, second = more[: self.half], more[self.half :]
            np.matmul(self.packed[:, at : at + SIGNS], signs[:, at : at + SIGNS].T, out=both)
            np.rint(np.multiply(both, np.float32(1 / SECOND), out=second), out=second)
            np.add(np.multiply(second, np.float32(-SECOND), out=first), both, out=first)
            if at:
                out[: 2 * self.half] += more
        return out[: self.turn.shape[2]]


class _Cell:
    """The `most` chunks of least (distance, id) that each question meets, for each number of probes, over a stream of
    chunks in the order of their ids.

    Distances are compared first, with the last one that each question holds; only what is nearer is looked up in the
    codes.  A question that holds too few takes whatever it meets.
    """

    def __init__(self, p: Projections, levels: Sequence[int], most: int, exclude_self: bool, asked: pa.Table):
        self.p, self.levels, self.exclude_self, self.asked = p, levels, exclude_self, asked
        self.ids, vectors = asked["query_id"].to_pandas(), similarity.matrix(asked["vector"])
        self.size = -(-len(vectors) // -(-len(vectors) // QUESTIONS))  # tiles of equal size
        self.tiles = [_Tile(p, vectors[at : at + self.size], max(levels)) for at in range(0, len(vectors), self.size)]
        self.never = (1 << (p.bits + 1).bit_length()) - 1
        self.kept = [similarity.Kept(np.full(len(asked), most), self.never, distinct=True) for _ in levels]
        self.names, self.seen = [], 0
        half = -(-QUESTIONS // 2) * similarity.PIECE
        self.space = [np.empty(half, np.float32), np.empty(half * (4 if p.bits > SIGNS else 2), np.float32)]

    def add(self, chunks: pa.Table) -> None:
        ids, signatures = chunks["chunk_id"].combine_chunks(), chunks["signature"].to_pylist()
        signs = _signs(np.frombuffer(b"".join(signatures), np.uint8).reshape(len(signatures), -1))
        codes, places = similarity.matrix(chunks["codes"], np.int64), self._places(ids)
        names = pd.factorize(pd.concat([self.ids, ids.to_pandas()], ignore_index=True))[0] if self.exclude_self else None
        for i, tile in enumerate(self.tiles):
            first = i * self.size
            same = None if names is None else (names[first : min(first + self.size, len(self.ids))], names[len(self.ids) :])
            self._tile(first, tile, tile.products(signs, self.space), codes, places, same)
            for kept in self.kept:
                if kept.waiting > similarity.WAITING:
                    kept.merge()
        for kept in self.kept:
            if kept.due():
                kept.merge()

    def _places(self, ids: pa.Array) -> np.ndarray:
        """A number for each id, in their order; equal ids, which come one after the other, have the same."""
        coded = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
        new = np.r_[not self.names or self.names[-1][-1] != ids[0], coded[1:] != coded[:-1]]
        self.names.append(ids.filter(pa.array(new)))
        places = self.seen - 1 + np.cumsum(new)
        self.seen = int(places[-1]) + 1
        return places

    def _tile(self, first: int, tile: _Tile, products: np.ndarray, codes: np.ndarray, places: np.ndarray, same) -> None:
        q = slice(first, first + len(products))
        limits = [kept.limit[q] for kept in self.kept]
        widest = np.max(limits, axis=0)
        near = products > (self.p.bits - 2 * widest)[:, None].astype(np.float32)
        if np.count_nonzero(near) <= FEW * near.size:
            rows, at = similarity.hits(near)
            turn = np.min([tile.turn[t, codes[at, t], rows] for t in range(self.p.tables)], axis=0)
            meets = turn < max(self.levels)
            if same is not None:
                meets &= same[0][rows] != same[1][at]
            rows, at, turn = rows[meets], at[meets], turn[meets]
            distance = (self.p.bits - products[rows, at]).astype(np.int64) // 2
            for n, limit, kept in zip(self.levels, limits, self.kept, strict=True):
                keep = (turn < n) & (distance < limit[rows])
                kept.add(rows[keep] + first, distance[keep], places[at[keep]])
            return
        turn = tile.turn[0][codes[:, 0]]
        for t in range(1, self.p.tables):
            np.minimum(turn, tile.turn[t][codes[:, t]], out=turn)
        turn, distance = np.ascontiguousarray(turn.T), ((self.p.bits - products) / 2).astype(np.uint16)
        if same is not None:
            turn[same[0][:, None] == same[1][None, :]] = max(self.levels)
        copies = len(places) - len(np.unique(places))
        for n, limit, kept in zip(self.levels, limits, self.kept, strict=True):
            reached, full = np.where(turn < n, distance, np.uint16(self.never)), limit < self.never
            limit, place = limit.astype(np.uint16), kept.most[first] - 1 + copies
            if not full.all() and place < reached.shape[1]:
                # Everything tied with the last one stays until places decide.
                last = np.partition(reached[~full], place, axis=1)[:, place]
                limit[~full] = np.minimum(last + 1, self.never)
            rows, at = similarity.hits(reached < limit[:, None])
            kept.add(rows + first, reached[rows, at], places[at])

    def table(self) -> pa.Table:
        found = []
        for n, kept in zip(self.levels, self.kept, strict=True):
            rows, distance, places = kept.entries()
            of = self.asked.select(["query_id", "k"]).take(rows)
            chunk_ids = pa.chunked_array(self.names, self.names[0].type).take(places) if self.names else pa.nulls(0)
            found.append(pa.table({"query_id": of["query_id"], "k": of["k"], "chunk_id": chunk_ids, "distance": distance, "probes": np.full(len(rows), n)}))
        return pa.concat_tables(found)


def candidates(index: Index, questions: DataFrame, probes: int = 32, rescored: int = 25, exclude_self: bool = False, block: int = BLOCK) -> DataFrame:
    """query_id, k, chunk_id, distance: per question the `rescored` chunks of least distance among those it meets.

    questions: query_id, vector, k.  See `candidates_at`.
    """
    return candidates_at(index, questions, (probes,), rescored, exclude_self, block).drop("probes")


def candidates_at(index: Index, questions: DataFrame, levels: Sequence[int], rescored: int = 25, exclude_self: bool = False, block: int = BLOCK) -> DataFrame:
    """query_id, k, chunk_id, distance, probes: the candidates for several numbers of probes, from one pass over the pairs.

    A question side of at most `block` rows (measured) is sent to the scan of the index; beyond that both sides are cut
    into blocks, and every (questions, chunks) cell is a task.  Both compare the signatures of all pairs, in tiles of
    bounded size, look up the codes of those that are near enough, and keep the best of each question: they give the same
    rows.  Where a few probes meet no small part of the chunks, as in 256 codes, this is cheaper than to join by code.
    """
    p = index.projections
    asked = questions.where("vector IS NOT NULL").select("query_id", "vector", F.col("k").cast("int").alias("k"))
    chunks = index.rows.select("chunk_id", "signature", "codes")
    schema = T.StructType([asked.schema["query_id"], T.StructField("k", T.IntegerType()), chunks.schema["chunk_id"], T.StructField("distance", T.IntegerType()), T.StructField("probes", T.IntegerType())])
    order = Window.partitionBy("probes", "query_id").orderBy("distance", "chunk_id")
    best = lambda found: found.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= rescored).drop("_place")
    if chunks.isEmpty():  # its dimension is unknown then
        return asked.sparkSession.createDataFrame([], schema)
    start = partial(_Cell, p, tuple(levels), rescored, exclude_self)
    head = asked.limit(block + 1).toArrow()
    if len(head) <= block:
        sent, arrow = index.rows.sparkSession.sparkContext.broadcast(head), to_arrow_schema(schema)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces = similarity.regrouped(pa.Table.from_batches([batch]) for batch in batches)
            yield from similarity.worked(start, [sent.value], pieces, block, arrow)

        return best(chunks.sortWithinPartitions("chunk_id").mapInArrow(scan, schema))
    found = similarity.grid(asked, chunks, [], block, start, schema).repartition("probes", "query_id")
    return best(found.groupBy("probes", "query_id", "chunk_id").agg(F.max("k").alias("k"), F.min("distance").alias("distance")).select(*schema.fieldNames()))


def scored(index: Index, questions: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, chunk_id, score, rank: the k best of the candidates, by exact cosine; with `probes` for each number of them."""
    by = [c for c in ("probes",) if c in found.columns]
    asked = questions.where("vector IS NOT NULL").select("query_id", F.col("vector").alias("_asked"))
    pairs = index.rows.select("chunk_id", "vector").join(broadcast_if_small(found), "chunk_id").join(broadcast_if_small(asked), "query_id")
    scores = pairs.select(*by, "query_id", "chunk_id", "k", F.round(cosines(F.col("_asked"), F.col("vector")), similarity.DIGITS).alias("score"))
    order = Window.partitionBy(*by, "query_id").orderBy(F.desc("score"), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("k")).select(*by, "query_id", "chunk_id", "score", "rank")


def search(index: Index, questions: DataFrame, probes: int = 32, rescored: int = 25, exclude_self: bool = False) -> DataFrame:
    """The k nearest of the chunks that each question meets; recall grows with `probes` (up to all 2^width codes) and `rescored`."""
    return scored(index, questions, cut_lineage(candidates(index, questions, probes, rescored, exclude_self)))
