"""Exact top-k by cosine without emitting pairs.

A scan task multiplies blocks of vectors and keeps a running top-k per query,
so what leaves a task is at most k rows per query.  A small query side
(measured) is sent to the tasks once and the chunk side is only scanned.
Otherwise both sides are cut into blocks of bounded size and every
(query block, chunk block) cell is its own task, so a hot key or a huge side
spreads over many tasks instead of meeting in one.  Within a task scores are
made in tiles of some ten MB, however many vectors meet there.

Without keys a cell holds a block of queries and reads its chunks as a stream
in the order of their ids, so few cells share one query.  `Best` scores them in
single precision, and again exactly where that comes near the k-th score so far.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.plans.session import salted_join, text_batches

BLOCK = 4096
#: Queries scored at once against a block of chunks.
TILE = 256
#: Without keys, a side of more than MANY blocks is cut into cells of LONG blocks: so each vector is repeated less often.
MANY, LONG = 16, 4
DIGITS = 6
#: Chunks of a stream that are scored at once; bytes of those that go through the shuffle as one row, one at least.
PIECE, PACK = 1024, 1 << 14
#: Where more than this share of a tile may come in, all of it is worked on exactly.
FEW = 0.05
#: Bits of a place in a stream; new entries of `Kept` that are sorted in at the latest.
PLACE, WAITING = 28, 1 << 20
#: Scores as whole numbers, best first: from 0 on, below NEVER.
STEPS, NEVER = 10**DIGITS, (1 << 21) - 1


def _unit(vectors: pd.Series) -> np.ndarray:
    return _units(np.array(vectors.tolist(), dtype=np.float64))


def _units(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def matrix(lists: pa.ChunkedArray | pa.Array, kind: type = np.float64) -> np.ndarray:
    """One row per list; all must be of one length."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.unique(lists.value_lengths().to_numpy(zero_copy_only=False))
    if len(sizes) > 1:
        raise ValueError(f"lists of {sizes.min()} to {sizes.max()} elements where all must be of one length")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(lists), int(sizes[0]) if len(sizes) else 0)


def hits(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero for a mask that is nearly empty: looks at eight places at once."""
    if mask.shape[1] % 8 or not mask.flags.c_contiguous:
        return np.nonzero(mask)
    eights = np.flatnonzero(mask.view(np.uint64).ravel())
    of, place = np.nonzero(mask.reshape(-1, 8)[eights])
    return np.divmod(eights[of] * 8 + place, mask.shape[1])


class Kept:
    """For each row the `most` entries of least (rank, place), as sorted whole numbers of row, rank and place.

    Places must come in ascending order, so what comes later with an equal rank is never better: see `limit`.
    """

    def __init__(self, most: np.ndarray, never: int, distinct: bool = False):
        self.most, self.never, self.distinct = most, never, distinct
        self.shift = PLACE + never.bit_length()
        if len(most) >> (64 - self.shift):
            raise ValueError(f"{len(most)} rows are too many")
        self.held, self.new, self.waiting = np.empty(0, np.uint64), [], 0
        #: Only a lower rank can still come in.
        self.limit = np.where(most > 0, never, 0)

    def add(self, rows: np.ndarray, ranks: np.ndarray, places: np.ndarray) -> None:
        self.new.append(rows.astype(np.uint64) << self.shift | ranks.astype(np.uint64) << PLACE | places.astype(np.uint64))
        self.waiting += len(rows)

    def merge(self) -> None:
        keys, self.new, self.waiting = np.sort(np.concatenate([self.held, *self.new])), [], 0
        if self.distinct:
            first = np.unique(keys >> self.shift << PLACE | keys & ((1 << PLACE) - 1), return_index=True)[1]
            keys = keys[np.sort(first)]
        row = (keys >> self.shift).astype(np.int64)
        at = np.arange(len(row))
        started = np.maximum.accumulate(np.where(np.r_[True, row[1:] != row[:-1]][: len(row)], at, 0))
        keep = at - started < self.most[row]
        self.held, row = keys[keep], row[keep]
        last = np.flatnonzero(np.r_[row[1:] != row[:-1], True][: len(row)])
        full = last[np.bincount(row, minlength=len(self.most))[row[last]] >= self.most[row[last]]]
        self.limit[row[full]] = (self.held[full] >> PLACE).astype(np.int64) & ((1 << (self.shift - PLACE)) - 1)

    def due(self) -> bool:
        """Is it time to sort the new entries in?  What is held grows with them, so each is sorted a few times at most."""
        return self.waiting > len(self.held) // 2

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, ranks and places, in this order."""
        self.merge()
        rank = self.held >> PLACE & ((1 << (self.shift - PLACE)) - 1)
        return (self.held >> self.shift).astype(np.int64), rank.astype(np.int64), (self.held & ((1 << PLACE) - 1)).astype(np.int64)


class Leaders:
    """Running top-k per query over blocks of scores, ordered by (score desc, chunk id)."""

    def __init__(self, ids, k):
        self.ids, self.k = ids, k
        self.best: list[list[tuple[float, object]]] = [[] for _ in range(len(ids))]
        self.least = np.full(len(ids), -np.inf)  # the k-th score of those that have k

    def merge(self, scores: np.ndarray, chunk_ids, first: int = 0) -> None:
        """scores: one row per query from `first` on, -inf where a chunk does not count."""
        least = self.least[first:first + len(scores)].copy()
        for i in np.flatnonzero(least == -np.inf):
            # Everything tied with the k-th score stays until ids decide.
            if (k := int(self.k[first + i])) < scores.shape[1]:
                least[i] = np.partition(scores[i], scores.shape[1] - k)[scores.shape[1] - k]
        rows, places = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        starts = np.searchsorted(rows, np.arange(len(scores) + 1))
        for i in np.flatnonzero(np.diff(starts)):
            q, hits = first + i, places[starts[i]:starts[i + 1]]
            merged = self.best[q] + list(zip(scores[i, hits].tolist(), chunk_ids[hits].tolist(), strict=True))
            merged.sort(key=lambda e: (-e[0], e[1]))
            self.best[q] = merged[:int(self.k[q])]
            if len(merged) >= self.k[q]:
                self.least[q] = self.best[q][-1][0] if self.best[q] else np.inf

    def frame(self) -> pd.DataFrame:
        rows = [(q, c, s, int(k)) for q, k, have in zip(self.ids, self.k, self.best) for s, c in have]
        return pd.DataFrame(rows, columns=["query_id", "chunk_id", "score", "k"])


class _Scan:
    """Scores blocks of chunk vectors against a set of queries."""

    def __init__(self, queries: pd.DataFrame, on: Sequence[str], ttl: float | None, floor: float | None, other: bool):
        self.q, self.on, self.ttl, self.floor, self.other = queries, list(on), ttl, floor, other
        self.unit = _unit(queries["vector"]) if len(queries) else np.zeros((0, 1))
        self.ids = queries["query_id"].to_numpy()
        self.leaders = Leaders(self.ids, queries["k"].to_numpy())

    def add(self, chunks: pd.DataFrame) -> None:
        if not len(chunks) or not len(self.q):
            return
        for low in range(0, len(chunks), BLOCK):
            part = chunks.iloc[low:low + BLOCK]
            ids, unit = part["chunk_id"].to_numpy(), _unit(part["vector"]).T
            for first in range(0, len(self.q), TILE):
                self._tile(first, part, ids, unit)

    def _tile(self, first: int, part: pd.DataFrame, ids: np.ndarray, unit: np.ndarray) -> None:
        q = slice(first, first + TILE)
        scores = self.unit[q] @ unit
        np.round(scores, DIGITS, out=scores)
        usable = np.ones(scores.shape, dtype=bool)
        for c in self.on:
            usable &= self.q[c].to_numpy()[q, None] == part[c].to_numpy()[None, :]
        if self.other:
            usable &= self.ids[q, None] != ids[None, :]
        if self.ttl is not None:
            age = self.q["at"].to_numpy()[q, None] - part["at"].to_numpy()[None, :]
            usable &= (age > 0) & (age < self.ttl)
        if self.floor is not None:
            usable &= scores >= self.floor
        scores[~usable] = -np.inf
        self.leaders.merge(scores, ids, first)


class Best:
    """Exact top-k of a block of queries over a stream of chunks in the order of their ids."""

    def __init__(self, asked: pa.Table, other: bool):
        self.asked, self.other, self.ids = asked, other, asked["query_id"].to_pandas().to_numpy()
        self.unit = _units(matrix(asked["vector"]))
        self.rough = self.unit.astype(np.float32)
        self.kept = Kept(asked["k"].fill_null(0).to_numpy().astype(np.int64), NEVER)
        #: Above the error of a product in single precision, whatever the order of its sum.
        self.error = (self.unit.shape[1] + 8) * 2.0**-24
        self.names, self.seen = [], 0
        self._raise()

    def _raise(self) -> None:
        limit = self.kept.limit
        self.bar = np.where(limit == NEVER, -np.inf, (STEPS + 1 - limit) / STEPS - self.error).astype(np.float32)

    def add(self, chunks: pa.Table) -> None:
        ids, unit = chunks["chunk_id"].to_pandas().to_numpy(), _units(matrix(chunks["vector"]))
        across = np.ascontiguousarray(unit.T, dtype=np.float32)
        for first in range(0, len(self.ids), TILE):
            self._tile(first, ids, unit, across)
            if self.kept.waiting > WAITING:
                self.kept.merge()
        if self.kept.due():
            self.kept.merge()
        self._raise()
        self.names.append(chunks["chunk_id"])
        self.seen += len(chunks)

    def _tile(self, first: int, ids: np.ndarray, unit: np.ndarray, across: np.ndarray) -> None:
        q = slice(first, first + TILE)
        near = self.rough[q] @ across >= self.bar[q, None]
        if np.count_nonzero(near) <= FEW * near.size:
            rows, at = hits(near)
            ranks = STEPS + 1 - np.rint(np.einsum("ij,ij->i", self.unit[q][rows], unit[at]) * STEPS)
            keep = ranks < self.kept.limit[q][rows]
            if self.other:
                keep &= self.ids[q][rows] != ids[at]
            rows, at, ranks = rows[keep], at[keep], ranks[keep]
        else:
            every = self.unit[q] @ unit.T
            np.rint(np.multiply(every, STEPS, out=every), out=every)
            np.subtract(STEPS + 1, every, out=every)
            every[np.isnan(every)] = np.inf
            if self.other:
                every[self.ids[q, None] == ids[None, :]] = np.inf
            limit = self.kept.limit[q].astype(float)
            for i in np.flatnonzero(limit == NEVER):
                # Everything tied with the k-th score stays until places decide.
                if (k := self.kept.most[first + i]) <= every.shape[1]:
                    limit[i] = min(NEVER, np.partition(every[i], k - 1)[k - 1] + 1)
            rows, at = hits(every < limit[:, None])
            ranks = every[rows, at]
        self.kept.add(rows + first, ranks, at + self.seen)

    def table(self) -> pa.Table:
        rows, ranks, places = self.kept.entries()
        found = self.asked.select(["query_id", "k"]).take(rows)
        chunk_ids = pa.chunked_array(self.names, self.names[0].type).take(places) if self.names else pa.nulls(0)
        return pa.table({"query_id": found["query_id"], "chunk_id": chunk_ids, "score": (STEPS + 1 - ranks) / STEPS, "k": found["k"]})


class _Streamed:
    """A `_Scan` that is fed Arrow tables."""

    def __init__(self, asked: pa.Table, *how):
        self.work = _Scan(asked.to_pandas(), *how)

    def add(self, chunks: pa.Table) -> None:
        self.work.add(chunks.to_pandas())

    def table(self) -> pa.Table:
        return pa.Table.from_pandas(self.work.leaders.frame(), preserve_index=False)


def topk(queries: DataFrame, chunks: DataFrame, on: Sequence[str] = (), ttl_seconds: float | None = None,
         floor: float | None = None, exclude_self: bool = False, block: int = BLOCK) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k nearest chunks of every query.

    queries: query_id, vector, k, the `on` columns, and `at` (epoch seconds) with a ttl.
    chunks: chunk_id, vector, the `on` columns, and `at` with a ttl: only chunks
    older than the query by less than the ttl count.  The `on` columns are
    compared as one text, in which a null equals a null, on every path.
    """
    if on:
        same = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in on]), {"ignoreNullFields": "false"})
        queries, chunks = queries.withColumn("_on", same), chunks.withColumn("_on", same)
    on = ["_on"] if on else []
    extra = on + (["at"] if ttl_seconds is not None else [])
    queries = queries.where("vector IS NOT NULL").select("query_id", "vector", F.col("k").cast("int").alias("k"), *extra)
    chunks = chunks.where("vector IS NOT NULL").select("chunk_id", "vector", *extra)
    schema = T.StructType([
        queries.schema["query_id"], chunks.schema["chunk_id"],
        T.StructField("score", T.DoubleType()), T.StructField("k", T.IntegerType())])
    head = queries.limit(block + 1).toPandas()
    if len(head) <= block:
        sent = queries.sparkSession.sparkContext.broadcast(head)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            work = _Scan(sent.value, on, ttl_seconds, floor, exclude_self)
            for batch in batches:
                work.add(batch)
            yield work.leaders.frame()

        found = chunks.mapInPandas(scan, schema)
    elif on:
        def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            work = _Scan(a, on, ttl_seconds, floor, exclude_self)
            work.add(b)
            return work.leaders.frame()

        found = grid(queries, chunks, on, block, run, schema)
    else:
        plain = ttl_seconds is None and floor is None
        start = lambda asked: Best(asked, exclude_self) if plain else _Streamed(asked, on, ttl_seconds, floor, exclude_self)
        found = grid(queries, chunks, on, block, start, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("k")).drop("k")


def _cuts(rows: int, block: int) -> int:
    return max(1, -(-rows // (block if rows <= MANY * block else LONG * block)))


def grid(queries: DataFrame, chunks: DataFrame, on: list[str], block: int, run: Callable, schema) -> DataFrame:
    """What `run` makes of every (query block, chunk block) cell, each in its own task; it compares the `on` columns itself.

    Keys with few rows share cells of about one block; a key with more rows
    than that is cut into blocks of its own, each query block meeting each
    chunk block.  There `run` takes the rows of both sides (pandas).  Without
    `on` see `_streams`.
    """
    if not on:
        return _streams(queries, chunks, block, run, schema)
    counted = queries.groupBy(*on).agg(F.count(F.lit(1)).alias("nq")).join(
        chunks.groupBy(*on).agg(F.count(F.lit(1)).alias("nc")), on)
    rows = queries.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    shared = max(1, -(-4 * rows // block))
    light = (F.col("nq") <= block) & (F.col("nc") <= block)
    sizes = counted.select(
        *on, F.when(light, 1).otherwise(F.ceil(F.col("nq") / block)).cast("int").alias("nq"),
        F.when(light, 1).otherwise(F.ceil(F.col("nc") / block)).cast("int").alias("nc"),
        F.when(light, F.pmod(F.xxhash64(*on), F.lit(shared)).cast("string")).otherwise(
            F.concat_ws("|", F.lit("key"), *[F.col(c).cast("string") for c in on])).alias("_g"))
    left, right = salted_join(queries, sizes, on, "query_id", "inner"), salted_join(chunks, sizes, on, "chunk_id", "inner")
    left = left.withColumn("_i", F.pmod(F.xxhash64("query_id"), "nq").cast("int")).withColumn(
        "_j", F.explode(F.sequence(F.lit(0), F.col("nc") - 1)))
    right = right.withColumn("_j", F.pmod(F.xxhash64("chunk_id"), "nc").cast("int")).withColumn(
        "_i", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    # Fresh column ids: both sides may stem from one DataFrame.
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    cell = ["_g", "_i", "_j"]
    left, right = left.drop("nq", "nc"), right.drop("nq", "nc")
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(run, schema)


def _streams(queries: DataFrame, chunks: DataFrame, block: int, run: Callable[[pa.Table], object], schema) -> DataFrame:
    """Cells without keys: `run` takes the queries of a cell, then `add` gets its chunks, piece by piece in the order of
    their ids, and `table` gives the rows.

    A task holds a block of queries and never the chunks.  For enough tasks first the blocks of queries are made smaller;
    chunks are cut only beyond that, and beyond MANY * MANY blocks: what leaves a cell is repeated for every cut of them.
    """
    rows, many = queries.count(), chunks.count()
    cores = queries.sparkSession.sparkContext.defaultParallelism
    nq = max(_cuts(rows, block), min(4 * cores, -(-LONG * rows // block)))
    nq = -(-nq // cores) * cores  # the last tasks end together
    nc = max(1, -(-many // (MANY * MANY * block)), min(-(-4 * cores // nq), -(-many // block)))
    packs = _packed(chunks).withColumn("_j", F.pmod(F.xxhash64("chunk_id"), F.lit(nc)).cast("int")).withColumn(
        "_i", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    asked = queries.withColumn("_i", F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int")).withColumn(
        "_j", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
    cell_of, names = (F.col("_i") * nc + F.col("_j")).alias("_cell"), queries.columns
    both = asked.select(cell_of, F.lit(None).cast(chunks.schema["chunk_id"].dataType).alias("_first"), F.lit(None).cast("binary").alias("_rows"), *names).unionByName(
        packs.select(cell_of, F.col("chunk_id").alias("_first"), F.col("rows").alias("_rows")), allowMissingColumns=True)
    # Exactly one task for each cell, however long: AQE must not merge them into a few.
    both = both.repartitionById(nq * nc, "_cell").sortWithinPartitions(F.col("_rows").isNotNull(), "_first")
    arrow, most = to_arrow_schema(schema), LONG * block

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = []

        def pieces() -> Iterator[pa.Table]:
            for batch in batches:
                packed = batch.column("_rows")
                if packed.null_count:
                    asked.append(pa.table([batch.column(c) for c in names], names=names).slice(0, packed.null_count))
                for rows in packed.slice(packed.null_count):
                    yield pa.ipc.open_stream(rows.as_buffer()).read_all()

        yield from worked(run, asked, regrouped(pieces()), most, arrow)

    return both.mapInArrow(cell, schema)


def _packed(chunks: DataFrame) -> DataFrame:
    """The chunks in the order of their ids, some at a time in one row as Arrow bytes, beside the first id of those.

    A row of a few numbers costs more on its way to Python than the numbers do.
    """
    schema = T.StructType([chunks.schema["chunk_id"], T.StructField("rows", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, PACK * len(batch) // max(1, batch.nbytes))
            parts = [batch.slice(at, rows) for at in range(0, len(batch), rows)]
            data = []
            for part in parts:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as writer:
                    writer.write_batch(part)
                data.append(sink.getvalue().to_pybytes())
            first = batch.column("chunk_id").take(pa.array(range(0, len(batch), rows), pa.int64()))
            yield pa.RecordBatch.from_arrays([first, pa.array(data, pa.binary())], names=["chunk_id", "rows"])

    # The rows of Python batches grow with their packs.
    text_batches(chunks.sparkSession)
    parts = chunks.sparkSession.sparkContext.defaultParallelism
    return chunks.repartitionByRange(parts, "chunk_id").sortWithinPartitions("chunk_id").mapInArrow(pack, schema)


def regrouped(tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
    """The same rows in pieces of PIECE."""
    held: list[pa.Table] = []
    for table in tables:
        held.append(table)
        if sum(map(len, held)) >= PIECE:
            whole = pa.concat_tables(held)
            full = len(whole) // PIECE * PIECE
            for at in range(0, full, PIECE):
                yield whole.slice(at, PIECE).combine_chunks()
            held = [whole.slice(full)]
    if sum(map(len, held)):
        yield pa.concat_tables(held).combine_chunks()


def worked(run: Callable[[pa.Table], object], asked: list[pa.Table], pieces: Iterator[pa.Table], most: int, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows for the queries `asked`, complete when the first piece is there; `most` of them are worked on as one."""
    work = None
    for piece in pieces:
        if work is None:
            whole = pa.concat_tables(asked) if asked else []
            work = [run(whole.slice(at, most).combine_chunks()) for at in range(0, len(whole), most)]
        for w in work:
            w.add(piece)
    for w in work or ():
        yield from w.table().select(arrow.names).cast(arrow).to_batches(max_chunksize=100_000)
