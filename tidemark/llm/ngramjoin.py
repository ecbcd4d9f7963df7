"""N-gram Jaccard join: documents whose sets of word shingles agree to three quarters are linked.

Rare-first prefix filtering: with the shingles of every set in one global order, rare ones first, two similar sets
share one of the first |x| - ceil(0.75 |x|) + 1.  Sets meet on these; a pair must pass the length filter, the
positional filter (what can still follow the shared place) and the suffix filter, and is then verified once on whole
sets.  The suffix filter compares bit maps, a sixteenth of the sets: a bit that only one of them has is a shingle that the
other lacks, so they bound the intersection from above, and only pairs that may link have their sets shuffled.

Skew.  Equal sets are one node.  A short posting list gives all its pairs.  A long one gives only the pairs with its
pivot; what they link is contracted, and only pairs of different components are left to try.  Some turns try further
pivots of a list's largest component with the members outside it, and at last the members still outside meet the whole
list.  So a group of copies costs pairs in proportion to its size, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.base import holds, stored, texts_of, windows
from tidemark.plans.session import salted_join, small_enough

WORDS = 5
#: Counters of the sketch that orders shingles: any order is right, a finer one gives fewer candidates.
COUNTERS, PIECES = 1 << 20, 256
#: Lists up to this length give all pairs.
SHORT_LIST = 8
TOGETHER = 250_000  # characters of texts whose shingles are made at once
BITS = 4  # of a map, for each shingle of its set
VERIFIED = 32_000_000  # bytes of sets compared at once
#: Turns with further pivots, this many each, before all pairs of different components are tried; pairs a member that are no matter.
TURNS, PIVOTS, EASY = 2, 48, 4
#: Up to so many edges (16 bytes each) one task joins them all; beyond, stars over the cluster do. Both give the same.
FEW_EDGES = 500_000
NO_ID = -(1 << 63)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_sets(texts: list[str], n: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted 64-bit keys of its distinct runs of n words; a shorter text is one run, one without words has none.

    Texts of a bounded length are cut and hashed together, as calls on single texts cost more than the work.  Words are
    hashed anew each time: a third of them are met so rarely that looking them up costs more than the hash.
    """
    ends = np.cumsum([len(t) for t in texts])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, "right")))
        words = [t.encode().translate(_LOWER).split() for t in texts[at:to]]
        lengths = [len(w) for w in words]
        ids = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words)), np.uint64, sum(lengths))
        del words
        runs = windows(ids, n)
        start = 0
        for length in lengths:
            # Runs over the end of a text are left out; a short one has a key of its own.
            keys = runs[start : start + length - n + 1].copy() if length >= n else windows(ids[start : start + length], length, length) if length else ids[:0]
            start += length
            keys.sort()
            fresh = np.empty(len(keys), bool)
            fresh[:1] = True
            np.not_equal(keys[1:], keys[:-1], out=fresh[1:])
            yield keys[fresh]
        at = to


def shingles(text: str, n: int = WORDS) -> np.ndarray:
    """The same for one text."""
    return next(shingle_sets([text], n))


def bit_map(keys: np.ndarray) -> bytes:
    """One bit for each shingle, placed by its first bits; a power of two, at least 64 of them."""
    if not len(keys):
        return b""
    size = max(6, (BITS * len(keys) - 1).bit_length())
    bits = np.zeros(1 << size, np.uint8)
    bits[(keys >> np.uint64(64 - size)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def may_agree(nx: int, x: bytes, ny: int, y: bytes) -> bool:
    """Can sets of these sizes and maps link?  Never false for those that do."""
    a, b = np.unpackbits(np.frombuffer(x, np.uint8)), np.unpackbits(np.frombuffer(y, np.uint8))
    while len(a) != len(b):  # the finer map is folded
        if len(a) > len(b):
            a = a[::2] | a[1::2]
        else:
            b = b[::2] | b[1::2]
    both = int((a & b).sum())
    most = min(nx - int(a.sum()) + both, ny - int(b.sum()) + both)
    return 100 * most >= 75 * (nx + ny - most)


def _sets(n: int):
    """Per row: id, size, 128 bits and bit map of its set; at the end of a partition its counts, in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds("ngramjoin")
        counts = np.zeros(COUNTERS, np.uint32)
        names = ["_d", "n", "s1", "s2", "bits", "piece", "counts"]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sizes, s1, s2, bits = [], [], [], []
                places, held = [], 0
                for keys in shingle_sets(texts_of(part.column(1)), n):
                    places.append((keys % np.uint64(COUNTERS)).astype(np.int32))
                    held += len(keys)
                    if held > COUNTERS:  # one pass over the counters for so many
                        counts += np.bincount(np.concatenate(places), minlength=COUNTERS).astype(np.uint32)
                        places, held = [], 0
                    digest = np.frombuffer(xxhash.xxh3_128_digest(keys.tobytes()), np.int64)
                    sizes.append(len(keys))
                    s1.append(int(digest[0]))
                    s2.append(int(digest[1]))
                    bits.append(bit_map(keys))
                if held:
                    counts += np.bincount(np.concatenate(places), minlength=COUNTERS).astype(np.uint32)
                nulls = pa.nulls(len(sizes))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(sizes, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(bits, pa.binary()),
                    nulls.cast(pa.int32()), nulls.cast(pa.binary())], names=names)
        size, pack = COUNTERS // PIECES, zstandard.ZstdCompressor(level=1).compress
        pieces = [(p, pack(counts[p * size : (p + 1) * size].tobytes())) for p in range(PIECES) if counts[p * size : (p + 1) * size].any()]
        if pieces:
            longs = pa.nulls(len(pieces)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([longs] * 4 + [pa.nulls(len(pieces), pa.binary()), pa.array([p for p, _ in pieces], pa.int32()), pa.array([c for _, c in pieces], pa.binary())], names=names)

    return run


def _add_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = np.frombuffer(zstandard.ZstdDecompressor().decompress(c), np.uint32).astype(np.uint64)
            total[p] = total[p] + counts if p in total else counts
    for p, counts in total.items():
        # Above 2^32 - 1 all counts are equally frequent.
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.minimum(counts, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())], names=["piece", "counts"])


def _prefixes(n: int, sketch):
    """Per row: id, set, size and its rarest shingles in order; a set seen before in the task is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds("ngramjoin")
        frequency = np.frombuffer(sketch.value, np.uint32)
        seen: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = []
                for d, keys in zip(part.column(0).to_pylist(), shingle_sets(texts_of(part.column(1)), n), strict=True):
                    if not len(keys):
                        continue
                    raw = xxhash.xxh3_128_digest(keys.tobytes())
                    s1, s2 = np.frombuffer(raw, np.int64).tolist()
                    if raw in seen:
                        rows.append((d, s1, s2, len(keys), None))
                        continue
                    if len(seen) > 50_000:
                        seen.clear()
                    seen.add(raw)
                    order = np.argsort(frequency[(keys % np.uint64(COUNTERS)).astype(np.int64)], kind="stable")
                    length = len(keys) - (3 * len(keys) + 3) // 4 + 1
                    rows.append((d, s1, s2, len(keys), keys[order[:length]].astype(np.int64)))
                kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["_d", "s1", "s2", "n", "prefix"])

    return run


def may_link(na: np.ndarray, nb: np.ndarray, pa_: np.ndarray, pb: np.ndarray) -> np.ndarray:
    """Length filter, and positional filter: the shared place and all that can follow it in both sets."""
    needed = -(-3 * (na + nb) // 7)
    return (4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb)) & (1 + np.minimum(na - pa_, nb - pb) - 1 >= needed)


_PAIRS = "key long, a long, b long, n long, at long"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings ordered by key, then pivot first: candidate pairs (key null), and the rows of long lists (b null)."""
    names = ["key", "a", "b", "n", "at"]
    columns = [np.empty(0, np.int64)] * 3  # key, node, size and place of rows not yet dealt with
    pivot: tuple[int, ...] | None = None  # of the list that is being read and already long

    def pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch | None:
        sure = may_link(a[2], b[2], a[3], b[3]) & (a[1] != b[1])
        if not sure.any():
            return None
        both = np.unique(np.stack([np.minimum(a[1], b[1])[sure], np.maximum(a[1], b[1])[sure]], axis=1), axis=0)
        no = pa.nulls(len(both)).cast(pa.int64())
        return pa.RecordBatch.from_arrays([no, pa.array(both[:, 0]), pa.array(both[:, 1]), no, no], names=names)

    def deal(packed: list[np.ndarray]) -> Iterator[pa.RecordBatch | None]:
        nonlocal pivot
        rows = [packed[0], packed[1], packed[2] >> 32, packed[2] & 0xFFFFFFFF]
        starts = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]]) if len(rows[0]) else np.empty(0, np.int64)
        lengths = np.diff(np.r_[starts, len(rows[0])])
        for size in range(2, SHORT_LIST + 1):
            at = starts[(lengths == size) & ~((rows[0][starts] == pivot[0]) if pivot else np.zeros(len(starts), bool))]
            if len(at):
                i, j = np.triu_indices(size, 1)
                first, second = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
                yield pairs([r[first] for r in rows], [r[second] for r in rows])
        long = lengths > SHORT_LIST
        if pivot is not None and len(starts):
            long[0] |= rows[0][0] == pivot[0]
        for s, n in zip(starts[long].tolist(), lengths[long].tolist(), strict=True):
            goes_on = pivot is not None and rows[0][s] == pivot[0]
            mine = [r[s : s + n] for r in rows]
            if not goes_on:
                pivot = tuple(int(r[0]) for r in mine)
            yield pairs([np.full(n, x) for x in pivot], mine)
            yield pa.RecordBatch.from_arrays([pa.array(mine[0]), pa.array(mine[1]), pa.nulls(n).cast(pa.int64()), pa.array(mine[2]), pa.array(mine[3])], names=names)

    for batch in batches:
        columns = [np.concatenate([c, x.to_numpy()]) for c, x in zip(columns, batch.columns, strict=True)]
        last = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0
        if len(columns[0]) - last > SHORT_LIST:
            last = len(columns[0])  # already a long list: its pivot is known, the rest may follow
        yield from (x for x in deal([c[:last] for c in columns]) if x)
        columns = [c[last:] for c in columns]
    yield from (x for x in deal(columns) if x)


def _suffix_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose bit maps allow a link."""
    for batch in batches:
        a, b, *rest = (c.to_pylist() for c in batch.columns)
        kept = [i for i, (nx, ny, x, y) in enumerate(zip(*rest, strict=True)) if may_agree(nx, x, ny, y)]
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in kept], pa.int64()), pa.array([b[i] for i in kept], pa.int64())], names=["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that link, by the exact intersection; a bounded number of bytes is held as sets at once."""
    for batch in batches:
        sizes = sum(np.diff(np.frombuffer(batch.column(c).buffers()[1], np.int32, batch.num_rows + 1, 4 * batch.column(c).offset)).sum(dtype=np.int64) for c in (2, 3)) if batch.num_rows else 0
        rows = max(1, int(batch.num_rows * VERIFIED / max(sizes, VERIFIED)))
        for at in range(0, batch.num_rows, rows):
            a_, b_ = [], []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.slice(at, rows).columns), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if 100 * both >= 75 * (len(x) + len(y) - both):
                    a_.append(a)
                    b_.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_, pa.int64()), pa.array(b_, pa.int64())], names=["a", "b"])


def _keys_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The whole sets of the wanted ids (_d), as packed keys; rows of one id with equal texts give one set."""
    if small_enough(wanted, 1_000_000):
        wanted = F.broadcast(wanted)  # at most a million ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([keys.tobytes() for keys in shingle_sets(texts_of(part.column(1)), n)], pa.binary())], names=["_d", "keys"])

    return docs.join(wanted, "_d", "left_semi").mapInArrow(run, "_d long, keys binary").where("length(keys) > 0").repartition("_d").distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    """The ids in pairs (a, b), each once, as _d."""
    return pairs.select(F.col("a").alias("_d")).unionByName(pairs.select(F.col("b").alias("_d"))).distinct()


def _linked(pairs: DataFrame, sets: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """Those of the candidate pairs (distinct) that link; written.  Only sets of pairs that pass the suffix filter are made."""
    ids = _ends(pairs)
    if small_enough(ids, 1_000_000):
        ids = F.broadcast(ids)  # at most a million ids
    maps = sets.where("n > 0").select("_d", "n", "bits").join(ids, "_d", "left_semi").distinct()
    a, b = (maps.select(F.col("_d").alias(c), F.col("n").alias(f"{c}_n"), F.col("bits").alias(f"{c}_bits")) for c in ("a", "b"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "a_n", "b_n", "a_bits", "b_bits")
    pairs = stored(both.mapInArrow(_suffix_filter, "a long, b long").distinct())
    whole = stored(_keys_of(docs, _ends(pairs), n))
    a, b = (whole.select(F.col("_d").alias(c), F.col("keys").alias(f"{c}_keys")) for c in ("a", "b"))
    return stored(pairs.join(a, "a").join(b, "b").select("a", "b", "a_keys", "b_keys").mapInArrow(_verify, "a long, b long").distinct())


def _roots(pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Each node that isn't the least of its component, with that least one."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    for x, y in pairs:
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    return [(x, r) for x in list(root) if (r := find(x)) != x]


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """node and the least node it is connected with, for all nodes of the edges (a, b).

    Alternating large and small stars (a published method): every node hands its neighbours to its least one until
    nothing changes, in a number of rounds that grows with the logarithm of the largest component.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        to = salted_join(both, least, ["a"], "b", "inner", parts=8)
        out = to.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if large else to.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
        return out.where("a != b").distinct()

    pairs_of = lambda batch: zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
    as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each task first joins what it has on its own, so few edges are left to shuffle."""
        for batch in batches:
            yield as_batch(_roots(pairs_of(batch)))

    if small_enough(edges, few):
        whole = edges.select("a", "b").coalesce(1).mapInArrow(lambda batches: iter([as_batch(_roots(p for batch in batches for p in pairs_of(batch)))]), "a long, b long")
        return stored(whole).select(F.col("a").alias("node"), F.col("b").alias("least"))
    e = stored(edges.select("a", "b").mapInArrow(forest, "a long, b long").distinct())
    before = None
    while True:
        after = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("least"))
        before = after
        e = stored(star(star(e, True), False))


#: The filters of a pair that shares a place, as SQL: other component, length, position.
_CAN_LINK = """x_part != part AND 4 * least(x_n, n) >= 3 * greatest(x_n, n)
    AND least(x_n - x_at, n - at) >= ceil(3 * (x_n + n) / 7)"""


def _open_lists(members: DataFrame, joined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of the lists with several components, with their own (part) and the largest (main); and those lists."""
    members = stored(members.join(joined, "node", "left").select("key", "node", "n", "at", F.coalesce("least", "node").alias("part")))
    sizes = members.groupBy("key", "part").count()
    lists = stored(sizes.groupBy("key").agg(
        F.max_by("part", F.struct("count", "part")).alias("main"), F.count("*").alias("parts"), F.sum("count").alias("all"), F.max("count").alias("most")).where("parts > 1"))
    return stored(salted_join(members, lists.select("key", "main"), ["key"], "node", "inner", parts=8)), lists


def _cross(lists: DataFrame) -> int:
    """Pairs to try if every member outside a list's largest component meets the whole list."""
    return lists.agg(F.sum((F.col("all") - F.col("most")) * F.col("all"))).first()[0] or 0


def _all_pairs(members: DataFrame) -> DataFrame:
    """Each member outside its list's largest component (x_node) with the members of other components that it may link with.

    Members of a list mostly share the list before it, too: a pair whose members both come from the same list is left to
    that one, where both places are earlier and so the filter is weaker.  So most pairs come up once, not in every list.
    """
    before = Window.partitionBy("node", "n").orderBy("at", "key")
    members = stored(members.withColumn("prev", F.lag("key").over(before)))
    few = members.where("part != main").select("key", *(F.col(c).alias(f"x_{c}") for c in ("node", "n", "at", "part", "prev")))
    return few.join(members, "key").where(f"{_CAN_LINK} AND NOT coalesce(x_prev = prev, false)")


def links(docs: DataFrame, sets: DataFrame, n: int = WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (s1, s2, node: least id with that set), verified links of nodes, and their components."""
    spark = docs.sparkSession
    pieces = sets.where("piece IS NOT NULL").select("piece", "counts").repartition("piece").mapInArrow(_add_pieces, "piece int, counts binary").collect()
    counts = np.zeros(COUNTERS, np.uint32)
    for r in pieces:  # a fixed number of counters
        counts[r["piece"] * (COUNTERS // PIECES) :][: COUNTERS // PIECES] = np.frombuffer(r["counts"], np.uint32)
    sketch = spark.sparkContext.broadcast(counts.tobytes())
    nodes = docs.mapInArrow(_prefixes(n, sketch), "_d long, s1 long, s2 long, n long, prefix array<long>").groupBy("s1", "s2").agg(
        F.min("_d").alias("node"), F.first("n").alias("n"), F.first("prefix", ignorenulls=True).alias("prefix"))
    # Size and place share a column: this is the widest shuffle.
    postings = nodes.select("node", "n", F.posexplode("prefix").alias("at", "key")).select("key", "node", (F.shiftleft("n", 32) + F.col("at")).alias("n_at"))
    met = stored(postings.repartition("key").sortWithinPartitions("key", F.xxhash64("node"), "node").mapInArrow(_meet, _PAIRS))
    pairs = stored(met.where("key IS NULL").select("a", "b").distinct())
    found = _linked(pairs, sets, docs, n)
    joined = components(found)
    # What the pivots left: lists that still hold several components.
    members = met.where("key IS NOT NULL").select("key", F.col("a").alias("node"), "n", "at")
    members, open_ = _open_lists(members, joined)
    if open_.isEmpty():
        return nodes.select("s1", "s2", "node"), found, joined
    for turn in range(TURNS + 1):
        few = members.where("part != main").select("key", *(F.col(c).alias(f"x_{c}") for c in ("node", "n", "at", "part")))
        if turn < TURNS and _cross(open_) > EASY * members.count():
            # More pivots of the largest component, for those outside it.
            member = F.struct("node", "n", "at", "part")
            chosen = F.array(*[F.min_by(member, F.xxhash64(F.lit(turn * PIVOTS + i), "node")) for i in range(PIVOTS)])
            others = members.where("part = main").groupBy("key").agg(F.array_distinct(chosen).alias("p")).select("key", F.explode("p").alias("p")).select("key", "p.*")
            more = salted_join(few, others, ["key"], "x_node", "inner", parts=8).where(_CAN_LINK)
        else:
            turn = TURNS
            more = _all_pairs(members)
        tried = more.select(F.least("x_node", "node").alias("a"), F.greatest("x_node", "node").alias("b")).distinct()
        tried = stored(tried.join(pairs, ["a", "b"], "left_anti"))
        if not tried.isEmpty():
            pairs = pairs.unionByName(tried)
            found = stored(found.unionByName(_linked(tried, sets, docs, n)))
            joined = components(found)
        if turn == TURNS:
            break
        members, open_ = _open_lists(members.select("key", "node", "n", "at"), joined)
        if open_.isEmpty():
            break
    return nodes.select("s1", "s2", "node"), found, joined


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS) -> DataFrame:
    """key, n_shingles and component_id (least id reachable by links) of every row.

    Two documents link when 100 * intersection >= 75 * union of their sets of n-word shingles (A-Z lower-cased; a text
    of fewer words is one shingle).  A null or empty text has none and links with nothing.  A null id counts as the
    least id and is shown as null.  Rows of one id are one document; if their texts differ it has each of their links.
    Shingles are compared by 64-bit keys.
    """
    docs = df.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("_d"), F.col(text).cast("string").alias("text"))
    sets = stored(docs.mapInArrow(_sets(n), "_d long, n long, s1 long, s2 long, bits binary, piece int, counts binary"))
    _, found, joined = links(docs, sets, n)
    rows = sets.where("piece IS NULL").select("_d", "n", "s1", "s2")
    of_set = rows.where("n > 0").groupBy("s1", "s2").agg(F.min("_d").alias("node"))
    # Sets of one id belong together, and so do its rows without words.
    repeated = stored(rows.groupBy("_d").agg(F.count("*").alias("rows"), F.max("n").alias("n")).where("rows > 1 AND n > 0").select("_d"))
    of_id = None
    if not repeated.isEmpty():
        of_id = rows.where("n > 0").join(repeated, "_d", "left_semi").select("_d", "s1", "s2").distinct()
        of_id = stored(salted_join(of_id, of_set, ["s1", "s2"], "_d", "inner", parts=8).select("_d", "node").distinct())
        least = of_id.groupBy("_d").agg(F.min("node").alias("a"))
        same = stored(salted_join(of_id, least, ["_d"], "node", "inner", parts=8).where("a != node").select("a", F.col("node").alias("b")).distinct())
        if not same.isEmpty():
            joined = components(stored(found.select("a", "b").unionByName(same)))
        of_id = least.join(joined, least["a"] == joined["node"], "left").select("_d", F.coalesce("least", "a").alias("of_id"))
    of_set = of_set.join(joined, "node", "left").select("s1", "s2", F.coalesce("least", "node").alias("part"))
    linked = salted_join(rows, of_set, ["s1", "s2"], "_d", "left", parts=8)
    linked = linked.withColumn("of_id", F.lit(None).cast("long")) if of_id is None else salted_join(linked, of_id, ["_d"], "s1", "left", parts=8)
    shown = lambda c: F.nullif(c, F.lit(NO_ID))
    return linked.select(shown(F.col("_d")).alias(key), F.col("n").alias("n_shingles"), shown(F.coalesce(F.when(F.col("n") > 0, F.col("part")), F.col("of_id"), F.col("_d"))).alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS) -> DataFrame:
    """The rows of `docs` without those linked to a smaller id, directly or not; all their columns unchanged.

    Of rows with one id, one stays.  Documents without words are linked with nothing and stay.
    """
    found = groups(docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")), "_id", "_text", n)
    found = stored(found.select(F.coalesce("_id", F.lit(NO_ID)).alias("_id"), F.coalesce("component_id", F.lit(NO_ID)).alias("_part")))
    gone = found.where("_id != _part").select("_id").distinct()
    if small_enough(gone, 1_000_000):
        gone = F.broadcast(gone)  # at most a million ids
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("_id"))
    held = held.join(gone, "_id", "left_anti")
    if not found.groupBy("_id").count().where("count > 1").isEmpty():
        held = held.groupBy("_id").agg(F.min_by("row", F.xxhash64("row." + text)).alias("row"))
    return held.select("row.*")
