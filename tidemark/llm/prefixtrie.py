"""A trie of conversation prefixes, its node table in shards with minimal perfect hashes.

Every prefix of a conversation has a 128-bit digest: the exclusive or of a hash of each turn and its depth, so a window
sum gives all of them.  Equal digests are one node.  Sums over subtrees are made per shard, a set of whole subtrees of at
most `limit` turns: the distinct digests get the slots of a minimal perfect hash, each verified by the digest stored
there; counts are scattered into flat numpy arrays and added up through the array of parent slots, deepest first.

Subtrees are cut where they first fit a shard.  The few nodes above the cuts, each with more than `limit` turns below,
get their sums from the roots of the shards: the smallest conversation of a root leads through all nodes above it, and
what it passes on is summed along its path.  So no shard outgrows a task, however many conversations begin alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.base import mix, stored
from tidemark.plans.session import salted_join, small_enough

#: Turns below a node that may form one shard, and nodes that share a hash table.
LIMIT = 20_000
#: Ids of conversations in a piece of a list, for the digests of long lists.
PIECE = 4096
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "d1 long, d2 long, p1 long, p2 long, depth long, conv_id long, n_convs long"


# ---- prefixes ----


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), t1, t2 (hash of role and text), size of every turn.

    Turns are ordered by turn, null first; rows of one turn by role and text, equal rows stay apart.  Null roles and
    texts are empty.  Rows without a conversation are left out.  Positions are made in a sorted stream per conversation.
    """
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.select(
        "conv_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), F.xxhash64(F.lit(1), "role", "text").alias("t1"), F.xxhash64(F.lit(2), "role", "text").alias("t2"),
        F.char_length("text").cast("long").alias("size"))


def with_heads(turns: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Turns of rebuilt conversations: the first h of the conversation at the last multiple of `every`, then one's own after the first h.

    h is the CRC-32 of the decimal id, modulo `most`.  A conversation that loses all its turns keeps a row without a
    turn (pos -1), as does every other one for its empty prefix.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    heads = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "donor")
    ids = turns.where("pos = 0").select("conv_id", h.alias("h"))
    borrowed = ids.where("h > 0").join(heads, (F.col("conv_id") - F.col("conv_id") % every == F.col("donor")) & (F.col("pos") < F.col("h")))
    none = [F.lit(0).cast("long").alias(c) for c in ("t1", "t2", "size")]
    return turns.where(F.col("pos") >= h).unionByName(borrowed.select(*turns.columns)).unionByName(ids.select("conv_id", F.lit(-1).cast("long").alias("pos"), *none))


def prefixes(turns: DataFrame) -> DataFrame:
    """One row for each prefix of each conversation, the empty one too: conv_id, depth, digest d1 and d2, that of the
    prefix before (p1, p2), size of the last turn, turns still to come (rest).  From conv_id, pos, t1, t2, size."""
    path = Window.partitionBy("conv_id").orderBy("pos")
    upto, whole = path.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("conv_id")
    rows = turns.withColumn("depth", (F.row_number().over(path) - 1).cast("long"))
    value = lambda seed: F.when(F.col("pos") < 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(seed), "t1", "t2", "depth"))
    rows = rows.select("*", value(1).alias("v1"), value(2).alias("v2"))
    rows = rows.select("*", F.bit_xor("v1").over(upto).alias("d1"), F.bit_xor("v2").over(upto).alias("d2"), (F.count("*").over(whole) - 1 - F.col("depth")).alias("rest"))
    return rows.select("conv_id", "depth", "d1", "d2", F.col("d1").bitwiseXOR(F.col("v1")).alias("p1"), F.col("d2").bitwiseXOR(F.col("v2")).alias("p2"), "size", "rest")


# ---- one shard ----


class Slots:
    """Minimal perfect hash of distinct 128-bit keys: rounds of hashing into a table twice the size of what is left; keys
    alone in their cell get the next slots, the others go on to the next round.  A look-up is verified by the stored key."""

    def __init__(self, k1: np.ndarray, k2: np.ndarray):
        self.rounds: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.slots = np.empty(len(k1), np.int64)
        left, at = np.arange(len(k1)), 0
        while len(left):
            if len(self.rounds) > 200:
                raise ValueError("keys are not distinct")
            cell = self._cells(k1[left], k2[left], 2 * len(left), len(self.rounds))
            counts = np.bincount(cell, minlength=2 * len(left))
            alone = counts == 1
            rank = at + np.cumsum(alone) - 1
            self.rounds.append((len(counts), alone, rank))
            placed = alone[cell]
            self.slots[left[placed]] = rank[cell[placed]]
            at += int(placed.sum())
            left = left[~placed]
        self.k1, self.k2 = np.empty(len(k1), np.int64), np.empty(len(k1), np.int64)
        self.k1[self.slots], self.k2[self.slots] = k1, k2

    @staticmethod
    def _cells(k1: np.ndarray, k2: np.ndarray, size: int, seed: int) -> np.ndarray:
        h = mix(k1.view(np.uint64) ^ mix(k2.view(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))))
        return (h % np.uint64(size)).astype(np.int64)

    def of(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for others."""
        out = np.full(len(k1), -1, np.int64)
        left = np.arange(len(k1))
        for seed, (size, alone, rank) in enumerate(self.rounds):
            cell = self._cells(k1[left], k2[left], size, seed)
            hit = alone[cell]
            found, slot = left[hit], rank[cell[hit]]
            out[found] = np.where((self.k1[slot] == k1[found]) & (self.k2[slot] == k2[found]), slot, -1)
            left = left[~hit]
        return out


def summed(node: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """n_children, n_leaves, saved and parent (slot row, -1 outside) of the nodes of whole subtrees."""
    slots = Slots(node["d1"], node["d2"])
    n = len(slots.slots)
    at = slots.slots
    parent, depth, saved = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
    parent[at] = np.where(node["depth"] > 0, slots.of(node["p1"], node["p2"]), -1)
    depth[at] = node["depth"]
    saved[at] = (node["n_convs"] - 1) * node["size"]
    children = np.bincount(parent[parent >= 0], minlength=n)
    leaves = (children == 0).astype(np.int64)
    order = np.argsort(-depth, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        part = part[parent[part] >= 0]
        np.add.at(saved, parent[part], saved[part])
        np.add.at(leaves, parent[part], leaves[part])
    row = np.empty(n, np.int64)  # of each slot
    row[at] = np.arange(n)
    up = parent[at]
    return {"n_children": children[at], "n_leaves": leaves[at], "saved": saved[at], "parent": np.where(up >= 0, row[up], -1)}


def _shards(most: int):
    """From nodes ordered by shard: each with its sums; `parent_conv_id` is null and `top` true where the parent lies outside."""
    names = [f.split()[0] for f in NODE.split(", ")]

    def deal(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        node = {c: table[c].to_numpy() for c in [*names, "size"]}
        sums = summed(node)
        inside = sums["parent"] >= 0
        made = [pa.array(sums["n_children"]), pa.array(sums["n_leaves"]), pa.array(sums["saved"]), pa.array(node["conv_id"][sums["parent"]], mask=~inside), pa.array(~inside)]
        return pa.RecordBatch.from_arrays([pa.array(node[c]) for c in names] + made, names=[*names, "n_children", "n_leaves", "saved_tokens", "parent_conv_id", "top"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            ends = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
            if held and len(k1) and (held[-1]["k1"][-1].as_py(), held[-1]["k2"][-1].as_py()) != (k1[0], k2[0]):
                ends = np.append(0, ends)
            at = 0
            for end in ends.tolist():  # a shard is complete
                if size + end - at >= most:
                    held.append(batch.slice(at, end - at))
                    yield deal([b for b in held if b.num_rows])
                    held, size, at = [], 0, end
            held.append(batch.slice(at))
            size += batch.num_rows - at
        if size:
            yield deal([b for b in held if b.num_rows])

    return run


# ---- ends ----


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ordered (d1, d2, conv_id): pieces of the comma-joined list of each node."""
    names = ["d1", "d2", "least", "ids"]
    for batch in batches:
        d1, d2, ids = (c.to_numpy() for c in batch.columns)
        if not len(ids):
            continue
        cuts = np.flatnonzero((d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])) + 1
        starts = np.unique(np.concatenate([[0], cuts, *[np.arange(a, b, PIECE) for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True) if b - a > PIECE]])).astype(np.int64)
        shown = ids.astype(str).tolist()
        joined = [",".join(shown[a:b]) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(d1[starts]), pa.array(d2[starts]), pa.array(ids[starts]), pa.array(joined)], names=names)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ordered pieces: the digest of each node's list; only a running hash is kept."""
    now, state, done = None, None, []
    out = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i == 2 else pa.int64()) for i in range(3)], names=["d1", "d2", "ends_sha256"])
    for batch in batches:
        for d1, d2, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if now == (d1, d2):
                state.update(b"," + ids.encode())
                continue
            if now is not None:
                done.append((*now, state.hexdigest()))
            now, state = (d1, d2), hashlib.sha256(ids.encode())
        if len(done) >= 10_000:
            yield out(done)
            done = []
    if now is not None:
        yield out([*done, (*now, state.hexdigest())])


def ends(rows: DataFrame) -> DataFrame:
    """d1, d2 and the digest of the ids that end there, ascending.

    Ids are joined in pieces by ranges of (node, id) first, so a node where a third of all conversations end sends few
    rows to the task that hashes its list; hashing itself is sequential.
    """
    ended = rows.where("rest = 0").select("d1", "d2", "conv_id")
    pieces = ended.repartitionByRange("d1", "d2", "conv_id").sortWithinPartitions("d1", "d2", "conv_id").mapInArrow(_pieces, "d1 long, d2 long, least long, ids string")
    return pieces.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "least").mapInArrow(_hashed, "d1 long, d2 long, ends_sha256 string")


# ---- the trie ----


def _joined(rows: DataFrame, nodes: DataFrame, on: list[str], spread: str, how: str, small: bool) -> DataFrame:
    """Rows joined to a table with one row per node, of which few nodes may hold most rows."""
    return rows.join(F.broadcast(nodes), on, how) if small else salted_join(rows, nodes, on, spread, how)


def nodes(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """All nodes of the trie of `prefixes`: depth, conv_id (its smallest member), parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (over its subtree: conversations beyond the first, times the size of the last text),
    ends_sha256 (of the ids that end there).  No rows give no node.  The result is the same for every limit above 0."""
    rows = stored(rows)
    all_ = stored(rows.groupBy("d1", "d2").agg(
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
        F.max("size").alias("size"), F.sum("rest").alias("below")))
    crown = stored(all_.where(F.col("below") > limit).drop("below"))
    small = small_enough(crown)
    # Rows of the paths through the crown; below them a path enters the shard of its first node that fits one.
    above = stored(_joined(rows.select("conv_id", "depth", "d1", "d2"), crown.select("d1", "d2"), ["d1", "d2"], "conv_id", "inner", small))
    cut = above.groupBy("conv_id").agg(F.count("*").alias("depth"))
    light = all_.where(F.col("below") <= limit).drop("below")
    if crown.isEmpty():
        light = light.select("*", F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"))  # at most `limit` turns in all
    else:
        entered = rows.join(cut, ["conv_id", "depth"]).select("conv_id", F.col("d1").alias("k1"), F.col("d2").alias("k2"))
        light = light.join(entered, "conv_id")
    made = stored(light.repartition("k1", "k2").sortWithinPartitions("k1", "k2").mapInArrow(
        _shards(limit), f"{NODE}, n_children long, n_leaves long, saved_tokens long, parent_conv_id long, top boolean"))
    # What reaches the crown: the sums of the shards' subtrees and the crown's own, along the path of the smallest member.
    zero = F.lit(0).cast("long")
    given = made.where("top AND depth > 0").select("conv_id", (F.col("depth") - 1).alias("depth"), "n_leaves", "saved_tokens").unionByName(
        crown.select("conv_id", "depth", zero.alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"))).groupBy("conv_id", "depth").agg(
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    given = stored(given)
    paths = above.join(given.select("conv_id").distinct(), "conv_id", "left_semi").join(given, ["conv_id", "depth"], "left")
    back = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    sums = paths.select("d1", "d2", *(F.sum(F.coalesce(c, zero)).over(back).alias(c) for c in ("n_leaves", "saved_tokens")))
    sums = sums.groupBy("d1", "d2").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    held = all_.where("depth > 0").groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count("*").alias("n_children"))
    tops = crown.join(sums, ["d1", "d2"]).join(held, ["d1", "d2"]).select(
        *[c.split()[0] for c in NODE.split(", ")], "n_children", "n_leaves", "saved_tokens", F.lit(None).cast("long").alias("parent_conv_id"), F.lit(True).alias("top"))
    # Parents in the crown.
    over = crown.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("over"))
    outer = _joined(made.where("top").unionByName(tops), over, ["p1", "p2"], "conv_id", "left", small).withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("over"))).drop("over")
    out = made.where("NOT top").unionByName(outer.select(*made.columns))
    named = out.join(ends(rows), ["d1", "d2"], "left")
    return named.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The nodes of all prefixes of conversations (conv_id, turn, role, text) as they are; see `numbered` and `nodes`."""
    turns = numbered(conversations)
    none = [F.lit(0).cast("long").alias(c) for c in ("t1", "t2", "size")]
    turns = stored(turns)
    return nodes(prefixes(turns.unionByName(turns.where("pos = 0").select("conv_id", F.lit(-1).cast("long").alias("pos"), *none))), limit)


def trie_of_rebuilt(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The same for conversations rebuilt by `with_heads`."""
    return nodes(prefixes(with_heads(stored(numbered(conversations)))), limit)
