"""Byte-level BPE: speculate by greedy longest match, verify neighbours, merge exactly where that fails.

A token sequence is the BPE encoding of its text exactly if every pair of neighbours is the encoding of its own text.
So each distinct word gets a guess (the longest vocabulary entry at each place), all pairs of all guesses are tested
at once in numpy, and only words with a failing pair are merged by rank.  Words repeat, so both results are cached;
the caches are bounded by bytes, keep no long pieces, and only save time.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.base import holds, per_batch, texts_of

#: The pattern of the byte-level pre-tokenizer (fixed values).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of the caches of a worker, and the longest piece that stays in them.
CACHED, LONGEST = 48_000_000, 64
NEVER = np.int64(1 << 40)
NONE = 1 << 40
SHORT = 200
AT_ONCE = 1_000_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBpe:
    """Encoder and decoder of a byte-level BPE file (the JSON of the tokenizers library)."""

    def __init__(self, spec: bytes):
        j = json.loads(spec)
        model, pre = j["model"], j["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or j["normalizer"]:
            raise ValueError("not a plain byte-level BPE file")
        letters = byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        self.ids = {to_bytes(s): i for s, i in model["vocab"].items() if all(c in letters for c in s)}
        self.added = {a["content"]: a["id"] for a in j["added_tokens"]}
        size = max([*self.ids.values(), *self.added.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in self.ids.items():
            self.bytes_of[i] = token
        for content, i in self.added.items():
            self.bytes_of[i] = content.encode()
            self.ids.pop(content.encode(), None) if content not in model["vocab"] else None
        self.byte_id = [self.ids[bytes([b])] for b in range(256)]
        self.left, self.right = np.arange(size), np.arange(size)
        self.rank = np.full(size, -1, np.int64)
        self.rank_of: dict[tuple[int, int], int] = {}
        self.whole: list[int] = []
        sound = True
        for r, m in enumerate(model["merges"]):
            a, b = (self.ids[to_bytes(x)] for x in (m.split(" ") if isinstance(m, str) else m))
            whole = self.ids[self.bytes_of[a] + self.bytes_of[b]]
            # The pair test needs one merge per token and parts that are older than the whole.
            sound &= self.rank[whole] < 0 and max(self.rank[a], self.rank[b]) < r
            self.left[whole], self.right[whole], self.rank[whole] = a, b, r
            self.rank_of[a, b] = r
            self.whole.append(whole)
        self.sound = sound and all(self.rank[i] >= 0 or len(t) == 1 for t, i in self.ids.items())
        self.size = size
        pairs = np.array([a * size + b for a, b in self.rank_of], np.int64)
        order = np.argsort(pairs)
        self.pair_keys = np.append(pairs[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.array([*self.rank_of.values()], np.int64)[order], NEVER)
        self.longest = [1] * 256
        for token in self.ids:
            self.longest[token[0]] = max(self.longest[token[0]], len(token))
        lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.split = regex.compile(SPLIT).findall
        self.special = regex.compile("|".join(regex.escape(c) for c in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.led: dict[str, bytes] = {}  # ids of a blank and this piece, for pieces that don't end in white space
        self.bare: dict[str, bytes] = {}  # ids of any other text between two cuts
        # The entries of before: the caches have two ages, each of half the bound.
        self.old_led: dict[str, bytes] = {}
        self.old_bare: dict[str, bytes] = {}
        self.held = 0
        self.stats = {"words": 0, "merged": 0}

    # ---- one word ----

    def guess(self, word: bytes) -> list[int]:
        """The longest vocabulary entry at each place."""
        out, i, n, ids, longest = [], 0, len(word), self.ids, self.longest
        while i < n:
            j = min(n, i + longest[word[i]])
            while (token := ids.get(word[i:j])) is None:
                j -= 1
            out.append(token)
            i = j
        return out

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: always the pair of lowest rank, the leftmost first."""
        if len(word) > SHORT:
            return self._merged_long(word)
        ids, rank_of, whole = [self.byte_id[b] for b in word], self.rank_of, self.whole
        ranks = [rank_of.get(pair, NONE) for pair in pairwise(ids)]
        while ranks and (r := min(ranks)) != NONE:
            i = ranks.index(r)
            ids[i] = whole[r]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of.get((ids[i - 1], ids[i]), NONE)
            if i < len(ranks):
                ranks[i] = rank_of.get((ids[i], ids[i + 1]), NONE)
        return ids

    def _merged_long(self, word: bytes) -> list[int]:
        """The same with a heap and a linked list, for words of any length."""
        ids, rank_of = [self.byte_id[b] for b in word], self.rank_of
        n = len(ids)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i, *pair) for i, pair in enumerate(pairwise(ids)) if (r := rank_of.get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # a part has been merged meanwhile
            ids[i], ids[j], after[i] = self.whole[r], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := rank_of.get((ids[i], ids[after[j]]))) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[after[j]]))
            if (h := before[i]) >= 0 and (r := rank_of.get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (r, h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    # ---- many words ----

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a * self.size + b
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens: does no merge cross their border?

        Undo the merges inside both tokens, the latest first.  The two parts at the border then lived side by side until
        the merge just undone; a merge of the two with a lower rank would have come first.  At equal rank the leftmost
        place wins: the left token's own merge before the crossing one, the crossing one before the right token's.
        """
        ok = self.pair_rank(a, b) == NEVER
        live = np.flatnonzero(ok)
        a, b = a[live], b[live]
        while len(live):
            ra, rb = self.rank[a], self.rank[b]
            more = (ra >= 0) | (rb >= 0)
            live, a, b, ra, rb = live[more], a[more], b[more], ra[more], rb[more]
            undo_left = ra > rb
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
            fine = self.pair_rank(a, b) >= np.where(undo_left, ra, rb + 1)
            ok[live[~fine]] = False
            live, a, b = live[fine], a[fine], b[fine]
        return ok

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each pre-token, packed as little-endian unsigned 32-bit integers."""
        raw = [w.encode() for w in words]
        guesses = [self.guess(w) for w in raw]
        flat = np.fromiter((x for g in guesses for x in g), np.int64)
        owner = np.repeat(np.arange(len(raw)), [len(g) for g in guesses])
        failing = np.ones(len(raw), bool)
        if self.sound:
            same = owner[1:] == owner[:-1]
            bad = ~self.compatible(flat[:-1][same], flat[1:][same])
            failing = np.bincount(owner[1:][same][bad], minlength=len(raw)) > 0
        self.stats["words"] += len(raw)
        self.stats["merged"] += int(failing.sum())
        if failing.any():
            for i in np.flatnonzero(failing):
                guesses[i] = self.merged(raw[i])
            flat = np.fromiter((x for g in guesses for x in g), np.int64)
        packed, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum([len(g) for g in guesses], dtype=np.int64)).tolist()
        return [packed[i:j] for i, j in pairwise([0, *ends])]

    # ---- texts ----

    def cut(self, text: str) -> list[str]:
        """Pieces that begin a pre-token each: cut before a blank that follows no white space."""
        pieces, out, held = text.split(" "), [], ""
        for i, p in enumerate(pieces):
            held += p if i == 0 else " " + p
            if p and not p[-1].isspace():
                out.append(held)
                held = ""
        return [*out, held] if held else out

    def plain_parts(self, text: str) -> Iterable[tuple[str, int | None]]:
        """The text between added tokens, and those tokens."""
        if not self.special:
            yield text, None
            return
        at = 0
        for m in self.special.finditer(text):
            yield text[at : m.start()], None
            yield "", self.added[m[0]]
            at = m.end()
        yield text[at:], None

    def pre_tokens(self, piece: str) -> list[str]:
        return [piece] if piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()) else self.split(piece)

    def plan(self, text: str) -> list[tuple[str, list[str]] | int]:
        """How a text is put together: a bare first part and pieces that a blank leads; added tokens by id."""
        if self.special and self.special.search(text):
            return [x for part, added in self.plain_parts(text) for x in (self.plan_plain(part) if added is None else [added])]
        return self.plan_plain(text)

    def plan_plain(self, text: str) -> list[tuple[str, list[str]]]:
        first, *pieces = text.split(" ")
        if not (first and first[-1].isspace()) and (first or not pieces) and all(p and not p[-1].isspace() for p in pieces if p not in self.led):
            return [(first, pieces)]
        return [(chunk, []) for chunk in self.cut(text)]

    def learn(self, plans: list[list[tuple[str, list[str]] | int]]) -> list[str]:
        """Encode what the caches lack, all distinct pre-tokens at once; the pieces too long to stay there."""
        led, bare = self.led, self.bare
        pieces: set[str] = set()
        firsts: set[str] = set()
        for plan in plans:
            for x in plan:
                if isinstance(x, tuple):
                    firsts.add(x[0])
                    pieces.update(x[1])
        again = 0
        for wanted, young, old in ((pieces, led, self.old_led), (firsts, bare, self.old_bare)):
            for p in (wanted - young.keys()) & old.keys():
                young[p] = old[p]
                again += 200 + 4 * len(p)
        missing = {p: self.pre_tokens(" " + p) for p in pieces - led.keys()}
        others = {x: self.pre_tokens(x) for x in firsts - bare.keys()}
        new = list({w for parts in (missing, others) for words in parts.values() for w in words if w not in bare and not (w[0] == " " and w[1:] in led)})
        words = dict(zip(new, self.encode_words(new), strict=True)) if new else {}
        for w, ids in words.items():
            if w[0] == " " and w[1:].isalpha():
                led[w[1:]] = ids
            else:
                bare[w] = ids
        of = lambda w: words[w] if w in words else bare[w] if w in bare else led[w[1:]]
        for p, parts in missing.items():
            led[p] = of(parts[0]) if len(parts) == 1 else b"".join(map(of, parts))
        for p, parts in others.items():
            bare[p] = b"".join(map(of, parts))
        added = [*words, *missing, *others]
        # A key takes up to four bytes a character, its ids four a token; the objects and the tables the rest.
        self.held += again + sum(map(len, added)) * 4 + 200 * len(added)
        return [x for x in added if len(x) > LONGEST]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; the pieces of only some texts are held at once."""
        out: list[bytes] = []
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size > AT_ONCE:
                out += self._encode(held)
                held, size = [], 0
        return out + self._encode(held)

    def _encode(self, texts: list[str]) -> list[bytes]:
        if self.held > CACHED // 2:
            self.old_led, self.old_bare = self.led, self.bare
            self.led, self.bare, self.held = {}, {}, 0
        self.bare[""] = b""
        plans = [self.plan(text) for text in texts]
        long = self.learn(plans)
        led, bare = self.led, self.bare
        out = [b"".join([y for x in plan for y in ([bare[x[0]], *[led[p] for p in x[1]]] if isinstance(x, tuple) else [np.array([x], "<u4").tobytes()])]) for plan in plans]
        for x in long:
            led.pop(x, None)
            led.pop(x[1:], None)
            bare.pop(x, None)
            self.held -= 4 * len(x)
        return out

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; ids outside the vocabulary are passed over, broken UTF-8 is replaced."""
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        ids = ids[ids < self.size]
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids):
            return ""
        places = np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends + lengths, lengths)
        return self.flat[places].tobytes().decode("utf-8", "replace")


_LOADED: dict[int, ByteBpe] = {}


def loaded(spec) -> ByteBpe:
    """The encoder of a broadcast file, built once in each Python worker."""
    holds("bpe", _LOADED.clear)
    key = hash(spec.value)
    if key not in _LOADED:
        _LOADED.clear()  # of several files the last is kept
        _LOADED[key] = ByteBpe(spec.value)
    return _LOADED[key]


def shipped(df: DataFrame, path: str):
    """The vocabulary file (about 1.5 MB, whatever the data) as a broadcast, so executors need no such path."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", decoded: str | None = None) -> DataFrame:
    """Encode whole texts: key, n_tokens, ids (binary, little-endian unsigned 32-bit integers).

    One row per input row, also for repeated rows and null keys; a null or empty text has no ids.  Strings of the file's
    added tokens become those tokens, no others are added.  Other input columns are left out.  `decoded` names a further
    column with the text of the ids, decoded in the same pass.
    """
    spec = shipped(df, path)
    schema = T.StructType([df.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    if decoded:
        schema = schema.add(decoded, T.StringType())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = loaded(spec)
        ids = bpe.encode(texts_of(batch.column(1)))
        again = [pa.array([bpe.decode(x) for x in ids], pa.string())] if decoded else []
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), *again], names=schema.fieldNames())

    return per_batch(df.select(F.col(key), F.col(text).cast("string")), run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Replace packed ids by their text, in the column `into`; null ids give an empty text. Other columns stay."""
    spec = shipped(df, path)
    schema = T.StructType([f for f in df.schema if f.name not in (ids, into)] + [T.StructField(into, T.StringType())])
    kept = [f.name for f in schema][:-1]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = loaded(spec)
        texts = [bpe.decode(x or b"") for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(texts, pa.string())], names=[*kept, into])

    return per_batch(df, run, schema)


def ids_array(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()
