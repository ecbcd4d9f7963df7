"""SentencePiece BPE: exact encoding by backtracking over longest matches, and decoding.

The model merges neighbours whose joint text is a piece, best score first, the leftmost first among equals.  A sequence
of tokens is what these merges give for its text exactly if each two neighbours are what they give for the two alone:
merges inside two neighbours run in the same order alone and in the text until one of them crosses a border.  So

* an Aho-Corasick automaton finds the longest piece at every place;
* tokens are taken greedily, each checked against the one before by merging the two anew (kept per pair);
* where no piece fits, the next shorter one is tried, then the token before is taken back and its end is marked in a
  bitfield: tokens up to a place are unique, so a place that failed once fails always.

Every place is marked at most once, so the work is linear in the text but for the lengths of pieces.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.base import Kept, holds, per_batch, small_batches

SPACE = "▁"  # stands for a blank inside pieces
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # kinds of pieces in a model file (fixed values)
#: Characters whose pieces are gathered before they are put together.
AT_ONCE = 1_000_000
#: Pairs of neighbours whose check is kept (some 140 bytes each).
PAIRS = 250_000

codecs.register_error("one_for_each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def spec_of(path: str) -> bytes:
    """What the encoder needs of a model file, as JSON: pieces, scores, kinds."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    rule, trained = model.normalizer_spec, model.trainer_spec
    plain = not rule.precompiled_charsmap and rule.add_dummy_prefix and not rule.remove_extra_whitespaces and rule.escape_whitespaces
    if trained.model_type != trained.BPE or not plain or not trained.byte_fallback or trained.treat_whitespace_as_suffix or model.denormalizer_spec.precompiled_charsmap:
        raise ValueError("not a BPE model with byte fallback, a leading blank and texts as they are")
    if {p.type for p in model.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("pieces of a user or unused ones are not supported")
    return json.dumps([[p.piece, p.score, p.type] for p in model.pieces]).encode()


class Pieces:
    """Encoder and decoder of one model.

    Tokens are numbers here: the id of a piece, or, for a character without one, its code point after all ids.
    """

    def __init__(self, spec: bytes):
        pieces = json.loads(spec)
        self.size = len(pieces)
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.text_of = [p for p, *_ in pieces]
        self.lengths = [len(p) for p, *_ in pieces]
        self.scores = {p: score for p, score, kind in pieces if kind == NORMAL}
        self.kinds = [kind for *_, kind in pieces]
        bytes_ = {int(p[3:-1], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.byte_ids = [bytes_[b] for b in range(256)]
        self.said = [
            bytes([int(p[3:-1], 16)]) if kind == BYTE else " ⁇ ".encode() if kind == UNKNOWN else b"" if kind == CONTROL else p.replace(SPACE, " ").encode()
            for p, _, kind in pieces]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        # The next shorter piece that begins a piece; -1: there is none.
        self.shorter = [next((self.ids[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), -1) for p in self.text_of]
        longer = [p for p in self.ids if len(p) > 1]
        # No merge crosses a border before a blank, or one beside a line feed, if no piece holds it: then words are encoded apart.
        self.by_blank = not any(SPACE in p.lstrip(SPACE) for p in longer)
        self.by_line = not any("\n" in p for p in longer)
        self.parts = re.compile(f"\n|{SPACE}*[^\n{SPACE}]+|{SPACE}+" if self.by_line else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.pairs: dict[int, bool] = {}
        self.units: Kept = Kept(16_000_000)
        self.led: Kept = Kept(64_000_000)

    # ---- one unit ----

    def merged(self, text: str) -> list[str]:
        """The merges as the model has them: the best score first, the leftmost first among equals."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def shown(self, token: int) -> str:
        return self.text_of[token] if token < self.size else chr(token - self.size)

    def fits(self, left: int, right: int, key: int) -> bool:
        """Do the two, merged anew, come out as they are?  Without a left one (-1): does the right one alone?"""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        parts = [self.shown(right)] if left < 0 else [self.shown(left), self.shown(right)]
        self.pairs[key] = fit = self.merged("".join(parts)) == parts
        return fit

    def longest(self, unit: str) -> list[int]:
        """The longest token at every place."""
        found, lengths = [-1] * len(unit), self.lengths
        for end, token in self.automaton.iter(unit):  # by end, so at each place the longest comes last
            found[end + 1 - lengths[token]] = token
        if -1 in found:
            found = [self.size + ord(c) if t < 0 else t for t, c in zip(found, unit, strict=True)]
        return found

    def split(self, unit: str) -> list[int]:
        """The tokens of a unit, by backtracking."""
        n, size, shorter, lengths, longest = len(unit), self.size, self.shorter, self.lengths, self.longest(unit)
        known, fits = self.pairs.get, self.fits
        failed = bytearray(n // 8 + 1)
        tokens: list[int] = []
        at, token, last = 0, longest[0], -1
        while True:
            end = at + (lengths[token] if token < size else 1)
            if not failed[end >> 3] >> (end & 7) & 1:
                key = last << 32 | token
                if (fit := known(key)) is None:
                    fit = fits(last, token, key)
                if fit:
                    tokens.append(token)
                    if end == n:
                        return tokens
                    at, last, token = end, token, longest[end]
                    continue
            token = shorter[token] if token < size else -1
            while token < 0:  # nothing fits after the last token: take it back, then try a shorter one
                if not tokens:
                    raise ValueError("no sequence of pieces fits; the model is not complete")
                failed[at >> 3] |= 1 << (at & 7)
                token = tokens.pop()
                at -= lengths[token] if token < size else 1
                last = tokens[-1] if tokens else -1
                token = shorter[token] if token < size else -1

    def packed(self, unit: str) -> bytes:
        """Ids of a unit as little-endian 32-bit integers; characters without a piece become their bytes."""
        ids = self.split(unit)
        if max(ids) >= self.size:
            ids = [i for t in ids for i in ([t] if t < self.size else [self.byte_ids[b] for b in chr(t - self.size).encode()])]
        return pack(f"<{len(ids)}i", *ids)

    def unit(self, unit: str) -> bytes:
        """The same, kept."""
        if (known := self.units.known(unit)) is None:
            self.units.keep(unit, known := self.packed(unit))
        return known

    # ---- texts ----

    def word(self, word: str) -> bytes:
        """Ids of a blank and these characters, none of them a blank."""
        if (known := self.led.known(word)) is not None:
            return known
        out = self.packed(SPACE + word) if not (self.by_line and "\n" in word) else b"".join(map(self.unit, self.parts(SPACE + word)))
        self.led.keep(word, out)
        return out

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text."""
        if not text:
            return b""
        words = text.split(" ")
        if not self.by_blank or SPACE in text or "" in words:
            # Runs of blanks lead the word after them; other models may merge across words.
            whole = SPACE + text.replace(" ", SPACE)
            return b"".join(map(self.unit, self.parts(whole))) if self.by_blank else self.packed(whole)
        led = self.led
        return b"".join([led.get(w) or self.word(w) for w in words])

    def decode(self, ids: list[int]) -> str:
        """The text of ids: one leading blank goes, bytes that make no character become U+FFFD each."""
        out = b"".join(map(self.said.__getitem__, ids))
        if out[:1] == b" ":
            first = next(i for i in ids if self.kinds[i] != CONTROL)
            if self.kinds[first] == NORMAL:
                out = out[1:]
        return out.decode("utf-8", "one_for_each_byte")


_LOADED: dict[int, Pieces] = {}


def loaded(spec) -> Pieces:
    """The encoder of a broadcast model, built once in each Python worker; of several models the last is kept."""
    holds("pieces", _LOADED.clear)
    key = hash(spec.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(spec.value)
    return _LOADED[key]


def _lists(packed: list[bytes]) -> pa.Array:
    offsets = np.cumsum([0, *(len(x) // 4 for x in packed)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", decoded: str | None = None) -> DataFrame:
    """Encode whole texts: key, n_tokens, ids (array of int), without begin and end ids.

    One row per input row, also for repeated rows and null keys; a null or empty text has no ids.  Names of control
    pieces inside a text are plain text.  Other input columns are left out.  `decoded` names a further column with the
    text of the ids, decoded in the same pass.
    """
    small_batches(df.sparkSession)
    spec = df.sparkSession.sparkContext.broadcast(spec_of(path))  # about 1 MB, whatever the data
    schema = T.StructType([df.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    if decoded:
        schema = schema.add(decoded, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(spec)
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # by characters, so that long texts come in small batches
                size, packed = 0, []
                start = at
                for t in batch.column(1).slice(start, 1000):
                    t = t.as_py() or ""
                    packed.append(model.encode(t))
                    size += len(t)
                    at += 1
                    if size > AT_ONCE:
                        break
                again = [pa.array([model.decode(np.frombuffer(x, "<i4").tolist()) for x in packed], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(packed)), pa.array([len(x) // 4 for x in packed], pa.int64()), _lists(packed), *again], names=schema.fieldNames())

    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Replace arrays of ids by their text, in the column `into`; null ids give an empty text. Other columns stay."""
    spec = df.sparkSession.sparkContext.broadcast(spec_of(path))
    schema = T.StructType([f for f in df.schema if f.name not in (ids, into)] + [T.StructField(into, T.StringType())])
    kept = [f.name for f in schema][:-1]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = loaded(spec)
        column = lambda c: batch.column(batch.schema.get_field_index(c))
        return pa.RecordBatch.from_arrays([*map(column, kept), pa.array([model.decode(x or []) for x in column(ids).to_pylist()], pa.string())], names=[*kept, into])

    return per_batch(df, run, schema)

