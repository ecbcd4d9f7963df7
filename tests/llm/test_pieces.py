"""SentencePiece encoding and decoding, against the library."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tidemark.llm import pieces
from tidemark.llm.base import Kept
from tests.llm import cases

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "1", "23", "'s", "<s>", "</s>", "<unk>", "<0x41>", "日本", "😀", "\x1c", "\x85", "​", "́", " the", "!", "...", "²", "▁", "▁▁", "\0", "ing", "er", "xxxxx", "\r\n"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def engine():
    return pieces.Pieces(pieces.spec_of(PATH))


def ids_of(packed):
    return np.frombuffer(packed, "<i4").tolist()


def test_encoder_equals_the_library(library, engine):
    r = random.Random(3)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randrange(25))) for _ in range(3000)]
    texts += ["".join(r.choice("aehinrst") for _ in range(r.randrange(1, 40))) for _ in range(3000)]
    texts += ["a" * 3000, " " * 2000, "ab" * 2000, "", "\n" * 500, "日" * 5000 + "本" * 999, *(t or "" for _, t, *_ in cases.rows())]
    for text in texts:
        ids = ids_of(engine.encode(text))
        assert ids == library.encode(text)
        assert engine.decode(ids) == library.decode(ids)


def test_any_ids_decode_as_in_the_library(library, engine):
    r = random.Random(4)
    odd = [0, 1, 2, engine.ids["▁"], engine.ids["▁▁"], *engine.byte_ids]
    for _ in range(3000):
        ids = [r.randrange(len(engine.said)) if r.random() < 0.5 else r.choice(odd) for _ in range(r.randrange(8))]
        assert engine.decode(ids) == library.decode(ids)


def test_backtracking_equals_merging(engine):
    """Also where the caches are empty at every word, and where words may not be encoded apart."""
    r = random.Random(5)
    retries = 0
    for _ in range(500):
        text = "▁" + "".join(r.choice("aeinrstu▁") for _ in range(r.randrange(1, 60)))
        tokens = engine.split(text)
        assert [engine.shown(t) for t in tokens] == engine.merged(text)
        longest = engine.longest(text)
        greedy, at = [], 0
        while at < len(text):
            greedy.append(longest[at])
            at += engine.lengths[longest[at]]
        retries += greedy != tokens
    assert retries > 100
    whole = pieces.Pieces(pieces.spec_of(PATH))
    whole.by_blank, whole.led = False, Kept(0)
    for text in ("the river  walks\nslowly ", " a", cases.prose(3, 30)):
        assert whole.encode(text) == engine.encode(text)


def test_caches_are_bounded_by_bytes():
    kept = Kept(10_000)
    for i in range(2000):
        kept.keep(f"word{i}", i)
        assert len(kept) < 60
    kept.keep("x" * 65, 1)
    assert "x" * 65 not in kept


def test_a_worker_holds_the_tables_of_one_operator():
    from tidemark.llm import base

    dropped = []
    base.holds("one", lambda: dropped.append(1))
    base.holds("one", lambda: dropped.append(2))
    assert dropped == []
    base.holds("two")
    base.holds("three", lambda: dropped.append(3))
    assert dropped == [1]
    base.holds("")
    assert dropped == [1, 3]


def test_tables(spark, library):
    docs = cases.docs(spark, extra=True)
    got = pieces.encode(docs, PATH, decoded="again").collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids, r.again) for r in got), key=repr) == sorted(
        ((i, len(w := library.encode(t or "")), w, library.decode(w)) for i, t, *_ in cases.rows()), key=repr)
    back = pieces.decode(pieces.encode(docs, PATH), PATH).select("doc_id", "decoded").collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((r.doc_id, r.again) for r in got), key=repr)
    assert pieces.encode(cases.empty(spark), PATH).count() == 0
