"""The trie of conversation prefixes, against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import prefixtrie

LOG = "conv_id long, turn long, role string, text string, n_convs long, d1 string, depth int"


def logs(seed=1, n=90):
    """Conversations that begin alike, equal ones, one long one, gaps, nulls, ties and repeated rows."""
    r = random.Random(seed)
    said = [f"text {i} é😀" for i in range(3)]
    rows = []
    for c in [*range(n), 100, 103, 250, -7, -200, 1_000_003]:
        for t in range(r.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c, t, r.choice(["user", "assistant"]) if t > 1 else "user", r.choice(said) if t else said[0]))
    rows += [(120 + i, t, "user", said[t % 2]) for i in range(40) for t in range(4)]
    rows += [(300, t, "user", said[t % 3]) for t in range(60)] + [(301, t, "user", said[t % 3]) for t in range(60)]
    rows += [(400, None, None, None), (400, 1, "user", None), (400, None, "", "x"), (401, 2, "user", "b"), (401, 2, "user", "a"), (401, 2, "user", "a"), (None, 1, "user", "lost")]
    r.shuffle(rows)
    return rows


def ordered(rows):
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            out.setdefault(c, []).append((-(10**9) if turn is None else turn, role or "", text or ""))
    return {c: [x[1:] for x in sorted(v)] for c, v in out.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        donor = c - int(np.fmod(c, 100))
        out[c] = convs.get(donor, [])[:h] + turns[h:]
    return out


def plain_trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, m in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = lambda x: [y for y in members if len(y) == len(x) + 1 and y[: len(x)] == x]
        ends = sorted(c for c in m if len(convs[c]) == len(node))
        out.append((
            min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children(node)), sum(not children(x) for x in below),
            sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame([(*r, None, None, None) for r in logs()], LOG)


@pytest.mark.parametrize("limit", [1, 7, 60, 10**6])
def test_rebuilt_trie(spark, log, limit):
    got = sorted(map(tuple, prefixtrie.trie_of_rebuilt(log, limit).collect()), key=repr)
    assert got == plain_trie(rebuilt(ordered(logs())))


def test_plain_trie_and_large_crowns(spark, log, monkeypatch):
    monkeypatch.setattr(prefixtrie, "small_enough", lambda df: False)
    monkeypatch.setattr(prefixtrie, "PIECE", 3)
    assert sorted(map(tuple, prefixtrie.trie(log, 5).collect()), key=repr) == plain_trie(ordered(logs()))


def test_edges(spark):
    none = spark.createDataFrame([], LOG)
    assert prefixtrie.trie_of_rebuilt(none).count() == 0 and prefixtrie.trie(none).count() == 0
    lost = spark.createDataFrame([(5, 0, "user", "x", None, None, None)], LOG)  # rebuilt without a turn: h is 4 and 0 is absent
    assert [tuple(r)[:7] for r in prefixtrie.trie_of_rebuilt(lost).collect()] == [(5, 0, None, 1, 0, 1, 0)]


def test_slots():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 30_000):
        k1, k2 = r.integers(-(2**62), 2**62, n), r.integers(0, 3, n)
        slots = prefixtrie.Slots(k1, k2)
        assert sorted(slots.slots.tolist()) == list(range(n))
        assert (slots.of(k1, k2) == slots.slots).all()
        assert (slots.of(k1, k2 + 3) == -1).all()  # a cell may be taken: the stored key tells
    with pytest.raises(ValueError):
        prefixtrie.Slots(np.array([4, 4]), np.array([1, 1]))
