"""Runs of periodic text, against brute force."""

import random
import zlib

import numpy as np
import pytest

from tidemark.llm import periodic
from tests.llm import cases


def plain_runs(x, least=24):
    found = {}
    for q in range(1, len(x) // 3 + 1):
        t = 0
        while t < len(x) - q:
            u = t
            while u < len(x) - q and x[u] == x[u + q]:
                u += 1
            if u - t + q >= max(least, 3 * q):
                found.setdefault((t, u - t + q), q)
            t = max(u, t + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def some_text(r):
    n, letters = r.randrange(0, 160), r.choice([1, 2, 3, 20])
    x = [r.randrange(letters) for _ in range(n)]
    for _ in range(r.randrange(3)):
        if n:
            p, a = r.randrange(1, 12), r.randrange(n)
            base = x[a : a + p]
            for i in range(a, min(n, a + r.randrange(1, 90))):
                x[i] = base[(i - a) % len(base)]
    return x


@pytest.mark.parametrize("grid, piece", [(1 << 15, 400_000), (40, 30)])
def test_runs_equal_brute_force(monkeypatch, grid, piece):
    """Also for texts longer than the kept grid, and with slices of few candidates."""
    monkeypatch.setattr(periodic, "GRID", grid)
    monkeypatch.setattr(periodic, "SLICE", piece)
    periodic._grid.cache_clear()
    r = random.Random(grid)
    for _ in range(80):
        texts, least = [some_text(r) for _ in range(r.randrange(1, 8))], r.choice([3, 6, 24])
        got = periodic.runs_of([np.array(x, np.int32) for x in texts], least)
        assert [[tuple(row) for row in g.tolist()] for g in got] == [plain_runs(x, least) for x in texts]
    periodic._grid.cache_clear()


def test_extensions_equal_comparing(monkeypatch):
    r = random.Random(7)
    for _ in range(60):
        texts = [some_text(r) for _ in range(3)]
        parts, ends = [np.array([0])], [0]
        for k, x in enumerate(texts):
            parts += [np.array(x, np.int64) + 4, np.array([k + 1])]
            ends.append(ends[-1] + len(x) + 1)
        flat = np.concatenate(parts)
        levels = periodic.grammar(flat, 4)
        assert all((np.diff(level.first) > 0).all() for level in levels[1:])
        pairs = [(a, b) for a, b in ((r.randrange(1, len(flat) - 1), r.randrange(1, len(flat) - 1)) for _ in range(40)) if a < b]
        a, b = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
        for forward in (True, False):
            want = []
            for i, j in pairs:
                n = 0
                while flat[i] == flat[j] and i >= 0:
                    i, j, n = i + (1 if forward else -1), j + (1 if forward else -1), n + 1
                want.append(n)
            assert periodic.common(levels, a, b, forward).tolist() == want


def test_rounds_are_few():
    x = np.random.default_rng(1).integers(0, 3, 50_000)
    assert len(periodic.grammar(np.concatenate([[0], x + 2, [1]]), 2)) < 90
    assert len(periodic.grammar(np.concatenate([[0], np.full(50_000, 2), [1]]), 2)) < 4


def test_tables(spark):
    texts = ["a b c " * 20, "x " * 30 + "y", "the " * 23, None, "", "one two  three\n" * 12 + "end \x1f word", "la " * 40_000 + cases.prose(3, 50)]
    rows = cases.rows() + [(200 + i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = periodic.find(cases.docs(spark, True, rows)).collect()
    assert len(got) == len(rows)
    want = []
    for i, t, *_ in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        runs = plain_runs(words) if len(words) < 30_000 else [(0, 40_000, 1)]
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((i, [tuple(r) for r in runs], " ".join(w for k, w in enumerate(words) if k not in gone)))
    assert sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=repr) == sorted(want, key=repr)
    assert periodic.find(cases.empty(spark)).count() == 0
    top = {r.doc_id: r for r in periodic.digest(periodic.find(cases.docs(spark, True, rows))).collect()}
    assert (top[200].start, top[200].length, top[200].period, top[200].exponent_milli) == (0, 60, 3, 20_000)
    assert top[202].n_runs == 0 and top[202].start is None and top[203].collapsed_sha256 == top[204].collapsed_sha256


def test_planted_texts(spark):
    rows = [(i, cases.prose(i, 5 + 7 * i % 90) if i % 9 else None, "en", "s", 1) for i in range(150)] + [(None, "a b", "en", "s", 1)]
    got = {r.doc_id: r.text for r in periodic.planted(cases.docs(spark, True, rows)).collect()}
    changed = 0
    for i, t, *_ in rows:
        h = zlib.crc32(str(i).encode())
        words = (t or "").split()
        if i is not None and h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            t = " ".join(w if k < a else words[a + (k - a) % p] for k, w in enumerate(words))
            changed += 1
        assert got[i] == t
    assert changed > 5
