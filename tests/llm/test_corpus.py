"""Operators over whole corpora, against brute force."""

import random
import re
import sys

import pytest

import corpus_pipeline
from tidemark.llm import linededup, ngramjoin
from tests.llm import cases


# ---- op3 ----


def plain_dedup(rows, min_words):
    """Delete every line of a run with enough words that begins, word for word, at an earlier place too."""
    docs = sorted({(i if i is not None else -(1 << 63), t) for i, t, *_ in rows if t is not None}, key=lambda x: x[0])
    lines = {d: [(n, x.strip(" \t\n\x0b\x0c\r")) for n, x in enumerate(d[1].split("\n")) if x.strip(" \t\n\x0b\x0c\r")] for d in docs}
    gone = {d: set() for d in docs}
    places = [(d, i) for d in docs for i in range(len(lines[d]))]
    for at, (d, i) in enumerate(places):
        for e, j in places[:at]:
            n = 0
            while i + n < len(lines[d]) and j + n < len(lines[e]) and lines[d][i + n][1] == lines[e][j + n][1]:
                n += 1
            if n and sum(len(re.findall(r"[^ \t-\r]+", x)) for _, x in lines[d][i : i + n]) >= min_words:
                gone[d] |= {k for k, _ in lines[d][i : i + n]}
    for d in docs:  # a line without a word goes if the next lines with one on both sides go
        for (a, _), (b, _) in zip(lines[d], lines[d][1:], strict=False):
            if {a, b} <= gone[d]:
                gone[d] |= set(range(a, b))
    return {d: "\n".join(x for n, x in enumerate(d[1].split("\n")) if n not in gone[d]) for d in docs}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_dedup(spark, seed):
    r = random.Random(seed)
    pool = [" ".join(r.choice(cases.WORDS) for _ in range(r.randint(1, 5))) for _ in range(6)] + ["", "  "]
    rows = [(i, "\n".join(" " * r.randrange(2) + r.choice(pool) for _ in range(r.randint(0, 14))), "en", "s", 1) for i in range(14)]
    rows += [(90, pool[0] + "\n" + pool[1], "en", "s", 1)] * 2 + [(91, None, "en", "s", None), (91, "", "en", "s", 0), (None, "\n".join(pool), "en", "s", 1)]
    for min_words in (1, 6, 15):
        want = plain_dedup(rows, min_words)
        got = linededup.dedup(cases.docs(spark, True, rows), min_words).select("row.doc_id", "row.text", "cleaned").collect()
        assert len(got) == len(rows)
        for x in got:
            assert x.cleaned == (None if x.text is None else want[x.doc_id if x.doc_id is not None else -(1 << 63), x.text])


def test_line_dedup_edges(spark):
    passage = cases.prose(60, 55)
    rows = cases.rows() + [(70 + i, f"{cases.prose(80 + i, 30)}\n{passage}\n{cases.prose(99 - i, 9)}", "en", "s", 1) for i in range(5)] + [(69, passage, "en", "s", 1), (80, passage, "en", "s", 1)]
    docs = cases.docs(spark, True, rows)
    out = linededup.clean(docs)
    assert out.schema.names == docs.schema.names
    got = {r.doc_id: r for r in out.collect()}
    assert passage in got[69].text and all(passage not in got[70 + i].text for i in range(5)) and 80 not in got
    assert all(got[70 + i].n_chars == len(got[70 + i].text) and cases.prose(80 + i, 30) in got[70 + i].text for i in range(5))
    assert out.where("text IS NULL").count() == sum(r[1] is None for r in rows)
    assert linededup.clean(cases.empty(spark)).count() == 0


# ---- op6 ----


def plain_groups(rows):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    rows = [(-(1 << 63) if i is None else i, t) for i, t, *_ in rows]
    sets = [(i, shingles(t)) for i, t in rows]
    label = {i: i for i, _ in rows}
    edges = [(a, b) for a, x in sets for b, y in sets if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y)]
    for _ in rows:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    shown = lambda i: None if i == -(1 << 63) else i
    return sorted(((shown(i), len(s), shown(label[i] if s else i)) for i, s in sets), key=repr)


def copies(seed, n, words=60):
    """Copies of one text with a few words changed: some link, some don't, some only through others."""
    r = random.Random(seed)
    base, out = cases.prose(seed, words).split(), []
    for i in range(n):
        mine = list(base)
        for _ in range(r.choice([0, 1, 1, 1, 2, 3])):
            mine[r.randrange(words)] = f"w{r.randrange(10**6)}"
        out.append((1000 * seed + i, " ".join(mine), "en", "s", 1))
    return out


@pytest.mark.parametrize("short", [2, 8])
def test_ngram_join(spark, monkeypatch, short):
    monkeypatch.setattr(ngramjoin, "SHORT_LIST", short)
    rows = cases.rows() + copies(1, 40) + copies(2, 12, 25) + [(5000 + i, x[1].upper() + " \n", *x[2:]) for i, x in enumerate(copies(1, 10))]
    rows += [(6000 + i, t, "en", "s", 1) for i, t in enumerate(["a b c", "A b  c", "a b", "a b c d e", "a b c d e"])]
    random.Random(1).shuffle(rows)
    got = ngramjoin.groups(cases.docs(spark, True, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == plain_groups(rows)


def test_shingles_of_texts_made_together(monkeypatch):
    """Equal to each text alone, and no Python call for a word, however rare the words are."""
    monkeypatch.setattr(ngramjoin, "TOGETHER", 2_000)
    texts = [x or "" for _, x, *_ in cases.rows()] + ["", "a", "A b c", "a b c d e", "a b c d e a b c d e", cases.prose(5, 900)]
    for n in (1, 3, 5):
        got = list(ngramjoin.shingle_sets(texts, n))
        assert len(got) == len(texts)
        for text, keys in zip(texts, got, strict=True):
            words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
            assert len(keys) == len({tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else ())
            assert (keys[1:] > keys[:-1]).all() and (keys == ngramjoin.shingles(text, n)).all()
    calls, text = [], " ".join(f"w{i}" for i in range(20_000))
    sys.setprofile(lambda frame, event, what: calls.append(event) if event == "call" else None)
    try:
        ngramjoin.shingles(text)
    finally:
        sys.setprofile(None)
    assert len(calls) < 2_000


def test_rows_of_one_id_are_one_document(spark):
    s, t, u = (cases.prose(700 + i, 40) for i in range(3))
    rows = [(i, x, "en", "s", 1) for i, x in [(3, s), (5, s), (5, t), (5, ""), (9, t), (9, u), (12, u), (13, ""), (13, None), (20, cases.prose(800, 40))]]
    got = ngramjoin.groups(cases.docs(spark, True, rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [*[(i, 3) for i in (3, 5, 5, 5, 9, 9, 12)], (13, 13), (13, 13), (20, 20)]
    assert sorted(r.doc_id for r in ngramjoin.keep_one(cases.docs(spark, True, rows)).collect()) == [3, 13, 20]


def test_keep_one(spark):
    rows = cases.rows() + copies(3, 20)
    docs = cases.docs(spark, True, rows)
    kept = ngramjoin.keep_one(docs)
    assert kept.schema.names == docs.schema.names
    want = {i for i, n, c in plain_groups(rows) if i == c}
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert ngramjoin.groups(cases.empty(spark)).count() == 0 and ngramjoin.keep_one(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("few", [0, 10**6])
def test_components(spark, few):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, x) for x in range(2, 40)] + [(r.randrange(500, 900), r.randrange(500, 900)) for _ in range(150)]
    label = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame([(min(e), max(e)) for e in edges if e[0] != e[1]], "a long, b long")
    got = {x.node: x.least for x in ngramjoin.components(df, few).collect()}
    assert got == {x: c for x, c in label.items() if x != c}


# ---- pipeline ----


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    counts = []
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = now
        now = stage(spark, now, folder).cache()
        assert now.schema.names == docs.schema.names, name
        assert now.select("doc_id").exceptAll(before.select("doc_id")).isEmpty()
        counts.append(now.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, now, folder)
    assert last.where("decoded IS NULL").isEmpty() and last.count() == counts[-1]
    assert sorted(map(repr, last.join(now, "doc_id").where("decoded != text").collect())) == []
    none = cases.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, folder)
    assert none.count() == 0


def test_bit_maps_never_refuse_a_link():
    import numpy as np

    r = np.random.default_rng(2)
    refused = 0
    for _ in range(3000):
        n = int(r.integers(1, 400))
        x = np.unique(r.integers(0, 2**63, n, dtype=np.uint64) << np.uint64(1))
        keep = x[r.random(len(x)) < r.choice([0.5, 0.8, 0.95])]
        y = np.unique(np.concatenate([keep, r.integers(0, 2**63, int(r.integers(0, 1 + n // 3)), dtype=np.uint64)]))
        if not len(y):
            continue
        both = len(np.intersect1d(x, y))
        links = 100 * both >= 75 * (len(x) + len(y) - both)
        agrees = ngramjoin.may_agree(len(x), ngramjoin.bit_map(x), len(y), ngramjoin.bit_map(y))
        assert agrees or not links
        refused += not agrees
    assert refused > 500
