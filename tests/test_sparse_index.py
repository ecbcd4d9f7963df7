import math
import random
from collections import Counter

import numpy as np
import pytest

from tests.helpers import pairs
from tidemark.functions.text import tokens
from tidemark.operators import sparse_index
from pyspark.sql import functions as F

WORDS = [f"w{i}" for i in range(40)]


def corpus(seed=1, n=130):
    """Zipf-like words, a word that most chunks share, copies (ties), empty and null texts."""
    r = random.Random(seed)
    texts = [" ".join([*(WORDS[min(39, int(r.paretovariate(0.7)) - 1)] for _ in range(r.randrange(1, 30))), *(["the"] * r.randrange(3))]) for _ in range(n)]
    return [*texts, *texts[:20], "", None, "the " * 50]


def brute(query, texts, k):
    docs = [(t or "").split() for t in texts]
    average = sum(map(len, docs)) / len(docs)
    df = Counter(w for d in docs for w in set(d))
    out = []
    for i, d in enumerate(docs):
        tf = Counter(d)
        s = sum(sparse_index.weight(len(docs), df[w]) * q * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * max(len(d), 1) / average)) for w, q in Counter(query.split()).items() if tf[w])
        if s > 0:
            out.append((-round(s, 6), i))
    return [(i, -s) for s, i in sorted(out)[:k]]


def tables(spark, texts, queries):
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "chunk_id long, text string").repartition(3)
    asked = spark.createDataFrame([(i, q, k) for i, (q, k) in enumerate(queries)], "query_id long, text string, k int")
    return chunks.select("chunk_id", tokens(F.col("text")).alias("t")), sparse_index.query_terms(asked)


QUERIES = [("the w0 w3", 5), ("w0 w0 w1", 1), ("w30 the", 8), ("w7", 300), ("nothing here", 3), (" ".join(WORDS), 4), ("the", 7)]


@pytest.mark.parametrize("max_terms", [10**6, 3])
@pytest.mark.parametrize("only", [None, ["the", "w0", "w1", "w3", "w7", "w30", *WORDS]])
def test_search_equals_scoring_every_chunk(spark, monkeypatch, max_terms, only):
    monkeypatch.setattr(sparse_index, "BLOCK", 4)
    texts = corpus()
    chunks, terms = tables(spark, texts, QUERIES)
    found = sparse_index.search(sparse_index.build(chunks, only and sorted(set(only)), shard=30), terms, max_terms)
    got = {}
    for q, c, s, rank in sorted(pairs(found, "query_id", "chunk_id", "score", "rank"), key=lambda x: (x[0], x[3])):
        got.setdefault(q, []).append((c, pytest.approx(s, abs=1e-6)))
    want = {i: x for i, (q, k) in enumerate(QUERIES) if (x := brute(q, texts, k))}
    assert got.keys() == want.keys() and all([c for c, _ in got[q]] == [c for c, _ in want[q]] and got[q] == want[q] for q in want)


def test_parts_of_an_index_can_be_added_later(spark, monkeypatch):
    texts = corpus(2)
    chunks, terms = tables(spark, texts, QUERIES)
    whole = sparse_index.search(sparse_index.build(chunks), terms)
    late = sparse_index.build(chunks.where("chunk_id >= 60"))
    parts = sparse_index.search(sparse_index.build(chunks.where("chunk_id < 60")).unionByName(late), terms)
    key = lambda df: sorted(pairs(df, "query_id", "chunk_id", "score", "rank"))
    assert key(whole) == key(parts) != []


def test_unusable_chunks_count_but_are_not_found(spark):
    texts = corpus(3)
    chunks, terms = tables(spark, texts, [("the w0 w2", 500)])
    flagged = chunks.withColumn("usable", F.col("chunk_id") % 3 == 0)
    free = pairs(sparse_index.search(sparse_index.build(chunks), terms), "chunk_id", "score")
    some = pairs(sparse_index.search(sparse_index.build(flagged, shard=40), terms), "chunk_id", "score")
    assert sorted(some) == sorted((c, s) for c, s in free if c % 3 == 0)
    assert sparse_index.described(sparse_index.build(flagged)).count() == len(texts)


def test_blocks_are_skipped():
    """A rare term decides; of the common one, whose postings are nearly all, only some blocks are read."""
    rng = np.random.default_rng(1)
    n = 5000
    lengths = rng.integers(20, 400, n)
    shard = sparse_index.Shard(lengths, np.arange(n), None, float(lengths.mean()))

    def posted(term, places):
        tf = rng.integers(1, 9, len(places))
        gain = tf * 2.5 / (tf + shard.norm[places])
        order = np.argsort(-gain, kind="stable")
        places, tf = places[order], tf[order]
        at = np.arange(0, len(places), sparse_index.BLOCK)
        shard.add(term, places, tf, np.maximum.reduceat(tf, at), np.minimum.reduceat(lengths[places], at))

    posted("common", np.arange(n))
    posted("rare", np.sort(rng.choice(n, 40, replace=False)))
    terms = [("common", 0.02), ("rare", 6.0)]
    got = shard.best(terms, 10)
    assert shard.read < 200
    every = np.zeros(n)
    for t, w in terms:
        every[shard.terms[t].places] += w * shard.terms[t].gains
    want = sorted(zip((-np.round(every, 6)).tolist(), range(n), strict=True))[:10]
    assert [c for _, c in got] == [c for _, c in want] and not shard.seen.any() and not shard.sums.any()
    assert math.isclose(got[0][0], -want[0][0], abs_tol=1e-6)


def test_empty_sides(spark):
    chunks, terms = tables(spark, corpus(), QUERIES)
    assert sparse_index.search(sparse_index.build(chunks.limit(0)), terms).count() == 0
    assert sparse_index.search(sparse_index.build(chunks), terms.limit(0)).count() == 0


@pytest.mark.parametrize("only", [None, ["b", "zz", "a"]])
def test_an_index_counted_in_parts_is_the_same(only):
    """Tokens are counted part by part, so a shard of long texts never holds them all."""
    import pyarrow as pa

    rows = [["a", "b", "a"], [], None, ["c", "b"], ["a"] * 5, ["d", "b", "b"]]
    wanted, whole = None if only is None else pa.array(only), pa.array(rows, pa.list_(pa.string()))

    def plain(parts):
        terms, starts, place, tf, *_, lengths = sparse_index._postings(parts, wanted)
        ends = [*starts[1:], len(place)]
        return {t: list(zip(place[a:b].tolist(), tf[a:b].tolist())) for t, a, b in zip(terms.to_pylist(), starts, ends)}, lengths.tolist()

    one = plain([sparse_index._counts(whole, wanted)])
    assert one == plain([sparse_index._counts(whole.slice(i, 2), wanted) for i in (0, 2, 4)])
    assert one[1] == [3, 0, 0, 2, 5, 3] and sorted(one[0]["b"]) == [(0, 1), (3, 1), (5, 2)]
