"""Text rules, retrieval, answer checks and question tags."""

import math
from collections import Counter
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import pairs, ts
from tests.conftest import SF
from tidemark.functions import similarity
from tidemark.functions import text as TX
from tidemark.functions import vectors as VX
from tidemark.operators import answers as AN
from tidemark.operators import corpus as CO
from tidemark.operators import questions as Q
from tidemark.operators import retrieval as RT


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def lit(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t"))).first()[0]


@pytest.mark.parametrize("a,b", [("1.500.000", "1500000"), ("12.5%", "12,5%"), ("2,84", "2.84"), ("7.0", "7"), ("100", "100.000,0" [:3])])
def test_number_forms_are_equal(spark, a, b):
    assert lit(spark, a, TX.canonical_number) == lit(spark, b, TX.canonical_number)


def test_number_tokens(spark):
    assert lit(spark, "Rp 2.84 and 12,5% of 1.500 in 2024.", TX.number_tokens) == ["2.84", "12,5", "1.500", "2024"]
    assert lit(spark, "0.0000", TX.canonical_number) == "0" and lit(spark, "100", TX.canonical_number) == "100"


def test_sentences(spark):
    got = lit(spark, "Short one. This sentence is long enough!  Is this one also long?\nA line by itself here", TX.sentences)
    assert got == ["This sentence is long enough!", "Is this one also long?", "A line by itself here"]


def test_chunk_identity_and_query_key(spark):
    one = lambda t: value(spark, TX.chunk_id(F.lit("c"), F.lit("k"), F.lit(t)))
    assert one("text") == one("text") != one("other")
    assert lit(spark, "  Same Question ", TX.query_key) == lit(spark, "same question", TX.query_key)


@pytest.mark.parametrize("text,base,k", [("revenue today", 5, 10), ("revenue in 2024 please tell", 5, 3), (" ".join(["w"] * 8), 5, 5),
                                         (" ".join(["w"] * 14), 8, 6), ("up 12% now", 8, 6), ("a b", 3, 6)])
def test_adaptive_k(spark, text, base, k):
    assert lit(spark, text, lambda c: TX.adaptive_k(c, base)) == k


CORPUS = [("a", "monthly revenue grew in the second quarter", "insight"), ("b", "customers leave after a long silence", "insight"),
          ("c", "loyalty points are the cheapest campaign", "playbook"), ("d", "", "playbook")]


def chunks(spark):
    return spark.createDataFrame([(i, t, s, "x") for i, t, s in CORPUS], "chunk_id string, text string, source_type string, topic string")


def asked(spark, *texts, k=3):
    return spark.createDataFrame([(i, t, k) for i, t in enumerate(texts)], "query_id int, text string, k int")


def brute_bm25(query, corpus):
    docs = {i: TXTOK(t) for i, t in corpus}
    avg = sum(map(len, docs.values())) / len(docs)
    df = Counter(w for d in docs.values() for w in set(d))
    out = {}
    for i, d in docs.items():
        score = 0.0
        for w in TXTOK(query):
            tf = d.count(w)
            if tf:
                idf = math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5))
                score += idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * max(len(d), 1) / avg))
        if score > 0:
            out[i] = score
    return out


def TXTOK(text):
    import re
    return re.findall("[a-z0-9]+", text.lower())


def test_bm25_equals_brute_force(spark):
    queries = ["revenue revenue quarter", "the campaign", "nothing matches zebra"]
    got = {(q, c): s for q, c, s in pairs(RT.bm25_topk(asked(spark, *queries), chunks(spark)), "query_id", "chunk_id", "score")}
    want = {(i, c): s for i, q in enumerate(queries) for c, s in brute_bm25(q, [(a, b) for a, b, _ in CORPUS]).items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_bm25_filter_keeps_the_statistics(spark):
    free = dict(pairs(RT.bm25_topk(asked(spark, "the cheapest"), chunks(spark)), "chunk_id", "score"))
    only = dict(pairs(RT.bm25_topk(asked(spark, "the cheapest"), chunks(spark), {"source_type": "playbook"}), "chunk_id", "score"))
    assert only == {"c": free["c"]}


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id int, chunk_id string, key string, score double, rank int")


def test_normalise_and_fuse(spark):
    n = RT.normalised(hits(spark, [(1, "a", "a", 2.0, 3), (1, "b", "b", 4.0, 2), (1, "c", "c", 6.0, 1), (2, "a", "a", 3.0, 1), (2, "b", "b", 3.0, 2)]))
    assert sorted(pairs(n, "query_id", "norm")) == [(1, 0.0), (1, 0.5), (1, 1.0), (2, 1.0), (2, 1.0)]
    fused = RT.fuse(hits(spark, [(1, "a", "same", 0.9, 1)]), hits(spark, [(1, "z", "same", 5.0, 1)]), 0.7)
    assert pairs(fused, "chunk_id", "score") == [("a", 1.0)]
    fused = RT.fuse(hits(spark, [(1, "a", "k1", 0.9, 1), (1, "b", "k2", 0.1, 2)]), hits(spark, []), 0.7)
    assert sorted(pairs(fused, "chunk_id", "score")) == [("a", 0.7), ("b", 0.0)]


def test_hybrid_context_and_gate(spark):
    texts = ["loyalty campaign cheapest points", "zzz qqq"]
    found = RT.hybrid_retrieve(asked(spark, *texts).drop("k"), chunks(spark), base_k=3)
    out = {r["query_id"]: r for r in RT.relevance_gate(RT.assemble_context(asked(spark, *texts).drop("k"), found, chunks(spark))).collect()}
    assert out[0]["context"].startswith("[playbook] loyalty points") and out[0]["top_score"] == 1.0 and out[0]["response_type"] == "answer"
    assert len(out[0]["sources"]) == found.where("query_id = 0").count()


def brute_topk(q, c, k, usable=None):
    qn, cn = q / np.linalg.norm(q, axis=1, keepdims=True), c / np.linalg.norm(c, axis=1, keepdims=True)
    s = np.round(qn @ cn.T, 6)
    out = {}
    for i in range(len(q)):
        js = [j for j in range(len(c)) if usable is None or usable(i, j)]
        out[i] = sorted(((-s[i, j], j) for j in js))[:k]
    return {(i, j): -v for i, rows in out.items() for v, j in rows}


@pytest.mark.parametrize("block", [4096, 16])
def test_topk_equals_brute_force_with_a_hot_group_of_copies(spark, block):
    """A third of the chunks are copies of one vector; both the scan and the block grid must be exact."""
    rng = np.random.default_rng(5)
    q, c = rng.standard_normal((40, 8)), rng.standard_normal((150, 8))
    c[:50] = q[0]
    group = lambda i: "hot" if i % 3 else "cold"
    left = spark.createDataFrame([(i, v.tolist(), 4, group(i)) for i, v in enumerate(q)], "query_id int, vector array<double>, k int, g string")
    right = spark.createDataFrame([(i, v.tolist(), group(i)) for i, v in enumerate(c)], "chunk_id int, vector array<double>, g string").repartition(5)
    got = {(a, b): s for a, b, s in pairs(similarity.topk(left, right, block=block), "query_id", "chunk_id", "score")}
    assert got == pytest.approx(brute_topk(q, c, 4))
    got = {(a, b): s for a, b, s in pairs(similarity.topk(left, right, on=["g"], block=block), "query_id", "chunk_id", "score")}
    assert got == pytest.approx(brute_topk(q, c, 4, lambda i, j: group(i) == group(j)))


@pytest.mark.parametrize("block", [4096, 8])
def test_topk_with_time_floor_and_self(spark, block):
    rng = np.random.default_rng(6)
    v = rng.standard_normal((60, 4))
    at = rng.integers(0, 500, 60).astype(float)
    rows = spark.createDataFrame([(i, x.tolist(), 1, float(t)) for i, (x, t) in enumerate(zip(v, at))], "query_id int, vector array<double>, k int, at double")
    got = {(a, b): s for a, b, s in pairs(similarity.topk(
        rows, rows.withColumnRenamed("query_id", "chunk_id"), ttl_seconds=100.0, floor=0.5, exclude_self=True, block=block),
        "query_id", "chunk_id", "score")}
    want = brute_topk(v, v, 60, lambda i, j: 0 < at[i] - at[j] < 100)
    best = {}
    for (i, j), s in want.items():
        if s >= 0.5 and (i not in best or (-s, j) < best[i]):
            best[i] = (-s, j)
    assert got == pytest.approx({(i, j): -s for i, (s, j) in best.items()})


def test_cosine_and_dimension(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    assert tuple(df.select(VX.cosine(F.col("a"), F.col("b")), VX.cosine(F.col("a"), F.col("z")), VX.unit(F.col("z"))).first()) == (
        pytest.approx(0.96), 0.0, [0.0, 0.0])
    with pytest.raises(Exception, match="dimension"):
        VX.require_dimension(df, "a", 3).collect()


def test_groundedness_edges(spark):
    rows = [(1, "The revenue grew by ten percent this year.", ""), (2, "", "Some context sentence that is long."), (3, "Short.", ""),
            (4, "The revenue grew by ten percent this year. Bananas orbit purple saxophones quietly.",
             "The revenue grew by ten percent this year, and costs fell."),
            (5, "Numbers 11, 22, 33 appear in this sentence here.", "Entirely other words are written in the context.")]
    got = {r["answer_id"]: r for r in AN.groundedness(spark.createDataFrame(rows, "answer_id int, answer string, context string")).collect()}
    assert (got[1]["score"], got[1]["is_grounded"], got[1]["total"]) == (0.0, False, 1)
    assert (got[2]["score"], got[2]["is_grounded"], got[2]["total"]) == (1.0, True, 0)
    assert (got[3]["is_grounded"], got[3]["total"]) == (True, 0)
    assert (got[4]["score"], got[4]["is_grounded"], got[4]["supported"]) == (0.5, True, 1)
    assert got[5]["unverified_numbers"] == ["11", "22", "33"] and not got[5]["is_grounded"]
    off = {r["answer_id"]: r for r in AN.groundedness(
        spark.createDataFrame(rows, "answer_id int, answer string, context string"), embed=None).collect()}
    assert off[4]["is_grounded"] and not off[4]["checked"] and not off[1]["is_grounded"]


def test_exact_reuse_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, ["Halo ", "halo", "other"][int(rng.integers(0, 3))], int(t)) for i, t in enumerate(rng.integers(0, 20_000, 400))]
    df = spark.createDataFrame(rows, "question_id int, text string, s long").withColumn("asked_at", F.timestamp_seconds("s"))
    got = dict(pairs(AN.exact_reuse(df, ttl=90), "question_id", "reused_age_seconds"))
    for i, text, t in rows:
        ages = [t - u for _, other, u in rows if other.strip().lower() == text.strip().lower() and 0 < t - u < 90]
        assert got[i] == (min(ages) if ages else None)


def test_semantic_reuse_respects_language_and_ttl(spark):
    rows = [(1, [1.0, 0.0], "id", "2024-01-01T00:00:00"), (2, [1.0, 0.01], "id", "2024-01-01T00:30:00"),
            (3, [1.0, 0.0], "en", "2024-01-01T00:31:00"), (4, [1.0, 0.0], "id", "2024-01-01T01:29:00"), (5, [0.0, 1.0], "id", "2024-01-01T01:29:30")]
    df = spark.createDataFrame([(i, v, lang, ts(t)) for i, v, lang, t in rows], "question_id int, vector array<double>, lang string, asked_at timestamp")
    assert dict(pairs(AN.semantic_reuse(df, same=["lang"]), "question_id", "reused_question_id")) == {2: 1, 4: 2}


@pytest.fixture(scope="module")
def sources(spark):
    records = [("k1", " A first long enough text. ", "t"), ("k2", "short", "t"), (None, "A keyless but long enough text.", "t"),
               ("k3", "Another long enough text here.", None), ("k1", "A first long enough text.", "u")]
    return {"ml_insights": (spark.createDataFrame(records, "id string, text string, topic string"), "insight")}


def test_chunks_delta_and_guards(spark, sources):
    desired = CO.build_chunks(sources)
    assert sorted(pairs(desired, "id", "topic")) == [("k1", "u"), ("k3", "")]
    assert pairs(CO.skipped_records(sources), "usable", "skipped") == [(3, 2)]
    existing = desired.where("id = 'k1'").unionByName(desired.limit(1).withColumn("chunk_id", F.lit("gone"))).withColumn(
        "embedding", VX.hashed_embedding(F.col("text")))
    assert tuple(CO.delta_counts(CO.index_delta(desired, existing)).first()) == (1, 1, 1)
    index = CO.apply_delta(desired, existing)
    assert index.count() == 2 and CO.corpus_stats(index).first()["min_dim"] == VX.DIMENSION
    with pytest.raises(RuntimeError):
        CO.apply_delta(desired.where("false"), existing)
    stale = existing.withColumn("chunk_id", F.concat("chunk_id", F.lit("x")))
    with pytest.raises(RuntimeError):
        CO.apply_delta(desired, stale)
    assert CO.apply_delta(desired, stale, force=True).count() == 2


QUESTIONS = [
    ("Ramalan omzet untuk minggu depan?", "entity_prediction"), ("Mengapa pelanggan lama pergi?", "insight"),
    ("Berapa jumlah pesanan tadi pagi?", "raw_fact"), ("halo", "greeting"), ("makasih ya", "gratitude"),
    ("halo, minta angka revenue tadi malam ya", "entity_prediction"), ("ｈａｌｏ", "greeting"), ("forecast revenue per channel", "raw_fact"),
    ("berapa tren booking", "exploratory"),
]


def test_intents(spark):
    df = spark.createDataFrame([(t,) for t, _ in QUESTIONS], "text string")
    assert dict(pairs(Q.tag(df), "text", "intent")) == dict(QUESTIONS)


def test_language(spark):
    assert lit(spark, "Berapa omzet untuk pekan ini?", Q.language) == "id"
    assert lit(spark, "How is the revenue", Q.language) == "en"
    assert lit(spark, "danau apartemen", Q.language) == "en"


@pytest.mark.parametrize("text,span", [
    ("revenue 2023", (date(2023, 1, 1), date(2023, 12, 31))), ("revenue maret 2023", (date(2023, 3, 1), date(2023, 3, 31))),
    ("januari sampai april 2024", (date(2024, 1, 1), date(2024, 4, 30))), ("february 2024", (date(2024, 2, 1), date(2024, 2, 29))),
    ("february 2100", None), ("maret 2021 dan 2023", (date(2021, 1, 1), date(2023, 12, 31))), ("maret", None), ("12023", None)])
def test_periods(spark, text, span):
    row = Q.extract_period(spark.createDataFrame([(text,)], "text string")).first()
    if text.endswith("2100"):
        span = None
    assert (row["start_date"], row["end_date"]) == (span or (None, None))


def test_known_dates_are_kept(spark):
    df = spark.createDataFrame([("revenue 2023", date(2020, 1, 1), date(2020, 2, 1)), ("revenue 2023", date(2020, 1, 1), None)],
                               "text string, start_date date, end_date date")
    assert pairs(Q.extract_period(df), "start_date") == [(date(2020, 1, 1),), (date(2023, 1, 1),)]


@pytest.mark.parametrize("text,n", [("top 7 kota", 7), ("3 terbaik", 3), ("top 99", 25), ("top 0", 1), ("terbaik", 5), ("laptop 8", 5)])
def test_top_n(spark, text, n):
    assert lit(spark, text, Q.top_n) == n


def test_metric_and_topic_tags(spark):
    assert lit(spark, "diskon, kanal, agen dan kota", Q.metrics) == ["revenue_by_channel", "agent_performance", "discount_impact"]
    assert lit(spark, "pelanggan terbaik", Q.topic) == "customer_top"
    assert lit(spark, "nothing here", Q.topic) is None
    assert lit(spark, "x", lambda c: Q.related_topics(F.lit("revenue_trend"))) == ["revenue_destination", "revenue_channel", "revenue_segment"]


def test_name_mentions_equal_brute_force(spark):
    names = ["Andi Wijaya", "Andika Putra", "Budi Andi", "Siti", "Al Amin Rashid", "Alan"]
    people = spark.createDataFrame([(i, names[i % len(names)]) for i in range(60)], "customer_id int, name string")
    asks = [(0, "apakah pelanggan bernama Andi akan churn"), (1, "customer Siti risiko"), (2, "nama Al Amin"), (3, "pelanggan andi"), (4, "customer Andi Wijaya x")]
    got = {}
    for q, c in pairs(Q.name_mentions(spark.createDataFrame(asks, "question_id int, text string"), people), "question_id", "customer_id"):
        got.setdefault(q, []).append(c)
    mention = {0: "andi", 1: "siti", 2: "al amin", 4: "andi wijaya"}
    want = {q: [i for i in range(60) if m in names[i % len(names)].lower()][:10] for q, m in mention.items()}
    assert {q: sorted(v) for q, v in got.items()} == want


@pytest.mark.parametrize("bytes_, rows", [(2_000_000, 200_000), (40, 9)])
def test_mentions_inside_names_equal_brute_force(spark, monkeypatch, bytes_, rows):
    """Mentions inside one another, overlapping, of one name a third of all ids; blocks and parts of any number."""
    monkeypatch.setattr(Q, "MENTION_BYTES", bytes_)
    monkeypatch.setattr(Q, "NAME_ROWS", rows)
    rng = np.random.default_rng(2)
    names = sorted({"".join(rng.choice(list("abé "), int(rng.integers(1, 12)))) for _ in range(60)})
    ids = {n: sorted(rng.choice(10_000, 300 if i == 3 else 4, replace=False).tolist())[:50] for i, n in enumerate(names)}
    mentions = sorted({"".join(rng.choice(list("abé "), int(rng.integers(1, 5)))) for _ in range(40)})
    got = {}
    for m, c in pairs(Q.containing(spark.createDataFrame([(m,) for m in mentions], "mention string"), spark.createDataFrame(list(ids.items()), "lowered string, ids array<long>"), "customer_id", 10), "mention", "customer_id"):
        got.setdefault(m, []).append(c)
    for m in mentions:
        want = sorted(i for n in names if m in n for i in ids[n])[:10]
        assert sorted(got.get(m, []))[:10] == want
    assert Q.containing(spark.createDataFrame([], "mention string"), spark.createDataFrame([], "lowered string, ids array<long>"), "customer_id", 10).count() == 0


def test_bm25_join_path_equals_scan_path(spark):
    args = (asked(spark, "revenue second quarter the", "campaign points"), chunks(spark))
    key = lambda df: sorted(pairs(df, "query_id", "chunk_id", "score", "rank"))
    assert key(RT.bm25_topk(*args)) == key(RT.bm25_topk(*args, max_terms=1))


def test_grid_accepts_two_sides_of_one_table(spark):
    rng = np.random.default_rng(9)
    base = spark.createDataFrame([(i, v.tolist(), i % 7) for i, v in enumerate(rng.standard_normal((50, 4)))], "id int, vector array<double>, g int")
    left = base.select(F.col("id").alias("query_id"), "vector", F.lit(2).alias("k"), "g")
    right = base.select(F.col("id").alias("chunk_id"), "vector", "g")
    key = lambda df: sorted(pairs(df, "query_id", "chunk_id", "score"))
    assert key(similarity.topk(left, right, on=["g"], block=4)) == key(similarity.topk(left, right, on=["g"]))


def test_null_keys_meet_on_both_paths_of_topk(spark):
    rows = [(1, [1.0, 0.0], None), (2, [0.9, 0.1], None), (3, [1.0, 0.0], "en"), (4, [0.0, 1.0], "en")]
    chunks = spark.createDataFrame(rows, "chunk_id int, vector array<double>, language string")
    queries = chunks.select(F.col("chunk_id").alias("query_id"), "vector", F.lit(3).alias("k"), "language")
    one, other = (sorted(map(tuple, similarity.topk(queries, chunks, on=["language"], block=b).collect())) for b in (4096, 1))
    assert one == other and [(q, c) for q, c, *_ in one if q == 1] == [(1, 1), (1, 2)]


def test_bm25_paths_agree_on_null_and_empty_texts(spark):
    chunks = spark.createDataFrame([(1, "red house"), (2, None), (3, ""), (4, "red red green"), (5, "red house")], "chunk_id int, text string")
    asked = spark.createDataFrame([(1, "red house", 5), (2, None, 5), (3, "", 5)], "query_id int, text string, k int")
    scan, join = (sorted(map(tuple, RT.bm25_topk(asked, chunks, max_terms=n).collect())) for n in (1000, 0))
    assert scan == join and len(scan) == 3


def test_greetings_have_no_length_cap(spark):
    texts = ["halo ! ! ! ! ! ! ! !", "hi \U0001f600 \U0001f600 \U0001f600 \U0001f600 \U0001f600 \U0001f600 \U0001f600 \U0001f600", "hi one two three", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(Q.is_greeting(F.col("text"))).collect()] == [True, True, False, False]


def test_scores_of_a_cell_are_made_in_tiles():
    """Whatever meets in a task, only a tile of scores is held (before: all pairs of both blocks, twice)."""
    import tracemalloc

    rng = np.random.default_rng(8)
    m = rng.standard_normal((similarity.BLOCK, 8))
    rows = pd.DataFrame({"query_id": range(len(m)), "vector": list(m), "k": 5})
    work = similarity._Scan(rows, [], None, None, True)
    tracemalloc.start()
    work.add(rows.rename(columns={"query_id": "chunk_id"}))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    got = work.leaders.frame()
    assert len(got) == 5 * len(m)
    want = brute_topk(m[:50], m, 6)
    assert {(q, c): s for q, c, s, _ in got.head(250).itertuples(index=False)} == pytest.approx({(i, j): s for (i, j), s in want.items() if i != j})


def test_long_cells_only_for_many_blocks():
    assert [similarity._cuts(n, 10) for n in (0, 1, 10, 11, 160, 161, 1000)] == [1, 1, 1, 2, 16, 5, 25]


def test_memory_of_embeddings_follows_a_slice_not_the_batch():
    """A batch of many long texts, and one of many sentences (before: all counts, and all numbers as Python objects, at once)."""
    import tracemalloc

    import pyarrow as pa

    def peak(work):
        tracemalloc.start()
        out = work()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, most

    words = pa.array(["a", "b", "c", "d"]).take(pa.array(np.arange(6_000_000) % 4))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 6_000_001, 2000, dtype=np.int32)), words)
    out, most = peak(lambda: VX._hashed_counts.func(lists))
    assert most < 60e6
    small = VX._hashed_counts.func(pa.array([["a", "b", "c", "d"] * 500]))
    assert np.allclose(out.flatten().to_numpy().reshape(3000, -1), small.flatten().to_numpy())
    rng = np.random.default_rng(4)
    m = pa.array(rng.standard_normal(4000 * 8 * 64))
    inner = pa.ListArray.from_arrays(pa.array(np.arange(0, 4000 * 8 * 64 + 1, 64, dtype=np.int32)), m)
    said = pa.ListArray.from_arrays(pa.array(np.arange(0, 32001, 8, dtype=np.int32)), inner)
    best, most = peak(lambda: AN._best_matches.func(said, said))
    assert most < 30e6 and best.to_pylist() == [[1.0] * 8] * 4000
    assert AN._best_matches.func(pa.array([[], [[1.0, 0.0]], [[0.0, 0.0]]], said.type), pa.array([[[1.0, 0.0]], [], [[1.0, 1.0]]], said.type)).to_pylist() == [[], [], [0.0]]


def test_runs_hold_whole_rows():
    assert list(VX._runs(np.cumsum([3, 3, 9, 0, 1]), 6)) == [(0, 2), (2, 3), (3, 5)] and not list(VX._runs(np.empty(0, int), 6))


def test_token_lists_reach_python_in_small_batches(spark):
    """What a worker holds follows its batch, so rows that carry whole texts come 1,000 at once, unless the user set another number."""
    import pyarrow as pa

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    @F.arrow_udf("long")
    def size(v: pa.Array) -> pa.Array:
        return pa.array([len(v)] * len(v), pa.int64())

    largest = lambda: spark.range(0, 5000, 1, 1).select(size("id").alias("n")).agg(F.max("n")).first()[0]
    try:
        for given, want in (("10000", 1000), ("3000", 3000)):
            spark.conf.set(name, given)
            VX.hashed_embedding(F.col("text"))
            assert largest() == want
    finally:
        spark.conf.set(name, before)


def test_batches_are_small_in_the_session_of_the_data(spark):
    """The setting must reach the session whose rows are embedded, which need not be the active one."""
    import pyarrow as pa
    from tidemark.plans.all_queries import QUERIES

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"

    @F.arrow_udf("array<double>")
    def size(v: pa.Array) -> pa.Array:
        return pa.array([[float(len(v))]] * len(v), pa.list_(pa.float64()))

    own = spark.newSession()
    text = F.concat(F.lit("A long enough text of number "), F.col("id").cast("string"))
    desired = CO.build_chunks({"ml_insights": (own.range(8000).select("id", text.alias("text")), "insight")})
    index = CO.apply_delta(desired, desired.where("false"), embed=size)
    assert index.agg(F.max(F.element_at("embedding", 1))).first()[0] <= 1000 and index.count() == 8000
    for query in ("corpus_stats", "apply_index_delta", "question_dedup_semantic", "groundedness"):
        own = spark.newSession()
        QUERIES[query](own, SF)
        assert own.conf.get(name) == "1000", query
    own = spark.newSession()
    own.conf.set(name, "3000")
    QUERIES["corpus_stats"](own, SF)
    assert own.conf.get(name) == "3000"
