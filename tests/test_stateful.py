import random
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.helpers import pairs, ts
from tidemark.plans import all_queries
from tidemark.streaming import events as E
from tidemark.streaming import jobs as J
from tidemark.streaming import stateful as ST

START = ts("2024-01-01")


def files(spark, rows, schema, folder, parts):
    """A stream over one file a micro-batch, in their order."""
    for i, part in enumerate(parts):
        spark.createDataFrame([rows[k] for k in part], schema).coalesce(1).write.parquet(f"{folder}/in/f{i}")
    return spark.readStream.schema(schema.replace("ntz", "")).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def plain_sessions(rows, gap):
    out = {}
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        mine = out.setdefault(k, [])
        if mine and t < mine[-1][1]:
            mine[-1][1:] = [t + gap, mine[-1][2] + 1]
        else:
            mine.append([t, t + gap, 1])
    return sorted(((k, *s) for k, v in out.items() for s in v), key=repr)


def test_sessions_are_sent_out_once_and_closed(spark, tmp_path):
    """Batches out of order within the delay, a batch that joins two sessions, a hot key, a null key; nothing stays open."""
    r = random.Random(3)
    gap = timedelta(minutes=30)
    rows = [(r.choice([1, 1, 1, 2, None]), START + timedelta(minutes=r.randrange(0, 4000))) for _ in range(300)]
    rows += [(7, START + timedelta(minutes=m)) for m in (0, 25, 50)] + [(8, START), (8, START + gap), (9, None)]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][1] or START) + timedelta(minutes=r.randrange(0, 300)))
    order.remove(301)  # the row that joins two sessions comes last of its time
    parts = [order[:100], order[100:200], [*order[200:], 301]]
    stream = files(spark, rows, "user long, at timestamp", tmp_path, parts)
    got = J.drain_closed(stream, lambda e: ST.closed_sessions(e, "user", "at", "30 minutes", "5000 minutes"), "at", str(tmp_path / "job"))
    shown = [(x["user"], x["session_start"], x["session_end"], x["events"]) for x in got.collect()]
    assert sorted(shown, key=repr) == plain_sessions([x for x in rows if x[1]], gap)
    state = spark.read.format("statestore").option("stateVarName", "open").load(str(tmp_path / "job" / "checkpoint"))
    assert state.where("key.user IS NOT NULL").count() == 0  # only the row that flushes is left


@pytest.mark.parametrize("streamed", [True, False])
def test_session_windows_are_the_same_sessions(spark, tmp_path, streamed):
    """As above, by session windows: events at the very end of a session, or a microsecond before; large keys beside a null one."""
    r = random.Random(4)
    gap, near, big = timedelta(minutes=30), timedelta(microseconds=1), 2**60
    rows = [(r.choice([1, 1, 1, 2, None, big, big + 1]), START + timedelta(minutes=r.randrange(0, 4000))) for _ in range(300)]
    rows += [(7, START + timedelta(minutes=m)) for m in (0, 25, 50)] + [(8, START), (8, START + gap), (8, START + 2 * gap - near), (9, None)]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][1] or START) + timedelta(minutes=r.randrange(0, 300)))
    if streamed:
        stream = files(spark, rows, "user long, at timestamp", tmp_path, [order[:100], order[100:200], order[200:]])
        got = J.drain_closed(stream, lambda e: E.sessions(e, "user", "at", "30 minutes", "5000 minutes"), "at", str(tmp_path / "job"))
        state = spark.read.format("statestore").load(str(tmp_path / "job" / "checkpoint"))
        assert state.count() == 1  # only the row that flushes is left
    else:
        got = E.sessions(spark.createDataFrame(rows, "user long, at timestamp"), "user", "at", "30 minutes")
    shown = [(x["user"], x["session_start"], x["session_end"], x["events"]) for x in got.collect()]
    assert sorted(shown, key=repr) == plain_sessions([x for x in rows if x[1]], gap)


def test_sessions_of_the_query_need_no_python(spark, tmp_path, monkeypatch):
    """Calls into Python for each key and event took most of the time of a large table."""
    monkeypatch.setattr(J, "shared_folder", lambda spark: str(tmp_path / "job"))
    assert all_queries.QUERIES["stream_sessions"](spark, SF).count() > 0
    operators = {x["operatorName"] for x in spark.read.format("state-metadata").load(str(tmp_path / "job" / "checkpoint")).collect()}
    assert operators and not any("Python" in x or "PySpark" in x or "Pandas" in x for x in operators)


def test_merging_of_spans():
    assert ST.merged([(0, 10, 2), (20, 30, 1)], np.array([9]), 12) == [(0, 30, 4)]
    assert ST.merged([], np.array([10, 0, 20]), 10) == [(0, 10, 1), (10, 20, 1), (20, 30, 1)]


@pytest.mark.parametrize("parts", [1, 4])
def test_questions_return_after_their_ttl(spark, tmp_path, parts):
    r = random.Random(parts)
    texts = ["Halo", " halo ", "apa kabar?", None, "terima kasih"]
    rows = sorted(((i, r.choice(texts), START + timedelta(minutes=r.randrange(0, 2000))) for i in range(200)), key=lambda x: (x[2], x[0]))
    rows += [(900, "Halo", None)]
    step = -(-len(rows) // parts)
    stream = files(spark, rows, "id long, text string, asked_at timestamp", tmp_path, [range(a, min(len(rows), a + step)) for a in range(0, len(rows), step)])
    got = J.drain(ST.first_questions(stream, "id", ttl="3 hours", delay="2000 minutes"), folder=str(tmp_path / "job"))
    last, want = {}, []
    for i, text, at in rows[:-1]:
        key = (text or "").strip().lower() if text is not None else None
        if key not in last or at - last[key] >= timedelta(hours=3):
            last[key] = at
            want.append(i)
    assert sorted(x[0] for x in pairs(got, "id")) == sorted(want) and len(want) > 20


def test_late_and_earlier_questions(spark, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    rows = [(1, "x", at(600)), (2, "x", at(500)), (3, "x", at(100)), (4, "x", at(659)), (5, "x", at(660))]
    stream = files(spark, rows, "id long, text string, asked_at timestamp", tmp_path, [[0], [1, 2], [3, 4]])
    got = J.drain(ST.first_questions(stream, "id", ttl="1 hour", delay="1 day"), folder=str(tmp_path / "job"))
    assert sorted(x[0] for x in pairs(got, "id")) == [1, 2, 3, 5]
    assert got.where(F.col("query_key").isNull()).count() == 0


@pytest.mark.parametrize("parts", [None, 3])
def test_a_table_is_one_file_or_a_folder_of_files(spark, tmp_path, parts):
    """Tables of several files lie in a folder that is named like the file; all of its files are read."""
    rows = spark.range(100).repartition(parts or 1)
    rows.write.parquet(str(tmp_path / "in" / ("t.parquet" if parts else "one")))
    if parts is None:
        next((tmp_path / "in" / "one").glob("part-*.parquet")).rename(tmp_path / "in" / "t.parquet")
    spark.range(7).write.parquet(str(tmp_path / "in" / "other.parquet"))
    got = J.drain(J.read_stream(spark, str(tmp_path / "in"), "t", 1), folder=str(tmp_path / "job"))
    assert sorted(x[0] for x in pairs(got, "id")) == list(range(100))
