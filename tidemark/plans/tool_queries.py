"""Queries of the small tools: exports, record files, run logs, guards, identifiers and isolated runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import semantics as S
from tidemark.operators import churn as H
from tidemark.operators import corpus as CO
from tidemark.plans import catalog
from tidemark.plans.registry import query
from tidemark.plans.text_queries import _desired, _DOCS, _BENCH
from tidemark.sources import driver_tables as T
from tidemark.sources import readers, sinks
from tidemark.sources.driver_tables import oracle
from tidemark.streaming.jobs import shared_folder


@query("read_export", """SELECT o_orderkey AS _id, CAST(o_orderkey AS VARCHAR) AS order_id, o_orderstatus AS state_code,
  o_custkey AS buyer_id, o_totalprice AS buyer_spent FROM orders""")
def _export(spark, sf):
    """Orders written as a JSON export with wrapped ids and nested objects, and read back flat."""
    folder = f"{shared_folder(spark)}/export"
    orders = T.read(spark, sf, "orders")
    wrapped = orders.select(
        F.struct(F.col("o_orderkey").cast("string").alias("$numberLong")).alias("_id"),
        F.struct(F.col("o_orderkey").cast("string").alias("$oid")).alias("order_id"),
        F.struct(F.col("o_orderstatus").alias("code")).alias("state"),
        F.struct(F.struct(F.col("o_custkey").cast("string").alias("$numberInt")).alias("id"), F.col("o_totalprice").alias("spent")).alias("buyer"))
    wrapped.write.json(folder)
    flat = readers.read_export(spark, folder, wrapped.schema)
    return flat.select(F.col("_id").cast("long").alias("_id"), "order_id", "state_code", F.col("buyer_id").cast("long").alias("buyer_id"), "buyer_spent")


@query("load_records", "SELECT item_id, text, TIMESTAMP '2024-01-01' AS updated_at FROM benchmark WHERE text <> ''")
def _records(spark, sf):
    """Benchmark items as a record file with required fields."""
    folder = f"{shared_folder(spark)}/records"
    items = T.read(spark, sf, "benchmark").where("text <> ''").select("item_id", "text")
    items.write.json(folder)
    rows = readers.load_records(spark, folder, items.schema, ["item_id", "text"], "2024-01-01", lines=True)
    return rows.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


@query("run_log", """SELECT 'revenue' AS job, count(*) AS rows_used, 1 AS times FROM orders
  UNION ALL SELECT 'reviews', count(*), 1 FROM events""")
def _run_log(spark, sf):
    """Two runs appended to a log, the second delivered twice under one tag."""
    base = f"{shared_folder(spark)}/runs"
    record = lambda job, table, tag: T.read(spark, sf, table).agg(F.count("*").alias("rows_used")).select(F.lit(job).alias("job"), "rows_used", F.lit(tag).alias("tag"))
    log = sinks.saved(record("revenue", "orders", "run-1"), base)
    for _ in range(2):
        log = sinks.saved(sinks.appended(log, record("reviews", "events", "run-2")), base)
    return log.groupBy("job", "rows_used").agg(F.count("*").cast("int").alias("times"))


query("object_ids", """SELECT doc_id, CASE WHEN regexp_matches(x, '^[0-9a-fA-F]{24}$') THEN lower(x) END AS oid FROM (
  SELECT doc_id, upper(substr(md5(text), 1, CAST(20 + doc_id % 8 AS INT))) AS x FROM documents)""")(
    lambda spark, sf: T.read(spark, sf, "documents").select(
        "doc_id", F.expr("upper(substr(md5(text), 1, cast(20 + doc_id % 8 as int)))").alias("x")).select("doc_id", S.object_id(F.col("x")).alias("oid")))

query("clean_inputs", """SELECT doc_id, nullif(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '') AS cleaned FROM documents""")(
    lambda spark, sf: T.read(spark, sf, "documents").select(
        # A bell and an escape sign are put into every text; both have to go.
        "doc_id", S.clean_input(F.concat(F.lit("\x07 "), "text", F.lit(" \x1b"))).alias("cleaned")))

query("period_labels", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS monthly, strftime(o_orderdate, '%Y-%m-%d') AS daily FROM orders""")(
    lambda spark, sf: T.read(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")).select(
        "o_orderkey", *[S.trimmed_period_label(F.col("d"), g).alias(g) for g in ("monthly", "daily")]))

# Every third review says nothing about the sentiment: the skip rule takes the latest that does.
query("latest_known_review", oracle("reviews", """
  SELECT customer_id, arg_max(rating, (review_date, review_id)) AS review_rating,
    arg_max(sentiment, (review_date, review_id)) FILTER (review_id % 3 <> 0) AS review_sentiment FROM reviews GROUP BY 1"""))(
    lambda spark, sf: H.review_features(
        T.reviews(spark, sf).withColumn("sentiment", F.when(F.col("review_id") % 3 != 0, F.col("sentiment"))), "2030-01-01", "skip").select(
        "customer_id", "review_rating", "review_sentiment"))


@query("index_guard", oracle("", f"""
  SELECT kept AS source, CAST(0 AS BIGINT) AS added, CAST(n - k AS BIGINT) AS deleted, CAST(k AS BIGINT) AS unchanged,
    CASE WHEN k = 0 THEN 'empty source' WHEN (n - k) / n > 0.5 THEN 'mass delete' ELSE 'apply' END AS decision
  FROM (SELECT count(*) AS n, count(*) FILTER (source_collection = 'business_knowledge') AS few, count(*) FILTER (source_collection = 'ml_insights') AS many FROM desired),
    LATERAL (SELECT unnest(['none', 'few', 'many']) AS kept, unnest([0, few, many]) AS k)""", desired=f"{_DOCS} UNION ALL {_BENCH}"))
def _guard(spark, sf):
    """What the guard says when all, most or few chunks of an index vanish from the sources."""
    index = _desired(spark, sf)
    parts = {"none": index.where("false"), "few": index.where("source_collection = 'business_knowledge'"), "many": index.where("source_collection = 'ml_insights'")}
    out = None
    for name, part in parts.items():
        row = CO.guard_decision(CO.index_delta(part, index)).select(F.lit(name).alias("source"), "added", "deleted", "unchanged", "decision")
        out = row if out is None else out.unionByName(row)
    return out


@query("isolated_runs", oracle("bookings", """
  SELECT 'booking_status_summary' AS id, count(DISTINCT status) AS found, CAST(NULL AS VARCHAR) AS error FROM bookings
  UNION ALL SELECT 'unknown', NULL, 'KeyError' UNION ALL SELECT 'customer_search', NULL, 'TypeError'
  UNION ALL SELECT 'package_type_summary', NULL, 'KeyError'"""))
def _isolated(spark, sf):
    """Several entries run apart: one works, one is unknown, one lacks an argument, one lacks its table."""
    wanted = ["booking_status_summary", "unknown", "customer_search", "package_type_summary"]
    rows = []
    for outcome in catalog.run_selected(wanted, {"bookings": T.bookings(spark, sf)}, start="1900-01-01", end="2100-01-01"):
        found, error = outcome.act(lambda plan: plan.count())
        rows.append((outcome.id, found, type(error).__name__ if error else None))
    return spark.createDataFrame(rows, "id string, found long, error string")
