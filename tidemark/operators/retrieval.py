"""Dense, BM25 and hybrid retrieval for a whole table of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import similarity
from tidemark.functions.text import KEY_LENGTH, PREVIEW_LENGTH, adaptive_k, tokens
from tidemark.functions.vectors import hashed_embedding
from tidemark.operators import sparse_index, vector_index
from tidemark.plans.session import broadcast_if_small, cut_lineage, small_enough, text_batches

# Fixed values of the ranking.
BASE_K = 8
ALPHA = 0.5
MIN_RELEVANCE = 0.35


def matching(chunks: DataFrame, where: dict[str, object] | None) -> DataFrame:
    """Chunks whose metadata equals every given value; applied before any scoring."""
    for name, value in (where or {}).items():
        chunks = chunks.where(F.col(name) == value)
    return chunks


def dense_topk(questions: DataFrame, chunks: DataFrame, where: dict[str, object] | None = None,
               exclude_self: bool = False) -> DataFrame:
    """questions: query_id, vector, k; chunks: chunk_id, vector, metadata."""
    return similarity.topk(questions, matching(chunks, where), exclude_self=exclude_self)


def dense_topk_approx(questions: DataFrame, chunks: DataFrame, where: dict[str, object] | None = None, probes: int = 32, rescored: int = 25,
                      exclude_self: bool = False) -> DataFrame:
    """Approximate form of `dense_topk`, as (query_id, chunk_id, score, rank): see `vector_index`, which also keeps an index."""
    return vector_index.search(vector_index.build(matching(chunks, where)), questions, probes, rescored, exclude_self)


def bm25_topk(questions: DataFrame, chunks: DataFrame, where: dict[str, object] | None = None,
              max_terms: int = sparse_index.MAX_SENT_TERMS) -> DataFrame:
    """The k best chunks per question with a positive score; see `sparse_index`, which also keeps an index.

    A metadata filter restricts the result, not the corpus statistics.  The corpus is read once; when the question terms
    are few (measured) only they are indexed.
    """
    terms = cut_lineage(sparse_index.query_terms(questions))
    rows = _spread(chunks).select("chunk_id", _usable(where).alias("usable"), tokens(F.col("text")).alias("t"))
    return sparse_index.search(sparse_index.build(rows, _few_terms(terms, max_terms)), terms, max_terms)


def _spread(chunks: DataFrame) -> DataFrame:
    """A small corpus (measured) often is one file that only one task can read: deal its rows out before the work on texts."""
    return chunks.repartition(chunks.sparkSession.sparkContext.defaultParallelism) if small_enough(chunks) else chunks


def _usable(where: dict[str, object] | None) -> Column:
    """Do the metadata of a chunk equal every given value?"""
    out = F.lit(True)
    for name, value in (where or {}).items():
        out = out & F.coalesce(F.col(name) == value, F.lit(False))
    return out


def _few_terms(terms: DataFrame, most: int) -> list[str] | None:
    """The distinct terms, if there are at most so many."""
    head = terms.select("term").distinct().limit(most + 1).toPandas()["term"]
    return sorted(head) if len(head) <= most else None


def normalised(hits: DataFrame) -> DataFrame:
    """Min-max scores per question; equal scores all become 1."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    spread = high - low
    return hits.withColumn("norm", F.when(spread < 1e-9, 1.0).otherwise((F.col("score") - low) / spread))


def fuse(dense: DataFrame, sparse: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Weighted sum of both lists, matched on the text key; the dense copy of a chunk is kept.

    Inputs have query_id, chunk_id, key, score, rank.  Within the dense list the
    last copy of a key speaks for it, within the sparse list copies add up.
    """
    d = normalised(dense).groupBy("query_id", "key").agg(
        F.max_by(F.struct("chunk_id", "norm"), "rank").alias("d"))
    s = normalised(sparse).groupBy("query_id", "key").agg(
        F.sum(F.col("norm").cast("decimal(20,12)")).cast("double").alias("s"), F.min_by("chunk_id", "rank").alias("s_chunk"))
    total = alpha * F.coalesce("d.norm", F.lit(0.0)) + (1 - alpha) * F.coalesce("s", F.lit(0.0))
    return d.join(s, ["query_id", "key"], "full_outer").select(
        "query_id", F.coalesce("d.chunk_id", "s_chunk").alias("chunk_id"), F.round(total, 6).alias("score"))


def hybrid_retrieve(questions: DataFrame, chunks: DataFrame, where: dict[str, object] | None = None, base_k: int = BASE_K,
                    alpha: float = ALPHA, hybrid: bool = True, adaptive: bool = True,
                    embed: Callable[[Column], Column] = hashed_embedding) -> DataFrame:
    """(query_id, chunk_id, score, rank) for questions (query_id, text) over chunks (chunk_id, text[, vector])."""
    text_batches(chunks.sparkSession)
    k = adaptive_k(F.col("text"), base_k) if adaptive else F.lit(base_k)
    asked = questions.select("query_id", "text", k.alias("k"))
    vector = F.col("vector") if "vector" in chunks.columns else embed(F.col("text"))
    asking = asked.withColumn("vector", embed(F.col("text")))
    if not hybrid:
        return dense_topk(asking, chunks.withColumn("vector", vector), where)
    # One pass over the corpus: the index carries what both sides and the fusion need of a chunk.
    terms = cut_lineage(sparse_index.query_terms(asked))
    rows = _spread(chunks).select("chunk_id", _usable(where).alias("usable"), F.substring("text", 1, KEY_LENGTH).alias("key"), vector.alias("vector"), tokens(F.col("text")).alias("t"))
    index = sparse_index.build(rows, _few_terms(terms, sparse_index.MAX_SENT_TERMS))
    carried = sparse_index.described(index)
    dense = dense_topk(asking, carried.where("usable"))
    sparse = sparse_index.search(index, terms)
    keys = carried.select("chunk_id", "key")
    found = dense.withColumn("side", F.lit("d")).unionByName(sparse.withColumn("side", F.lit("s")))
    # k rows per question and side, read several times below: written once.
    found = keys.join(broadcast_if_small(cut_lineage(found)), "chunk_id")
    fused = fuse(found.where("side = 'd'").drop("side"), found.where("side = 's'").drop("side"), alpha)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return (
        fused.join(asked.select("query_id", "k"), "query_id")
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("k")).drop("k"))


def assemble_context(questions: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Context text, sources and top score per question; at most k chunks per question are gathered."""
    tagged = hits.join(chunks.select("chunk_id", "text", "topic", "source_type"), "chunk_id").select(
        "query_id", F.struct(
            "rank", F.concat(F.lit("["), F.coalesce("source_type", F.lit("insight")), F.lit("] "), "text").alias("line"),
            F.col("chunk_id").cast("string").alias("id"), F.coalesce("topic", F.lit("")).alias("topic"),
            F.coalesce("source_type", F.lit("insight")).alias("source_type"), F.round("score", 4).alias("score"),
            F.substring("text", 1, PREVIEW_LENGTH).alias("text")).alias("h"))
    grouped = tagged.groupBy("query_id").agg(F.sort_array(F.collect_list("h")).alias("h"))
    lines = F.transform("h", lambda x: x["line"])
    sources = F.transform("h", lambda x: F.struct(x["id"].alias("id"), x["topic"].alias("topic"),
                                                  x["source_type"].alias("source_type"), x["score"].alias("score"),
                                                  x["text"].alias("text")))
    return questions.join(grouped, "query_id", "left").select(
        "query_id", F.col("text"), F.coalesce(F.array_join(lines, "\n\n"), F.lit("")).alias("context"),
        sources.alias("sources"),
        F.coalesce(F.get(F.transform("h", lambda x: x["score"]), F.lit(0)), F.lit(0.0)).alias("top_score"))


def relevance_gate(assembled: DataFrame, threshold: float = MIN_RELEVANCE) -> DataFrame:
    """not_found when nothing was retrieved or the best score is below the threshold."""
    missing = (F.col("context") == "") | (F.col("top_score") < threshold)
    return assembled.withColumn("response_type", F.when(missing, "not_found").otherwise("answer"))
