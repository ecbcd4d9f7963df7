"""Corpus, retrieval, answer-check and question-tag queries over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import keywords as K
from tidemark.functions import text as TX
from tidemark.functions.vectors import cosine, embedded, require_dimension, unit
from tidemark.operators import answers as AN
from tidemark.operators import corpus as CO
from tidemark.operators import questions as Q
from tidemark.operators import retrieval as RT
from tidemark.operators import vector_index
from tidemark.plans.registry import query
from tidemark.plans.session import cut_lineage
from tidemark.sources import driver_tables as T
from tidemark.sources import sinks
from tidemark.sources.driver_tables import oracle

DAY = 86_400

# ---- corpus ---------------------------------------------------------------


def _sources(spark, sf):
    docs = T.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("topic"))
    bench = T.read(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return {"ml_insights": (docs, "insight"), "business_knowledge": (bench, "playbook")}


def _desired(spark, sf):
    return CO.build_chunks(_sources(spark, sf))


def _existing(spark, sf):
    """An index built before the documents labelled toxic were edited."""
    edited = T.read(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"), F.lit(" (old)").alias("mark"))
    docs = _sources(spark, sf)["ml_insights"][0].join(edited, "id", "left").select(
        "id", F.concat("text", F.coalesce("mark", F.lit(""))).alias("text"), "topic")
    return embedded(CO.build_chunks({"ml_insights": (docs, "insight")}))


_STRIP = r"regexp_replace({t}, '^\s+|\s+$', '', 'g')"
_CHUNK = ("SELECT DISTINCT sha1('{c}:' || id || '::' || txt) AS chunk_id, txt AS text, CAST(id AS VARCHAR) AS id, {topic} AS topic, "
          "'{kind}' AS source_type, '{c}' AS source_collection, '' AS updated_at FROM (SELECT {id} AS id, "
          + _STRIP + " AS txt, * FROM {src}) s WHERE length(txt) >= 20")
_DOCS = _CHUNK.format(c="ml_insights", topic="lang", kind="insight", id="doc_id", t="text", src="documents")
_BENCH = _CHUNK.format(c="business_knowledge", topic="''", kind="playbook", id="item_id", t="text", src="benchmark")
_OLD = _CHUNK.format(c="ml_insights", topic="lang", kind="insight", id="doc_id", t="text",
                     src="(SELECT d.doc_id, d.lang, d.text || CASE WHEN toxic = 1 THEN ' (old)' ELSE '' END AS text "
                         "FROM documents d LEFT JOIN labels USING (doc_id)) q")
_DELTA = """SELECT coalesce(d.chunk_id, e.chunk_id) AS chunk_id, CASE WHEN e.chunk_id IS NULL THEN 'add'
  WHEN d.chunk_id IS NULL THEN 'delete' ELSE 'keep' END AS action
  FROM desired d FULL JOIN existing e ON d.chunk_id = e.chunk_id"""
_PAIR = {"desired": f"{_DOCS} UNION ALL {_BENCH}", "existing": _OLD}

query("build_chunks", oracle("", f"{_DOCS} UNION ALL {_BENCH}"))(_desired)
query("skipped_records", oracle("", " UNION ALL ".join(
    f"SELECT '{c}' AS source_collection, count(*) FILTER (length({_STRIP.format(t='text')}) >= 20) AS usable, "
    f"count(*) FILTER (length({_STRIP.format(t='text')}) < 20) AS skipped FROM {t}"
    for c, t in (("ml_insights", "documents"), ("business_knowledge", "benchmark")))))(
    lambda spark, sf: CO.skipped_records(_sources(spark, sf)))
query("index_delta", oracle("", _DELTA, **_PAIR))(
    lambda spark, sf: CO.index_delta(_desired(spark, sf), _existing(spark, sf)))
query("index_delta_counts", oracle("", f"""SELECT count(*) FILTER (action = 'add') AS added,
  count(*) FILTER (action = 'delete') AS deleted, count(*) FILTER (action = 'keep') AS unchanged FROM ({_DELTA})""", **_PAIR))(
    lambda spark, sf: CO.delta_counts(CO.index_delta(_desired(spark, sf), _existing(spark, sf))))
def slots(source: str, ident: str, text: str = "text") -> str:
    """Hashed, normalised token vectors as (id, slot, v)."""
    return f"""SELECT id, slot, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS v FROM (
      SELECT {ident} AS id, CAST('0x' || substr(md5(tok), 1, 8) AS BIGINT) % 64 AS slot, CAST(count(*) AS DOUBLE) AS c
      FROM (SELECT {ident}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS tok FROM {source}) GROUP BY 1, 2)"""


# A vector is compared by its length, its entries that are not zero and its sum weighted by place.
def _weighed():
    return F.round(F.aggregate(F.zip_with("embedding", F.sequence(F.lit(1), F.size("embedding")), lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x), 6)


query("apply_index_delta", oracle("", f"""SELECT d.chunk_id, source_type, 64 AS dim, CAST(count(slot) AS INT) AS used, coalesce(round(sum((slot + 1) * v), 6), 0.0) AS weighed
  FROM desired d LEFT JOIN ({slots('desired', 'chunk_id')}) s ON s.id = d.chunk_id GROUP BY 1, 2""", **_PAIR))(
    lambda spark, sf: CO.apply_delta(_desired(spark, sf), _existing(spark, sf)).select(
        "chunk_id", "source_type", F.size("embedding").alias("dim"), F.size(F.filter("embedding", lambda x: x != 0)).alias("used"), _weighed().alias("weighed")))
# Vectors of several lengths, and chunks that lost their id.
query("corpus_stats", oracle("", """SELECT source_type, count(*) AS chunks, CAST(min(64 - length(text) % 5) AS INT) AS min_dim, CAST(max(64 - length(text) % 5) AS INT) AS max_dim,
  count(*) FILTER (length(text) % 7 = 0) AS missing_ids FROM desired GROUP BY 1""", **_PAIR))(
    lambda spark, sf: CO.corpus_stats(embedded(_desired(spark, sf)).withColumns({
        "embedding": F.slice("embedding", F.lit(1), 64 - F.char_length("text") % 5), "id": F.when(F.char_length("text") % 7 != 0, F.col("id"))})))

# ---- text functions -------------------------------------------------------

query("tokenise", oracle("chunks", """
  SELECT chunk_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS INT) AS tokens,
    CAST(len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS INT) AS distinct_tokens FROM chunks"""))(
    lambda spark, sf: T.documents(spark, sf).select(
        "chunk_id", F.size(TX.tokens(F.col("text"))).alias("tokens"),
        F.size(F.array_distinct(TX.tokens(F.col("text")))).alias("distinct_tokens")))

SENTENCES = (r"list_filter(list_transform(string_split_regex(regexp_replace({t}, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), "
             r"lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 15)")

query("sentence_split", oracle("chunks", f"""
  SELECT chunk_id, CAST(i AS INT) AS pos, s[i + 1] AS sentence FROM (
    SELECT chunk_id, s, unnest(range(len(s))) AS i FROM (SELECT chunk_id, {SENTENCES.format(t='text')} AS s FROM chunks))"""))(
    lambda spark, sf: T.documents(spark, sf).select("chunk_id", F.posexplode(TX.sentences(F.col("text"))).alias("pos", "sentence")))

NUMBERS = r"regexp_extract_all({t}, '\b\d+(?:[.,]\d+)*%?\b')"
_PLAIN = ("CASE WHEN len(regexp_replace({x}, '[^.,]', '', 'g')) >= 2 THEN regexp_replace(rtrim({x}, '%'), '[.,]', '', 'g') "
          "ELSE replace(rtrim({x}, '%'), ',', '.') END")
CANON = ("rtrim(rtrim(printf('%.4f', CAST(" + _PLAIN + " AS DOUBLE)), '0'), '.') || CASE WHEN {x} LIKE '%\\%' ESCAPE '\\' THEN '%' ELSE '' END")

query("number_tokens", oracle("chunks", f"""
  SELECT chunk_id, tok AS token, {CANON.format(x='tok')} AS canonical, count(*) AS n FROM (
    SELECT chunk_id, unnest({NUMBERS.format(t='text')}) AS tok FROM chunks) GROUP BY 1, 2, 3"""))(
    lambda spark, sf: T.documents(spark, sf).select("chunk_id", F.explode(TX.number_tokens(F.col("text"))).alias("token"))
    .groupBy("chunk_id", "token", TX.canonical_number(F.col("token")).alias("canonical")).agg(F.count(F.lit(1)).alias("n")))

_WORDS = r"len(list_filter(string_split_regex({t}, '\s+'), lambda x: x <> ''))"


def adaptive_sql(t: str, base: int = RT.BASE_K) -> str:
    specific = rf"regexp_matches({t}, '\b\d{{4}}\b|\d+%')"
    n = _WORDS.format(t=t)
    return (f"CASE WHEN {n} <= 4 AND NOT {specific} THEN {min(base * 2, 10)} "
            f"WHEN {n} >= 14 OR {specific} THEN {max(3, base - 2)} ELSE {base} END")


query("adaptive_top_k", oracle("questions", f"SELECT question_id, CAST({adaptive_sql('text')} AS INT) AS k FROM questions"))(
    lambda spark, sf: T.questions(spark, sf).select("question_id", TX.adaptive_k(F.col("text"), RT.BASE_K).alias("k")))
query("query_key", oracle("questions", "SELECT question_id, md5(" + _STRIP.format(t="lower(text)") + ") AS query_key FROM questions"))(
    lambda spark, sf: T.questions(spark, sf).select("question_id", TX.query_key(F.col("text")).alias("query_key")))
query("text_preview", oracle("chunks", """
  SELECT chunk_id, substr(text, 1, 120) AS key, substr(text, 1, 300) AS preview FROM chunks"""))(
    lambda spark, sf: T.documents(spark, sf).select(
        "chunk_id", F.substring("text", 1, TX.KEY_LENGTH).alias("key"), F.substring("text", 1, TX.PREVIEW_LENGTH).alias("preview")))

# ---- dense ----------------------------------------------------------------


def _vectors(spark, sf):
    return require_dimension(T.read(spark, sf, "embeddings"), "embedding", 64).select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _dense(spark, sf, where=None):
    v = _vectors(spark, sf)
    asked = v.select(F.col("id").alias("query_id"), "vector", F.lit(5).alias("k"))
    return RT.dense_topk(asked, v.withColumnRenamed("id", "chunk_id"), where, exclude_self=True)


def _dense_sql(where: str) -> str:
    return f"""
      SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
          SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(
            CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score
          FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id {where})) WHERE rank <= 5"""


query("dense_topk", _dense_sql(""))(lambda spark, sf: _dense(spark, sf))
query("dense_topk_filtered", _dense_sql("AND c.label = 3"))(lambda spark, sf: _dense(spark, sf, {"label": 3}))
# The approximate index against the exact neighbours: every vector indexed, nine of ten found, one pair in twenty scored.
@query("dense_topk_recall", """
  SELECT count(*) AS questions, count(*) AS indexed, true AS recalled, true AS few_scored, true AS more_probes_find_more FROM embeddings""")
def _recall(spark, sf):
    v = _vectors(spark, sf)
    asked, chunks = v.select(F.col("id").alias("query_id"), "vector", F.lit(5).alias("k")), v.withColumnRenamed("id", "chunk_id")
    exact = RT.dense_topk(asked, chunks, exclude_self=True).select("query_id", "chunk_id")
    index = vector_index.build(chunks)
    pairs = cut_lineage(vector_index.candidates_at(index, asked, (1, 8, 32), exclude_self=True))
    near = vector_index.scored(index, asked, pairs).groupBy("query_id", "chunk_id").agg(*[F.max((F.col("probes") == p).cast("int")).alias(f"at_{p}") for p in (1, 8, 32)])
    found = exact.withColumn("n", F.lit(1)).join(near, ["query_id", "chunk_id"], "left")
    scored, indexed = pairs.where("probes = 32").count(), index.rows.count()
    share = [(F.sum(F.coalesce(f"at_{p}", F.lit(0))) / F.sum("n")).alias(f"r_{p}") for p in (1, 8, 32)]
    return found.agg(F.count_distinct("query_id").alias("questions"), *share).select(
        "questions", F.lit(indexed).cast("long").alias("indexed"), (F.col("r_32") >= 0.9).alias("recalled"), (F.lit(scored) <= 0.05 * F.col("questions") * indexed).alias("few_scored"),
        ((F.col("r_1") < F.col("r_8")) & (F.col("r_8") < F.col("r_32"))).alias("more_probes_find_more"))


query("cosine_similarity", """
  SELECT a.vec_id AS vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")(
    lambda spark, sf: _vectors(spark, sf).alias("a").join(
        _vectors(spark, sf).alias("b"), F.col("b.id") == F.col("a.id") + 1).select(
        F.col("a.id").alias("vec_id"), F.round(cosine(F.col("a.vector"), F.col("b.vector")), 6).alias("cosine")))
query("unit_vectors", """
  SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS first
  FROM embeddings""")(lambda spark, sf: _vectors(spark, sf).select(
      F.col("id").alias("vec_id"), F.round(F.get(unit(F.col("vector")), F.lit(0)), 6).alias("first")))

# ---- BM25 and hybrid ------------------------------------------------------

_TOK = "regexp_extract_all(lower(text), '[a-z0-9]+')"


def bm25_ctes(questions: str) -> dict[str, str]:
    """Score tables; `questions` selects query_id, text, k."""
    return {
        "asked": questions,
        "toks": f"SELECT chunk_id, {_TOK} AS t FROM chunks",
        "size": "SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks",
        "tf": "SELECT chunk_id, greatest(any_value(dl), 1) AS dl, term, count(*) AS tf FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY chunk_id, term",
        "df": "SELECT term, ln(1 + ((SELECT n FROM size) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY 1",
        "terms": f"SELECT query_id, k, term, count(*) AS qtf FROM (SELECT query_id, k, unnest({_TOK}) AS term FROM asked) GROUP BY 1, 2, 3",
        "sparse": """SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, k
            FROM (SELECT query_id, k, chunk_id, round(sum(qtf * idf * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM size)))), 6) AS score
              FROM terms JOIN df USING (term) JOIN tf USING (term) GROUP BY 1, 2, 3) WHERE score > 0) WHERE rank <= k""",
    }


_ASKED = f"SELECT question_id AS query_id, text, {adaptive_sql('text')} AS k FROM search_questions"
HYBRID = {
    **bm25_ctes(_ASKED),
    "qv": slots("asked", "query_id"), "cv": slots("chunks", "chunk_id"),
    "dense": """SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, k
      FROM (SELECT a.query_id, a.k, c.chunk_id, round(coalesce(s, 0), 6) AS score FROM asked a CROSS JOIN chunks c
        LEFT JOIN (SELECT qv.id AS q, cv.id AS c, sum(qv.v * cv.v) AS s FROM qv JOIN cv USING (slot) GROUP BY 1, 2) x
          ON x.q = a.query_id AND x.c = c.chunk_id)) WHERE rank <= k""",
    "dn": """SELECT query_id, key, arg_max(chunk_id, rank) AS chunk_id, arg_max(norm, rank) AS norm FROM (
      SELECT d.query_id, d.chunk_id, d.rank, substr(text, 1, 120) AS key, CASE WHEN hi - lo < 1e-9 THEN 1.0 ELSE (score - lo) / (hi - lo) END AS norm
      FROM dense d JOIN (SELECT query_id, min(score) AS lo, max(score) AS hi FROM dense GROUP BY 1) m USING (query_id)
      JOIN chunks USING (chunk_id)) GROUP BY 1, 2""",
    "sn": """SELECT query_id, key, arg_min(chunk_id, rank) AS chunk_id, CAST(sum(CAST(norm AS DECIMAL(20,12))) AS DOUBLE) AS norm FROM (
      SELECT d.query_id, d.chunk_id, d.rank, substr(text, 1, 120) AS key, CASE WHEN hi - lo < 1e-9 THEN 1.0 ELSE (score - lo) / (hi - lo) END AS norm
      FROM sparse d JOIN (SELECT query_id, min(score) AS lo, max(score) AS hi FROM sparse GROUP BY 1) m USING (query_id)
      JOIN chunks USING (chunk_id)) GROUP BY 1, 2""",
    "hybrid": """SELECT query_id, chunk_id, score, rank FROM (
      SELECT f.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
        SELECT coalesce(dn.query_id, sn.query_id) AS query_id, coalesce(dn.chunk_id, sn.chunk_id) AS chunk_id,
          round(0.5 * coalesce(dn.norm, 0) + 0.5 * coalesce(sn.norm, 0), 6) AS score
        FROM dn FULL JOIN sn ON dn.query_id = sn.query_id AND dn.key = sn.key) f) JOIN asked USING (query_id) WHERE rank <= k""",
    "assembled": """SELECT query_id, a.text, coalesce(context, '') AS context, coalesce(top_score, 0.0) AS top_score, coalesce(n, 0) AS n FROM asked a LEFT JOIN (
      SELECT query_id, string_agg('[' || source_type || '] ' || text, chr(10) || chr(10) ORDER BY rank) AS context,
        round(max(score), 4) AS top_score, count(*) AS n FROM hybrid JOIN chunks USING (chunk_id) GROUP BY 1) h USING (query_id)""",
}


def _asked(spark, sf):
    return T.search_questions(spark, sf).withColumnRenamed("question_id", "query_id")


def _assembled(spark, sf):
    docs, asked = T.documents(spark, sf), _asked(spark, sf)
    return RT.relevance_gate(RT.assemble_context(asked, RT.hybrid_retrieve(asked, docs), docs))


query("bm25_topk", oracle("chunks search_questions", "SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM sparse",
                          **bm25_ctes("SELECT question_id AS query_id, text, 8 AS k FROM search_questions")))(
    lambda spark, sf: RT.bm25_topk(_asked(spark, sf).withColumn("k", F.lit(8)), T.documents(spark, sf)))
query("hybrid_retrieve", oracle("chunks search_questions", "SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM hybrid", **HYBRID))(
    lambda spark, sf: RT.hybrid_retrieve(_asked(spark, sf), T.documents(spark, sf)))
query("context_assembly", oracle("chunks search_questions", "SELECT query_id, context, top_score, CAST(n AS INT) AS sources FROM assembled", **HYBRID))(
    lambda spark, sf: _assembled(spark, sf).select("query_id", "context", "top_score", F.size("sources").alias("sources")))
query("relevance_gate", oracle("chunks search_questions", """
  SELECT query_id, top_score, CASE WHEN context = '' OR top_score < 0.35 THEN 'not_found' ELSE 'answer' END AS response_type
  FROM assembled""", **HYBRID))(lambda spark, sf: _assembled(spark, sf).select("query_id", "top_score", "response_type"))


def _dense_text_gate(spark, sf):
    """User questions against the benchmark passages by vector similarity alone."""
    asked = T.questions(spark, sf).select(F.col("question_id").alias("query_id"), "text")
    passages = T.search_questions(spark, sf).select(
        F.col("question_id").alias("chunk_id"), "text", F.lit("").alias("topic"), F.lit("playbook").alias("source_type"))
    hits = RT.hybrid_retrieve(asked, passages, hybrid=False)
    return sinks.unanswered(RT.relevance_gate(RT.assemble_context(asked, hits, passages), 0.8), "2024-02-01")


query("unanswered_backlog", oracle("questions search_questions", """
  SELECT text AS question, round(coalesce(s, 0), 4) AS top_score, TIMESTAMP '2024-02-01 00:00:00' AS recorded_at
  FROM questions q LEFT JOIN (SELECT id, max(s) AS s FROM (SELECT qv.id, cv.id AS c, round(sum(qv.v * cv.v), 6) AS s
    FROM qv JOIN cv USING (slot) GROUP BY 1, 2) GROUP BY 1) b ON b.id = q.question_id WHERE round(coalesce(s, 0), 4) < 0.8""",
    qv=slots("questions", "question_id"), cv=slots("search_questions", "question_id")))(_dense_text_gate)

# ---- answers --------------------------------------------------------------


def _answers(spark, sf):
    """Assistant turns with the user turn before them as context."""
    turns = T.read(spark, sf, "conversations")
    said = turns.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    known = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    return said.join(known, ["conv_id", "turn"], "left").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "answer", F.coalesce("context", F.lit("")).alias("context"))


_ANSWERS = """SELECT a.conv_id * 1000 + a.turn AS answer_id, a.text AS answer, coalesce(u.text, '') AS context
  FROM conversations a LEFT JOIN conversations u ON u.role = 'user' AND u.conv_id = a.conv_id AND u.turn + 1 = a.turn WHERE a.role = 'assistant'"""


def _parts(side: str) -> str:
    return f"""SELECT answer_id, answer_id || '/' || i AS id, s[i + 1] AS sentence FROM (SELECT answer_id, s, unnest(range(len(s))) AS i
      FROM (SELECT answer_id, {SENTENCES.format(t=side)} AS s FROM answers))"""


_UNVERIFIED = (f"list_filter({NUMBERS.format(t='answer')}, lambda x: NOT list_contains(list_transform({NUMBERS.format(t='context')}, "
               f"lambda y: {CANON.format(x='y')}), {CANON.format(x='x')}))")

query("groundedness", oracle("", f"""
  SELECT answer_id, CASE WHEN total = 0 THEN 1.0 WHEN ctotal = 0 THEN 0.0 ELSE round(supported / total, 3) END AS score,
    CASE WHEN total = 0 THEN true WHEN ctotal = 0 THEN false
      ELSE supported / total >= 0.35 AND NOT (len(loose) > 2 AND supported / total < 0.6) END AS is_grounded,
    CAST(supported AS BIGINT) AS supported, CAST(total AS INT) AS total,
    CASE WHEN total = 0 OR ctotal = 0 THEN [] ELSE loose END AS unverified_numbers, true AS checked
  FROM (SELECT a.answer_id, len({SENTENCES.format(t='answer')}) AS total, len({SENTENCES.format(t='context')}) AS ctotal,
      {_UNVERIFIED} AS loose, coalesce(n, 0) AS supported FROM answers a LEFT JOIN (
        SELECT answer_id, count(DISTINCT sid) AS n FROM (SELECT s.answer_id, s.id AS sid, k.id AS kid
          FROM said s JOIN known k USING (answer_id) JOIN sv ON sv.id = s.id JOIN kv ON kv.id = k.id AND kv.slot = sv.slot
          GROUP BY 1, 2, 3 HAVING round(sum(sv.v * kv.v), 6) >= 0.55) GROUP BY 1) x USING (answer_id))""",
    answers=_ANSWERS, said=_parts("answer"), known=_parts("context"),
    sv=slots("said", "id", "sentence"), kv=slots("known", "id", "sentence")))(lambda spark, sf: AN.groundedness(_answers(spark, sf)))


def _neighbours(spark, sf):
    """Every document checked against the document before it."""
    docs = T.read(spark, sf, "documents").select("doc_id", "text")
    before = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("context"))
    return docs.join(before, "doc_id", "left").select(
        F.col("doc_id").alias("answer_id"), F.col("text").alias("answer"), F.coalesce("context", F.lit("")).alias("context"))


query("unverified_numbers", oracle("", f"SELECT answer_id, {_UNVERIFIED} AS unverified_numbers FROM answers",
    answers="""SELECT d.doc_id AS answer_id, d.text AS answer, coalesce(b.text, '') AS context
      FROM documents d LEFT JOIN documents b ON b.doc_id + 1 = d.doc_id"""))(
    lambda spark, sf: AN.numbers_report(_neighbours(spark, sf)))

query("question_dedup_exact", oracle("questions", f"""
  SELECT q.question_id, md5({_STRIP.format(t='lower(q.text)')}) AS query_key,
    min(epoch_us(q.asked_at) - epoch_us(p.asked_at)) / 1000000.0 AS reused_age_seconds
  FROM questions q LEFT JOIN questions p ON md5({_STRIP.format(t='lower(q.text)')}) = md5({_STRIP.format(t='lower(p.text)')})
    AND p.asked_at < q.asked_at AND epoch_us(q.asked_at) - epoch_us(p.asked_at) < {DAY}000000
  GROUP BY 1, 2"""))(lambda spark, sf: AN.exact_reuse(T.questions(spark, sf), DAY))

query("question_dedup_semantic", oracle("questions", f"""
  SELECT question_id, reused_question_id, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, reused_question_id) AS r
    FROM (SELECT a.question_id, b.question_id AS reused_question_id, round(sum(x.v * y.v), 6) AS score
      FROM questions a JOIN questions b ON b.asked_at < a.asked_at AND epoch_us(a.asked_at) - epoch_us(b.asked_at) < {DAY}000000
      JOIN qv x ON x.id = a.question_id JOIN qv y ON y.id = b.question_id AND y.slot = x.slot GROUP BY 1, 2) WHERE score >= 0.93) WHERE r = 1""",
    qv=slots("questions", "question_id")))(
    lambda spark, sf: AN.semantic_reuse(embedded(T.questions(spark, sf), "vector"), DAY))

# ---- question rules -------------------------------------------------------

_ASCII = "regexp_replace({t}, '[^\\x00-\\x7F]', 'x', 'g')"


def words_sql(low: str, options) -> str:
    return "(" + " OR ".join(f"contains({low}, '{w}')" for w in options) + ")"


LANGUAGE = (f"CASE WHEN len(regexp_extract_all({_ASCII.format(t='lower(text)')}, '\\b(" + "|".join(K.LANGUAGE_WORDS)
            + ")\\b')) >= 2 THEN 'id' ELSE 'en' END")


def only_sql(patterns) -> str:
    plain = f"regexp_replace({_ASCII.format(t='lower(text)')}, '[^\\w\\s'']', ' ', 'g')"
    tests = []
    for p in patterns:
        p = p.replace("'", "''")
        rest = f"len(list_filter(string_split_regex(regexp_replace({plain}, '\\b{p}\\b', ' '), '\\s+'), lambda x: x <> ''))"
        tests.append(f"(regexp_matches({plain}, '\\b{p}\\b') AND {rest} <= 2)")
    return "(" + " OR ".join(tests) + ")"


_LOW = "lower(text)"
FALLBACK = (f"CASE WHEN {words_sql(_LOW, K.INSIGHT_WORDS)} THEN 'insight' WHEN {words_sql(_LOW, K.PREDICTION_WORDS)} "
            f"THEN 'entity_prediction' WHEN {words_sql(_LOW, K.FACT_WORDS)} THEN 'raw_fact' ELSE 'insight' END")
_FIRST = (f"CASE WHEN {words_sql(_LOW, K.FORECAST_WORDS)} AND {words_sql(_LOW, K.REVENUE_WORDS)} "
          f"THEN 'entity_prediction' ELSE {FALLBACK} END")
CORRECTED = f"""
  SELECT *, CASE WHEN i2 IN ('raw_fact', 'insight') AND {words_sql(_LOW, K.EXPLORATORY_WORDS)} THEN 'exploratory' ELSE i2 END AS i3 FROM (
    SELECT *, CASE WHEN i1 = 'entity_prediction' AND {words_sql(_LOW, K.NOT_FORECASTABLE_WORDS)} THEN 'raw_fact' ELSE i1 END AS i2 FROM (
      SELECT *, {_FIRST} AS i1 FROM questions))"""

query("detect_language", oracle("questions", f"SELECT question_id, {LANGUAGE} AS language FROM questions"))(
    lambda spark, sf: T.questions(spark, sf).select("question_id", Q.language(F.col("text")).alias("language")))
query("detect_greeting_gratitude", oracle("questions", f"""
  SELECT question_id, {only_sql(K.GREETINGS)} AS greeting, {only_sql(K.THANKS)} AS gratitude FROM questions"""))(
    lambda spark, sf: T.questions(spark, sf).select(
        "question_id", Q.is_greeting(F.col("text")).alias("greeting"), Q.is_gratitude(F.col("text")).alias("gratitude")))
query("fallback_intent", oracle("questions", f"SELECT question_id, {FALLBACK} AS intent FROM questions"))(
    lambda spark, sf: T.questions(spark, sf).select("question_id", Q.fallback_intent(F.col("text")).alias("intent")))
query("intent_corrections", oracle("questions", f"SELECT question_id, i3 AS intent FROM ({CORRECTED})"))(
    lambda spark, sf: T.questions(spark, sf).select(
        "question_id", Q.corrected_intent(F.col("text"), Q.fallback_intent(F.col("text"))).alias("intent")))

_YEARS = "list_transform(list_distinct(regexp_extract_all(lower(text), '\\b(20\\d{2})\\b', 1)), lambda y: CAST(y AS INT))"
_MONTHS = "list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{m}') THEN {n} END" for m, n in K.MONTHS.items()) + "], lambda m: m IS NOT NULL)"

query("extract_period", oracle("questions", f"""
  SELECT question_id,
    CASE WHEN len(ys) = 0 THEN NULL WHEN len(ms) > 0 AND len(ys) = 1 THEN make_date(list_min(ys), list_min(ms), 1)
      ELSE make_date(list_min(ys), 1, 1) END AS start_date,
    CASE WHEN len(ys) = 0 THEN NULL WHEN len(ms) > 0 AND len(ys) = 1 THEN last_day(make_date(list_min(ys), list_max(ms), 1))
      ELSE make_date(list_max(ys), 12, 31) END AS end_date
  FROM (SELECT question_id, {_YEARS} AS ys, {_MONTHS} AS ms FROM questions)"""))(
    lambda spark, sf: Q.extract_period(T.questions(spark, sf)).select("question_id", "start_date", "end_date"))

_TOPN = "'" + K.TOP_N + "'"
query("requested_top_n", oracle("questions", f"""
  SELECT question_id, CASE WHEN n IS NULL THEN 5 ELSE least(greatest(CAST(n AS INT), 1), 25) END AS top_n FROM (
    SELECT question_id, coalesce(nullif(regexp_extract(lower(text), {_TOPN}, 1), ''), nullif(regexp_extract(lower(text), {_TOPN}, 2), '')) AS n
    FROM questions)"""))(lambda spark, sf: T.questions(spark, sf).select("question_id", Q.top_n(F.col("text")).alias("top_n")))

_METRICS = "list_slice(list_filter([" + ", ".join(
    f"CASE WHEN {words_sql(_LOW, ws)} THEN '{name}' END" for name, ws in K.METRIC_WORDS.items()) + "], lambda m: m IS NOT NULL), 1, 3)"
query("tag_metrics", oracle("questions", f"""
  SELECT question_id, CAST(i AS INT) AS pos, m[i + 1] AS metric FROM (SELECT question_id, m, unnest(range(len(m))) AS i
    FROM (SELECT question_id, {_METRICS} AS m FROM questions))"""))(
    lambda spark, sf: T.questions(spark, sf).select("question_id", F.posexplode(Q.metrics(F.col("text"))).alias("pos", "metric")))

_TOPIC_ROWS = ", ".join(f"({i}, '{name}', '{w}')" for i, (name, ws) in enumerate(K.TOPIC_WORDS.items()) for w in ws)
_TOPIC = f"""SELECT question_id, arg_max(name, (length(w), -i)) AS topic FROM questions
  JOIN (VALUES {_TOPIC_ROWS}) v(i, name, w) ON contains(lower(text), w) GROUP BY 1"""
query("tag_topic", oracle("questions", f"""
  SELECT q.question_id, topic, CASE WHEN topic IS NOT NULL THEN coalesce((SELECT string_agg(name, ',' ORDER BY i) FROM (
    SELECT DISTINCT i, name FROM (VALUES {_TOPIC_ROWS}) v(i, name, w) WHERE name <> topic AND starts_with(name, split_part(topic, '_', 1))
    ORDER BY i LIMIT 3)), '') END AS related
  FROM questions q LEFT JOIN ({_TOPIC}) t USING (question_id)"""))(
    lambda spark, sf: T.questions(spark, sf).select("question_id", Q.topic(F.col("text")).alias("topic")).withColumn(
        "related", F.array_join(Q.related_topics(F.col("topic")), ",")))


def _named(spark, sf):
    """Questions that name a product-like person, and customers called so."""
    people = T.read(spark, sf, "customer").join(
        T.read(spark, sf, "part"), F.col("c_custkey") == F.col("p_partkey")).select(
        F.col("c_custkey").alias("customer_id"), F.initcap("p_name").alias("name"))
    asked = T.read(spark, sf, "conversations").where("role = 'user'").join(
        T.read(spark, sf, "part"), F.col("conv_id") == F.col("p_partkey")).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"),
        F.concat(F.lit("apakah pelanggan "), F.initcap("p_name"), F.lit(" akan churn? "), F.col("text")).alias("text"))
    return Q.name_mentions(asked, people)


query("customer_name_mentions", oracle("", """
  SELECT question_id, mention, customer_id, CAST(rank AS INT) AS rank FROM (
    SELECT question_id, mention, c_custkey AS customer_id, row_number() OVER (PARTITION BY question_id ORDER BY c_custkey) AS rank
    FROM (SELECT conv_id * 1000 + turn AS question_id, p_name AS mention FROM conversations JOIN part ON p_partkey = conv_id WHERE role = 'user') q
    JOIN (SELECT c_custkey, p_name FROM customer JOIN part ON p_partkey = c_custkey) p ON contains(p_name, mention)) WHERE rank <= 10"""))(_named)

query("question_mix", oracle("questions", f"""
  SELECT CAST(asked_at AS DATE) AS day, intent, language, count(*) AS questions,
    round(avg(CAST(coalesce(top_score < 0.35, true) AS INT)), 6) AS below_gate_share
  FROM (SELECT *, {LANGUAGE} AS language, CASE WHEN {only_sql(K.GREETINGS)} THEN 'greeting' WHEN {only_sql(K.THANKS)} THEN 'gratitude' ELSE i3 END AS intent,
    question_id % 100 / 100 AS top_score FROM ({CORRECTED})) GROUP BY 1, 2, 3"""))(
    lambda spark, sf: Q.question_mix(Q.tag(T.questions(spark, sf)).withColumn("top_score", F.col("question_id") % 100 / 100.0)))
