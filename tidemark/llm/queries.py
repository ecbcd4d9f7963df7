"""The queries of the training-data operators over the given tables, with check SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, decontam, htmltext, langid, linededup, ngramjoin, periodic, pieces, prefixtrie, quality, secretscan, tokencounts
from tidemark.llm.base import read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}
BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return add


@query("op1_bpe_round_trip")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), decoded="decoded")
    return ids.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op5_quality_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(read(spark, sf_dir, "documents"))


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


PLANTED = "\\### Assistant: </turn> ok"  # a text that says the template's own control strings


@query("op8_chat_formatting", r"""WITH c AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS safe,
  replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') AS safe_role FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || safe_role || ': ' || safe || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    logged = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.render(chat.fold(chat.events_of(logged.unionByName(planted)))))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query("op9_decontamination", f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, item, n, i FROM dw JOIN bw USING (n, g)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    learned = langid.profiles(docs.where(~held_out & F.col("lang").isNotNull()), "text", "lang")
    return langid.predict(docs, learned, carry={"held_out": held_out})


@query("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digest(secretscan.scan(read(spark, sf_dir, "documents")))


@query("op3_line_dedup", r"""WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, line, trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x
  FROM (SELECT doc_id, unnest(ls) AS x, unnest(range(len(ls))) AS line FROM t)),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS i, len(regexp_extract_all(x, '[^ \t-\r]+')) AS words FROM l WHERE x <> ''),
c AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY i) AS upto, list(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS xs FROM n),
w AS (SELECT a.doc_id, a.i, a.line AS first, b.line AS last, b.i - a.i + 1 AS size, array_to_string(a.xs[a.i:b.i], chr(10)) AS run
  FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.words >= 50
  WHERE b.upto - b.words - a.upto + a.words < 50 OR b.upto - a.upto < 50),
g AS (SELECT *, min((doc_id, i)) OVER (PARTITION BY run, size) AS place FROM w),
gw AS (SELECT DISTINCT n.doc_id, n.i, n.line FROM n JOIN g ON n.doc_id = g.doc_id AND n.line BETWEEN g.first AND g.last WHERE place <> (g.doc_id, g.i)),
gr AS (SELECT a.doc_id, a.line AS first, coalesce(b.line, a.line) AS last FROM gw a LEFT JOIN gw b ON a.doc_id = b.doc_id AND b.i = a.i + 1),
gone AS (SELECT DISTINCT l.doc_id, l.line FROM l JOIN gr ON l.doc_id = gr.doc_id AND l.line BETWEEN gr.first AND gr.last),
kept AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY line) AS s FROM (SELECT doc_id, unnest(ls) AS x, unnest(range(len(ls))) AS line FROM t) q
  WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = q.doc_id AND gone.line = q.line) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, (SELECT count(*) FROM gone WHERE gone.doc_id = d.doc_id) AS n_deleted,
  sha256(coalesce(s, '')) AS kept_sha256 FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup(read(spark, sf_dir, "documents"))
    gone = F.aggregate(F.coalesce("ranges", F.array().cast("array<struct<first: int, last: int>>")), F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    n_lines = F.coalesce(F.size(F.split("row.text", "\n", -1)), F.lit(0))
    return out.select("row.doc_id", F.greatest(n_lines, F.lit(0)).cast("long").alias("n_lines"), gone.alias("n_deleted"), F.sha2(F.coalesce("cleaned", F.lit("")), 256).alias("kept_sha256"))


@query("op6_ngram_jaccard", r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) q ON q.a = d.doc_id""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.groups(read(spark, sf_dir, "documents"))


@query("op4_html_extraction")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return htmltext.extract(pages, htmltext.fit(pages))


@query("op12_sentencepiece_round_trip")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = pieces.encode(read(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE), decoded="decoded")
    return ids.select("doc_id", "n_tokens", F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


#: CRC-32 of the decimal text of a number, as SQL over a table `tab` with the list t of 256 remainders.
_TAB = "tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"
_CRC = "xor(list_reduce([4294967295] || list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)"


@query("op11_periodic_runs", f"""WITH {_TAB},
d AS (SELECT doc_id, {_CRC.format("doc_id")} AS h, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS o FROM documents, tab),
a AS (SELECT doc_id, o, len(o) AS n, h % 10 = 0 AND len(o) > 0 AS changed, (h // 10) % greatest(len(o), 1) AS a, h // 10 AS g FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
w AS (SELECT doc_id, n, i, CASE WHEN changed AND i >= a THEN o[a + (i - a) % p + 1] ELSE o[i + 1] END AS x FROM (SELECT *, unnest(range(n)) AS i FROM p)),
e AS (SELECT s.doc_id, s.i, z.i - s.i AS q FROM w s JOIN w z ON s.doc_id = z.doc_id AND s.x = z.x AND z.i > s.i AND 3 * (z.i - s.i) <= s.n),
g AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM e) GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(24, 3 * q)),
r AS (SELECT doc_id, s, len, min(q) AS q FROM g GROUP BY doc_id, s, len),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM r),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS c FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(len AS DOUBLE) / q DESC, s, q) = 1),
t AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.len AS length, b.q AS period, 1000 * b.len // b.q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN b ON d.doc_id = b.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.find(periodic.planted(read(spark, sf_dir, "documents"))))


@query("op13_prefix_trie", f"""WITH {_TAB},
c AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, {_CRC.format("conv_id")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM c), tab),
x AS (SELECT conv_id, pos, r, t FROM c JOIN k USING (conv_id) WHERE pos >= h
  UNION ALL SELECT k.conv_id, pos, r, t FROM k JOIN c ON c.conv_id = k.conv_id - k.conv_id % 100 AND pos < h),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth, length(t) AS size,
  md5(string_agg(length(r) || ':' || length(t) || ':' || r || t, '') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS id FROM x),
p AS (SELECT conv_id, depth, size, id, coalesce(lag(id) OVER w, '') AS up, count(*) OVER (PARTITION BY conv_id) = depth AS ends FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
  UNION ALL SELECT conv_id, 0, 0, '', NULL, conv_id NOT IN (SELECT conv_id FROM s) FROM k),
n AS (SELECT id, min(up) AS up, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(size) AS size,
  coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (ends), '') AS listed FROM p GROUP BY id),
h AS (SELECT up AS id, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
b AS (SELECT p.id, count(*) FILTER (h.id IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.size) AS saved_tokens
  FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN h ON h.id = n.id GROUP BY p.id)
SELECT n.conv_id, n.depth, o.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(n.listed) AS ends_sha256
FROM n JOIN b USING (id) LEFT JOIN h USING (id) LEFT JOIN n o ON o.id = n.up""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie_of_rebuilt(read(spark, sf_dir, "conversations"))
