"""Rules over question tables: language, greeting, intent, period, metric and topic tags.

Everything is a narrow column expression over whole texts; the word lists are
small constants inside the expression, so no join is needed.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import keywords as K
from tidemark.functions.text import words
from tidemark.operators.facts import DEFAULT_TOP_N, MAX_TOP_N
from tidemark.operators.retrieval import MIN_RELEVANCE
from tidemark.plans.session import cut_lineage

MAX_EXTRA_WORDS = 2
MAX_METRICS = 3
MAX_NAME_MATCHES = 10


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def any_word(text: Column, options: Iterable[str]) -> Column:
    """Substring test against a word list; `text` is lower case."""
    hit = F.lit(False)
    for w in options:
        hit = hit | text.contains(w)
    return hit


def language(text: Column) -> Column:
    """Two or more Indonesian function words make it 'id'."""
    found = F.regexp_count(F.lower(text), F.lit(r"(?U)\b(" + "|".join(K.LANGUAGE_WORDS) + r")\b"))
    return F.when(found >= 2, "id").otherwise("en")


def _only(text: Column, patterns: Iterable[str]) -> Column:
    """The message is one of the patterns plus at most two other words."""
    # ASCII is its own normal form; only other texts go to Python.
    composed = F.coalesce(nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)
    plain = F.regexp_replace(F.lower(composed), r"(?U)[^\w\s']", " ")
    hit = F.lit(False)
    for p in patterns:
        halves = F.split(plain, rf"(?U)\b{p}\b", 2)
        rest = F.size(words(F.array_join(halves, " ")))
        hit = hit | ((F.size(halves) == 2) & (rest <= MAX_EXTRA_WORDS))
    return F.coalesce(hit, F.lit(False))


def is_greeting(text: Column) -> Column:
    return _only(text, K.GREETINGS)


def is_gratitude(text: Column) -> Column:
    return _only(text, K.THANKS)


def fallback_intent(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(any_word(low, K.INSIGHT_WORDS), "insight").when(any_word(low, K.PREDICTION_WORDS), "entity_prediction")
        .when(any_word(low, K.FACT_WORDS), "raw_fact").otherwise("insight"))


def corrected_intent(text: Column, intent: Column) -> Column:
    """Three corrections in order; each looks at the result of the one before."""
    low = F.lower(text)
    first = F.when(any_word(low, K.FORECAST_WORDS) & any_word(low, K.REVENUE_WORDS), "entity_prediction").otherwise(intent)
    second = F.when((first == "entity_prediction") & any_word(low, K.NOT_FORECASTABLE_WORDS), "raw_fact").otherwise(first)
    explores = second.isin("raw_fact", "insight") & any_word(low, K.EXPLORATORY_WORDS)
    return F.when(explores, "exploratory").otherwise(second)


def wants_comparison(text: Column) -> Column:
    return any_word(F.lower(text), K.COMPARISON_WORDS)


def period_bounds(text: Column) -> tuple[Column, Column]:
    """First and last day named by years 20dd and month names; null without a year."""
    low = F.lower(text)
    years = F.array_distinct(F.transform(
        F.regexp_extract_all(low, F.lit(r"(?U)\b(20\d{2})\b"), F.lit(1)), lambda y: y.cast("int")))
    months = F.filter(F.array(*[F.when(low.contains(name), F.lit(n)) for name, n in K.MONTHS.items()]), lambda m: m.isNotNull())
    by_month = (F.size(months) > 0) & (F.size(years) == 1)
    year_a, year_b = F.array_min(years), F.array_max(years)
    start = F.when(by_month, F.make_date(year_a, F.array_min(months), F.lit(1))).otherwise(F.make_date(year_a, F.lit(1), F.lit(1)))
    end = F.when(by_month, F.last_day(F.make_date(year_a, F.array_max(months), F.lit(1)))).otherwise(
        F.make_date(year_b, F.lit(12), F.lit(31)))
    return F.when(F.size(years) > 0, start), F.when(F.size(years) > 0, end)


def extract_period(questions: DataFrame) -> DataFrame:
    """Start and end dates; dates already known in both columns are kept."""
    start, end = period_bounds(F.col("text"))
    if {"start_date", "end_date"} <= set(questions.columns):
        known = F.col("start_date").isNotNull() & F.col("end_date").isNotNull() | start.isNull()
        start = F.when(known, F.col("start_date")).otherwise(start)
        end = F.when(known, F.col("end_date")).otherwise(end)
    return questions.withColumns({"start_date": start, "end_date": end})


def top_n(text: Column) -> Column:
    low = F.lower(text)
    number = F.coalesce(F.nullif(F.regexp_extract(low, "(?U)" + K.TOP_N, 1), F.lit("")),
                        F.nullif(F.regexp_extract(low, "(?U)" + K.TOP_N, 2), F.lit("")))
    return F.when(number.isNull(), DEFAULT_TOP_N).otherwise(F.least(F.greatest(number.cast("int"), F.lit(1)), F.lit(MAX_TOP_N)))


def metrics(text: Column, limit: int = MAX_METRICS) -> Column:
    """The first catalogue entries, in catalogue order, one of whose keywords occurs."""
    low = F.lower(text)
    hits = F.array(*[F.when(any_word(low, ws), F.lit(name)) for name, ws in K.METRIC_WORDS.items()])
    return F.slice(F.filter(hits, lambda h: h.isNotNull()), 1, limit)


def topic(text: Column) -> Column:
    """Topic of the longest matching keyword; the earlier topic wins a tie."""
    low = F.lower(text)
    candidates = []
    for order, (name, ws) in enumerate(K.TOPIC_WORDS.items()):
        longest = F.greatest(*[F.when(low.contains(w), F.lit(len(w))).otherwise(F.lit(0)) for w in ws])
        candidates.append(F.struct(longest.alias("length"), F.lit(-order).alias("order"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*candidates))
    return F.when(best["length"] > 0, best["name"])


def related_topics(name: Column, limit: int = 3) -> Column:
    """Other topics that start with the part of the name before its first underscore."""
    names = list(K.TOPIC_WORDS)
    prefix = F.substring_index(name, "_", 1)
    others = F.filter(F.array(*[F.lit(n) for n in names]), lambda n: (n != name) & F.startswith(n, prefix))
    return F.when(name.isNotNull(), F.slice(others, 1, limit))


def tag(questions: DataFrame) -> DataFrame:
    """Language, intent (greeting and thanks first), metrics and topic of every question."""
    text = F.col("text")
    flagged = questions.withColumns({"_hi": is_greeting(text), "_thanks": is_gratitude(text)})
    intent = (
        F.when(F.col("_hi"), "greeting").when(F.col("_thanks"), "gratitude")
        .otherwise(corrected_intent(text, fallback_intent(text))))
    return flagged.withColumns({
        "language": language(text), "intent": intent, "metrics": metrics(text), "topic": topic(text)}).drop("_hi", "_thanks")


def question_mix(tagged: DataFrame) -> DataFrame:
    """Questions per day, intent and language, and the share below the relevance gate."""
    below = F.coalesce(F.col("top_score") < MIN_RELEVANCE, F.lit(True))
    return (
        tagged.groupBy(F.col("asked_at").cast("date").alias("day"), "intent", "language")
        .agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg(below.cast("int")), 6).alias("below_gate_share"))
        .orderBy("day", "intent", "language"))


#: Bytes of mentions in one automaton (some twenty times that in memory), and distinct names scanned by one task.
MENTION_BYTES, NAME_ROWS = 2_000_000, 200_000


def containing(mentions: DataFrame, names: DataFrame, key: str, limit: int) -> DataFrame:
    """(mention, key): for each mention the `limit` smallest keys of the names that contain it.

    mentions: mention, distinct; names: lowered, ids (keys of one name).  An Aho-Corasick automaton over a block of
    mentions runs once over a part of the names and finds all mentions in them in one pass, so nothing but true matches
    leaves a task.  The numbers of blocks and parts follow from the measured sizes; every block meets every part.
    """
    size = mentions.agg(F.sum(F.octet_length("mention"))).first()[0] or 0
    blocks, parts = max(1, -(-size // MENTION_BYTES)), max(1, -(-names.count() // NAME_ROWS))
    schema = T.StructType([T.StructField("mention", T.StringType()), T.StructField(key, names.schema["ids"].dataType.elementType)])
    left = mentions.withColumn("_b", F.pmod(F.xxhash64("mention"), F.lit(blocks))).withColumn("_p", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    right = names.withColumn("_p", F.pmod(F.xxhash64("lowered"), F.lit(parts))).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found: dict[str, list] = {}
        if len(a) and len(b):
            automaton = ahocorasick.Automaton()
            for m in a["mention"]:
                automaton.add_word(m, m)
            automaton.make_automaton()
            for name, ids in zip(b["lowered"], b["ids"], strict=True):
                for m in {m for _, m in automaton.iter(name)}:
                    held = found.setdefault(m, [])
                    held.extend(ids)
                    if len(held) > 8 * limit + len(ids):
                        held[:] = sorted(held)[:limit]
        return pd.DataFrame([(m, i) for m, held in found.items() for i in sorted(held)[:limit]], columns=schema.fieldNames())

    return left.groupBy("_b", "_p").cogroup(right.groupBy("_b", "_p")).applyInPandas(match, schema)


def name_mentions(questions: DataFrame, customers: DataFrame, limit: int = MAX_NAME_MATCHES) -> DataFrame:
    """Customers whose name contains the name a question mentions; the first `limit` ids per question.

    Equal mentions are matched once, and customers of equal name are first cut to their `limit` smallest ids, which is
    all that any question can show.
    """
    asked = cut_lineage(questions.select("question_id", F.lower(F.nullif(
        F.regexp_extract("text", "(?U)" + K.NAME_AFTER_CUE, 1), F.lit(""))).alias("mention")).where("mention IS NOT NULL"))
    people = customers.where("name IS NOT NULL").select("customer_id", F.lower("name").alias("lowered"))
    same_name = Window.partitionBy("lowered").orderBy("customer_id")
    people = cut_lineage(people.withColumn("_n", F.row_number().over(same_name)).where(F.col("_n") <= limit).groupBy("lowered").agg(
        F.sort_array(F.collect_list("customer_id")).alias("ids")))
    order = Window.partitionBy("mention").orderBy("customer_id")
    found = containing(asked.select("mention").distinct(), people, "customer_id", limit).withColumn(
        "rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return asked.join(found, "mention").select("question_id", "mention", "customer_id", "rank")
