"""Text rules as column expressions; whole texts, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lengths, patterns.
MIN_CHUNK_LENGTH = 20
MIN_SENTENCE_LENGTH = 15
KEY_LENGTH = 120
PREVIEW_LENGTH = 300
TOKEN = "[a-z0-9]+"
SENTENCE_BREAK = r"(?U)(?<=[.!?])\s+|\n+"
NUMBER = r"(?U)\b\d+(?:[.,]\d+)*%?\b"
SPECIFIC = r"(?U)\b\d{4}\b|\d+%"


def strip(text: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(text, r"(?U)\s+", -1), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Sentences of more than 15 characters."""
    parts = F.transform(F.split(text, SENTENCE_BREAK, -1), strip)
    return F.filter(parts, lambda s: F.length(s) > MIN_SENTENCE_LENGTH)


def number_tokens(text: Column) -> Column:
    """Numbers as written; a % counts only when a word character follows it."""
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def canonical_number(token: Column) -> Column:
    """1.500.000 and 1500000 are equal, 12,5% and 12.5% are equal; 4 decimals."""
    percent = token.endswith("%")
    digits = F.when(percent, F.substring(token, F.lit(1), F.length(token) - 1)).otherwise(token)
    marks = F.length(F.regexp_replace(digits, r"[^.,]", ""))
    plain = F.when(marks >= 2, F.regexp_replace(digits, r"[.,]", "")).otherwise(F.replace(digits, F.lit(","), F.lit(".")))
    value = plain.try_cast("double")
    shown = F.regexp_replace(F.format_string("%.4f", value), r"\.?0+$", "")
    return F.when(value.isNull(), token).otherwise(F.concat(shown, F.when(percent, "%").otherwise("")))


def bound(value: Column, use) -> Column:
    """use(value) with `value` computed once: inside a lambda Spark would compute it per element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def unverified_numbers(answer: Column, context: Column) -> Column:
    """Number tokens of the answer (duplicates kept) whose canonical form the context lacks."""
    said, known = number_tokens(answer), number_tokens(context)
    missing = F.array_except(F.transform(said, canonical_number), F.transform(known, canonical_number))
    return bound(missing, lambda m: F.filter(said, lambda t: F.array_contains(m, canonical_number(t))))


def chunk_id(collection: Column, key: Column, text: Column) -> Column:
    return F.sha1(F.concat(collection, F.lit(":"), key, F.lit("::"), text))


def query_key(text: Column) -> Column:
    return F.md5(strip(F.lower(text)))


def adaptive_k(text: Column, base: int) -> Column:
    """Short open questions read more chunks, long or specific ones fewer."""
    count = F.size(words(text))
    specific = text.rlike(SPECIFIC)
    return (
        F.when((count <= 4) & ~specific, min(base * 2, 10))
        .when((count >= 14) | specific, max(3, base - 2))
        .otherwise(base)
    )
