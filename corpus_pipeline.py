"""A training-data pipeline in five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and works on all rows the stage before it kept; `run` writes each stage's rows
to the shared folder and reads them again, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontam, linededup, ngramjoin, quality
from tidemark.llm.base import read, stored

TOKENIZER = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the word rules or the compression bands go."""
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words or more go; a document that loses all its words goes with them."""
    return linededup.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.75 the smallest id stays."""
    return ngramjoin.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window of ten words, or with a whole shorter item, go."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed, see tidemark.llm.bpe) and the text decoded from them."""
    return bpe.encode(docs, public_tokenizers.path(TOKENIZER), decoded="decoded")


STAGES = [
    ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate), ("bpe_encode", bpe_encode)]

#: BPE merges and zstandard ratios are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
