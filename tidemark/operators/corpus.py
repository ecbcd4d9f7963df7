"""Corpus chunks and the incremental index over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import MIN_CHUNK_LENGTH, chunk_id, strip
from tidemark.functions.vectors import embedded, hashed_embedding
from tidemark.plans.session import cut_lineage

MAX_DELETE_RATIO = 0.5


def build_chunks(sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Chunks of several collections; keyless or short records are left out, one row per chunk id.

    `sources` maps a collection name to (records, source type); records have
    id, text and optionally topic and updated_at.
    """
    out = None
    for collection, (records, source_type) in sources.items():
        def field(name: str) -> Column:
            return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in records.columns else F.lit("")

        text, key = strip(F.coalesce("text", F.lit(""))), F.nullif(F.col("id").cast("string"), F.lit(""))
        rows = records.select(
            text.alias("text"), key.alias("id"), field("topic").alias("topic"), F.lit(source_type).alias("source_type"),
            F.lit(collection).alias("source_collection"), field("updated_at").alias("updated_at"),
        ).where(F.col("id").isNotNull() & (F.length("text") >= MIN_CHUNK_LENGTH))
        rows = rows.select(chunk_id(F.col("source_collection"), F.col("id"), F.col("text")).alias("chunk_id"), "*")
        # Same id means same collection, key and text; the latest record speaks for it.
        rows = rows.groupBy("chunk_id").agg(F.max_by(F.struct(*rows.columns[1:]), F.struct("updated_at", "topic")).alias("r"))
        rows = rows.select("chunk_id", "r.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def skipped_records(sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """How many records of each collection are indexable and how many are left out."""
    out = None
    for collection, (records, _) in sources.items():
        ok = F.col("id").isNotNull() & (F.length(strip(F.coalesce("text", F.lit("")))) >= MIN_CHUNK_LENGTH)
        rows = records.agg(F.lit(collection).alias("source_collection"), F.count_if(ok).alias("usable"),
                           F.count_if(~ok).alias("skipped"))
        out = rows if out is None else out.unionByName(rows)
    return out


def index_delta(desired: DataFrame, existing: DataFrame) -> DataFrame:
    """(chunk_id, action): add, delete or keep, from one full outer join on the id."""
    new = desired.select("chunk_id", F.lit(True).alias("wanted"))
    old = existing.select("chunk_id", F.lit(True).alias("stored"))
    action = F.when(F.col("stored").isNull(), "add").when(F.col("wanted").isNull(), "delete").otherwise("keep")
    return new.join(old, "chunk_id", "full_outer").select("chunk_id", action.alias("action"))


def delta_counts(delta: DataFrame) -> DataFrame:
    return delta.agg(
        F.count_if(F.col("action") == "add").alias("added"), F.count_if(F.col("action") == "delete").alias("deleted"),
        F.count_if(F.col("action") == "keep").alias("unchanged"))


def guard_decision(delta: DataFrame, force: bool = False) -> DataFrame:
    """Counts of a delta and the guard's decision: apply, `empty source` or `mass delete`."""
    stored = F.col("deleted") + F.col("unchanged")
    wiped = (stored > 0) & (F.col("added") + F.col("unchanged") == 0)
    heavy = (stored > 0) & (F.col("deleted") / F.greatest(stored, F.lit(1)) > MAX_DELETE_RATIO) & ~F.lit(force)
    return delta_counts(delta).withColumn("decision", F.when(wiped, "empty source").when(heavy, "mass delete").otherwise("apply"))


def guard(added: int, deleted: int, unchanged: int, force: bool = False) -> None:
    """An empty source must not empty the index, and a mass delete needs consent."""
    stored = deleted + unchanged
    if stored and not added + unchanged:
        raise RuntimeError(f"the sources hold no chunk while the index holds {stored}")
    if stored and not force and deleted / stored > MAX_DELETE_RATIO:
        raise RuntimeError(f"{deleted} of {stored} chunks would be deleted; pass force=True to allow it")


def apply_delta(desired: DataFrame, existing: DataFrame, force: bool = False,
                embed: Callable[[Column], Column] = hashed_embedding) -> DataFrame:
    """The new index: stored rows that are still wanted plus newly embedded ones; only new text is embedded.

    The two meet once, in a full outer join that is written: the guard counts it, and the index is taken from it.
    """
    new = desired.select("chunk_id", F.struct(*desired.columns).alias("wanted"))
    old = existing.select("chunk_id", F.struct(*existing.columns).alias("stored"))
    both = cut_lineage(new.join(old, "chunk_id", "full_outer"))
    action = F.when(F.col("stored").isNull(), "add").when(F.col("wanted").isNull(), "delete").otherwise("keep")
    guard(**delta_counts(both.select(action.alias("action"))).first().asDict(), force=force)
    kept = both.where("wanted IS NOT NULL AND stored IS NOT NULL").select("stored.*")
    fresh = both.where("stored IS NULL").select("wanted.*")
    return kept.unionByName(embedded(fresh, embed=embed), allowMissingColumns=True)


def corpus_stats(index: DataFrame) -> DataFrame:
    """Chunks, vector dimensions and missing ids per source type."""
    return index.groupBy("source_type").agg(
        F.count(F.lit(1)).alias("chunks"), F.min(F.size("embedding")).alias("min_dim"),
        F.max(F.size("embedding")).alias("max_dim"),
        F.count_if(F.col("id").isNull() | (F.col("id") == "")).alias("missing_ids")).orderBy("source_type")
