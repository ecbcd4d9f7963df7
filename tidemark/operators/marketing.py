"""Campaign dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.quantiles import approx_quantiles, quantiles
from tidemark.functions.semantics import in_range, key_or_unknown, money_sum


def performance(campaigns: DataFrame, start, end, limit: int = 20) -> DataFrame:
    """Best return on spend first, with the cost per conversion."""
    return (
        campaigns.where(in_range("start_date", start, end))
        .select(
            F.coalesce("campaign_code", F.lit("")).alias("campaign_code"),
            F.coalesce("name", F.lit("")).alias("name"),
            key_or_unknown("type").alias("type"),
            F.coalesce("spend_idr", F.lit(0.0)).alias("spend_idr"),
            F.coalesce("revenue_generated_idr", F.lit(0.0)).alias("revenue_generated_idr"),
            F.coalesce("roi", F.lit(0.0)).alias("roi"),
            F.coalesce("conversion_rate", F.lit(0.0)).alias("conversion_rate"),
            F.try_divide(F.col("spend_idr"), F.col("conversions").cast("double")).alias("cpa_idr"),
        )
        .orderBy(F.desc("roi"), "campaign_code")
        .limit(limit)
    )


def type_summary(campaigns: DataFrame, start, end) -> DataFrame:
    roi = F.col("roi").cast("decimal(28,10)")
    return (
        campaigns.where(in_range("start_date", start, end))
        .groupBy(key_or_unknown("type").alias("type"))
        .agg(
            money_sum("spend_idr").alias("total_spend_idr"),
            money_sum("revenue_generated_idr").alias("total_revenue_idr"),
            F.round(F.try_divide(F.sum(roi).cast("double"), F.count(roi)), 6).alias("avg_roi"),
        )
        .orderBy(F.desc("total_revenue_idr"), "type")
    )


def funnel(campaigns: DataFrame, start, end) -> DataFrame:
    """Reach to conversion per campaign."""
    steps = ["reach", "impressions", "clicks", "conversions"]
    return (
        campaigns.where(in_range("start_date", start, end))
        .select(
            "campaign_code", F.coalesce("name", F.lit("")).alias("name"),
            *[F.coalesce(s, F.lit(0)).cast("bigint").alias(s) for s in steps],
        )
        .orderBy("campaign_code")
    )


def cost_per_conversion(campaigns: DataFrame, exact: bool = True) -> DataFrame:
    """Median cost per conversion by campaign type, cheapest first."""
    rows = campaigns.where(F.col("conversions") > 0).select(
        key_or_unknown("type").alias("type"),
        (F.col("spend_idr") / F.col("conversions").cast("double")).alias("cpa"),
    )
    pick = quantiles if exact else approx_quantiles
    return (
        pick(rows, "cpa", {"median_cpa_idr": 0.5}, by=["type"])
        .select("type", F.col("n").alias("campaigns"), F.round("median_cpa_idr", 6).alias("median_cpa_idr"))
        .orderBy("median_cpa_idr", "type")
    )
