"""Customer clusters on log-scaled RFM."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.quantiles import approx_quantiles, quantiles_of

RFM = ["recency_days", "frequency", "monetary_total"]


def log_rfm(features: DataFrame) -> DataFrame:
    return features.select("*", *[F.log1p(F.col(c).cast("double")).alias(f"log_{c}") for c in RFM])


def cluster_estimator(k: int = 5, seed: int = 42) -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=[f"log_{c}" for c in RFM], outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
        KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster"),
    ])


def fit_clusters(features: DataFrame, k: int = 5, seed: int = 42) -> PipelineModel:
    return cluster_estimator(k, seed).fit(log_rfm(features))


def assign_clusters(model: PipelineModel, features: DataFrame) -> DataFrame:
    return model.transform(log_rfm(features)).drop("raw", "features", *[f"log_{c}" for c in RFM])


def silhouette(model: PipelineModel, features: DataFrame) -> float:
    return ClusteringEvaluator(predictionCol="cluster").evaluate(model.transform(log_rfm(features)))


def cluster_profile(clustered: DataFrame, exact: bool = True) -> DataFrame:
    """Size, median spend, median recency and share of single bookers per cluster."""
    sizes = clustered.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("customers"), F.avg((F.col("track") == "single").cast("int")).alias("single_share"))
    names = {"monetary_total": {"median_spend_idr": 0.5}, "recency_days": {"median_recency_days": 0.5}}
    if exact:
        medians = quantiles_of(clustered.select("cluster", *names), names, ["cluster"])
    else:
        spend, recency = (approx_quantiles(clustered, m, p, ["cluster"]).drop("n") for m, p in names.items())
        medians = spend.join(recency, "cluster")
    return sizes.join(medians, "cluster").select(
        "cluster", "customers", "single_share", F.round("median_spend_idr", 4).alias("median_spend_idr"),
        F.round("median_recency_days", 4).alias("median_recency_days"),
    ).orderBy(F.desc("median_spend_idr"), "cluster")
