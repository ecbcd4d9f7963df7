"""Customer features, churn labels, training, gated deployment and scoring."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import QuantileDiscretizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.quantiles import values_at_ranks
from tidemark.functions.semantics import (
    CANCELLED, as_date, booking_track, committed, half_even, key_or_unknown, money_avg, money_sum,
    object_id, risk_bucket, whole_days,
)
from tidemark.plans.session import broadcast_if_small, cut_lineage, small_enough

# Fixed values of the feature contract, in model order.
CATEGORIES = {
    "review_sentiment": ["Negative", "Neutral", "No Review", "Positive"],
    "segment": ["Bronze", "Diamond", "Gold", "Platinum", "Silver"],
    "acquisition_channel": ["Email", "Google Ads", "Instagram", "Mobile App", "Partner Agency", "Referral",
                            "TikTok", "Walk-in", "Website", "WhatsApp"],
}
NUMERIC = ["recency_days", "frequency", "monetary_total", "monetary_avg", "pax_avg", "nights_avg", "tenure_days",
           "avg_interval", "recency_ratio", "cancel_rate", "review_rating", "aspect_value", "has_review", "age"]
CONTRACT = NUMERIC + [f"{c}_{v}" for c, values in CATEGORIES.items() for v in values]
LABEL_WINDOW_DAYS = 365
# How the latest review's null fields are treated in training and in scoring alike.
NULL_POLICY = "skip"
AUC_TOLERANCE = 0.01
MAX_INLINE_IDS = 100


def only_ids(df: DataFrame, ids: Sequence[str] | DataFrame, column: str = "customer_id") -> DataFrame:
    """Rows of the wanted ids: a literal list when short, a semi join when it is a table."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(column)), column, "left_semi")
    if len(ids) > MAX_INLINE_IDS:
        raise ValueError(f"more than {MAX_INLINE_IDS} ids: pass them as a DataFrame")
    return df.where(F.col(column).isin(*ids))


def valid_ids(ids: DataFrame, column: str = "customer_id") -> DataFrame:
    """24-hex ids; anything else in the table is an error."""
    broken = ids.where(F.col(column).isNull() | object_id(F.col(column)).isNull()).limit(1).count()
    if broken:
        raise ValueError(f"{column} holds values that are not 24 hex digits")
    return ids


def booking_features(bookings: DataFrame, snapshot, label_days: int | None = None) -> DataFrame:
    """RFM and cancellation per customer, and with `label_days` the return flag: one scan, one shuffle."""
    snapshot = as_date(snapshot)
    at = F.lit(snapshot).cast("timestamp")
    last_day = snapshot + timedelta(days=label_days or 0)
    seen = F.col("booking_date") <= F.lit(snapshot)
    valid = committed() & seen
    aggregates = [
        F.max(F.when(valid, F.col("booking_date"))).alias("last_booking"),
        F.min(F.when(valid, F.col("booking_date"))).alias("first_booking"),
        F.count_if(valid).alias("frequency"),
        money_sum("total_price_idr", valid).alias("monetary_total"),
        money_avg("total_price_idr", valid).alias("monetary_avg"),
        F.avg(F.when(valid, F.col("pax_count"))).alias("pax_avg"),
        F.avg(F.when(valid, F.col("nights"))).alias("nights_avg"),
        F.avg(F.when(seen, (F.col("status") == CANCELLED).cast("int"))).alias("cancel_rate"),
    ]
    if label_days is not None:
        aggregates.append(F.coalesce(F.max(committed() & ~seen), F.lit(False)).alias("returned"))
    rows = bookings.where(F.col("booking_date") <= F.lit(last_day)).groupBy("customer_id").agg(*aggregates)
    gap = whole_days("last_booking", "first_booking") / (F.col("frequency") - 1)
    return (
        rows.where(F.col("frequency") > 0)
        .withColumn("cancel_rate", F.coalesce("cancel_rate", F.lit(0.0)))
        .withColumn("recency_days", whole_days(at, "last_booking"))
        .withColumn("tenure_days", whole_days(at, "first_booking"))
        .withColumn("avg_interval", F.when(F.col("frequency") > 1, gap))
        .withColumn("recency_ratio", F.try_divide(
            F.col("recency_days").cast("double"), F.nullif(F.col("avg_interval"), F.lit(0.0))))
        .withColumn("track", booking_track(F.col("frequency")))
    )


def rfm(bookings: DataFrame, snapshot) -> DataFrame:
    return booking_features(bookings, snapshot).select(
        "customer_id", "last_booking", "first_booking", "frequency", "monetary_total", "monetary_avg",
        "pax_avg", "nights_avg", "recency_days", "tenure_days", "avg_interval", "recency_ratio", "track")


def cancel_rate(bookings: DataFrame, snapshot) -> DataFrame:
    """Share of cancelled bookings over everything booked so far."""
    return (
        bookings.where(F.col("booking_date") <= F.lit(as_date(snapshot)))
        .groupBy("customer_id")
        .agg(F.avg((F.col("status") == CANCELLED).cast("int")).alias("cancel_rate"))
    )


def review_features(reviews: DataFrame, snapshot, null_policy: str = "keep") -> DataFrame:
    """Latest review per customer and the mean value-for-money.

    `keep` takes the fields of the latest review even when null (scoring rule);
    `skip` takes the latest non-null value of each field (training-job rule).
    """
    newest = F.struct("review_date", "review_id")

    def latest(name: str) -> Column:
        if null_policy == "keep":
            return F.max_by(name, newest)
        return F.max_by(name, F.when(F.col(name).isNotNull(), newest))

    return (
        reviews.where(F.col("review_date") <= F.lit(as_date(snapshot)))
        .groupBy("customer_id")
        .agg(latest("rating").alias("review_rating"), latest("sentiment").alias("review_sentiment"),
             F.avg("aspects.value_for_money").alias("aspect_value"))
    )


def profile_features(customers: DataFrame) -> DataFrame:
    """Age, segment and channel only: stored totals would leak the label."""
    return customers.select("customer_id", "age", "segment", "acquisition_channel")


def churn_features(bookings: DataFrame, reviews: DataFrame, customers: DataFrame, snapshot,
                   label_days: int | None = None, null_policy: str = "keep") -> DataFrame:
    """All features per customer; every input is first reduced on the same key."""
    base = booking_features(bookings, snapshot, label_days)
    return (
        base.join(review_features(reviews, snapshot, null_policy), "customer_id", "left")
        .join(profile_features(customers), "customer_id", "left")
        .withColumn("has_review", F.col("review_rating").isNotNull().cast("int"))
        .withColumn("review_sentiment", F.coalesce("review_sentiment", F.lit("No Review")))
    )


def align_features(features: DataFrame, contract: Sequence[str] = CONTRACT, keep: Sequence[str] = ()) -> DataFrame:
    """One column per contract entry, in order; unseen or null categories are all zeros.

    The columns of `keep` go along unchanged, as kept_<name>.
    """
    picked = ["customer_id"] + [c for c in ("track", "label", "weight") if c in features.columns]
    columns = [F.col(c) for c in picked]
    for name in contract:
        category = next((c for c in CATEGORIES if name.startswith(f"{c}_") and name not in features.columns), None)
        if category:
            hit = F.col(category) == name[len(category) + 1:]
            columns.append(F.coalesce(hit.cast("int"), F.lit(0)).alias(name))
        elif name in features.columns:
            columns.append(F.col(name).cast("double").alias(name))
        else:
            raise ValueError(f"feature {name} of the contract is missing")
    return features.select(*columns, *[F.col(c).alias(f"kept_{c}") for c in keep])


def unseen_categories(features: DataFrame, contract: Sequence[str] = CONTRACT) -> DataFrame:
    """Category values without a contract entry, and how many customers carry them."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in CATEGORIES]))
    known = F.concat("feature", F.lit("_"), "value").isin(*contract)
    return (
        features.select(pairs.alias("p")).select("p.*")
        .where(F.col("value").isNotNull() & ~known)
        .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("customers"))
        .orderBy("feature", "value")
    )


def churn_labels(bookings: DataFrame, snapshot, window: int = LABEL_WINDOW_DAYS) -> DataFrame:
    """1 when nobody came back in the window and the silence exceeds three personal intervals."""
    return with_label(booking_features(bookings, snapshot, window), window).select(
        "customer_id", "frequency", "recency_days", "avg_interval", "returned", "label")


def with_label(features: DataFrame, window: int = LABEL_WINDOW_DAYS) -> DataFrame:
    silent = F.coalesce(F.col("recency_days") + window > 3 * F.col("avg_interval"), F.lit(True))
    return features.withColumn("label", (~F.col("returned") & silent).cast("int"))


def split_hash(key: str, seed: int) -> Column:
    """Reproducible pseudo-random non-negative number of a row."""
    text = F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def stratified_split(df: DataFrame, label: str = "label", share: float = 0.2, seed: int = 42,
                     key: str = "customer_id") -> DataFrame:
    """Flag exactly ceil(share * n) rows of every class as test, without ranking a class in one task.

    Rows without a label are a class of their own.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("none"))
    rows = df.withColumn("_h", split_hash(key, seed)).withColumn("_class", name)
    last = F.array((F.ceil(F.col("n") * share) - 1).cast("bigint"))
    cut = values_at_ranks(rows.select("_class", "_h"), "_h", last, ["_class"]).select("_class", F.col("value").alias("_cut"))
    return rows.join(broadcast_if_small(cut), "_class").withColumn("is_test", F.col("_h") <= F.col("_cut")).drop("_h", "_cut", "_class")


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """weight = n / (2 * n_class); rows without a label are a class of their own."""
    n = df.agg(F.count(F.lit(1))).scalar()
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).withColumn("weight", n / (2.0 * F.col("_n")))
    sizes = broadcast_if_small(sizes.select(F.col(label).alias("_label"), "weight"))
    return df.join(sizes, F.col(label).eqNullSafe(F.col("_label"))).drop("_label")


#: Quantile bins of a numeric feature; missing values get one more.
BINS = 64
#: Training rows that are dealt to a few tasks only: boosting makes hundreds of small passes.
FEW_ROWS = 200_000


def churn_estimator(contract: Sequence[str] = CONTRACT, seed: int = 42, rounds: int = 20,
                    empty: Sequence[str] = ()) -> Pipeline:
    """Gradient-boosted trees over quantile bins, in which missing values have a bin of their own, so trees split on absence.

    A column of `empty` has no value in the training rows, hence no bins, and enters as 0.
    """
    numeric = [c for c in NUMERIC if c in contract]
    known, bins = [c for c in numeric if c not in empty], [f"{c}__bin" for c in numeric if c not in empty]
    absent = [f"{c}__zero" for c in numeric if c in empty]
    rest = [c for c in contract if c not in NUMERIC]
    # Bins are ordered: as sums they lose the mark of a category.
    places = ", ".join(f"{b} + 0.0 AS {b}_place" for b in bins)
    binned = [
        QuantileDiscretizer(numBuckets=BINS, relativeError=0.001, handleInvalid="keep", inputCols=[f"{c}__value" for c in known], outputCols=bins),
        SQLTransformer(statement=f"SELECT *, {places} FROM __THIS__")] if known else []
    return Pipeline(stages=[
        *binned, VectorAssembler(inputCols=[f"{b}_place" for b in bins] + absent + rest, outputCol="features"),
        GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=rounds, maxDepth=4, maxBins=BINS + 2, seed=seed),
    ])


def model_input(aligned: DataFrame, contract: Sequence[str] = CONTRACT) -> DataFrame:
    """Numeric features as doubles with NaN for what is missing, and a zero column for those without any value."""
    numeric = [c for c in NUMERIC if c in contract]
    values = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"{c}__value") for c in numeric]
    return aligned.select("*", *values, *[F.lit(0.0).alias(f"{c}__zero") for c in numeric])


def train_churn(aligned: DataFrame, contract: Sequence[str] = CONTRACT, seed: int = 42, rounds: int = 20) -> PipelineModel:
    """Fit on the training rows of `aligned` (columns label, is_test optional); rows without a label teach nothing."""
    rows = (aligned.where(~F.col("is_test")) if "is_test" in aligned.columns else aligned).where("label IS NOT NULL")
    numeric = [c for c in NUMERIC if c in contract]
    known = rows.agg(*[F.count(c).alias(c) for c in numeric]).first()
    empty = [c for c in numeric if known[c] == 0]
    ready = model_input(balanced_weights(rows), contract)
    # Written once: boosting passes over its input many times.
    ready = cut_lineage(ready.coalesce(2) if small_enough(rows, FEW_ROWS) else ready)
    return churn_estimator(contract, seed, rounds, empty).fit(ready)


def score(model: PipelineModel, aligned: DataFrame, contract: Sequence[str] = CONTRACT, keep: Sequence[str] = ()) -> DataFrame:
    """Probability at 4 digits, bucket by the unrounded probability; the columns of `keep` stay."""
    rows = model_input(aligned, contract)
    for name, value in (("weight", 1.0), ("label", 0)):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(value))
    p = F.get(vector_to_array(F.col("probability")), F.lit(1))
    return model.transform(rows).select(
        "customer_id", "track", half_even(p, 4).alias("churn_proba"), risk_bucket(p).alias("risk_bucket"), *keep)


def rescore_all(model: PipelineModel, bookings: DataFrame, reviews: DataFrame, customers: DataFrame, as_of,
                null_policy: str = NULL_POLICY) -> DataFrame:
    """The score table of every customer with history at `as_of`, with the features' null policy of training."""
    features = churn_features(bookings, reviews, customers, as_of, null_policy=null_policy)
    # The profile values travel with the row; the features are computed once.
    aligned = align_features(features, keep=("monetary_total", "tenure_days"))
    return score(model, aligned, keep=("kept_monetary_total", "kept_tenure_days")).withColumnsRenamed(
        {"kept_monetary_total": "monetary_total", "kept_tenure_days": "tenure_days"}).withColumn(
        "scored_at", F.lit(as_date(as_of)).cast("timestamp"))


def predict_churn(model: PipelineModel, ids, bookings: DataFrame, reviews: DataFrame, customers: DataFrame,
                  as_of, null_policy: str = NULL_POLICY) -> tuple[DataFrame, DataFrame]:
    """Scores of the wanted ids, and the ids that have no history."""
    spark = bookings.sparkSession
    if not isinstance(ids, DataFrame):
        ids = spark.createDataFrame([(i,) for i in ids], ["customer_id"])
    wanted = ids.select("customer_id").distinct()
    scored = rescore_all(model, only_ids(bookings, wanted), only_ids(reviews, wanted), only_ids(customers, wanted), as_of, null_policy)
    known = booking_features(only_ids(bookings, wanted), as_of).select("customer_id")
    return scored, wanted.join(known, "customer_id", "left_anti")


def auc(df: DataFrame, proba: str = "churn_proba", label: str = "label", by: str | None = None) -> DataFrame:
    """ROC-AUC as the Mann-Whitney statistic, ties counted half, on the scores as they are.

    Rows become counts per score.  These are dealt by ranges of the score; the counts below a score are those of the
    ranges before, a row per range, and those within its range.  So no track is ranked in one task.
    """
    group = key_or_unknown(by) if by else F.lit("all")
    counts = df.groupBy(group.alias("track"), F.col(proba).alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    ranges = cut_lineage(counts.repartitionByRange("track", "s").withColumn("part", F.spark_partition_id()))
    sums = ranges.groupBy("track", "part").agg(F.sum("neg").alias("neg"))
    # A row for each range and track.
    earlier = Window.partitionBy("track").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("track", "part", F.coalesce(F.sum("neg").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("track", "part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranges.withColumn("lower", F.coalesce(F.sum("neg").over(within), F.lit(0))).join(broadcast_if_small(before), ["track", "part"])
    twice = F.col("pos").cast("decimal(38,0)") * (2 * (F.col("lower") + F.col("before")) + F.col("neg"))
    totals = ranked.groupBy("track").agg(F.sum(twice).cast("double").alias("w"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    pairs = 2 * F.col("positives").cast("double") * F.col("negatives")
    return totals.select("track", "positives", "negatives", F.round(F.try_divide(F.col("w"), pairs), 6).alias("auc")).orderBy("track")


@dataclass
class Gate:
    """Outcome of comparing a new model with the deployed one."""

    auc: float
    previous: float | None
    deploy: bool


def champion_gate(new_auc: float, previous_auc: float | None, tolerance: float = AUC_TOLERANCE) -> Gate:
    """Deploy unless the new model is worse than the old one by more than the tolerance."""
    ok = previous_auc is None or new_auc >= previous_auc - tolerance
    return Gate(new_auc, previous_auc, ok)


def retrained_rows(bookings: DataFrame, reviews: DataFrame, customers: DataFrame, as_of, null_policy: str = NULL_POLICY) -> tuple[PipelineModel, DataFrame]:
    """A model of the labels of a year back, and all its rows with a held-out fifth."""
    snapshot = as_date(as_of) - timedelta(days=LABEL_WINDOW_DAYS)
    labelled = with_label(churn_features(bookings, reviews, customers, snapshot, LABEL_WINDOW_DAYS, null_policy))
    # Written once: the split, the training passes and the evaluation all read it.
    aligned = stratified_split(cut_lineage(align_features(labelled)))
    return train_churn(aligned), aligned


def gated(model: PipelineModel, aligned: DataFrame, as_of, runs: DataFrame | None = None) -> tuple[DataFrame, Gate]:
    """The one-row run record of a model on its held-out rows, gated against the last deployed run.  Only metrics reach the driver."""
    from tidemark.sources.sinks import latest_run

    snapshot = as_date(as_of) - timedelta(days=LABEL_WINDOW_DAYS)
    scored = score(model, aligned.where("is_test"), keep=("label",))
    parts = {r["track"]: r["auc"] for r in auc(scored, by="track").collect()}
    overall = auc(scored).first()["auc"]
    size = aligned.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("rate")).first()
    last = latest_run(runs, "retrain_churn").select("auc").first() if runs is not None else None
    gate = champion_gate(overall, last["auc"] if last else None)
    record = aligned.sparkSession.createDataFrame(
        [("retrain_churn", str(as_of), str(snapshot), size["n"], round(size["rate"], 4), round(overall, 4), parts,
          gate.previous, gate.deploy)],
        "job string, ran_at string, snapshot string, population long, churn_rate double, auc double,"
        " auc_by_track map<string,double>, prev_auc double, deployed boolean")
    return record, gate


def retrain(bookings: DataFrame, reviews: DataFrame, customers: DataFrame, as_of, runs: DataFrame | None = None,
            model_path: str | None = None, null_policy: str = NULL_POLICY) -> tuple[PipelineModel, DataFrame, Gate]:
    """Label a year back, train, evaluate on the held-out fifth, gate against the last deployed run.

    Returns the model, the one-row run record and the gate.
    """
    model, aligned = retrained_rows(bookings, reviews, customers, as_of, null_policy)
    record, gate = gated(model, aligned, as_of, runs)
    if gate.deploy and model_path:
        model.write().overwrite().save(model_path)
    return model, record, gate


def overview_insight(run: DataFrame) -> DataFrame:
    """The run record as one sentence for the corpus."""
    text = F.format_string(
        "[Update: %s] Churn model %s: AUC %.3f (single %.3f, repeat %.3f), churn rate %.1f%% of %,d customers.",
        F.col("ran_at").cast("string"), F.when(F.col("deployed"), "replaced").otherwise("kept"),
        F.col("auc"), F.coalesce(F.try_element_at("auc_by_track", F.lit("single")), F.lit(0.0)),
        F.coalesce(F.try_element_at("auc_by_track", F.lit("repeat")), F.lit(0.0)),
        F.col("churn_rate") * 100, F.col("population"))
    return run.select(F.lit("churn_model_overview").alias("id"), F.lit("churn").alias("topic"), text.alias("text"))


def due_to_return(bookings: DataFrame, as_of, limit: int | None = None) -> DataFrame:
    """Repeat customers whose silence is close to their usual interval."""
    z = (F.col("recency_days") - F.col("avg_interval")) / F.greatest(F.col("avg_interval"), F.lit(30.0))
    rows = booking_features(bookings, as_of).where(F.col("frequency") > 1).select(
        "customer_id", "frequency", "recency_days", F.round("avg_interval", 6).alias("avg_interval"),
        F.round(F.exp(-0.5 * z * z) + 1e-6, 6).alias("weight"))
    # The whole table is left unsorted: its order is the sink's business.
    return rows.orderBy(F.desc("weight"), "customer_id").limit(limit) if limit else rows
