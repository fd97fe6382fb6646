"""Anomaly detection: behaviour against the user's baseline, and clustering of single transactions."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from spendlens.functions import columns as C
from spendlens.operators.timeline import behaviour_features, merchant_features

# The features that are clustered, in order.
CLUSTER_FEATURES = ["amount_zscore", "time_since_last", "transactions_last_hour", "amount_ratio",
                    "merchant_frequency"]


# --- behaviour against baseline -----------------------------------------------------------------------

def recent_windows(aggregates: DataFrame, as_of=None, recency: str = "1 HOUR") -> DataFrame:
    return aggregates.filter(F.col("window_end") > C.as_of_or_now(as_of) - F.expr(f"INTERVAL {recency}"))


def is_anomalous(threshold: float = 3.0) -> Column:
    return ((F.col("spend_zscore") > threshold) | (F.col("transaction_zscore") > threshold)
            | (F.col("unusual_category") == 1))


def scored_windows(aggregates: DataFrame, as_of=None, recency: str = "1 HOUR",
                   categories_from: str = "history") -> DataFrame:
    """Recent windows with their z-scores and the unusual-category flag.

    A category is unusual when the user's windows before the recent ones never had it. With
    ``categories_from="all"`` the recent ones count as well, so nothing is unusual. Membership is a join on
    (user, category); no set of categories is built per user.
    """
    if categories_from not in ("history", "all"):
        raise ValueError("categories_from must be 'history' or 'all'")
    baseline = aggregates.groupBy("user_id").agg(
        F.avg("total_amount").alias("_mean_spend"), F.stddev("total_amount").alias("_std_spend"),
        F.avg("transaction_count").alias("_mean_count"), F.stddev("transaction_count").alias("_std_count"))
    history = aggregates
    if categories_from == "history":
        history = aggregates.filter(F.col("window_end") <= C.as_of_or_now(as_of) - F.expr(f"INTERVAL {recency}"))
    known = history.select("user_id", "category").distinct().withColumn("_known", F.lit(True))
    unusual = F.when(F.col("category").isNotNull() & F.col("_known").isNull(), 1).otherwise(0)
    joined = (recent_windows(aggregates, as_of, recency).join(baseline, "user_id")
              .join(known, ["user_id", "category"], "left"))
    return joined.withColumns({
        "spend_zscore": C.zscore("total_amount", "_mean_spend", "_std_spend"),
        "transaction_zscore": C.zscore("transaction_count", "_mean_count", "_std_count"),
        "unusual_category": unusual,
    }).select(*aggregates.columns, "spend_zscore", "transaction_zscore", "unusual_category")


def behaviour_anomalies(aggregates: DataFrame, as_of=None, recency: str = "1 HOUR", threshold: float = 3.0,
                        categories_from: str = "history") -> DataFrame:
    """Recent windows that break the user's habits in spend, frequency or category."""
    return scored_windows(aggregates, as_of, recency, categories_from).filter(is_anomalous(threshold)).select(
        "user_id", "category", "total_amount", "transaction_count", "spend_zscore", "transaction_zscore",
        "unusual_category", C.as_of_or_now(as_of).alias("detected_at"))


# --- clustering of transactions -------------------------------------------------------------------------

def transaction_features(tx: DataFrame) -> DataFrame:
    """Time, behaviour and merchant features of every transaction, without NULLs."""
    out = merchant_features(behaviour_features(tx), tx).withColumns({
        "hour": F.hour("timestamp"), "day_of_week": F.dayofweek("timestamp"),
    }).withColumns({"is_weekend": C.is_weekend("day_of_week"), "is_night": C.is_night("hour")})
    # What stands in for a missing feature.
    out = out.fillna({"time_since_last": 3600, "amount_zscore": 0.0, "amount_ratio": 1.0, "merchant_frequency": 1})
    return out.withColumn("avg_merchant_amount", F.coalesce("avg_merchant_amount", "amount"))


def without_outliers(features: DataFrame) -> DataFrame:
    """Rows the clustering learns from (fixed values: the limits)."""
    return features.filter(
        F.col("amount_zscore").between(-3, 3) & (F.col("time_since_last") < 86_400)
        & (F.col("transactions_last_hour") < 100) & F.col("amount_ratio").between(0.1, 10))


def cluster_pipeline(k: int = 5, seed: int = 42) -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=CLUSTER_FEATURES, outputCol="features"),
        StandardScaler(inputCol="features", outputCol="scaled_features", withStd=True, withMean=True),
        KMeans(k=k, seed=seed, featuresCol="scaled_features", predictionCol="cluster"),
    ])


def cluster_statistics(clustered: DataFrame) -> DataFrame:
    """Size, share, amounts and mean z-score per cluster; the share is taken over the few aggregated rows."""
    stats = clustered.groupBy("cluster").agg(
        F.count("*").alias("count"), F.avg("amount").alias("avg_amount"), F.stddev("amount").alias("std_amount"),
        F.avg("amount_zscore").alias("avg_zscore"))
    everything = Window.partitionBy(F.lit(1))
    return stats.withColumn("share", F.col("count") / F.sum("count").over(everything))


def anomalous_clusters(statistics: DataFrame, max_share: float = 0.05, min_zscore: float = 1.5) -> DataFrame:
    """Small clusters far from the usual amount (fixed values: a share of 5 %, a z-score of 1.5)."""
    return statistics.filter((F.col("share") < max_share) & (F.abs("avg_zscore") > min_zscore)).select("cluster")


class ClusterModel:
    """A fitted pipeline together with the ids of its anomalous clusters."""

    def __init__(self, pipeline: PipelineModel, anomalous: list[int], silhouette: float | None = None):
        self.pipeline, self.anomalous, self.silhouette = pipeline, anomalous, silhouette

    def save(self, spark: SparkSession, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        ids = spark.createDataFrame([(i,) for i in self.anomalous], "cluster int")
        ids.coalesce(1).write.mode("overwrite").parquet(f"{path}/anomalous_clusters")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ClusterModel":
        ids = spark.read.parquet(f"{path}/anomalous_clusters")
        return cls(PipelineModel.load(f"{path}/pipeline"), [r.cluster for r in ids.collect()])


def train_clusters(features: DataFrame, k: int = 5, seed: int = 42, evaluate: bool = True, max_share: float = 0.05,
                   min_zscore: float = 1.5) -> ClusterModel:
    """Fit, measure and pick the anomalous clusters. Only the k statistics rows reach the driver."""
    training = without_outliers(features).select("amount", *CLUSTER_FEATURES)
    training = training.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = cluster_pipeline(k, seed).fit(training)
        clustered = model.transform(training)
        chosen = anomalous_clusters(cluster_statistics(clustered), max_share, min_zscore)
        ids = [r.cluster for r in chosen.collect()]
        silhouette = None
        if evaluate:
            silhouette = ClusteringEvaluator(featuresCol="scaled_features", predictionCol="cluster").evaluate(clustered)
    finally:
        training.unpersist()
    return ClusterModel(model, sorted(ids), silhouette)


def load_or_train(spark: SparkSession, path: str, features: DataFrame, k: int = 5, seed: int = 42) -> ClusterModel:
    """The saved model, or a new one that is saved for the next call."""
    if model_exists(spark, f"{path}/pipeline/metadata"):
        return ClusterModel.load(spark, path)
    model = train_clusters(features, k, seed)
    model.save(spark, path)
    return model


def model_exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        return not spark.read.text(path).isEmpty()
    except AnalysisException:
        return False


def transaction_anomalies(features: DataFrame, model: ClusterModel, as_of=None) -> DataFrame:
    """Transactions that fall into an anomalous cluster."""
    return (model.pipeline.transform(features).filter(F.col("cluster").isin(model.anomalous))
            .select("transaction_id", "user_id", "amount", "merchant", "category", "timestamp",
                    F.col("features").alias("anomaly_features"), F.col("cluster").alias("anomaly_type"),
                    C.as_of_or_now(as_of).alias("detected_at")))
