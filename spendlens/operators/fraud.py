"""Fraud classification: features, training, scoring."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import FeatureHasher, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from spendlens.functions import columns as C
from spendlens.operators.timeline import recent_history

# Encoded and numeric features.
CATEGORICAL = ["category", "device_id"]
NUMERIC = ["amount", "hour_of_day", "day_of_week", "amount_log", "avg_last_10", "std_last_10", "count_last_hour"]


def row_features() -> dict[str, Column]:
    """Features that need nothing but the row."""
    hour, day = F.hour("timestamp"), F.dayofweek("timestamp")
    return {
        "hour_of_day": hour, "day_of_week": day, "is_weekend": C.is_weekend(day), "is_night": C.is_night(hour),
        "amount_log": F.log(F.col("amount") + 1), "amount_squared": F.pow("amount", F.lit(2)),
        "is_high_value": F.when(F.col("amount") > 500, 1).otherwise(0), "location_change": F.lit(0),
    }


def fraud_features(tx: DataFrame) -> DataFrame:
    """Row features and the recent history of the user; a user's first rows have no history (NULL)."""
    return recent_history(tx).withColumns(row_features())


def model_input(features: DataFrame) -> DataFrame:
    """Missing history counts as 0, a missing time as hour -1 of day 0, and a missing category or device as its own value."""
    return features.fillna({"avg_last_10": 0.0, "std_last_10": 0.0, "count_last_hour": 0, "hour_of_day": -1,
                            "day_of_week": 0}).fillna("", subset=CATEGORICAL)


def fraud_pipeline(label: str = "is_fraud", trees: int = 100, depth: int = 10, seed: int = 42,
                   hashed: Sequence[str] = ("device_id",), buckets: int = 32) -> Pipeline:
    """Encoded categories, seven numbers, a random forest.

    The values of a one-hot column are indexed on the driver, which suits a fixed domain. Columns whose values grow with
    the data are named in ``hashed`` and go into a vector of ``buckets`` places, whatever their number of values; many places
    would crowd out the numbers, as a tree looks at the square root of all features only.

    The node that a row has reached in each tree is kept from level to level, on disk where memory is short; otherwise every
    level would send all rows through all trees from their roots again. The forest is the same. Levels are too few to need
    checkpoints of them.
    """
    indexed = [c for c in CATEGORICAL if c not in hashed]
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep") for c in indexed]
    stages += [OneHotEncoder(inputCol=f"{c}_index", outputCol=f"{c}_encoded") for c in indexed]
    stages += [FeatureHasher(inputCols=[c], outputCol=f"{c}_encoded", numFeatures=buckets) for c in hashed]
    stages.append(VectorAssembler(inputCols=[f"{c}_encoded" for c in CATEGORICAL] + NUMERIC, outputCol="features"))
    stages.append(RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth,
                                         seed=seed, featureSubsetStrategy="auto", impurity="gini",
                                         cacheNodeIds=True, checkpointInterval=-1))
    return Pipeline(stages=stages)


@dataclass
class TrainedFraudModel:
    pipeline: PipelineModel
    auc: float

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(path)


def split_by_id(df: DataFrame, train_share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test parts by a hash of the id: the same rows on every run and after a lost executor."""
    bucket = F.pmod(F.xxhash64(F.lit(seed), "transaction_id"), F.lit(1000))
    return df.filter(bucket < int(train_share * 1000)), df.filter(bucket >= int(train_share * 1000))


def train_fraud_model(tx: DataFrame, label: str = "is_fraud", trees: int = 100, depth: int = 10, seed: int = 42,
                      hashed: Sequence[str] = ("device_id",), buckets: int = 32) -> TrainedFraudModel:
    """Features, unless the transactions come with theirs, 80/20 split, fit, AUC on the held-out part."""
    features = tx if set(NUMERIC) <= set(tx.columns) else fraud_features(tx)
    features = model_input(features).select("transaction_id", label, *CATEGORICAL, *NUMERIC)
    features = features.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        train, test = split_by_id(features, 0.8, seed)
        pipeline = fraud_pipeline(label, trees, depth, seed, hashed, buckets).fit(train)
        auc = BinaryClassificationEvaluator(labelCol=label).evaluate(pipeline.transform(test))
    finally:
        features.unpersist()
    return TrainedFraudModel(pipeline, auc)


def load_fraud_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score(features: DataFrame, model: PipelineModel, only_fraud: bool = True, as_of=None,
          keep: Sequence[str] = ()) -> DataFrame:
    """Predictions with the fraud probability; works on a batch or a stream of features."""
    scored = model.transform(model_input(features)).select(
        *keep, "transaction_id", "user_id", "amount", "merchant", "prediction",
        vector_to_array("probability")[1].alias("fraud_probability"), C.as_of_or_now(as_of).alias("prediction_time"))
    return scored.filter(F.col("prediction") == 1) if only_fraud else scored
