"""Trained models: invariants, persistence, use on a stream."""

import random

import pytest
from helpers import frame, tx
from pyspark.sql import functions as F

from spendlens import sources
from spendlens.operators import anomaly, fraud
from spendlens.plans import QUERIES
from spendlens.streaming import jobs
from spendlens.streaming.fraud_state import predict_streaming
from spendlens import domain


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        bad = rng.random() < 0.15
        amount = rng.uniform(800, 1000) if bad else rng.uniform(1, 200)
        rows.append(tx(f"{i:04d}", f"u{i % 9}", round(amount, 2), i * 700 + rng.randrange(300),
                       status="FRAUD" if bad else "COMPLETED", device_id=f"D{rng.randrange(5)}"))
    return frame(spark, rows).coalesce(1).cache()


def test_clusters(spark, labelled, tmp_path):
    features = anomaly.transaction_features(labelled).coalesce(1).cache()
    model = anomaly.load_or_train(spark, str(tmp_path / "m"), features)
    assert -1 <= model.silhouette <= 1
    stats = anomaly.cluster_statistics(model.pipeline.transform(anomaly.without_outliers(features))).collect()
    assert len(stats) == 5 and sum(r.share for r in stats) == pytest.approx(1)
    again = anomaly.load_or_train(spark, str(tmp_path / "m"), features)
    assert again.anomalous == model.anomalous and again.silhouette is None
    model.anomalous = [0]
    found = anomaly.transaction_anomalies(features, model, "2024-01-31")
    assert 0 < found.count() < features.count()
    assert {r.anomaly_type for r in found.select("anomaly_type").distinct().collect()} == {0}


def test_split_is_repeatable(labelled):
    train, test = fraud.split_by_id(labelled)
    assert train.count() + test.count() == labelled.count()
    assert 0.7 < train.count() / labelled.count() < 0.9
    assert train.join(test, "transaction_id").isEmpty()


@pytest.fixture(scope="module")
def model(labelled):
    tx_label = labelled.withColumn("is_fraud", (F.col("status") == "FRAUD").cast("int"))
    return fraud.train_fraud_model(tx_label, trees=10, depth=5)


def test_fraud_model(labelled, model, tmp_path):
    assert model.auc > 0.95
    features = fraud.fraud_features(labelled)
    scores = fraud.score(features, model.pipeline, only_fraud=False)
    assert scores.count() == labelled.count()
    assert scores.filter("fraud_probability < 0 OR fraud_probability > 1").isEmpty()
    frauds = fraud.score(features, model.pipeline).join(labelled.select("transaction_id", "status"), "transaction_id")
    assert frauds.filter("status = 'FRAUD'").count() / frauds.count() > 0.9
    model.save(str(tmp_path / "f"))
    loaded = fraud.load_fraud_model(str(tmp_path / "f"))
    assert fraud.score(features, loaded).count() == frauds.count()


def test_named_columns_are_hashed(labelled):
    tx_label = labelled.withColumn("is_fraud", (F.col("status") == "FRAUD").cast("int"))
    model = fraud.train_fraud_model(tx_label, trees=5, depth=4, hashed=("category", "device_id"), buckets=16)
    assert [type(s).__name__ for s in model.pipeline.stages].count("FeatureHasher") == 2
    assert model.auc > 0.9


def test_node_ids_are_kept_and_the_forest_is_the_same(labelled):
    """Levels do not start at the roots again; the trees are those without kept ids."""
    rows = fraud.model_input(fraud.fraud_features(labelled)).withColumn("is_fraud", (F.col("status") == "FRAUD").cast("int"))
    kept, plain = fraud.fraud_pipeline(trees=5, depth=6), fraud.fraud_pipeline(trees=5, depth=6)
    assert kept.getStages()[-1].getCacheNodeIds() and kept.getStages()[-1].getCheckpointInterval() == -1
    plain.getStages()[-1].setParams(cacheNodeIds=False, checkpointInterval=10)
    trees = [[t.toDebugString.split("\n", 1)[1] for t in p.fit(rows.coalesce(1)).stages[-1].trees] for p in (kept, plain)]
    assert trees[0] == trees[1] and max(map(len, trees[0])) > 100


def test_stream_scores(spark, labelled, model, tmp_path):
    labelled.write.parquet(str(tmp_path / "in"))
    stream = sources.read_stream(spark, "parquet", domain.TRANSACTION_SCHEMA, str(tmp_path / "in"))
    out = predict_streaming(stream, model.pipeline)
    jobs.run_to_end(spark, jobs.write_append(out, "p", str(tmp_path / "out"), str(tmp_path / "cp"), True))
    got = {r.transaction_id: r.fraud_probability for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.transaction_id: r.fraud_probability
            for r in fraud.score(fraud.fraud_features(labelled), model.pipeline).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_rows_without_user_or_time_are_scored(spark, labelled, model, tmp_path):
    rows = labelled.limit(40).unionByName(labelled.limit(3).withColumn("user_id", F.lit(None).cast("string")))
    rows = rows.unionByName(labelled.limit(3).withColumn("timestamp", F.lit(None).cast("timestamp")))
    rows.write.parquet(str(tmp_path / "in"))
    stream = sources.read_stream(spark, "parquet", domain.TRANSACTION_SCHEMA, str(tmp_path / "in"))
    out = predict_streaming(stream, model.pipeline, only_fraud=False)
    jobs.run_to_end(spark, jobs.write_append(out, "p", str(tmp_path / "out"), str(tmp_path / "cp"), True))
    batch = fraud.score(fraud.fraud_features(spark.read.parquet(str(tmp_path / "in"))), model.pipeline, only_fraud=False)
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count() == 46


@pytest.mark.parametrize("name", ["m8_score_invariants", "p10_predicted_frauds"])
def test_checks_use_the_production_forest(spark, sf_dir, monkeypatch, name):
    settings = []

    def train(tx, **kwargs):
        settings.append(kwargs)
        raise InterruptedError

    monkeypatch.setattr(fraud, "train_fraud_model", train)
    with pytest.raises(InterruptedError):
        QUERIES[name](spark, sf_dir)
    assert settings == [{}]


def test_training_label_from_status(spark, labelled, tmp_path):
    labelled.write.parquet(str(tmp_path / "t"))
    df = sources.read_training_data(spark, str(tmp_path / "t"))
    assert df.filter("is_fraud = 1").count() == labelled.filter("status = 'FRAUD'").count()


@pytest.mark.parametrize("name", ["m8_fraud_scores", "k9_saved_forest", "s10_loaded_model", "m4_transaction_anomalies"])
def test_features_are_computed_once(spark, sf_dir, name):
    """Scoring reads the features that the training computed: no window runs over the transactions again."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "features" in plan and "events.parquet" not in plan
