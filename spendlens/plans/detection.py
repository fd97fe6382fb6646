"""Features, behaviour anomalies, alerts, clustering and fraud models."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from spendlens.functions import columns as C
from spendlens.operators import aggregates as A, alerts, anomaly, fraud, timeline as L
from spendlens.operators.metrics import counts_by
from spendlens.plans.registry import query
from spendlens.plans.tables import AS_OF, epoch, transactions, with_tx
from spendlens.session import shared_dir
from spendlens.sources import read_training_data

BEHAVIOUR_SQL = """, behaviour AS (
  SELECT *, avg(amount) OVER so_far AS mean, stddev_samp(amount) OVER so_far AS sd,
         sec - lag(sec) OVER in_order AS pause,
         count(*) OVER hour AS n_hour, avg(amount) OVER hour AS avg_hour,
         count(*) OVER (PARTITION BY user_id, merchant) AS merchant_n,
         avg(amount) OVER (PARTITION BY user_id, merchant) AS merchant_avg
  FROM tx WINDOW so_far AS (PARTITION BY user_id ORDER BY timestamp),
    in_order AS (PARTITION BY user_id ORDER BY timestamp, transaction_id),
    hour AS (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)),
scored AS (SELECT *, CASE WHEN sd > 0 THEN (amount - mean) / sd END AS z,
  CASE WHEN avg_hour <> 0 THEN amount / avg_hour END AS ratio FROM behaviour)"""


@query("w3_running_zscore", with_tx(BEHAVIOUR_SQL + "SELECT transaction_id, round(z, 6) AS amount_zscore FROM scored"))
def w3_running_zscore(spark, sf_dir):
    return L.behaviour_features(transactions(spark, sf_dir)).select(
        "transaction_id", F.round("amount_zscore", 6).alias("amount_zscore"))


@query("w4_time_since_last", with_tx(BEHAVIOUR_SQL + "SELECT transaction_id, pause AS time_since_last FROM scored"))
def w4_time_since_last(spark, sf_dir):
    return L.behaviour_features(transactions(spark, sf_dir)).select("transaction_id", "time_since_last")


@query("w5_last_hour", with_tx(BEHAVIOUR_SQL + """
SELECT transaction_id, n_hour AS transactions_last_hour, round(avg_hour, 6) AS avg_amount_last_hour,
       round(ratio, 6) AS amount_ratio FROM scored"""))
def w5_last_hour(spark, sf_dir):
    return L.behaviour_features(transactions(spark, sf_dir)).select(
        "transaction_id", "transactions_last_hour", F.round("avg_amount_last_hour", 6).alias("avg_amount_last_hour"),
        F.round("amount_ratio", 6).alias("amount_ratio"))


@query("w6_merchant_frequency", with_tx(BEHAVIOUR_SQL + """
SELECT transaction_id, merchant, merchant_n AS merchant_frequency, round(merchant_avg, 6) AS avg_merchant_amount
FROM scored"""))
def w6_merchant_frequency(spark, sf_dir):
    return L.merchant_features(transactions(spark, sf_dir)).select(
        "transaction_id", "merchant", "merchant_frequency",
        F.round("avg_merchant_amount", 6).alias("avg_merchant_amount"))


FEATURES_SQL = BEHAVIOUR_SQL + """, features AS (
  SELECT transaction_id, user_id, amount, hour(timestamp) AS hour, dayofweek(timestamp) + 1 AS day_of_week,
         CASE WHEN dayofweek(timestamp) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend,
         CASE WHEN hour(timestamp) >= 22 OR hour(timestamp) <= 6 THEN 1 ELSE 0 END AS is_night,
         coalesce(z, 0) AS amount_zscore, coalesce(pause, 3600) AS time_since_last, n_hour AS transactions_last_hour,
         avg_hour AS avg_amount_last_hour, coalesce(ratio, 1) AS amount_ratio, merchant_n AS merchant_frequency,
         coalesce(merchant_avg, amount) AS avg_merchant_amount FROM scored)"""

FEATURE_COLUMNS = """transaction_id, user_id, hour, day_of_week, is_weekend, is_night,
  round(amount_zscore, 6) AS amount_zscore, time_since_last, transactions_last_hour,
  round(avg_amount_last_hour, 6) AS avg_amount_last_hour, round(amount_ratio, 6) AS amount_ratio, merchant_frequency,
  round(avg_merchant_amount, 6) AS avg_merchant_amount"""


def _feature_columns(features):
    rounded = {"amount_zscore", "avg_amount_last_hour", "amount_ratio", "avg_merchant_amount"}
    names = ["transaction_id", "user_id", "hour", "day_of_week", "is_weekend", "is_night", "amount_zscore",
             "time_since_last", "transactions_last_hour", "avg_amount_last_hour", "amount_ratio",
             "merchant_frequency", "avg_merchant_amount"]
    longs = {"hour", "day_of_week"}
    return features.select(*[
        F.round(n, 6).alias(n) if n in rounded else F.col(n).cast("long").alias(n) if n in longs else F.col(n)
        for n in names])


@query("m1_anomaly_features", with_tx(FEATURES_SQL + f"SELECT {FEATURE_COLUMNS} FROM features"))
def m1_anomaly_features(spark, sf_dir):
    return _feature_columns(anomaly.transaction_features(transactions(spark, sf_dir)))


@query("p8_training_rows", with_tx(FEATURES_SQL + f"""
SELECT {FEATURE_COLUMNS} FROM features WHERE amount_zscore BETWEEN -3 AND 3 AND time_since_last < 86400
  AND transactions_last_hour < 100 AND amount_ratio BETWEEN 0.1 AND 10"""))
def p8_training_rows(spark, sf_dir):
    return _feature_columns(anomaly.without_outliers(anomaly.transaction_features(transactions(spark, sf_dir))))


@query("e6_filled_features", with_tx(FEATURES_SQL + """
SELECT count(*) AS n, count(amount_zscore) AS zscores, count(time_since_last) AS pauses,
       count(*) FILTER (time_since_last = 3600) AS default_pauses, count(*) FILTER (amount_zscore = 0) AS zero_zscores
FROM features"""))
def e6_filled_features(spark, sf_dir):
    return anomaly.transaction_features(transactions(spark, sf_dir)).agg(
        F.count("*").alias("n"), F.count("amount_zscore").alias("zscores"), F.count("time_since_last").alias("pauses"),
        F.count_if(F.col("time_since_last") == 3600).alias("default_pauses"),
        F.count_if(F.col("amount_zscore") == 0).alias("zero_zscores"))


@query("e1_time_features", with_tx("""
SELECT transaction_id, hour(timestamp) AS hour, dayofweek(timestamp) + 1 AS day_of_week,
       CASE WHEN dayofweek(timestamp) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend,
       CASE WHEN hour(timestamp) >= 22 OR hour(timestamp) <= 6 THEN 1 ELSE 0 END AS is_night, sec AS epoch_second
FROM tx"""))
def e1_time_features(spark, sf_dir):
    hour, day = F.hour("timestamp"), F.dayofweek("timestamp")
    return transactions(spark, sf_dir).select(
        "transaction_id", hour.cast("long").alias("hour"), day.cast("long").alias("day_of_week"),
        C.is_weekend(day).alias("is_weekend"), C.is_night(hour).alias("is_night"),
        C.epoch_second().alias("epoch_second"))


@query("e2_amount_features", with_tx("""
SELECT transaction_id, round(ln(amount + 1), 6) AS amount_log, round(pow(amount, 2), 4) AS amount_squared,
       CASE WHEN amount > 500 THEN 1 ELSE 0 END AS is_high_value, 0 AS location_change FROM tx"""))
def e2_amount_features(spark, sf_dir):
    f = fraud.row_features()
    return transactions(spark, sf_dir).select(
        "transaction_id", F.round(f["amount_log"], 6).alias("amount_log"),
        F.round(f["amount_squared"], 4).alias("amount_squared"), f["is_high_value"].alias("is_high_value"),
        f["location_change"].alias("location_change"))


HISTORY_SQL = """, history AS (
  SELECT *, avg(amount) OVER ten AS avg10, stddev_samp(amount) OVER ten AS std10,
         count(*) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n_hour
  FROM tx WINDOW ten AS (PARTITION BY user_id ORDER BY timestamp, transaction_id ROWS BETWEEN 10 PRECEDING
    AND 1 PRECEDING))"""


@query("w7_previous_ten", with_tx(HISTORY_SQL + """
SELECT transaction_id, round(avg10, 6) AS avg_last_10, round(std10, 6) AS std_last_10 FROM history"""))
def w7_previous_ten(spark, sf_dir):
    return L.recent_history(transactions(spark, sf_dir)).select(
        "transaction_id", F.round("avg_last_10", 6).alias("avg_last_10"), F.round("std_last_10", 6).alias("std_last_10"))


@query("w8_count_last_hour", with_tx(HISTORY_SQL + "SELECT transaction_id, n_hour AS count_last_hour FROM history"))
def w8_count_last_hour(spark, sf_dir):
    return L.recent_history(transactions(spark, sf_dir)).select("transaction_id", "count_last_hour")


@query("m5_fraud_features", with_tx(HISTORY_SQL + """
SELECT transaction_id, user_id, hour(timestamp) AS hour_of_day, dayofweek(timestamp) + 1 AS day_of_week,
       CASE WHEN dayofweek(timestamp) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend,
       CASE WHEN hour(timestamp) >= 22 OR hour(timestamp) <= 6 THEN 1 ELSE 0 END AS is_night,
       round(ln(amount + 1), 6) AS amount_log, round(pow(amount, 2), 4) AS amount_squared,
       CASE WHEN amount > 500 THEN 1 ELSE 0 END AS is_high_value, 0 AS location_change,
       round(avg10, 6) AS avg_last_10, round(std10, 6) AS std_last_10, n_hour AS count_last_hour FROM history"""))
def m5_fraud_features(spark, sf_dir):
    return fraud.fraud_features(transactions(spark, sf_dir)).select(
        "transaction_id", "user_id", F.col("hour_of_day").cast("long").alias("hour_of_day"),
        F.col("day_of_week").cast("long").alias("day_of_week"), "is_weekend", "is_night",
        F.round("amount_log", 6).alias("amount_log"), F.round("amount_squared", 4).alias("amount_squared"),
        "is_high_value", "location_change", F.round("avg_last_10", 6).alias("avg_last_10"),
        F.round("std_last_10", 6).alias("std_last_10"), "count_last_hour")


# --- behaviour against the baseline, on daily windows and merchants as categories -------------------------

def daily_aggregates(spark, sf_dir, member="category"):
    """Spend per user, day and category; the merchant can stand for the category, as users have usual merchants."""
    tx = transactions(spark, sf_dir).withColumn("category", F.col(member))
    return A.sliding_spend(tx, "1 day", "1 day")


def _daily_sql(member):
    return f""", aggs AS (
  SELECT (sec // 86400) * 86400 AS window_start, (sec // 86400 + 1) * 86400 AS window_end, user_id,
         {member} AS category, count(*) AS transaction_count, sum(amount) AS total_amount, avg(amount) AS avg_amount
  FROM tx GROUP BY 1, 2, 3, 4),
base AS (SELECT user_id, avg(total_amount) AS mean_spend, stddev_samp(total_amount) AS sd_spend,
  avg(transaction_count) AS mean_n, stddev_samp(transaction_count) AS sd_n,
  string_agg(DISTINCT category, ',' ORDER BY category) AS common FROM aggs GROUP BY 1),
seen AS (SELECT DISTINCT user_id, category FROM aggs
  WHERE window_end <= epoch(TIMESTAMP '{AS_OF}') - 86400),
current AS (SELECT * FROM aggs WHERE window_end > epoch(TIMESTAMP '{AS_OF}') - 86400),
judged AS (SELECT c.*, CASE WHEN sd_spend > 0 THEN (total_amount - mean_spend) / sd_spend END AS spend_z,
    CASE WHEN sd_n > 0 THEN (transaction_count - mean_n) / sd_n END AS count_z,
    CASE WHEN s.user_id IS NULL THEN 1 ELSE 0 END AS unusual
  FROM current c JOIN base USING (user_id) LEFT JOIN seen s ON s.user_id = c.user_id AND s.category = c.category)"""


@query("p4_window_bounds", with_tx(_daily_sql("category") + """
SELECT window_start, window_end, user_id, category FROM aggs"""))
def p4_window_bounds(spark, sf_dir):
    return daily_aggregates(spark, sf_dir).select(
        epoch("window_start").alias("window_start"), epoch("window_end").alias("window_end"), "user_id", "category")


@query("a10_user_baseline", with_tx(_daily_sql("category") + """
SELECT user_id, round(mean_spend, 8) AS avg_daily_spend, round(sd_spend, 6) AS std_daily_spend,
       round(mean_n, 8) AS avg_daily_transactions, round(sd_n, 6) AS std_daily_transactions,
       common AS common_categories FROM base"""))
def a10_user_baseline(spark, sf_dir):
    numbers = ["avg_daily_spend", "std_daily_spend", "avg_daily_transactions", "std_daily_transactions"]
    return A.user_baseline(daily_aggregates(spark, sf_dir)).select(
        "user_id", *[F.round(n, 8 if n.startswith("avg") else 6).alias(n) for n in numbers],
        F.concat_ws(",", "common_categories").alias("common_categories"))


@query("p7_recent_windows", with_tx(_daily_sql("category") + """
SELECT user_id, category, window_end, transaction_count, round(total_amount, 2) AS total_amount FROM current"""))
def p7_recent_windows(spark, sf_dir):
    return anomaly.recent_windows(daily_aggregates(spark, sf_dir), AS_OF, "1 DAY").select(
        "user_id", "category", epoch("window_end").alias("window_end"), "transaction_count",
        F.round("total_amount", 2).alias("total_amount"))


def _judged(spark, sf_dir):
    return anomaly.scored_windows(daily_aggregates(spark, sf_dir, "merchant"), AS_OF, "1 DAY")


@query("j2_baseline_join", with_tx(_daily_sql("merchant") + """
SELECT user_id, category, round(spend_z, 6) AS spend_zscore, round(count_z, 6) AS transaction_zscore FROM judged"""))
def j2_baseline_join(spark, sf_dir):
    return _judged(spark, sf_dir).select(
        "user_id", "category", F.round("spend_zscore", 6).alias("spend_zscore"),
        F.round("transaction_zscore", 6).alias("transaction_zscore"))


@query("e5_unusual_category", with_tx(_daily_sql("merchant") + """
SELECT user_id, category, unusual AS unusual_category FROM judged"""))
def e5_unusual_category(spark, sf_dir):
    return _judged(spark, sf_dir).select("user_id", "category", "unusual_category")


ANOMALIES_SQL = _daily_sql("merchant") + """, anomalies AS (
  SELECT * FROM judged WHERE spend_z > 2 OR count_z > 2 OR unusual = 1)"""


def _anomalies(spark, sf_dir):
    return anomaly.behaviour_anomalies(daily_aggregates(spark, sf_dir, "merchant"), AS_OF, "1 DAY", threshold=2.0)


@query("g2_behaviour_anomalies", with_tx(ANOMALIES_SQL + f"""
SELECT user_id, category, round(total_amount, 2) AS total_amount, transaction_count,
       round(spend_z, 6) AS spend_zscore, round(count_z, 6) AS transaction_zscore, unusual AS unusual_category,
       CAST(epoch(TIMESTAMP '{AS_OF}') AS BIGINT) AS detected_at FROM anomalies"""))
def g2_behaviour_anomalies(spark, sf_dir):
    return _anomalies(spark, sf_dir).select(
        "user_id", "category", F.round("total_amount", 2).alias("total_amount"), "transaction_count",
        F.round("spend_zscore", 6).alias("spend_zscore"), F.round("transaction_zscore", 6).alias("transaction_zscore"),
        "unusual_category", epoch("detected_at").alias("detected_at"))


@query("g2_all_windows", with_tx(_daily_sql("category") + """
SELECT user_id, category, transaction_count, round(spend_z, 6) AS spend_zscore FROM judged
WHERE spend_z > 2 OR count_z > 2"""))
def g2_all_windows(spark, sf_dir):
    """The form that counts recent windows as known categories, so only the scores decide."""
    found = anomaly.behaviour_anomalies(daily_aggregates(spark, sf_dir), AS_OF, "1 DAY", 2.0, categories_from="all")
    return found.select("user_id", "category", "transaction_count", F.round("spend_zscore", 6).alias("spend_zscore"))


# Alerts for every window of all days, scored by lower limits so that each alert type occurs.
ALERTS_SQL = ANOMALIES_SQL + """, typed AS (
  SELECT *, round(spend_z * 3, 6) AS sz, round(count_z * 3, 6) AS cz, round(total_amount, 2) AS total FROM anomalies),
alerts AS (SELECT *, CASE WHEN unusual = 1 THEN 'UNUSUAL_CATEGORY' WHEN sz > 5 THEN 'HIGH_SPENDING'
    WHEN cz > 5 THEN 'HIGH_FREQUENCY' ELSE 'SUSPICIOUS_PATTERN' END AS alert_type,
  CASE WHEN sz > 5 OR cz > 5 THEN 'HIGH' WHEN unusual = 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM typed)"""


def _alerts(spark, sf_dir):
    scaled = _anomalies(spark, sf_dir).withColumns({
        "spend_zscore": F.round(F.col("spend_zscore") * 3, 6),
        "transaction_zscore": F.round(F.col("transaction_zscore") * 3, 6),
        "total_amount": F.round("total_amount", 2)})
    return alerts.anomaly_alerts(scaled, AS_OF)


@query("g1_anomaly_alerts", with_tx(ALERTS_SQL + """
SELECT user_id, alert_type, severity, 'Anomaly detected: ' || alert_type || '. User: ' || user_id || '. Details: ' ||
  CASE alert_type
    WHEN 'HIGH_SPENDING' THEN 'Spent $' || total || ' which is ' || round(sz, 1) || ' standard deviations above average'
    WHEN 'HIGH_FREQUENCY' THEN 'Made ' || transaction_count || ' transactions which is ' || round(cz, 1)
      || ' standard deviations above average'
    WHEN 'UNUSUAL_CATEGORY' THEN 'Transaction in unusual category: ' || category
    ELSE 'Suspicious pattern detected' END AS message,
  total AS alert_data_amount, transaction_count AS alert_data_count, category AS alert_data_category FROM alerts"""))
def g1_anomaly_alerts(spark, sf_dir):
    return _alerts(spark, sf_dir).drop("alert_id", "created_at")


@query("b4_active_alerts", with_tx(ALERTS_SQL + """
SELECT user_id, severity, count(*) AS alert_count FROM alerts GROUP BY 1, 2"""))
def b4_active_alerts(spark, sf_dir):
    return alerts.active_alerts(_alerts(spark, sf_dir))


@query("w9_newest_alerts", with_tx(ALERTS_SQL + """
SELECT user_id, category, alert_type, CAST(position AS INTEGER) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY category DESC) AS position FROM alerts)
WHERE position <= 10"""))
def w9_newest_alerts(spark, sf_dir):
    newest = A.newest_per_user(_alerts(spark, sf_dir), 10, ts="created_at", tie="alert_data_category")
    return newest.select("user_id", F.col("alert_data_category").alias("category"), "alert_type", "position")


# --- models: results depend on training, so they are checked by tests, not by SQL -------------------------

def _learned(features, train, name):
    """What ``train`` learns from the features, and the features again for scoring. They are computed once: on the
    executors' disks while the training reads them, in the shared folder afterwards."""
    spark, path = features.sparkSession, shared_dir(features.sparkSession, name)
    held = features.persist(StorageLevel.DISK_ONLY)
    try:
        held.write.parquet(path)
        model = train(held)
    finally:
        held.unpersist()
    return model, spark.read.schema(features.schema).parquet(path)


def _clusters(spark, sf_dir, **options):
    """The clustering of the whole table, and its features."""
    features = anomaly.transaction_features(transactions(spark, sf_dir))
    return _learned(features, lambda rows: anomaly.train_clusters(rows, **options), "cluster-features")


def _forest(tx, **options):
    """The forest of labelled transactions, and of their features those that training and scores need."""
    needed = dict.fromkeys(["transaction_id", "user_id", "amount", "merchant", "is_fraud", *fraud.CATEGORICAL, *fraud.NUMERIC])
    features = fraud.fraud_features(tx).select(*needed)
    return _learned(features, lambda rows: fraud.train_fraud_model(rows, **options), "fraud-features")


@query("m2_cluster_statistics")
def m2_cluster_statistics(spark, sf_dir):
    """Train the clustering on the whole table and describe its clusters."""
    model, features = _clusters(spark, sf_dir, evaluate=False)
    return anomaly.cluster_statistics(model.pipeline.transform(anomaly.without_outliers(features)))


@query("m4_transaction_anomalies")
def m4_transaction_anomalies(spark, sf_dir):
    """A wider rule than the default, which finds no cluster in evenly spread data."""
    model, features = _clusters(spark, sf_dir, evaluate=False, max_share=0.3, min_zscore=0.5)
    return anomaly.transaction_anomalies(features, model, AS_OF).drop("anomaly_features", "detected_at")


@query("m8_fraud_scores")
def m8_fraud_scores(spark, sf_dir):
    """Train the forest on the whole table and score every transaction."""
    tx = transactions(spark, sf_dir).withColumn("is_fraud", (F.col("status") == "FRAUD").cast("int"))
    model, features = _forest(tx)
    return fraud.score(features, model.pipeline, only_fraud=False, as_of=AS_OF).drop("prediction_time")


# The learned models are checked by what must hold for any model, and their rules on a fixed clustering.

CLUSTER_SQL = """, marked AS (SELECT features.*, CAST(CAST(transaction_id AS BIGINT) % 50 // 12 AS INTEGER) AS cluster FROM features),
stats AS (SELECT cluster, count(*) AS count, avg(amount) AS avg_amount, stddev_samp(amount) AS std_amount,
  avg(amount_zscore) AS avg_zscore, count(*) / sum(count(*)) OVER () AS share FROM marked GROUP BY 1)"""


def _fixed_clusters(spark, sf_dir):
    cluster = F.expr("int((bigint(transaction_id) % 50) div 12)")
    return anomaly.transaction_features(transactions(spark, sf_dir)).withColumn("cluster", cluster)


@query("a11_cluster_statistics", with_tx(FEATURES_SQL + CLUSTER_SQL + """
SELECT cluster, count, round(avg_amount, 6) AS avg_amount, round(std_amount, 6) AS std_amount,
       round(avg_zscore, 6) AS avg_zscore, round(share, 9) AS share FROM stats"""))
def a11_cluster_statistics(spark, sf_dir):
    stats = anomaly.cluster_statistics(_fixed_clusters(spark, sf_dir))
    return stats.select("cluster", "count", *[F.round(c, 6).alias(c) for c in ("avg_amount", "std_amount", "avg_zscore")],
                        F.round("share", 9).alias("share"))


@query("m3_anomalous_clusters", with_tx(FEATURES_SQL + CLUSTER_SQL + """
SELECT cluster FROM stats WHERE share < 0.1 AND abs(avg_zscore) > 0.000001"""))
def m3_anomalous_clusters(spark, sf_dir):
    """A wide rule on the fixed clustering, of whose clusters one is small."""
    return anomaly.anomalous_clusters(anomaly.cluster_statistics(_fixed_clusters(spark, sf_dir)), 0.1, 0.000001)


@query("m4_fixed_anomalies", with_tx(FEATURES_SQL + CLUSTER_SQL + """
SELECT transaction_id, tx.user_id, round(tx.amount, 6) AS amount, category, cluster AS anomaly_type
FROM marked JOIN tx USING (transaction_id) WHERE cluster IN (SELECT cluster FROM stats WHERE share < 0.1 AND abs(avg_zscore) > 0.000001)"""))
def m4_fixed_anomalies(spark, sf_dir):
    """The scoring of all rows with the fixed clustering in the place of the fitted one, by the rule of m3."""
    features = anomaly.transaction_features(transactions(spark, sf_dir))
    fixed = SQLTransformer(statement="SELECT *, array(amount) AS features, int((bigint(transaction_id) % 50) div 12) AS cluster FROM __THIS__")
    pipeline = Pipeline(stages=[fixed]).fit(features)
    small = anomaly.anomalous_clusters(anomaly.cluster_statistics(pipeline.transform(features)), 0.1, 0.000001)
    model = anomaly.ClusterModel(pipeline, [r.cluster for r in small.collect()])
    return anomaly.transaction_anomalies(features, model, AS_OF).select(
        "transaction_id", "user_id", F.round("amount", 6).alias("amount"), "category", "anomaly_type")


@query("m2_cluster_invariants", with_tx(FEATURES_SQL + """
SELECT count(*) AS clustered, 1.0::DOUBLE AS shares, TRUE AS silhouette_in_range FROM features
WHERE amount_zscore BETWEEN -3 AND 3 AND time_since_last < 86400 AND transactions_last_hour < 100
  AND amount_ratio BETWEEN 0.1 AND 10"""))
def m2_cluster_invariants(spark, sf_dir):
    """Every training row is in a cluster, the shares are a whole, and the silhouette is one."""
    model, features = _clusters(spark, sf_dir)
    stats = anomaly.cluster_statistics(model.pipeline.transform(anomaly.without_outliers(features)))
    return stats.agg(F.sum("count").alias("clustered"), F.round(F.sum("share"), 9).alias("shares"),
                     F.lit(-1 <= model.silhouette <= 1).alias("silhouette_in_range"))


@query("m8_score_invariants", with_tx("""
SELECT transaction_id, TRUE AS consistent, TRUE AS auc_in_range FROM tx"""))
def m8_score_invariants(spark, sf_dir):
    """One score per transaction; a fraud is what is more likely one than not; the area under the curve beats chance."""
    tx = transactions(spark, sf_dir).withColumn("is_fraud", (F.col("status") == "FRAUD").cast("int"))
    model, features = _forest(tx)
    scores = fraud.score(features, model.pipeline, only_fraud=False, as_of=AS_OF)
    likely = F.col("fraud_probability")
    return scores.select("transaction_id", ((F.col("prediction") == (likely > 0.5).cast("double")) & likely.between(0, 1))
                         .alias("consistent"), F.lit(0.5 < model.auc <= 1).alias("auc_in_range"))


@query("m7_confusion", with_tx("""
SELECT count(*) AS transactions, count(*) FILTER (status = 'FRAUD') AS frauds, TRUE AS mostly_found, TRUE AS mostly_right FROM tx"""))
def m7_confusion(spark, sf_dir):
    """The label follows from amount and hour, which are features: the forest finds most frauds, and most of what it finds are."""
    tx = transactions(spark, sf_dir).withColumn("is_fraud", (F.col("status") == "FRAUD").cast("int"))
    model, features = _forest(tx)
    scores = fraud.score(features, model.pipeline, only_fraud=False, as_of=AS_OF).select("transaction_id", "prediction")
    both = scores.join(tx.select("transaction_id", "is_fraud"), "transaction_id")
    right = F.count_if((F.col("prediction") == 1) & (F.col("is_fraud") == 1))
    return both.agg(F.count("*").alias("transactions"), F.sum("is_fraud").alias("frauds"),
                    (right > 0.5 * F.sum("is_fraud")).alias("mostly_found"),
                    (right > 0.5 * F.count_if(F.col("prediction") == 1)).alias("mostly_right"))


@query("p10_predicted_frauds", with_tx("SELECT 0 AS missing, 0 AS unlikely"))
def p10_predicted_frauds(spark, sf_dir):
    """The filtered scores are those with a prediction of 1, with a probability above one half."""
    tx = transactions(spark, sf_dir).withColumn("is_fraud", (F.col("status") == "FRAUD").cast("int"))
    model, features = _forest(tx)
    every = fraud.score(features, model.pipeline, only_fraud=False, as_of=AS_OF)
    kept = fraud.score(features, model.pipeline, as_of=AS_OF).select("transaction_id", F.lit(1).alias("kept"))
    both = every.join(kept, "transaction_id", "left")
    return both.agg(F.count_if((F.col("prediction") == 1) & F.col("kept").isNull()).cast("int").alias("missing"),
                    F.count_if(F.col("kept").isNotNull() & (F.col("fraud_probability") <= 0.5)).cast("int").alias("unlikely"))


@query("q8_counts_by_status", with_tx("SELECT status, currency, count(*) AS events FROM tx GROUP BY 1, 2"))
def q8_counts_by_status(spark, sf_dir):
    return counts_by(transactions(spark, sf_dir), "status", "currency")


# --- single rules of the alerts -----------------------------------------------------------------------

@query("p9_anomaly_filter", with_tx(_daily_sql("merchant") + """
SELECT user_id, category, coalesce(spend_z > 2 OR count_z > 2 OR unusual = 1, unusual = 1) AS anomalous FROM judged"""))
def p9_anomaly_filter(spark, sf_dir):
    flag = F.coalesce(anomaly.is_anomalous(2.0), F.col("unusual_category") == 1)
    return _judged(spark, sf_dir).select("user_id", "category", flag.alias("anomalous"))


@query("e4_zscores", with_tx(_daily_sql("category") + """
SELECT user_id, category, round(spend_z, 6) AS spend_zscore, round(count_z, 6) AS transaction_zscore FROM judged"""))
def e4_zscores(spark, sf_dir):
    scored = anomaly.scored_windows(daily_aggregates(spark, sf_dir), AS_OF, "1 DAY")
    return scored.select("user_id", "category", F.round("spend_zscore", 6).alias("spend_zscore"),
                         F.round("transaction_zscore", 6).alias("transaction_zscore"))


@query("e7_alert_types", with_tx(ALERTS_SQL + "SELECT alert_type, count(*) AS alerts FROM alerts GROUP BY 1"))
def e7_alert_types(spark, sf_dir):
    return _alerts(spark, sf_dir).groupBy("alert_type").agg(F.count("*").alias("alerts"))


@query("e8_severities", with_tx(ALERTS_SQL + "SELECT alert_type, severity, count(*) AS alerts FROM alerts GROUP BY 1, 2"))
def e8_severities(spark, sf_dir):
    return _alerts(spark, sf_dir).groupBy("alert_type", "severity").agg(F.count("*").alias("alerts"))


@query("e9_message_details", with_tx(ALERTS_SQL + """
SELECT user_id, category, CASE alert_type
    WHEN 'HIGH_SPENDING' THEN concat('Spent $', total, ' which is ', round(sz, 1), ' standard deviations above average')
    WHEN 'HIGH_FREQUENCY' THEN concat('Made ', transaction_count, ' transactions which is ', round(cz, 1),
      ' standard deviations above average')
    WHEN 'UNUSUAL_CATEGORY' THEN concat('Transaction in unusual category: ', category)
    ELSE 'Suspicious pattern detected' END AS details FROM alerts"""))
def e9_message_details(spark, sf_dir):
    return _alerts(spark, sf_dir).select(
        "user_id", F.col("alert_data_category").alias("category"),
        F.regexp_extract("message", "Details: (.*)$", 1).alias("details"))


@query("e10_stable_alert_ids", with_tx(ANOMALIES_SQL + """
SELECT user_id, category, sha256(user_id || '|' || category || '|' || round(total_amount, 2) || '|' || transaction_count)
  AS alert_id FROM anomalies"""))
def e10_stable_alert_ids(spark, sf_dir):
    anomalies = _anomalies(spark, sf_dir).withColumn("total_amount", F.round("total_amount", 2))
    return alerts.anomaly_alerts(anomalies, AS_OF, stable_ids=True).select(
        "user_id", F.col("alert_data_category").alias("category"), "alert_id")


@query("s4_training_rows", with_tx("SELECT transaction_id, amount, CAST(status = 'FRAUD' AS INTEGER) AS is_fraud FROM tx"))
def s4_training_rows(spark, sf_dir):
    """Training data from stored files; the label follows from the status."""
    path = shared_dir(spark, "training")
    transactions(spark, sf_dir).write.parquet(path)
    return read_training_data(spark, path).select("transaction_id", "amount", "is_fraud")


@query("s10_loaded_model", with_tx(FEATURES_SQL + "SELECT transaction_id, TRUE AS same FROM features"))
def s10_loaded_model(spark, sf_dir):
    """The second call loads what the first one trained and saved: the same cluster for every row, the same anomalous ones."""
    path, features = shared_dir(spark, "clusters"), anomaly.transaction_features(transactions(spark, sf_dir))
    trained, features = _learned(features, lambda rows: anomaly.load_or_train(spark, path, rows), "cluster-features")
    loaded = anomaly.load_or_train(spark, path, features)
    first = trained.pipeline.transform(features).select("transaction_id", F.col("cluster").alias("before"))
    both = loaded.pipeline.transform(features).join(first, "transaction_id")
    agree = F.lit(trained.anomalous == loaded.anomalous)
    return both.select("transaction_id", ((F.col("cluster") == F.col("before")) & agree).alias("same"))


@query("k9_saved_forest", with_tx("SELECT transaction_id, TRUE AS same FROM tx"))
def k9_saved_forest(spark, sf_dir):
    """A saved forest gives the probabilities of the one in memory."""
    tx = transactions(spark, sf_dir).withColumn("is_fraud", (F.col("status") == "FRAUD").cast("int"))
    path = shared_dir(spark, "forest")
    model, features = _forest(tx, trees=20, depth=5)
    model.pipeline.write().overwrite().save(path)
    scores = [fraud.score(features, m, only_fraud=False, as_of=AS_OF).select("transaction_id", F.col("fraud_probability").alias(name))
              for m, name in ((model.pipeline, "before"), (fraud.load_fraud_model(path), "after"))]
    return scores[0].join(scores[1], "transaction_id").select("transaction_id", (F.col("before") == F.col("after")).alias("same"))
