"""Alerts and recommendations: projections over aggregates, without a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from spendlens.functions import columns as C


def high_velocity_alerts(agg: DataFrame, threshold: float = 1000, as_of=None, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` adds columns of the aggregate, so that readers can tell the versions of one alert apart."""
    return agg.filter(F.col("spending_velocity") > threshold).select(
        F.lit("HIGH_SPENDING_VELOCITY").alias("alert_type"), "user_id", "spending_velocity",
        C.as_of_or_now(as_of).alias("alert_time"), *keep)


def alert_type() -> Column:
    # The limit of 5, the names, and the order of the rules.
    return (F.when(F.col("unusual_category") == 1, "UNUSUAL_CATEGORY")
            .when(F.col("spend_zscore") > 5, "HIGH_SPENDING")
            .when(F.col("transaction_zscore") > 5, "HIGH_FREQUENCY")
            .otherwise("SUSPICIOUS_PATTERN"))


def severity() -> Column:
    """The score decides before the category does, unlike in ``alert_type``."""
    # The limit of 5, the names, and the order of the rules.
    high = (F.col("spend_zscore") > 5) | (F.col("transaction_zscore") > 5)
    return F.when(high, "HIGH").when(F.col("unusual_category") == 1, "MEDIUM").otherwise("LOW")


def alert_message() -> Column:
    """Fixed texts with the figures of the row; NULL when a figure is NULL."""
    # The texts.
    def above(zscore):
        return F.concat(F.round(zscore, 1).cast("string"), F.lit(" standard deviations above average"))

    kind = F.col("alert_type")
    details = (
        F.when(kind == "HIGH_SPENDING", F.concat(
            F.lit("Spent $"), F.col("total_amount").cast("string"), F.lit(" which is "), above("spend_zscore")))
        .when(kind == "HIGH_FREQUENCY", F.concat(
            F.lit("Made "), F.col("transaction_count").cast("string"), F.lit(" transactions which is "),
            above("transaction_zscore")))
        .when(kind == "UNUSUAL_CATEGORY", F.concat(F.lit("Transaction in unusual category: "), F.col("category")))
        .otherwise(F.lit("Suspicious pattern detected")))
    return F.concat(F.lit("Anomaly detected: "), kind, F.lit(". User: "), F.col("user_id"), F.lit(". Details: "),
                    details)


def anomaly_alerts(anomalies: DataFrame, as_of=None, stable_ids: bool = False) -> DataFrame:
    """One alert per anomaly. ``stable_ids`` derives the id from the row, so a replay gives the same alert."""
    key = F.concat_ws("|", "user_id", "category", "total_amount", "transaction_count",
                      *(["window_end"] if "window_end" in anomalies.columns else []))
    alert_id = F.sha2(key, 256) if stable_ids else F.expr("uuid()")
    typed = anomalies.withColumn("alert_type", alert_type())
    return typed.select(
        alert_id.alias("alert_id"), "user_id", "alert_type", severity().alias("severity"),
        alert_message().alias("message"), F.col("total_amount").alias("alert_data_amount"),
        F.col("transaction_count").alias("alert_data_count"), F.col("category").alias("alert_data_category"),
        C.as_of_or_now(as_of).alias("created_at"))


def recommendations(metrics: DataFrame, daily_limit: float = 1000, food_share: float = 0.4, late_hour: float = 22,
                    devices: int = 3) -> DataFrame:
    """Advice texts per user; a NULL metric gives no advice of its kind."""
    def advice(condition, text, otherwise=""):
        return F.when(condition, F.lit(text)).otherwise(F.lit(otherwise))

    # The advice texts.
    texts = F.array(
        advice(F.col("avg_daily_spending") > daily_limit, "Consider setting a daily spending limit",
               "Your spending patterns look healthy"),
        advice(F.try_divide("FOOD_total", "total_spending") > food_share,
               "High food spending. Consider meal planning"),
        advice(F.col("avg_transaction_hour") > late_hour,
               "Late night spending detected. Consider setting limits"),
        advice(F.col("total_devices_used") > devices, "Multiple devices used. Ensure all are secure"),
    )
    return metrics.select("user_id", F.filter(texts, lambda t: t != "").alias("recommendations"),
                          F.col("calculated_at").alias("generated_at"))


def active_alerts(alerts: DataFrame) -> DataFrame:
    """Open alerts per user and severity."""
    return alerts.groupBy("user_id", "severity").agg(F.count("*").alias("alert_count"))
