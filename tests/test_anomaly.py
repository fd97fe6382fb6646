"""Behaviour anomalies, alerts, recommendations, aggregates with lists."""

import datetime as dt
import hashlib

import pytest
from helpers import close, frame, sec, skewed_rows, stdev, tx
from pyspark.sql import functions as F

from spendlens.operators import aggregates as A, alerts, anomaly

AS_OF = "2024-02-01 00:00:00"


def aggregates(spark, rows):
    """rows: (user, category, end, amount, count)."""
    return spark.createDataFrame(
        rows, "user_id string, category string, window_end timestamp, total_amount double, transaction_count long")


@pytest.fixture(scope="module")
def history(spark):
    old = dt.datetime(2024, 1, 1)
    rows = [("u", "FOOD", old + dt.timedelta(hours=i), 10.0 + i % 2, 2) for i in range(40)]
    now = dt.datetime(2024, 1, 31, 23, 30)
    rows += [("u", "FOOD", now, 500.0, 2), ("u", "BILLS", now, 10.0, 2), ("u", None, now, 10.0, 2),
             ("single", "FOOD", now, 5.0, 1)]
    return aggregates(spark, rows)


def test_recency_and_scores(history):
    found = {(r.user_id, r.category): r for r in anomaly.behaviour_anomalies(history, AS_OF).collect()}
    # The only window of a user has no deviation, but its category was never seen before.
    assert set(found) == {("u", "FOOD"), ("u", "BILLS"), ("single", "FOOD")}
    assert found["u", "FOOD"].spend_zscore > 5 and found["u", "FOOD"].unusual_category == 0
    assert found["u", "BILLS"].unusual_category == 1
    assert found["single", "FOOD"].spend_zscore is None


def test_all_categories_known(history):
    found = anomaly.behaviour_anomalies(history, AS_OF, categories_from="all").collect()
    assert [(r.user_id, r.category) for r in found] == [("u", "FOOD")]
    with pytest.raises(ValueError):
        anomaly.behaviour_anomalies(history, categories_from="none")


def scored(spark, *rows):
    return spark.createDataFrame(
        rows, "user_id string, category string, total_amount double, transaction_count long, spend_zscore double, "
              "transaction_zscore double, unusual_category int")


def test_alert_precedence(spark):
    df = scored(spark, ("a", "FOOD", 9.5, 2, 6.0, 0.0, 1), ("b", "FOOD", 9.5, 2, 6.04, 0.0, 0),
                ("c", "FOOD", 9.5, 2, 1.0, 5.55, 0), ("d", "FOOD", 9.5, 2, 4.0, 1.0, 0), ("e", "FOOD", 9.5, 2, None, None, 1),
                ("f", None, 9.5, 2, 1.0, 1.0, 1))
    got = {r.user_id: r for r in alerts.anomaly_alerts(df, AS_OF).collect()}
    assert (got["a"].alert_type, got["a"].severity) == ("UNUSUAL_CATEGORY", "HIGH")
    assert (got["b"].alert_type, got["b"].severity) == ("HIGH_SPENDING", "HIGH")
    assert got["b"].message == ("Anomaly detected: HIGH_SPENDING. User: b. Details: Spent $9.5 which is 6.0 standard "
                                "deviations above average")
    assert got["c"].message.endswith("Made 2 transactions which is 5.6 standard deviations above average")
    assert (got["d"].alert_type, got["d"].severity) == ("SUSPICIOUS_PATTERN", "LOW")
    assert (got["e"].alert_type, got["e"].severity) == ("UNUSUAL_CATEGORY", "MEDIUM")
    assert got["f"].message is None
    assert len({r.alert_id for r in got.values()}) == 6


def test_stable_alert_ids(spark):
    df = scored(spark, ("a", "FOOD", 9.5, 2, 6.0, 0.0, 1))
    first, second = (alerts.anomaly_alerts(df, stable_ids=True).first().alert_id for _ in range(2))
    assert first == second


def test_recommendations_ignore_unknown_metrics(spark):
    df = spark.createDataFrame(
        [("a", 1500.0, 50.0, 100.0, 23.0, 4, None), ("b", None, None, 100.0, None, None, None),
         ("c", 10.0, 50.0, 0.0, 22.0, 3, None)],
        "user_id string, avg_daily_spending double, FOOD_total double, total_spending double, "
        "avg_transaction_hour double, total_devices_used int, calculated_at timestamp")
    got = {r.user_id: r.recommendations for r in alerts.recommendations(df).collect()}
    assert len(got["a"]) == 4
    assert got["b"] == got["c"] == ["Your spending patterns look healthy"]


def test_outlier_filter_borders(spark):
    df = spark.createDataFrame([(3.0, 86_399, 99, 10.0), (3.1, 0, 1, 1.0), (0.0, 86_400, 1, 1.0), (0.0, 0, 100, 1.0),
                                (0.0, 0, 1, 0.09)],
                               "amount_zscore double, time_since_last int, transactions_last_hour int, amount_ratio double")
    assert anomaly.without_outliers(df).count() == 1


def test_cluster_rule(spark):
    stats = spark.createDataFrame([(0, 0.04, -1.6), (1, 0.04, 1.5), (2, 0.05, 9.0)],
                                  "cluster int, share double, avg_zscore double")
    assert [r.cluster for r in anomaly.anomalous_clusters(stats).collect()] == [0]


def test_paged_lists_hold_every_row(spark):
    rows = skewed_rows(300)
    df = frame(spark, rows)
    lists = A.paged_lists(df, ["user_id"], df["transaction_id"], "ids", "transaction_id", pages=5).collect()
    assert sorted(i for r in lists for i in r.ids) == sorted(r["transaction_id"] for r in rows)
    assert len([r for r in lists if r.user_id == "hot"]) == 5
    for r in lists:
        assert all(int(hashlib.md5(i.encode()).hexdigest()[:8], 16) % 5 == r.page for i in r.ids)


def test_sliding_windows(spark):
    rows = skewed_rows(300) + [tx("n", "hot", None, 40), tx("o", "hot", 3, -1), tx("p", None, 3, 19_200)]
    rows += [tx(f"c{i}", "close", 900_000 + i % 3 / 100, 90_000 + i, category="BILLS") for i in range(30)]
    for length, step in ((300, 60), (3600, 1200)):
        windows = {}
        for r in rows:
            last = sec(r) // step * step
            for start in range(last - length + step, last + 1, step):
                windows.setdefault((start, r["user_id"], r["category"]), []).append(r["amount"])
        got = A.sliding_spend(frame(spark, rows), f"{length} seconds", f"{step} seconds").collect()
        assert len(got) == len(windows)
        for r in got:
            amounts = windows[int(r.window_start.timestamp()), r.user_id, r.category]
            known = [x for x in amounts if x is not None]
            assert r.transaction_count == len(amounts)
            assert close(r.total_amount, sum(known) if known else None) and close(r.std_amount, stdev(known), 4)


def test_hours_of_night_and_weekend(spark):
    rows = [tx(h, "u", 1, h * 3600) for h in (6, 7, 21, 22)] + [tx("sat", "u", 1, 5 * 86_400 + 43_200)]
    out = {r.transaction_id: (r.is_night, r.is_weekend) for r in anomaly.transaction_features(frame(spark, rows)).collect()}
    assert out == {"6": (1, 0), "7": (0, 0), "21": (0, 0), "22": (1, 0), "sat": (0, 1)}


def test_feature_defaults(spark):
    r = anomaly.transaction_features(frame(spark, [tx(1, "u", 7, 0, merchant=None)])).first()
    assert (r.time_since_last, r.amount_zscore, r.amount_ratio, r.merchant_frequency, r.avg_merchant_amount) == (
        3600, 0.0, 1.0, 1, 7.0)


def test_user_metrics_nulls(spark):
    r = A.user_metrics(frame(spark, [tx(1, "u", 7, 0), tx(2, "u", 9, 60, category="BILLS")]), as_of=AS_OF).first()
    assert (r.FOOD_total, r.FOOD_count, r.SHOPPING_total, r.SHOPPING_count) == (7.0, 1, None, None)
    assert r.total_spending == 16.0 and r.max_hourly_spending == 16.0


def test_newest_and_pages(spark):
    df = frame(spark, [tx(i, "u", i + 1, i) for i in range(30)])
    assert {r.transaction_id for r in A.newest_per_user(df, 3).collect()} == {"27", "28", "29"}
    assert [r.transaction_id for r in A.list_transactions(df, 5, 2).collect()] == ["5", "6"]
    third = A.list_transactions(df, limit=2, after=("2024-01-01 00:00:06", "6"))
    assert [r.transaction_id for r in third.collect()] == ["7", "8"]
    assert A.get_transaction(df, "99").isEmpty()


def test_empty_summary(spark):
    r = A.pattern_summary(frame(spark, [])).first()
    assert tuple(r) == (0.0, 0, 0.0)
