"""Metric rules on hand-made series."""

import datetime as dt
import random

import numpy as np
from helpers import START, frame, tx
from pyspark.sql import functions as F

from spendlens.operators import metrics as Q
from spendlens.plans.monitoring import _compared


def requests(spark, rows):
    """rows: (seconds, status, duration)."""
    return spark.createDataFrame([(START + dt.timedelta(seconds=s), "e", c, d) for s, c, d in rows],
                                 "ts timestamp, endpoint string, status_code int, duration_s double")


def test_rate_windows(spark):
    df = frame(spark, [tx(i, "u", 1, s) for i, s in enumerate((0, 30, 60, 299, 300))])
    got = {(r.evaluated_at - START).seconds // 60: r.transactions for r in Q.transaction_rate(df).collect()}
    assert got == {1: 2, 2: 3, 3: 3, 4: 3, 5: 4, 6: 3, 7: 2, 8: 2, 9: 2, 10: 1}


def test_hold_needs_consecutive_evaluations(spark):
    minutes = [(0, 9), (1, 9), (2, 9), (3, 1), (4, 9), (5, 9), (7, 9)]
    series = spark.createDataFrame([(START + dt.timedelta(minutes=m), v) for m, v in minutes],
                                   "evaluated_at timestamp, v int")
    got = Q.held(series, F.col("v") > 5, 2, F.col("v")).collect()
    assert len(got) == 1
    assert got[0].pending_since == START and got[0].last_true == START + dt.timedelta(minutes=2)
    assert len(Q.held(series, F.col("v") > 5, 1, F.col("v")).collect()) == 2


def test_episodes_across_days(spark):
    """Evaluations are numbered per piece of time, and episodes that go on over its border are one."""
    minutes = [*range(1430, 1445), *range(2000, 2010), *range(2878, 5765), *range(5770, 5780), 7199, 7201, 8639, 8640]
    series = spark.createDataFrame([(k, START + dt.timedelta(minutes=m), m) for k in "ab" for m in minutes if k == "a" or m > 2005],
                                   "k string, evaluated_at timestamp, v int")
    def found(df, keys=()):
        out = Q.held(df, F.col("v") > 0, 1, F.col("v"), keys)
        return out, sorted((*[r[k] for k in keys], (r.pending_since - START).total_seconds() / 60,
                            (r.last_true - START).total_seconds() / 60, r.peak) for r in out.collect())
    whole = [(1430, 1444, 1444), (2000, 2009, 2009), (2878, 5764, 5764), (5770, 5779, 5779), (8639, 8640, 8640)]
    out, got = found(series.filter("k = 'a'").drop("k"))
    assert got == whole
    assert "row_number() windowspecdefinition(_piece" in out._jdf.queryExecution().analyzed().toString()
    assert found(series, ["k"])[1] == [("a", *w) for w in whole] + [("b", 2006, 2009, 2009)] + [("b", *w) for w in whole[2:]]


def test_error_share(spark):
    df = requests(spark, [(0, 500, 0.1), (1, 200, 0.1), (2, 503, 0.1), (3, 404, 0.1)])
    assert {r.share for r in Q.error_share(df).collect()} == {0.5}


def test_histogram_quantile_interpolates(spark):
    df = requests(spark, [(i, 200, 0.3) for i in range(10)] + [(20, 200, 99.0)] * 10)
    assert {r.quantile for r in Q.histogram_quantile(df, 0.25, 5).collect()} == {0.25 + 0.25 * 0.5}
    assert {r.quantile for r in Q.histogram_quantile(df, 0.95, 5).collect()} == {10.0}


def test_exact_quantile(spark):
    df = requests(spark, [(i, 200, float(v)) for i, v in enumerate([1, 1, 1, 2, 10])])
    assert Q.exact_quantile(df, 0.5).first().quantile == 1.0
    assert abs(Q.exact_quantile(df, 0.95).first().quantile - 8.4) < 1e-9


def test_exact_quantile_of_any_numbers(spark):
    rng = random.Random(4)
    values = [rng.choice([0.0, -1.5, rng.uniform(-9, 9), rng.expovariate(0.01)]) for _ in range(250)]
    df = requests(spark, [(0, 200, v) for v in values])
    for q in (0.0, 0.05, 0.5, 0.95, 1.0):
        assert abs(Q.exact_quantile(df, q).first().quantile - float(np.quantile(values, q))) < 1e-9


def test_sketches_of_small_groups_are_compared(spark):
    """A group of few values passes with the value at the rank and with no other one."""
    values = {n: [float(v) for v in range(n)] for n in (1, 2, 19, 20, 21, 40, 41, 61, 99, 300)}
    df = spark.createDataFrame([(START, f"e{n}", 200, v) for n, vs in values.items() for v in vs],
                               "ts timestamp, endpoint string, status_code int, duration_s double")
    sketch = Q.approximate_quantile(df, duration="1 day", keys=["endpoint"])
    assert {r.close for r in _compared(sketch, df).collect()} == {True}
    wrong = sketch.withColumn("quantile", F.col("quantile") - F.greatest(F.lit(2), F.col("events") / 20))
    assert {r.close for r in _compared(wrong, df).collect()} == {False}


def test_silent_sources(spark):
    df = spark.createDataFrame([("a", START), ("b", START + dt.timedelta(minutes=5))], "source string, ts timestamp")
    assert [r.source for r in Q.silent_sources(df, START + dt.timedelta(minutes=5)).collect()] == ["a"]


def test_low_cash(spark):
    df = spark.createDataFrame([("a", 900.0, "CHECKING"), ("a", 1200.0, "CHECKING"), ("b", 999.0, "CHECKING"),
                                ("c", 1.0, "SAVINGS")], "user_id string, balance double, account_type string")
    assert [r.user_id for r in Q.low_cash(df).collect()] == ["b"]


def test_lag_levels(spark):
    df = spark.createDataFrame([(START, "t", "g", 900), (START, "t", "h", 300)],
                               "ts timestamp, topic string, consumer_group string, lag long")
    assert Q.lag_levels(df, "topic", "sum").first().lag == 1200
    assert Q.high_lag(df, "topic", "sum", hold_minutes=0).count() == 1


def test_dashboard(spark):
    df = frame(spark, [tx(1, "u", 30, 0), tx(2, "u", 10, 86_400, category="BILLS"), tx(3, "u", 20, 2 * 86_400)])
    assert {r.category: r.share_pct for r in Q.category_shares(df).collect()} == {"FOOD": 83.3, "BILLS": 16.7}
    assert [r.change_pct for r in Q.daily_change(df).orderBy("day").collect()] == [None, -66.7, 100.0]
    r = Q.category_against_average(df, "2024-01-02 00:00:00").filter("category = 'FOOD'").first()
    assert (r.month_avg, r.overall_avg, r.change_pct) == (30.0, 25.0, 20.0)
