"""Figures merged from minutes, exact quantiles by digits, deep pages."""

import datetime as dt
import math
import random
import statistics

import numpy as np
import pytest
from helpers import START, close, frame, skewed_rows, tx
from pyspark.sql import functions as F

from spendlens.operators import aggregates as A, metrics as Q, sketches as S


def test_hours_and_users_from_minutes(spark):
    rows = skewed_rows(400) + [tx("n1", "u1", None, 5, merchant=None, device_id=None), tx("n2", "only", float("nan"), 5, location=None)]
    minutes = S.minute_sketches(frame(spark, rows))
    exact = {(r.user_id, r.window_start): r for r in A.hourly_spend(frame(spark, rows).withColumn(
        "amount", F.when(~F.isnan("amount"), F.col("amount"))), exact=True).collect()}
    hours = S.hourly_from_minutes(minutes).collect()
    assert len(hours) == len(exact)
    for h in hours:
        e = exact[h.user_id, h.window_start]
        assert (h.transaction_count, h.unique_merchant, h.unique_category) == (
            e.transaction_count_hourly, e.unique_merchants, e.unique_categories)
        assert close(h.total_amount, e.total_amount_hourly or 0) and close(h.food_spending, e.food_spending or 0)
        assert h.window_end - h.window_start == dt.timedelta(hours=1)
    users = {r.user_id: r for r in S.users_from_minutes(S.merged(minutes, "user_id", "minute")).collect()}
    profile = {r.user_id: r for r in A.user_profile(frame(spark, rows), exact=True).collect()}
    assert users.keys() == profile.keys()
    for u, p in profile.items():
        assert (users[u].unique_merchant, users[u].unique_location, users[u].unique_device_id) == (
            p.total_unique_merchants, p.total_unique_locations, p.total_devices_used)


def test_distinct_counts_without_expansion(spark):
    df = frame(spark, skewed_rows(200))
    sketched = A.user_profile(df)
    assert "Expand" not in sketched._jdf.queryExecution().executedPlan().toString()
    counts = [c for c in sketched.columns if c.startswith("total_")]
    assert len(counts) == 4
    assert sorted(sketched.select("user_id", *counts).collect()) == sorted(A.user_profile(df, exact=True).select("user_id", *counts).collect())


def test_many_values_are_within_the_bound(spark):
    df = spark.range(200_000).select((F.col("id") % 60_000).cast("string").alias("v"))
    n = df.agg(S.distinct_estimate("v").alias("n")).first()["n"]
    assert abs(n - 60_000) <= 4 * 60_000 / 2 ** (S.BITS / 2)


def test_quantiles_from_minutes(spark):
    rng = random.Random(5)
    values = [(START + dt.timedelta(seconds=rng.randrange(600)), rng.choice("ab"), rng.lognormvariate(0, 2)) for _ in range(8000)]
    values += [(START, "a", None), (START, "a", float("nan"))]
    df = spark.createDataFrame(values, "ts timestamp, k string, duration_s double")
    out = S.quantile_from_minutes(S.minute_quantiles(df, ["k"]), 0.9, "5 minutes", ["k"]).collect()
    assert len(out) == 4
    for r in out:
        mine = sorted(v for t, k, v in values if k == r.k and r.window_start <= t < r.window_end and v is not None and not math.isnan(v))
        assert r.events == len(mine)
        assert abs(np.searchsorted(mine, r.quantile) / len(mine) - 0.9) < 4 * 2.3 / S.KLL_SIZE ** 0.9


def exact(values, q):
    ordered = sorted(values)
    rank = (len(ordered) - 1) * q
    low, high = ordered[math.floor(rank)], ordered[math.ceil(rank)]
    return low if low == high else low + (high - low) * (rank - math.floor(rank))


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_exact_quantile_of_any_doubles(spark, q):
    rng = random.Random(6)
    kinds = {
        "normal": [rng.gauss(0, 1) for _ in range(301)],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(300)],
        "close": [1.0 + i * 2.0 ** -52 for i in range(200)],
        "copies": [0.25] * 500 + [0.5, 1e308, -1e308],
        "one": [-3.5],
        "tiny": [i * 5e-324 for i in range(50)] + [-0.0, 0.0],
        "ends": [float("-inf"), -1.0, 2.0, float("inf"), float("inf")],
    }
    rows = [(START, k, v) for k, vs in kinds.items() for v in vs] + [(START, "normal", None), (START, None, 7.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "ts timestamp, k string, duration_s double").repartition(3)
    got = {r.k: r for r in Q.exact_quantile(df, q, "1 day", ["k"]).collect()}
    assert got.keys() == {*kinds, None} and got[None].quantile == 7.0
    for k, vs in kinds.items():
        want = exact(vs, q)
        assert got[k].events == len(vs)
        assert got[k].quantile == want or math.isclose(got[k].quantile, want, rel_tol=1e-12), (k, got[k], want)


def test_no_value_is_ordered(spark):
    rows = [(START + dt.timedelta(minutes=i % 7), float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "ts timestamp, duration_s double")
    out = {r.window_start: r.quantile for r in Q.exact_quantile(df, 0.5, "1 minute").collect()}
    assert out == {START + dt.timedelta(minutes=m): statistics.median([float(i) for i in range(100) if i % 7 == m]) for m in range(7)}
    assert Q.exact_quantile(df.limit(0)).count() == 0


# --- pages ------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def timed(spark):
    rng = random.Random(7)
    rows = [tx(f"{i:04d}", "u", 1, rng.choice([rng.randrange(90 * 86_400), 5_000_000])) for i in range(900)]
    rows += [tx(f"x{i}", "u", 1, 0, timestamp=None) for i in range(5)]
    rng.shuffle(rows)
    return frame(spark, rows).repartition(4).cache()


@pytest.mark.parametrize("skip, limit", [(0, 3), (2, 10), (5, 10), (300, 50), (450, 200), (880, 100), (905, 10), (5000, 1)])
@pytest.mark.parametrize("few", [1, 100])
def test_deep_pages(timed, skip, limit, few):
    want = [r.transaction_id for r in A.list_transactions(timed, skip, limit).collect()]
    assert [r.transaction_id for r in A.deep_page(timed, skip, limit, few).collect()] == want


def test_a_deep_page_sorts_one_range(spark, monkeypatch):
    df = frame(spark, [tx(f"{i:04d}", "u", 1, 3600 * i) for i in range(1000)])
    left = []
    whole = type(df).orderBy
    monkeypatch.setattr(type(df), "orderBy", lambda self, *by, **kw: (left.append(self.count()), whole(self, *by, **kw))[1])
    assert [r.transaction_id for r in A.deep_page(df, 900, 10, few=30).collect()] == [f"{i:04d}" for i in range(900, 910)]
    assert left == [24]  # the hours of one day
