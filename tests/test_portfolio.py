"""The worked example, and the edges of the lookup tables."""

import pytest
from pyspark.sql import functions as F

from spendlens.operators import portfolio as P

COLUMNS = ("user_id string, symbol string, asset_type string, quantity double, average_price double, "
           "current_price double, market_value double, unrealized_pnl double, allocation double")


@pytest.fixture(scope="module")
def positions(spark):
    return spark.createDataFrame([
        ("u", "AAPL", "STOCK", 100.0, 150.0, 180.0, 18000.0, 3000.0, 0.30),
        ("u", "MSFT", "STOCK", 50.0, 250.0, 350.0, 17500.0, 5000.0, 0.29),
        ("u", "BND", "BOND", 200.0, 80.0, 82.0, 16400.0, 400.0, 0.27),
        ("u", "GLD", "COMMODITY", 50.0, 170.0, 185.0, 9250.0, 750.0, 0.14),
    ], COLUMNS)


@pytest.fixture(scope="module")
def profiles(spark):
    return spark.createDataFrame([("u", "moderate")], "user_id string, risk_tolerance string")


def only(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_summary(positions):
    r = only(P.summary(positions))
    assert (r.total_positions, r.total_value, r.total_cost, r.total_pnl, r.pnl_percentage) == (4, 61150, 52000, 9150, 17.6)
    assert (r.largest_position, r.best_performer) == ("AAPL", "MSFT")


def test_diversification(positions):
    r = only(P.diversification(positions))
    assert (r.hhi_index, r.effective_holdings, r.diversification_score) == (0.4406, 2.27, 55.9)
    assert r.asset_allocation["STOCK"] == pytest.approx(0.59)
    assert r.recommendation.startswith("Highly concentrated")


def test_risk(positions):
    r = only(P.risk(positions))
    assert (r.portfolio_beta, r.portfolio_volatility, r.risk_level) == (0.826, 0.181, "MEDIUM")
    assert (r.value_at_risk_95, r.sharpe_ratio) == (18230.71, 0.254)


def test_stress(positions):
    r = only(P.stress(positions))
    assert (r.market_crash_impact, r.market_crash_pct, r.interest_rate_rise_impact) == (7920.0, 12.95, 1640.0)
    assert (r.liquidity_ratio, r.liquidity_rating) == (58.05, "GOOD")


def test_performance_and_benchmarks(positions):
    r = only(P.performance(positions))
    assert (r.annualized_return_pct, r.performance_rating) == (3.29, "FAIR")
    excess = {b.benchmark: round(b.excess_return, 4) for b in P.benchmark_comparison(positions).collect()}
    assert excess == {"SPY": -0.0871, "AGG": -0.0071, "GLD": -0.0271}


def test_concentration(positions):
    rows = {(r.symbol or r.sector): (r.type, r.risk_level, r.allocation) for r in P.concentration(positions).collect()}
    assert rows == {"AAPL": ("single_position", "medium", 30.0), "MSFT": ("single_position", "medium", 29.0),
                    "BND": ("single_position", "medium", 27.0), "Technology": ("sector_concentration", "high", 59.0)}
    r = only(P.concentration_score(positions))
    assert (r.has_concentration_risk, r.overall_concentration_score) == (True, 40)


def test_rebalance(positions, profiles):
    r = only(P.rebalance(positions, profiles))
    assert (r.asset_class, r.current, r.target, r.action, r.amount, r.priority) == (
        "BOND", 27.0, 35.0, "BUY", 4892.0, "medium")


def test_targets_per_profile(spark, positions):
    def classes(profile):
        p = spark.createDataFrame([("u", profile)], "user_id string, risk_tolerance string")
        return {r.asset_class: r.target for r in P.target_deviation(positions, p).collect()}

    assert classes("AGGRESSIVE") == {"STOCK": 0.80, "BOND": 0.15, "ALTERNATIVE": 0.05}
    assert classes("conservative")["BOND"] == 0.50
    assert classes(None) == classes("whatever") == {"STOCK": 0.60, "BOND": 0.35, "CASH": 0.05}


def test_nothing_invested(spark):
    empty = spark.createDataFrame([("u", "X", "STOCK", 0.0, 0.0, 5.0)],
                                  "user_id string, symbol string, asset_type string, quantity double, "
                                  "average_price double, current_price double")
    held = P.with_allocation(P.valued(empty))
    assert only(P.summary(held)).pnl_percentage == 0
    assert only(P.stress(held)).liquidity_rating == "POOR"
    assert only(P.risk(held)).sharpe_ratio is None
    assert len(P.analyze(held, spark.createDataFrame([("u", None)], "user_id string, risk_tolerance string"))) == 10


def test_users_without_a_profile_are_moderate(spark, positions):
    other = positions.withColumn("user_id", F.concat("user_id", F.lit("x")))
    profiles = positions.select("user_id", F.lit("conservative").alias("risk_tolerance")).distinct()
    out = P.target_deviation(positions.unionByName(other), profiles)
    assert out.select("user_id").distinct().count() == 2
    assert {r.asset_class: r.target for r in out.filter("user_id LIKE '%x'").collect()} == {"STOCK": 0.60, "BOND": 0.35, "CASH": 0.05}
    flags = P.needs_rebalancing(positions.unionByName(other), profiles).collect()
    assert len(flags) == 2 and all(r.needs_rebalancing == (r.trades > 0) for r in flags)


@pytest.mark.parametrize("run, scans", [(P.summary, 3), (P.diversification, 3), (P.risk, 3), (P.stress, 3), (P.performance, 3),
                                        (P.benchmark_comparison, 3), (P.concentration_score, 6)])
def test_each_table_is_scanned_once(spark, sf_dir, run, scans):
    from spendlens.plans.tables import positions as held

    plan = run(held(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= scans
