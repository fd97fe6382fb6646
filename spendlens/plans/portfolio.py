"""Portfolio analytics over order lines as holdings."""

from __future__ import annotations

from pyspark.sql import functions as F

from spendlens.operators import portfolio as P
from spendlens.plans.registry import query
from spendlens.plans.tables import PROFILES_SQL, positions, risk_profiles, with_positions


def _six_digits(df):
    """The report figures have two digits; the check compares more of them, where no value lies on a tie."""
    return df.withColumns({name: F.round(name, 6) for name, kind in df.dtypes if kind == "double"})


@query("f0_positions", with_positions("""
SELECT user_id, symbol, asset_type, quantity, round(market_value, 4) AS market_value,
       round(unrealized_pnl, 4) AS unrealized_pnl, round(allocation, 8) AS allocation FROM pos"""))
def f0_positions(spark, sf_dir):
    return P.with_allocation(positions(spark, sf_dir)).select(
        "user_id", "symbol", "asset_type", "quantity", F.round("market_value", 4).alias("market_value"),
        F.round("unrealized_pnl", 4).alias("unrealized_pnl"), F.round("allocation", 8).alias("allocation"))


SUMMARY_SQL = with_positions("""
SELECT user_id, count(*) AS total_positions, round(sum(market_value), 2) AS total_value,
       round(sum(quantity * average_price), 2) AS total_cost,
       round(sum(market_value) - sum(quantity * average_price), 2) AS total_pnl,
       round((sum(market_value) - sum(quantity * average_price)) / sum(quantity * average_price) * 100, 2)
         AS pnl_percentage,
       first(symbol ORDER BY market_value DESC, symbol DESC) AS largest_position,
       first(symbol ORDER BY unrealized_pnl / (quantity * average_price) DESC, symbol DESC) AS best_performer
FROM pos GROUP BY 1""")


@query("f1_summary", SUMMARY_SQL)
def f1_summary(spark, sf_dir):
    return P.summary(positions(spark, sf_dir))


@query("t3_largest_position", with_positions("""
SELECT user_id, symbol AS largest_position FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY market_value DESC, symbol DESC) AS n FROM pos)
WHERE n = 1"""))
def t3_largest_position(spark, sf_dir):
    return P.summary(positions(spark, sf_dir)).select("user_id", "largest_position")


CLASS_SQL = """, class AS (
  SELECT user_id, asset_type, sum(allocation) AS allocation FROM pos GROUP BY 1, 2)"""


@query("f2_diversification", with_positions(CLASS_SQL + """
, h AS (SELECT user_id, sum(allocation * allocation) AS hhi,
  string_agg(printf('%s=%.4f', asset_type, allocation), ',' ORDER BY asset_type) AS asset_allocation
  FROM class GROUP BY 1)
SELECT user_id, asset_allocation, round(hhi, 4) AS hhi_index, round(1 / hhi, 2) AS effective_holdings,
       round((1 - hhi) * 100, 1) AS diversification_score,
       CASE WHEN hhi > 0.25 THEN 'Highly concentrated portfolio. Consider diversifying across more asset classes.'
            WHEN hhi > 0.15 THEN 'Moderate concentration. Monitor position sizes.'
            ELSE 'Well-diversified portfolio.' END AS recommendation FROM h"""))
def f2_diversification(spark, sf_dir):
    shares = F.transform(F.map_entries("asset_allocation"),
                         lambda e: F.format_string("%s=%.4f", e.key, e.value))
    return P.diversification(positions(spark, sf_dir)).withColumn("asset_allocation", F.concat_ws(",", shares))


@query("f3_risk", with_positions("""
, r AS (SELECT *, CASE asset_type WHEN 'STOCK' THEN 1.2 WHEN 'BOND' THEN 0.2 ELSE 0.5 END::DOUBLE AS b,
        CASE asset_type WHEN 'STOCK' THEN 0.25 WHEN 'BOND' THEN 0.05 ELSE 0.15 END::DOUBLE AS v FROM pos),
w AS (SELECT user_id, sum(market_value) AS value, sum(market_value * b) / sum(market_value) AS beta,
        sum(market_value * v) / sum(market_value) AS vol FROM r GROUP BY 1)
SELECT user_id, round(beta, 6) AS portfolio_beta, round(vol, 6) AS portfolio_volatility,
       round(value * vol * 1.645::DOUBLE, 6) AS value_at_risk_95,
       round((beta * 0.08::DOUBLE - 0.02::DOUBLE) / vol, 6) AS sharpe_ratio,
       CASE WHEN vol > 0.20 THEN 'HIGH' WHEN vol > 0.10 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM w"""))
def f3_risk(spark, sf_dir):
    return _six_digits(P.risk(positions(spark, sf_dir), rounded=False))


@query("f4_stress", with_positions("""
, s AS (SELECT user_id, sum(market_value) AS value, sum(CASE asset_type WHEN 'STOCK' THEN market_value * 0.2::DOUBLE
          WHEN 'BOND' THEN market_value * 0.05::DOUBLE ELSE 0 END) AS crash,
        sum(CASE WHEN asset_type = 'BOND' THEN market_value * 0.1::DOUBLE ELSE 0 END) AS rate,
        sum(CASE WHEN asset_type IN ('CASH', 'STOCK') THEN market_value ELSE 0 END) AS liquid FROM pos GROUP BY 1)
SELECT user_id, round(crash, 6) AS market_crash_impact, round(crash / value * 100, 6) AS market_crash_pct,
       round(rate, 6) AS interest_rate_rise_impact, round(liquid / value * 100, 6) AS liquidity_ratio,
       CASE WHEN liquid / value > 0.20 THEN 'GOOD' ELSE 'POOR' END AS liquidity_rating FROM s"""))
def f4_stress(spark, sf_dir):
    return _six_digits(P.stress(positions(spark, sf_dir), rounded=False))


RETURNS_SQL = """, t AS (
  SELECT user_id, sum(market_value) AS value, sum(quantity * average_price) AS cost, sum(unrealized_pnl) AS pnl
  FROM pos GROUP BY 1),
p AS (SELECT *, (value - cost) / cost AS gain, pow(1 + (value - cost) / cost, 0.2::DOUBLE) - 1 AS yearly FROM t)"""


@query("f5_performance", with_positions(RETURNS_SQL + """
SELECT user_id, round(value, 6) AS total_value, round(pnl, 6) AS total_pnl, round(gain * 100, 6) AS total_return_pct,
       round(yearly * 100, 6) AS annualized_return_pct,
       CASE WHEN yearly > 0.10 THEN 'EXCELLENT' WHEN yearly > 0.05 THEN 'GOOD' WHEN yearly > 0 THEN 'FAIR'
            ELSE 'POOR' END AS performance_rating FROM p"""))
def f5_performance(spark, sf_dir):
    return _six_digits(P.performance(positions(spark, sf_dir), rounded=False))


BENCHMARK_SQL = with_positions(RETURNS_SQL + """
, b(benchmark, rate) AS (VALUES ('SPY', 0.12::DOUBLE), ('AGG', 0.04), ('GLD', 0.06))
SELECT user_id, benchmark, rate AS benchmark_return, round(yearly, 6) AS portfolio_return,
       round(yearly - rate, 6) AS excess_return, yearly - rate > 0 AS outperformance FROM p, b""")


def _benchmarks(spark, sf_dir):
    return P.benchmark_comparison(positions(spark, sf_dir)).withColumns({
        "portfolio_return": F.round("portfolio_return", 6), "excess_return": F.round("excess_return", 6)})


@query("f6_benchmarks", BENCHMARK_SQL)
def f6_benchmarks(spark, sf_dir):
    return _benchmarks(spark, sf_dir)


@query("j5_benchmark_product", BENCHMARK_SQL)
def j5_benchmark_product(spark, sf_dir):
    """Portfolio x benchmarks: the three fixed rows are exploded from every row instead of a cross join."""
    return _benchmarks(spark, sf_dir)


RISKS_SQL = """, risks AS (
  SELECT user_id, 'single_position' AS type, symbol, CAST(NULL AS VARCHAR) AS sector,
         round(allocation * 100, 1) AS allocation, 20 AS threshold,
         CASE WHEN allocation > 0.30 THEN 'high' ELSE 'medium' END AS risk_level,
         'Consider reducing position size' AS recommendation FROM pos WHERE allocation > 0.20
  UNION ALL
  SELECT user_id, 'sector_concentration', NULL, 'Technology', round(sum(allocation) * 100, 1), 50, 'high',
         'Diversify into other sectors' FROM pos WHERE symbol IN ('AAPL', 'MSFT', 'GOOGL')
  GROUP BY 1 HAVING sum(allocation) > 0.50)"""


@query("f7_concentration", with_positions(RISKS_SQL + "SELECT * FROM risks"))
def f7_concentration(spark, sf_dir):
    return P.concentration(positions(spark, sf_dir))


@query("u2_risk_union", with_positions(RISKS_SQL + "SELECT type, risk_level, count(*) AS risks FROM risks GROUP BY 1, 2"))
def u2_risk_union(spark, sf_dir):
    return P.concentration(positions(spark, sf_dir)).groupBy("type", "risk_level").agg(F.count("*").alias("risks"))


@query("f7_concentration_score", with_positions(RISKS_SQL + """
SELECT user_id, count(type) > 0 AS has_concentration_risk, count(type) * 10 AS overall_concentration_score
FROM (SELECT DISTINCT user_id FROM pos) LEFT JOIN risks USING (user_id) GROUP BY 1"""))
def f7_concentration_score(spark, sf_dir):
    return P.concentration_score(positions(spark, sf_dir))


DEVIATION_SQL = CLASS_SQL + ", " + PROFILES_SQL + """, d AS (
  SELECT user_id, t.asset_class, value, coalesce(allocation, 0) AS current, target,
         coalesce(allocation, 0) - target AS dev
  FROM profiles JOIN targets t USING (profile)
  JOIN (SELECT user_id, sum(market_value) AS value FROM pos GROUP BY 1) USING (user_id)
  LEFT JOIN class c USING (user_id) WHERE c.asset_type = t.asset_class
  UNION ALL
  SELECT user_id, t.asset_class, value, 0, target, -target FROM profiles JOIN targets t USING (profile)
  JOIN (SELECT user_id, sum(market_value) AS value FROM pos GROUP BY 1) USING (user_id)
  WHERE NOT EXISTS (SELECT 1 FROM class c WHERE c.user_id = profiles.user_id AND c.asset_type = t.asset_class))"""


@query("j6_target_join", with_positions(DEVIATION_SQL + """
SELECT user_id, asset_class, round(current, 8) AS current, target, round(dev, 8) AS deviation FROM d"""))
def j6_target_join(spark, sf_dir):
    return P.target_deviation(positions(spark, sf_dir), risk_profiles(spark, sf_dir)).select(
        "user_id", "asset_class", F.round("current", 8).alias("current"), "target",
        F.round("deviation", 8).alias("deviation"))


@query("f8_rebalance", with_positions(DEVIATION_SQL + """
SELECT user_id, asset_class, round(current * 100, 6) AS current, round(target * 100, 6) AS target,
       round(dev * 100, 6) AS deviation, CASE WHEN dev > 0 THEN 'SELL' ELSE 'BUY' END AS action,
       abs(round(value * dev, 6)) AS amount, CASE WHEN abs(dev) > 0.10 THEN 'high' ELSE 'medium' END AS priority
FROM d WHERE abs(dev) > 0.05"""))
def f8_rebalance(spark, sf_dir):
    return _six_digits(P.rebalance(positions(spark, sf_dir), risk_profiles(spark, sf_dir), rounded=False))


@query("f8_needs_rebalancing", with_positions(DEVIATION_SQL + """
SELECT user_id, bool_or(abs(dev) > 0.05) AS needs_rebalancing, count(*) FILTER (abs(dev) > 0.05) AS trades
FROM d GROUP BY 1"""))
def f8_needs_rebalancing(spark, sf_dir):
    return P.needs_rebalancing(positions(spark, sf_dir), risk_profiles(spark, sf_dir))


@query("e16_percentages", with_positions(CLASS_SQL + """
SELECT user_id, asset_type, round(allocation * 100, 1) AS allocation_pct FROM class"""))
def e16_percentages(spark, sf_dir):
    from spendlens.functions.columns import percent

    return P.class_allocation(positions(spark, sf_dir)).select(
        "user_id", "asset_type", percent("allocation").alias("allocation_pct"))
