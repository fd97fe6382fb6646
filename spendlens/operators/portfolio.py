"""Portfolio analytics over a positions table, one result row (or a few) per user.

Positions: ``user_id, symbol, asset_type, quantity, average_price, current_price, market_value, unrealized_pnl``
(``valued`` adds the last two). Where there is an ``allocation`` as well it is taken as the share of a position, else the
share is the part of the user's market value. Everything is an aggregate per user that combines in the map tasks; the lookup tables have three and
eight fixed rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spendlens import domain
from spendlens.functions import columns as C

# Fixed values: (beta, volatility) per asset class, and for any other class.
CLASS_RISK = {"STOCK": (1.2, 0.25), "BOND": (0.2, 0.05)}
OTHER_RISK = (0.5, 0.15)
# Market return, risk-free rate, 95 % quantile, years held.
MARKET_RETURN, RISK_FREE, QUANTILE_95, YEARS = 0.08, 0.02, 1.645, 5


def _value(*asset_types: str) -> Column:
    value = F.col("market_value")
    return F.sum(F.when(F.col("asset_type").isin(*asset_types), value).otherwise(0.0) if asset_types else value)


def _cost() -> Column:
    return F.col("quantity") * F.col("average_price")


def _first_by(symbol: str, measure: Column) -> Column:
    """Symbol with the largest measure; the later symbol wins a tie."""
    return F.max_by(symbol, F.struct(measure, F.col(symbol)))


def _rounded(c, digits: int, rounded: bool) -> Column:
    """Reports show rounded figures; ``rounded=False`` keeps them for further calculation."""
    value = F.col(c) if isinstance(c, str) else c
    return F.round(value, digits) if rounded else value


def valued(positions: DataFrame) -> DataFrame:
    """Market value and profit of each position."""
    return positions.withColumn("market_value", F.col("quantity") * F.col("current_price")).withColumn(
        "unrealized_pnl", F.col("market_value") - _cost())


def with_allocation(positions: DataFrame) -> DataFrame:
    """Valued positions with their share of the user's total, if they do not have it yet.

    Only what is asked of single positions needs it; shares of classes come from ``class_allocation``.
    """
    if "allocation" in positions.columns:
        return positions
    totals = positions.groupBy("user_id").agg(F.sum("market_value").alias("_total"))
    return (positions.join(totals, "user_id")
            .withColumn("allocation", F.coalesce(F.try_divide("market_value", "_total"), F.lit(0.0))).drop("_total"))


def summary(positions: DataFrame, rounded: bool = True) -> DataFrame:
    total = positions.groupBy("user_id").agg(
        F.count("*").alias("total_positions"), F.sum("market_value").alias("value"), F.sum(_cost()).alias("cost"),
        _first_by("symbol", F.col("market_value")).alias("largest_position"),
        _first_by("symbol", F.try_divide(F.col("unrealized_pnl"), _cost())).alias("best_performer"))
    pnl = F.col("value") - F.col("cost")
    return total.select(
        "user_id", "total_positions", _rounded("value", 2, rounded).alias("total_value"),
        _rounded("cost", 2, rounded).alias("total_cost"),
        _rounded(pnl, 2, rounded).alias("total_pnl"),
        _rounded(C.ratio_or_zero(pnl, "cost") * 100, 2, rounded).alias("pnl_percentage"), "largest_position",
        "best_performer")


def _class_shares(positions: DataFrame) -> DataFrame:
    """One row per user: the total value, and (asset class, share) of every class; a class may be NULL."""
    given = "allocation" in positions.columns
    classes = positions.groupBy("user_id", "asset_type").agg(
        F.sum("market_value").alias("value"), F.sum("allocation" if given else "market_value").alias("part"))
    held = classes.groupBy("user_id").agg(
        F.sum("value").alias("value"), F.collect_list(F.struct("asset_type", "part")).alias("_classes"))
    shares = F.transform("_classes", lambda c: F.struct(
        c["asset_type"].alias("asset_type"),
        (c["part"] if given else F.coalesce(F.try_divide(c["part"], F.col("value")), F.lit(0.0))).alias("allocation")))
    return held.select("user_id", "value", shares.alias("classes"))


def class_allocation(positions: DataFrame) -> DataFrame:
    """Share of each asset class: class sums divided by their total, after the positions are summed up."""
    return _class_shares(positions).select("user_id", F.inline("classes"))


def _share_map(classes: str) -> Column:
    named = F.filter(classes, lambda c: c["asset_type"].isNotNull())
    return F.map_from_entries(F.array_sort(named))


def diversification(positions: DataFrame, rounded: bool = True) -> DataFrame:
    """Concentration index over asset classes; the allocation map has one entry per class."""
    per_user = _class_shares(positions).select(
        "user_id", _share_map("classes").alias("asset_allocation"),
        F.aggregate("classes", F.lit(0.0), lambda s, c: s + c["allocation"] * c["allocation"]).alias("hhi"))
    hhi = F.col("hhi")
    # Limits and texts.
    advice = (
        F.when(hhi > 0.25, "Highly concentrated portfolio. Consider diversifying across more asset classes.")
        .when(hhi > 0.15, "Moderate concentration. Monitor position sizes.")
        .otherwise("Well-diversified portfolio."))
    return per_user.select(
        "user_id", "asset_allocation", _rounded(hhi, 4, rounded).alias("hhi_index"),
        _rounded(C.ratio_or_zero(F.lit(1.0), hhi), 2, rounded).alias("effective_holdings"),
        _rounded((1 - hhi) * 100, 1, rounded).alias("diversification_score"),
        advice.alias("recommendation"))


def _class_risk(index: int) -> Column:
    out = F.lit(OTHER_RISK[index])
    for asset_type, risk in CLASS_RISK.items():
        out = F.when(F.col("asset_type") == asset_type, F.lit(risk[index])).otherwise(out)
    return out


def risk(positions: DataFrame, rounded: bool = True) -> DataFrame:
    """Beta, volatility, value at risk and Sharpe ratio, weighted by market value."""
    sums = positions.groupBy("user_id").agg(
        _value().alias("value"),
        F.sum(F.col("market_value") * _class_risk(0)).alias("beta"),
        F.sum(F.col("market_value") * _class_risk(1)).alias("volatility"))
    weighted = sums.select("user_id", "value", F.try_divide("beta", "value").alias("beta"),
                           F.try_divide("volatility", "value").alias("volatility"))
    volatility = F.col("volatility")
    return weighted.select(
        "user_id", _rounded("beta", 3, rounded).alias("portfolio_beta"),
        _rounded(volatility, 3, rounded).alias("portfolio_volatility"),
        _rounded(F.col("value") * volatility * QUANTILE_95, 2, rounded).alias("value_at_risk_95"),
        _rounded(F.try_divide(F.col("beta") * MARKET_RETURN - RISK_FREE, volatility), 3, rounded).alias("sharpe_ratio"),
        F.when(volatility > 0.20, "HIGH").when(volatility > 0.10, "MEDIUM").otherwise("LOW").alias("risk_level"))


def stress(positions: DataFrame, rounded: bool = True) -> DataFrame:
    """Losses in a crash and a rate rise, and the liquid share."""
    sums = positions.groupBy("user_id").agg(
        _value().alias("value"), _value("STOCK").alias("stock"), _value("BOND").alias("bond"),
        _value("CASH", "STOCK").alias("liquid"))
    crash = F.col("stock") * 0.20 + F.col("bond") * 0.05
    liquidity = C.ratio_or_zero("liquid", "value")
    return sums.select(
        "user_id", _rounded(crash, 2, rounded).alias("market_crash_impact"),
        _rounded(F.try_divide(crash, F.col("value")) * 100, 2, rounded).alias("market_crash_pct"),
        _rounded(F.col("bond") * 0.10, 2, rounded).alias("interest_rate_rise_impact"),
        _rounded(liquidity * 100, 2, rounded).alias("liquidity_ratio"),
        F.when(liquidity > 0.20, "GOOD").otherwise("POOR").alias("liquidity_rating"))


def _returns(positions: DataFrame) -> DataFrame:
    total = positions.groupBy("user_id").agg(
        _value().alias("value"), F.sum(_cost()).alias("cost"), F.sum("unrealized_pnl").alias("pnl"))
    gain = C.ratio_or_zero(F.col("value") - F.col("cost"), "cost")
    return total.withColumn("gain", gain).withColumn("annualized", F.pow(F.col("gain") + 1, F.lit(1 / YEARS)) - 1)


def performance(positions: DataFrame, rounded: bool = True) -> DataFrame:
    annualized = F.col("annualized")
    return _returns(positions).select(
        "user_id", _rounded("value", 2, rounded).alias("total_value"),
        _rounded("pnl", 2, rounded).alias("total_pnl"),
        _rounded(F.col("gain") * 100, 2, rounded).alias("total_return_pct"),
        _rounded(annualized * 100, 2, rounded).alias("annualized_return_pct"),
        F.when(annualized > 0.10, "EXCELLENT").when(annualized > 0.05, "GOOD").when(annualized > 0, "FAIR")
        .otherwise("POOR").alias("performance_rating"))


def benchmark_comparison(positions: DataFrame) -> DataFrame:
    """Every user against the three benchmarks: a fixed array exploded per user row."""
    rows = F.array(*[F.struct(F.lit(name).alias("benchmark"), F.lit(rate).alias("benchmark_return"))
                     for name, rate in domain.BENCHMARK_RETURNS.items()])
    excess = F.col("annualized") - F.col("benchmark_return")
    return _returns(positions).select("user_id", "annualized", F.inline(rows)).select(
        "user_id", "benchmark", "benchmark_return", F.col("annualized").alias("portfolio_return"),
        excess.alias("excess_return"), (excess > 0).alias("outperformance"))


def _tech_share(positions: DataFrame) -> Column:
    given = "allocation" in positions.columns
    mine = F.sum(F.when(F.col("symbol").isin(*domain.TECH_SYMBOLS), F.col("allocation" if given else "market_value"))
                 .otherwise(0.0))
    return mine if given else F.try_divide(mine, F.sum("market_value"))


def concentration(positions: DataFrame) -> DataFrame:
    """Positions above 20 % and a technology share above 50 %, one row per risk."""
    single = with_allocation(positions).filter(F.col("allocation") > 0.20).select(
        "user_id", F.lit("single_position").alias("type"), "symbol", F.lit(None).cast("string").alias("sector"),
        C.percent("allocation").alias("allocation"), F.lit(20).alias("threshold"),
        F.when(F.col("allocation") > 0.30, "high").otherwise("medium").alias("risk_level"),
        F.lit("Consider reducing position size").alias("recommendation"))
    tech = (positions.groupBy("user_id").agg(_tech_share(positions).alias("share")).filter(F.col("share") > 0.50).select(
                "user_id", F.lit("sector_concentration").alias("type"), F.lit(None).cast("string").alias("symbol"),
                F.lit("Technology").alias("sector"), C.percent("share").alias("allocation"),
                F.lit(50).alias("threshold"), F.lit("high").alias("risk_level"),
                F.lit("Diversify into other sectors").alias("recommendation")))
    return single.unionByName(tech)


def concentration_score(positions: DataFrame) -> DataFrame:
    """10 points per risk; users without a risk have 0."""
    shared = with_allocation(positions)
    per_user = shared.groupBy("user_id").agg(
        F.count_if(F.col("allocation") > 0.20).alias("single"), _tech_share(shared).alias("tech"))
    n = F.col("single") + F.when(F.col("tech") > 0.50, 1).otherwise(0)
    return per_user.select(
        "user_id", (n > 0).alias("has_concentration_risk"), (n * 10).alias("overall_concentration_score"))


def _targets(users: DataFrame) -> DataFrame:
    """The users' rows with each asset class and target share; an unknown or missing profile counts as MODERATE."""
    def shares(profile):
        return F.array(*[F.struct(F.lit(a).alias("asset_class"), F.lit(s).alias("target"))
                         for a, s in domain.TARGET_ALLOCATIONS[profile].items()])

    tolerance = F.upper("risk_tolerance")
    chosen = (F.when(tolerance == "CONSERVATIVE", shares("CONSERVATIVE"))
              .when(tolerance == "AGGRESSIVE", shares("AGGRESSIVE")).otherwise(shares("MODERATE")))
    return users.select("*", F.inline(chosen))


def target_deviation(positions: DataFrame, profiles: DataFrame) -> DataFrame:
    """Actual share against the target of each targeted class; a class that is not held has share 0.

    Every user with positions has rows, also without a profile. The positions are reduced to a handful of classes per
    user and then to one row with their shares, so the left join of targets and classes is a lookup in that row.
    """
    held = _class_shares(positions).select("user_id", "value", _share_map("classes").alias("shares"))
    current = F.coalesce(F.try_element_at("shares", F.col("asset_class")), F.lit(0.0))
    return _targets(held.join(profiles.select("user_id", "risk_tolerance"), "user_id", "left")).select(
        "user_id", "asset_class", "value", current.alias("current"), "target",
        (current - F.col("target")).alias("deviation"))


def rebalance(positions: DataFrame, profiles: DataFrame, rounded: bool = True) -> DataFrame:
    """Trades for classes more than 5 points off target."""
    off = F.abs("deviation")
    return target_deviation(positions, profiles).filter(off > 0.05).select(
        "user_id", "asset_class", _rounded(F.col("current") * 100, 1, rounded).alias("current"),
        _rounded(F.col("target") * 100, 1, rounded).alias("target"),
        _rounded(F.col("deviation") * 100, 1, rounded).alias("deviation"),
        F.when(F.col("deviation") > 0, "SELL").otherwise("BUY").alias("action"),
        F.abs(_rounded(F.col("value") * F.col("deviation"), 2, rounded)).alias("amount"),
        F.when(off > 0.10, "high").otherwise("medium").alias("priority"))


def needs_rebalancing(positions: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row per user: whether a targeted class is more than 5 points off, and how many are."""
    off = F.count_if(F.abs("deviation") > 0.05)
    return target_deviation(positions, profiles).groupBy("user_id").agg(
        (off > 0).alias("needs_rebalancing"), off.alias("trades"))


def analyze(positions: DataFrame, profiles: DataFrame) -> dict[str, DataFrame]:
    """All analyses of a portfolio by name."""
    return {
        "portfolio_summary": summary(positions), "diversification_analysis": diversification(positions),
        "risk_analysis": risk(positions), "stress_tests": stress(positions),
        "performance_analysis": performance(positions), "benchmark_comparison": benchmark_comparison(positions),
        "concentration_risks": concentration(positions), "concentration_score": concentration_score(positions),
        "rebalancing_recommendations": rebalance(positions, profiles),
        "needs_rebalancing": needs_rebalancing(positions, profiles),
    }
