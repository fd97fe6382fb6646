"""Mergeable sketches: figures per minute that add up to hours, days and users without the rows.

A stored minute has sums, theta sketches of the columns whose different values are counted, and, for latencies, a KLL sketch
of the quantiles. Longer periods and users are merged from minutes, as long as they are kept, so each row is read once, and
no aggregate expands rows or keeps sets of values.

A theta sketch of ``2 ** bits`` entries is exact up to that many different values; beyond, its standard error is 1 divided by
the square root of that number. A KLL sketch of size k gives ranks within about 2.3 / k ** 0.9.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from spendlens.functions import columns as C

#: Entries of a theta sketch as a power of two.
BITS = 12
#: Size of a quantile sketch.
KLL_SIZE = 400
COUNTED = ("merchant", "category", "location", "device_id")


def distinct_estimate(column: str, bits: int = BITS) -> Column:
    """Number of different values, exact up to ``2 ** bits``; 0 where there are only NULLs."""
    return F.coalesce(F.theta_sketch_estimate(F.theta_sketch_agg(F.col(column).cast("string"), F.lit(bits))), F.lit(0).cast("long"))


def minute_sketches(tx: DataFrame, categories: Sequence[str] = ("FOOD", "SHOPPING", "ENTERTAINMENT"), counted: Sequence[str] = COUNTED,
                    bits: int = BITS) -> DataFrame:
    """One row per user and minute: count, exact total, spend by category, and a sketch of each counted column."""
    spent = {c: F.sum(F.when(F.col("category") == c, C.units("amount"))) for c in categories}
    return tx.groupBy("user_id", F.date_trunc("minute", "timestamp").alias("minute")).agg(
        F.count("*").alias("n"), F.sum(C.units("amount")).alias("units"),
        *[total.alias(f"units_{c}") for c, total in spent.items()],
        *[F.theta_sketch_agg(F.col(c).cast("string"), F.lit(bits)).alias(f"seen_{c}") for c in counted])


def merged(minutes: DataFrame, *keys: Column | str, bits: int = BITS) -> DataFrame:
    """Minutes merged by any keys: the same columns, so the result can be merged again."""
    sums = [F.sum(c).alias(c) for c in minutes.columns if c == "n" or c.startswith("units")]
    seen = [F.theta_union_agg(c, F.lit(bits)).alias(c) for c in minutes.columns if c.startswith("seen_")]
    return minutes.groupBy(*keys).agg(*sums, *seen)


def estimates(sketched: DataFrame) -> DataFrame:
    """Sums as amounts, and the number of different values from each sketch."""
    out = []
    for c in sketched.columns:
        if c == "n":
            out.append(F.col(c).alias("transaction_count"))
        elif c.startswith("units"):
            out.append(C.from_units(F.coalesce(F.col(c), F.lit(0))).alias("total_amount" if c == "units" else f"{c.removeprefix('units_').lower()}_spending"))
        elif c.startswith("seen_"):
            out.append(F.coalesce(F.theta_sketch_estimate(c), F.lit(0).cast("long")).alias(f"unique_{c.removeprefix('seen_')}"))
        else:
            out.append(F.col(c))
    return sketched.select(*out)


def hourly_from_minutes(minutes: DataFrame) -> DataFrame:
    """Hours per user from stored minutes."""
    hour = F.date_trunc("hour", "minute").alias("window_start")
    return estimates(merged(minutes, "user_id", hour)).withColumn("window_end", F.expr("window_start + INTERVAL 1 HOUR"))


def users_from_minutes(minutes: DataFrame) -> DataFrame:
    """All time per user from stored minutes."""
    return estimates(merged(minutes, "user_id"))


# --- quantiles ------------------------------------------------------------------------------------------

def minute_quantiles(requests: DataFrame, keys: Sequence[str] = (), value: str = "duration_s", ts: str = "ts", size: int = KLL_SIZE) -> DataFrame:
    """One row per minute (and key): a quantile sketch of the values; minutes without a value are left out. Also for streams."""
    known = requests.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return known.groupBy(*keys, F.window(ts, "1 minute").alias("window")).agg(
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size)).alias("sketch")).withColumn(
        "minute", F.col("window.start")).drop("window")


def quantile_from_minutes(minutes: DataFrame, q: float = 0.95, duration: str = "5 minutes", keys: Sequence[str] = (),
                          size: int = KLL_SIZE) -> DataFrame:
    """A quantile per longer window from the sketches of its minutes."""
    merged_sketch = F.kll_merge_agg_double("sketch", F.lit(size))
    windows = minutes.groupBy(*keys, F.window("minute", duration).alias("window")).agg(merged_sketch.alias("sketch"))
    return windows.select(*keys, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                          F.kll_sketch_get_n_double("sketch").alias("events"),
                          F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias("quantile"))
