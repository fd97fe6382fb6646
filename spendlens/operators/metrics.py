"""Operational and business metric rules, and the dashboard figures.

A rule first rolls its events up to one row per minute and series (combined in the map tasks), then slides its window
over those minutes. Whatever the traffic, the windowed part only sees minutes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from spendlens.functions import columns as C
from spendlens.session import shared_dir

# Upper bounds of the latency histogram in seconds; one more bucket is open-ended.
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)

# Evaluations are numbered in pieces of so many steps: a day of minutes.
STEPS_PER_PIECE = 1_440


def _minute(ts: str) -> Column:
    return F.date_trunc("minute", F.col(ts))


def sliding_sums(events: DataFrame, measures: Mapping[str, Column], minutes: int, keys: Sequence[str] = (),
                 ts: str = "timestamp") -> DataFrame:
    """Sums of ``measures`` over ``[evaluated_at - minutes, evaluated_at)``.

    There is a row for every minute that has an event in its window. ``measures`` are sums or counts, because minutes
    are added up.
    """
    per_minute = events.groupBy(*keys, _minute(ts).alias("minute")).agg(
        *[column.alias(name) for name, column in measures.items()])
    first, last = F.expr("minute + INTERVAL 1 MINUTE"), F.expr(f"minute + INTERVAL {minutes} MINUTE")
    ends = F.sequence(first, last, F.expr("INTERVAL 1 MINUTE"))
    return (per_minute.withColumn("evaluated_at", F.explode(ends)).groupBy(*keys, "evaluated_at")
            .agg(*[F.sum(name).alias(name) for name in measures]))


def held(evaluations: DataFrame, condition: Column, hold_minutes: int, value: Column, keys: Sequence[str] = (),
         step_minutes: int = 1) -> DataFrame:
    """Episodes in which a condition was true at consecutive evaluations for at least ``hold_minutes``.

    Gives ``pending_since``, ``firing_since``, ``last_true`` and the highest ``peak`` value. Evaluations are numbered per
    series and piece of time; only episodes that touch the border of a piece, at most two of each, meet in one window.
    """
    step = F.floor(F.col("evaluated_at").cast("long") / (60 * step_minutes))
    piece = F.floor(F.col("_step") / STEPS_PER_PIECE)
    true = evaluations.filter(condition).withColumn("_peak", value).withColumn("_step", step).withColumn("_piece", piece)
    island = F.col("_step") - F.row_number().over(Window.partitionBy(*keys, "_piece").orderBy("evaluated_at"))
    parts = true.withColumn("_island", island).groupBy(*keys, "_piece", "_island").agg(
        F.min("evaluated_at").alias("pending_since"), F.max("evaluated_at").alias("last_true"),
        F.max("_peak").alias("peak"), F.min("_step").alias("_from"), F.max("_step").alias("_to"))
    at_border = (F.col("_from") % STEPS_PER_PIECE == 0) | (F.col("_to") % STEPS_PER_PIECE == STEPS_PER_PIECE - 1)
    in_order = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit("all")]).orderBy("_from")
    opens = F.coalesce((F.col("_from") - F.lag("_to").over(in_order) > 1).cast("int"), F.lit(0))
    joined = parts.filter(at_border).withColumn("_opens", opens).withColumn("_whole", F.sum("_opens").over(in_order)).groupBy(
        *keys, "_whole").agg(F.min("pending_since").alias("pending_since"), F.max("last_true").alias("last_true"),
                             F.max("peak").alias("peak"))
    episodes = parts.filter(~at_border).select(*joined.drop("_whole").columns).unionByName(joined.drop("_whole"))
    firing = F.col("pending_since") + F.expr(f"INTERVAL {hold_minutes} MINUTE")
    return (episodes.withColumn("firing_since", firing).filter(F.col("last_true") >= F.col("firing_since"))
            .select(*keys, "pending_since", "firing_since", "last_true", "peak"))


# --- rules ------------------------------------------------------------------------------------------

def transaction_rate(tx: DataFrame, minutes: int = 5) -> DataFrame:
    """Transactions per second."""
    sums = sliding_sums(tx, {"transactions": F.count("*")}, minutes)
    return sums.withColumn("rate", F.col("transactions") / (60 * minutes))


def high_volume(tx: DataFrame, threshold: float = 1000, hold_minutes: int = 5) -> DataFrame:
    return held(transaction_rate(tx), F.col("rate") > threshold, hold_minutes, F.col("rate"))


def share_series(events: DataFrame, bad: Column, minutes: int, keys: Sequence[str] = (),
                 ts: str = "timestamp") -> DataFrame:
    """Share of events that satisfy ``bad`` per sliding window."""
    sums = sliding_sums(events, {"bad": F.count_if(bad), "events": F.count("*")}, minutes, keys, ts)
    return sums.withColumn("share", F.try_divide("bad", "events"))


def fraud_rate(tx: DataFrame, minutes: int = 60) -> DataFrame:
    return share_series(tx, F.col("status") == "FRAUD", minutes)


def high_fraud_rate(tx: DataFrame, threshold: float = 0.01, hold_minutes: int = 15) -> DataFrame:
    return held(fraud_rate(tx), F.col("share") > threshold, hold_minutes, F.col("share"))


def error_share(requests: DataFrame, minutes: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    return share_series(requests, F.col("status_code").between(500, 599), minutes, keys, ts="ts")


def high_error_rate(requests: DataFrame, threshold: float = 0.05, hold_minutes: int = 5,
                    keys: Sequence[str] = ()) -> DataFrame:
    return held(error_share(requests, 5, keys), F.col("share") > threshold, hold_minutes, F.col("share"), keys)


def histogram_quantile(requests: DataFrame, q: float = 0.95, minutes: int = 5, keys: Sequence[str] = (),
                       buckets: Sequence[float] = LATENCY_BUCKETS, value: str = "duration_s") -> DataFrame:
    """Quantile from bucket counts, linear inside a bucket; the open bucket gives the largest bound."""
    counts = {f"le_{i}": F.count_if(F.col(value) <= bound) for i, bound in enumerate(buckets)}
    sums = sliding_sums(requests, {**counts, "events": F.count(value)}, minutes, keys, ts="ts")
    rank = F.col("events") * q
    out = F.lit(float(buckets[-1]))
    for i in reversed(range(len(buckets))):
        low = float(buckets[i - 1]) if i else 0.0
        below = F.col(f"le_{i - 1}") if i else F.lit(0)
        inside = F.col(f"le_{i}") - below
        at = low + (buckets[i] - low) * F.try_divide(rank - below, inside)
        out = F.when(F.col(f"le_{i}") >= rank, F.coalesce(at, F.lit(low))).otherwise(out)
    return sums.withColumn("quantile", out).select(*keys, "evaluated_at", "events", "quantile")


def slow_responses(requests: DataFrame, threshold: float = 5, hold_minutes: int = 10, keys: Sequence[str] = (),
                   buckets: Sequence[float] = LATENCY_BUCKETS) -> DataFrame:
    series = histogram_quantile(requests, 0.95, 5, keys, buckets)
    return held(series, F.col("quantile") > threshold, hold_minutes, F.col("quantile"), keys)


#: Parts into which a range of values is divided at each step but the first.
RADIX = 1_024


def _octave(value: Column) -> Column:
    """Order-preserving bucket of a number, 64 per power of two."""
    infinite = F.abs(value) == float("inf")
    size = F.when(infinite, 200_000).otherwise(F.floor(F.log2(F.abs(value)) * 64) + 100_000)
    return F.when(F.isnan(value), 300_000).when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0)).cast("long")


def _digit(value: Column, low: Column, high: Column) -> Column:
    """Which of ``RADIX`` equal parts of a range a value is in; the ends are always in different parts."""
    at = (value / 4 - low / 4) / (high / 4 - low / 4)
    inner = F.when(F.isnan(at), 1).otherwise(F.floor(F.least(F.greatest(at, F.lit(0.0)), F.lit(1.0)) * RADIX))
    return F.when(value <= low, 0).when(value >= high, RADIX - 1).otherwise(F.least(F.greatest(inner, F.lit(0)), F.lit(RADIX - 1))).cast("long")


def exact_quantile(requests: DataFrame, q: float = 0.95, duration: str = "5 minutes", keys: Sequence[str] = (),
                   value: str = "duration_s") -> DataFrame:
    """Interpolated quantile per tumbling window by radix selection.

    Two ranks are looked for, below and above the quantile. Values are never ordered: a pass counts them by the next digit of
    the range in which a rank lies, at first by powers of two, then in ``RADIX`` equal parts, and the part that holds the rank
    is the next range, until it has a single value. Counts are made in the map tasks; the only windows are over the counts of
    a group's digits. After the first pass, which leaves a hundredth of the range of a value, five more settle any double.
    """
    spark, group = requests.sparkSession, [*keys, "window"]
    held = [f"_of_{k}" for k in group]
    v = F.col("_v")
    counted = requests.filter(F.col(value).isNotNull()).groupBy(
        *keys, F.window("ts", duration).alias("window"), F.col(value).cast("double").alias("_v")).agg(
        F.count("*").alias("_n")).persist(StorageLevel.MEMORY_AND_DISK)
    root, step = shared_dir(spark, "quantile"), 0
    events = counted.groupBy(*group).agg(F.sum("_n").alias("events"))
    ranks = F.array(F.floor((F.col("events") - 1) * q), F.ceil((F.col("events") - 1) * q))
    whole = events.select(*[F.col(k).alias(h) for k, h in zip(group, held)], "events", F.posexplode(ranks).alias("_which", "_rank"), F.lit(0).cast("long").alias("_before"))

    def narrowed(rows: DataFrame, digit: Column) -> DataFrame:
        """For each rank the part that holds it."""
        parts = rows.groupBy(*held, "_which", "events", "_rank", "_before", digit.alias("_digit")).agg(
            F.sum("_n").alias("_size"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        order = Window.partitionBy(*held, "_which").orderBy("_digit")
        upto = parts.withColumn("_upto", F.col("_before") + F.sum("_size").over(order))
        return upto.filter((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_size") <= F.col("_rank"))).select(
            *held, "events", "_which", "_rank", (F.col("_upto") - F.col("_size")).alias("_before"), "_low", "_high")

    def stored(targets: DataFrame) -> DataFrame:
        nonlocal step
        step += 1
        targets.write.parquet(f"{root}/{step}")
        return spark.read.schema(targets.schema).parquet(f"{root}/{step}")

    same = [F.col(k).eqNullSafe(F.col(h)) if k in keys else F.col(k) == F.col(h) for k, h in zip(group, held)]
    try:
        targets = stored(narrowed(counted.join(whole, same), _octave(v)))
        settled = [targets.filter("_low = _high")]
        while not (left := targets.filter("_low <> _high")).isEmpty():
            inside = counted.join(left, [*same, v >= F.col("_low"), v <= F.col("_high")])
            parts = inside.withColumn("_part", _digit(v, F.col("_low"), F.col("_high"))).drop("_low", "_high")
            targets = stored(narrowed(parts, F.col("_part")))
            settled.append(targets.filter("_low = _high"))
    finally:
        counted.unpersist()
    found = reduce(DataFrame.unionByName, settled).withColumnsRenamed(dict(zip(held, group)))
    ends = found.groupBy(*group, "events").agg(F.min(F.when(F.col("_which") == 0, F.col("_low"))).alias("_from"),
                                               F.min(F.when(F.col("_which") == 1, F.col("_low"))).alias("_to"))
    rank = (F.col("events") - 1) * q
    quantile = F.when(F.col("_from") == F.col("_to"), F.col("_from")).otherwise(
        F.col("_from") + (F.col("_to") - F.col("_from")) * (rank - F.floor(rank)))
    return ends.select(*keys, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                       "events", quantile.alias("quantile"))


def approximate_quantile(requests: DataFrame, q: float = 0.95, duration: str = "5 minutes",
                         keys: Sequence[str] = (), value: str = "duration_s", accuracy: int = 10_000) -> DataFrame:
    """The same with a mergeable sketch, also for streams."""
    return requests.groupBy(*keys, F.window("ts", duration).alias("window")).agg(
        F.count(value).alias("events"), F.percentile_approx(value, q, accuracy).alias("quantile"),
    ).select(*keys, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "events",
             "quantile")


def lag_levels(lag: DataFrame, key: str, how: str, step_minutes: int = 1) -> DataFrame:
    """Average or sum of the reported lags per key and evaluation step."""
    function = {"avg": F.avg, "sum": F.sum}[how]
    at = F.window("ts", f"{step_minutes} minutes")
    return lag.groupBy(key, at.alias("window")).agg(function("lag").cast("double").alias("lag")).select(
        key, F.col("window.end").alias("evaluated_at"), "lag")


def high_lag(lag: DataFrame, key: str, how: str, threshold: float = 1000, hold_minutes: int = 10,
             step_minutes: int = 1) -> DataFrame:
    return held(lag_levels(lag, key, how, step_minutes), F.col("lag") > threshold, hold_minutes, F.col("lag"), [key],
                step_minutes)


def low_cash(accounts: DataFrame, threshold: float = 1000) -> DataFrame:
    """Users whose checking accounts hold less than the threshold on average."""
    return (accounts.filter(F.col("account_type") == "CHECKING").groupBy("user_id")
            .agg(F.avg("balance").alias("avg_balance")).filter(F.col("avg_balance") < threshold))


def silent_sources(beats: DataFrame, as_of=None, minutes: int = 1, key: str = "source",
                   ts: str = "ts") -> DataFrame:
    """Sources whose last sign of life is too old."""
    limit = C.as_of_or_now(as_of) - F.make_dt_interval(mins=F.lit(minutes))
    return beats.groupBy(key).agg(F.max(ts).alias("last_seen")).filter(F.col("last_seen") < limit)


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("events"))


# --- dashboard --------------------------------------------------------------------------------------

def category_shares(tx: DataFrame) -> DataFrame:
    """Spend per user and category with its share of the user's spend (a handful of categories per user)."""
    spend = tx.groupBy("user_id", "category").agg(F.sum("amount").alias("spend"))
    total = F.sum("spend").over(Window.partitionBy("user_id"))
    return spend.withColumn("share_pct", F.round(F.try_divide(F.col("spend"), total) * 100, 1))


def daily_change(tx: DataFrame) -> DataFrame:
    """Spend per day and its change against the user's previous day with spend."""
    daily = tx.groupBy("user_id", F.to_date("timestamp").alias("day")).agg(F.sum("amount").alias("spend"))
    before = F.lag("spend").over(Window.partitionBy("user_id").orderBy("day"))
    return daily.withColumn("previous_spend", before).withColumn(
        "change_pct", F.round(F.try_divide(F.col("spend") - F.col("previous_spend"), F.col("previous_spend")) * 100, 1))


def category_against_average(tx: DataFrame, as_of) -> DataFrame:
    """Average amount of this month per user and category against the average of all time."""
    month = F.date_trunc("month", C.as_of_or_now(as_of))
    current = (F.col("timestamp") >= month) & (F.col("timestamp") < C.as_of_or_now(as_of))
    return tx.groupBy("user_id", "category").agg(
        F.avg(F.when(current, F.col("amount"))).alias("month_avg"), F.avg("amount").alias("overall_avg"),
    ).withColumn("change_pct", F.round(
        F.try_divide(F.col("month_avg") - F.col("overall_avg"), F.col("overall_avg")) * 100, 1))
