"""Windowed spending aggregates and per-user metrics.

Every aggregate here is a plain ``groupBy().agg()`` that combines inside the map task, so a user who owns a large
share of the rows sends one partial row per task and key over the network. The one thing that does not combine is a
list of member rows. Those come as their own frames: ``window_members`` (a projection, works on streams) or
``paged_lists`` (arrays of bounded length).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from spendlens import domain
from spendlens.functions import columns as C
from spendlens.operators.sketches import distinct_estimate


def _distinct(name: str, exact: bool) -> Column:
    return F.count_distinct(F.col(name)) if exact else F.approx_count_distinct(name)


def _watermarked(tx: DataFrame, delay: str | None) -> DataFrame:
    return tx.withWatermark("timestamp", delay) if delay else tx


def split_window(df: DataFrame) -> DataFrame:
    """The window struct as ``window_start`` and ``window_end``."""
    return df.withColumns({"window_start": F.col("window.start"), "window_end": F.col("window.end")}).drop("window")


def _spend(suffix: str = "", stddev: bool = True) -> list[Column]:
    out = [
        F.count("*").alias(f"transaction_count{suffix}"),
        F.sum("amount").alias(f"total_amount{suffix}"),
        F.avg("amount").alias(f"avg_amount{suffix}"),
    ]
    return out + ([F.stddev("amount").alias(f"std_amount{suffix}")] if stddev else [])


def sliding_spend(tx: DataFrame, duration: str = "5 minutes", slide: str = "1 minute",
                  watermark: str | None = None, suffix: str = "") -> DataFrame:
    """Count, sum, average and deviation per sliding window, user and category."""
    return split_window(
        _watermarked(tx, watermark)
        .groupBy(F.window("timestamp", duration, slide), "user_id", "category")
        .agg(*_spend(suffix)))


def spending_velocity(agg: DataFrame, minutes: float = 5) -> DataFrame:
    return agg.withColumn("spending_velocity", F.col("total_amount") / minutes)


def tumbling_spend(tx: DataFrame, duration: str = "1 minute", watermark: str | None = None,
                   suffix: str = "_1min") -> DataFrame:
    """Count, sum and average per tumbling window and user."""
    return split_window(
        _watermarked(tx, watermark).groupBy(F.window("timestamp", duration), "user_id")
        .agg(*_spend(suffix, stddev=False)))


def hourly_spend(tx: DataFrame, watermark: str | None = None, exact: bool = False) -> DataFrame:
    """Hourly totals per user with distinct merchants and categories and the spend of three categories.

    The set of devices of an hour is ``hourly_devices``. Exact distinct counts are a batch feature.
    """
    def spend_on(category):
        return F.sum(F.when(F.col("category") == category, F.col("amount")).otherwise(0))

    return split_window(
        _watermarked(tx, watermark).groupBy(F.window("timestamp", "1 hour"), "user_id").agg(
            F.count("*").alias("transaction_count_hourly"),
            F.sum("amount").alias("total_amount_hourly"),
            _distinct("merchant", exact).alias("unique_merchants"),
            _distinct("category", exact).alias("unique_categories"),
            spend_on("FOOD").alias("food_spending"),
            spend_on("SHOPPING").alias("shopping_spending"),
            spend_on("ENTERTAINMENT").alias("entertainment_spending"),
        ))


def window_members(tx: DataFrame, columns: Sequence[str], duration: str, slide: str | None = None) -> DataFrame:
    """The transactions of each window, one row per (window, transaction): a projection without any shuffle."""
    w = F.window("timestamp", duration, slide) if slide else F.window("timestamp", duration)
    return split_window(tx.select(w.alias("window"), "user_id", *columns))


def page_of(identity: Column, pages: int) -> Column:
    """One of ``pages`` pages, by a digest that other engines have as well."""
    return (F.conv(F.substring(F.md5(identity.cast("string")), 1, 8), 16, 10).cast("long") % pages).cast("int")


def paged_lists(rows: DataFrame, keys: Sequence[str], item: Column, name: str, identity: str,
                pages: int = 4) -> DataFrame:
    """``collect_list`` per key in ``pages`` arrays, whatever the key's number of rows.

    The page follows from ``identity``, which tells the rows of a key apart, so a recomputed task gives the same pages,
    and every page is built on its own. All pages together hold every row; empty pages do not occur. The caller sets the
    number of pages so that the hottest key's pages fit a task.
    """
    return (rows.select(*keys, page_of(F.col(identity), pages).alias("page"), item.alias("_item"))
            .groupBy(*keys, "page").agg(F.array_sort(F.collect_list("_item")).alias(name)))


def hourly_devices(tx: DataFrame, pages: int = 4) -> DataFrame:
    """Set of devices per hour and user."""
    distinct = (split_window(tx.select(F.window("timestamp", "1 hour").alias("window"), "user_id", "device_id"))
                .filter("device_id IS NOT NULL").distinct())
    return paged_lists(distinct, ["window_start", "window_end", "user_id"], F.col("device_id"), "devices_used",
                       "device_id", pages)


def stream_aggregates(tx: DataFrame, late: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """The aggregations of the live dashboard by name, each with its own watermark (batch or stream)."""
    # Allowed lateness per aggregation.
    late = {"one_minute": "5 minutes", "five_minute": "10 minutes", "hourly": "2 hours"} if late is None else late
    return {
        "one_minute": tumbling_spend(tx, watermark=late.get("one_minute")),
        "five_minute": sliding_spend(tx, watermark=late.get("five_minute"), suffix="_5min"),
        "hourly": hourly_spend(tx, watermark=late.get("hourly")),
    }


# --- per-user metrics -------------------------------------------------------------------------------

def _profile(exact: bool) -> list[Column]:
    """Different values are counted by sketches that are exact for the first few thousand, so rows are not expanded."""
    def different(name: str) -> Column:
        return F.count_distinct(F.col(name)) if exact else distinct_estimate(name)

    return [
        F.avg("amount").alias("avg_transaction_amount"),
        F.stddev("amount").alias("std_transaction_amount"),
        F.avg(F.hour("timestamp")).alias("avg_transaction_hour"),
        F.array_sort(F.collect_set(F.dayofweek("timestamp"))).alias("active_days"),
        different("merchant").alias("total_unique_merchants"),
        different("category").alias("total_unique_categories"),
        different("location").alias("total_unique_locations"),
        different("device_id").alias("total_devices_used"),
    ]


def _distribution(categories: Sequence[str]) -> list[Column]:
    """A pivot as conditional sums: it shares the shuffle of other aggregates and has a fixed schema."""
    out = []
    for name in categories:
        mine = F.col("category") == name
        out.append(F.sum(F.when(mine, F.col("amount"))).alias(f"{name}_total"))
        out.append(F.nullif(F.count_if(mine), F.lit(0)).alias(f"{name}_count"))
    return out


def user_profile(tx: DataFrame, exact: bool = False) -> DataFrame:
    """Amount, time, merchant, location and device figures per user (weekdays are a set of at most seven)."""
    return tx.groupBy("user_id").agg(*_profile(exact))


def category_distribution(tx: DataFrame, categories: Sequence[str] = domain.CATEGORIES) -> DataFrame:
    """``{CATEGORY}_total`` and ``{CATEGORY}_count`` per user; NULL where the user has none."""
    return tx.groupBy("user_id").agg(*_distribution(categories))


def user_metrics(tx: DataFrame, categories: Sequence[str] = domain.CATEGORIES, as_of=None,
                 exact: bool = False) -> DataFrame:
    """Profile, category distribution and velocity figures of every user in one row."""
    from spendlens.operators.timeline import velocity_metrics

    profile = tx.groupBy("user_id").agg(
        *_profile(exact), *_distribution(categories), F.sum("amount").alias("total_spending"))
    return (profile.join(velocity_metrics(tx), "user_id", "left")
            .withColumn("calculated_at", C.as_of_or_now(as_of)))


def user_baseline(aggregates: DataFrame) -> DataFrame:
    """Usual spend and frequency per user, with the categories seen (the domain has eight)."""
    return aggregates.groupBy("user_id").agg(
        F.avg("total_amount").alias("avg_daily_spend"),
        F.stddev("total_amount").alias("std_daily_spend"),
        F.avg("transaction_count").alias("avg_daily_transactions"),
        F.stddev("transaction_count").alias("std_daily_transactions"),
        F.array_sort(F.collect_set("category")).alias("common_categories"),
    )


def pattern_summary(tx: DataFrame, *keys: str) -> DataFrame:
    """Volume, count and average; without keys one row for everything, zeros when there is nothing."""
    total, count = F.coalesce(F.sum("amount"), F.lit(0.0)), F.count("*")
    return tx.groupBy(*keys).agg(
        total.alias("total_volume"), count.alias("transaction_count"),
        F.coalesce(F.try_divide(total, count), F.lit(0.0)).alias("average_amount"))


# --- feeds ------------------------------------------------------------------------------------------

def newest_per_user(df: DataFrame, n: int, ts: str = "timestamp", tie: str = "transaction_id") -> DataFrame:
    """The newest ``n`` rows per user. Spark keeps at most n rows per user and map task before the shuffle."""
    w = Window.partitionBy("user_id").orderBy(F.col(ts).desc(), F.col(tie).desc())
    return df.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def list_transactions(tx: DataFrame, skip: int = 0, limit: int = 100, after: tuple | None = None) -> DataFrame:
    """One page in time order.

    Skipped rows are sorted along. For deep pages pass ``after``, the (timestamp, transaction_id) of the last row seen, which
    becomes a filter on the scan, or use ``deep_page``.
    """
    if after is not None:
        ts, transaction_id = F.lit(after[0]).cast("timestamp"), F.lit(after[1])
        later = (F.col("timestamp") > ts) | ((F.col("timestamp") == ts) & (F.col("transaction_id") > transaction_id))
        tx = tx.filter((F.col("timestamp") >= ts) & later)
    return tx.orderBy("timestamp", "transaction_id").offset(skip).limit(limit)


#: Seconds of the ranges that rows are counted in, coarse ones first; a range of few rows is not divided further.
PAGE_RANGES, FEW_ROWS = (30 * 86_400, 86_400, 3_600, 60, 1), 100_000


def deep_page(tx: DataFrame, skip: int, limit: int = 100, few: int = FEW_ROWS) -> DataFrame:
    """The page of ``list_transactions``, however deep: only the ranges of time that hold it are sorted.

    Rows are counted per range; the counts tell which ranges hold the page, and these are counted in finer ranges until they
    hold few rows or a range is a second. Every step reads the times of the remaining ranges only. Rows without a time come
    first, as in any ascending order.
    """
    second = C.epoch_second()
    missing = tx.filter("timestamp IS NULL").count()
    if skip + limit <= missing:
        return tx.filter("timestamp IS NULL").orderBy("transaction_id").offset(skip).limit(limit)
    if skip < missing:
        return list_transactions(tx, skip, limit)
    rows, before = tx.filter("timestamp IS NOT NULL"), missing
    for width in PAGE_RANGES:
        counts = rows.groupBy(F.floor(second / width).alias("range")).count()
        upto = F.sum("count").over(Window.orderBy("range")) + before  # a row per range of time
        held = counts.withColumn("upto", upto).filter((F.col("upto") > skip) & (F.col("upto") - F.col("count") < skip + limit)).agg(
            F.min("range").alias("low"), F.max("range").alias("high"), F.min(F.col("upto") - F.col("count")).alias("before"),
            F.sum("count").alias("n")).first()
        if held["n"] is None:
            return rows.limit(0)
        low, high, before = held["low"] * width, (held["high"] + 1) * width, held["before"]
        rows = rows.filter((F.col("timestamp") >= F.timestamp_seconds(F.lit(low))) & (F.col("timestamp") < F.timestamp_seconds(F.lit(high))))
        if held["n"] <= max(few, limit):
            break
    return rows.orderBy("timestamp", "transaction_id").offset(skip - before).limit(limit)


def get_transaction(tx: DataFrame, transaction_id: str) -> DataFrame:
    """The transaction, or no row."""
    return tx.filter(F.col("transaction_id") == transaction_id).limit(1)
