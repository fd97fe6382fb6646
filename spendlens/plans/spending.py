"""Windowed spend, sessions, trailing spend and user metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from spendlens import sinks
from spendlens.operators import aggregates as A, alerts, sketches as S, timeline as L
from spendlens.plans.registry import ORACLE, query
from spendlens.plans.tables import AS_OF, epoch, transactions, with_tx

# Every window a transaction falls into, as in a 5-minute window sliding by one minute.
SLIDING_SQL = """, member AS (
  SELECT tx.*, (sec // 60) * 60 - 60 * i AS window_start, (sec // 60) * 60 - 60 * i + 300 AS window_end
  FROM tx, range(5) AS r(i))"""

A1_SQL = SLIDING_SQL + """, agg AS (
  SELECT window_start, window_end, user_id, category, count(*) AS transaction_count, sum(amount) AS total,
         avg(amount) AS average, stddev_samp(amount) AS deviation
  FROM member GROUP BY ALL)"""


#: The page of a row among four, as ``aggregates.page_of`` has it.
PAGE_SQL = "CAST(('0x' || substr(md5({}), 1, 8))::BIGINT % 4 AS INTEGER) AS page"


@query("a1_sliding_spend", with_tx(A1_SQL + """
SELECT window_start, window_end, user_id, category, transaction_count, round(total, 2) AS total_amount,
       round(average, 6) AS avg_amount, round(deviation, 6) AS std_amount,
       round(total / 5, 6) AS spending_velocity FROM agg"""))
def a1_sliding_spend(spark, sf_dir):
    agg = A.spending_velocity(A.sliding_spend(transactions(spark, sf_dir)))
    return agg.select(
        epoch("window_start").alias("window_start"), epoch("window_end").alias("window_end"), "user_id", "category",
        "transaction_count", F.round("total_amount", 2).alias("total_amount"),
        F.round("avg_amount", 6).alias("avg_amount"), F.round("std_amount", 6).alias("std_amount"),
        F.round("spending_velocity", 6).alias("spending_velocity"))


@query("a1_window_lists", with_tx(SLIDING_SQL + """
SELECT window_start, window_end, user_id, category, """ + PAGE_SQL.format("transaction_id") + """,
       string_agg(transaction_id || ':' || amount || ':' || merchant, ',' ORDER BY transaction_id) AS recent_transactions
FROM member GROUP BY ALL"""))
def a1_window_lists(spark, sf_dir):
    """Member transactions of every window as arrays, spread over four pages."""
    members = A.window_members(transactions(spark, sf_dir), ["category", "transaction_id", "amount", "merchant"],
                               "5 minutes", "1 minute")
    lists = A.paged_lists(members, ["window_start", "window_end", "user_id", "category"],
                          F.struct("transaction_id", "amount", "merchant"), "items", "transaction_id")
    text = F.transform("items", lambda t: F.concat_ws(":", t.transaction_id, t.amount.cast("string"), t.merchant))
    return lists.select(epoch("window_start").alias("window_start"), epoch("window_end").alias("window_end"),
                        "user_id", "category", "page", F.concat_ws(",", text).alias("recent_transactions"))


@query("a1_window_members", with_tx(SLIDING_SQL + """
SELECT window_start, window_end, user_id, category, transaction_id, amount, merchant FROM member"""))
def a1_window_members(spark, sf_dir):
    members = A.window_members(transactions(spark, sf_dir), ["category", "transaction_id", "amount", "merchant"],
                               "5 minutes", "1 minute")
    return members.withColumns({"window_start": epoch("window_start"), "window_end": epoch("window_end")})


@query("a2_minute_spend", with_tx("""
SELECT (sec // 60) * 60 AS window_start, user_id, count(*) AS transaction_count, round(sum(amount), 2) AS total_amount,
       round(avg(amount), 6) AS avg_amount FROM tx GROUP BY 1, 2"""))
def a2_minute_spend(spark, sf_dir):
    return A.tumbling_spend(transactions(spark, sf_dir), suffix="").select(
        epoch("window_start").alias("window_start"), "user_id", "transaction_count",
        F.round("total_amount", 2).alias("total_amount"), F.round("avg_amount", 6).alias("avg_amount"))


@query("a2_minute_lists", with_tx("""
SELECT (sec // 60) * 60 AS window_start, user_id, """ + PAGE_SQL.format("transaction_id") + """,
       string_agg(category || ':' || merchant || ':' || amount, ',' ORDER BY category, merchant, amount)
         AS recent_transactions FROM tx GROUP BY 1, 2, 3"""))
def a2_minute_lists(spark, sf_dir):
    members = A.window_members(transactions(spark, sf_dir), ["transaction_id", "category", "amount", "merchant"],
                               "1 minute")
    lists = A.paged_lists(members, ["window_start", "user_id"], F.struct("category", "merchant", "amount"), "items",
                          "transaction_id")
    text = F.transform("items", lambda t: F.concat_ws(":", t.category, t.merchant, t.amount.cast("string")))
    return lists.select(epoch("window_start").alias("window_start"), "user_id", "page",
                        F.concat_ws(",", text).alias("recent_transactions"))


@query("a3_sliding_spend_5min", with_tx(A1_SQL + """
SELECT window_start, user_id, category, transaction_count AS transaction_count_5min,
       round(total, 2) AS total_amount_5min, round(average, 6) AS avg_amount_5min,
       round(deviation, 6) AS std_amount_5min FROM agg"""))
def a3_sliding_spend_5min(spark, sf_dir):
    agg = A.stream_aggregates(transactions(spark, sf_dir), late={})["five_minute"]
    return agg.select(
        epoch("window_start").alias("window_start"), "user_id", "category", "transaction_count_5min",
        F.round("total_amount_5min", 2).alias("total_amount_5min"),
        F.round("avg_amount_5min", 6).alias("avg_amount_5min"), F.round("std_amount_5min", 6).alias("std_amount_5min"))


@query("a4_hourly_spend", with_tx("""
SELECT (sec // 3600) * 3600 AS window_start, user_id, count(*) AS transaction_count_hourly,
       round(sum(amount), 2) AS total_amount_hourly, count(DISTINCT merchant) AS unique_merchants,
       count(DISTINCT category) AS unique_categories,
       round(sum(CASE WHEN category = 'FOOD' THEN amount ELSE 0 END), 2) AS food_spending,
       round(sum(CASE WHEN category = 'SHOPPING' THEN amount ELSE 0 END), 2) AS shopping_spending,
       round(sum(CASE WHEN category = 'ENTERTAINMENT' THEN amount ELSE 0 END), 2) AS entertainment_spending
FROM tx GROUP BY 1, 2"""))
def a4_hourly_spend(spark, sf_dir):
    return _hourly(A.hourly_spend(transactions(spark, sf_dir), exact=True))


@query("a4_hourly_from_minutes", ORACLE["a4_hourly_spend"])
def a4_hourly_from_minutes(spark, sf_dir):
    """Hours merged from minutes: sums, and sketches that are exact for so few values."""
    hours = S.hourly_from_minutes(S.minute_sketches(transactions(spark, sf_dir)))
    return _hourly(hours.withColumnsRenamed({
        "transaction_count": "transaction_count_hourly", "total_amount": "total_amount_hourly",
        "unique_merchant": "unique_merchants", "unique_category": "unique_categories"}))


@query("a6_users_from_minutes", with_tx("""
SELECT user_id, count(*) AS transaction_count, round(sum(amount), 2) AS total_amount, count(DISTINCT merchant) AS unique_merchant,
       count(DISTINCT category) AS unique_category, count(DISTINCT location) AS unique_location,
       count(DISTINCT device_id) AS unique_device_id FROM tx GROUP BY 1"""))
def a6_users_from_minutes(spark, sf_dir):
    """All time per user, merged from hours that were merged from minutes."""
    hours = S.merged(S.minute_sketches(transactions(spark, sf_dir), categories=()), "user_id", F.date_trunc("hour", "minute").alias("minute"))
    return S.users_from_minutes(hours).withColumn("total_amount", F.round("total_amount", 2))


@query("a6_sketch_error", with_tx("""
SELECT category, count(DISTINCT transaction_id) > 256 AS many, TRUE AS close FROM tx GROUP BY 1"""))
def a6_sketch_error(spark, sf_dir):
    """Sketches of 256 entries over thousands of ids, merged from minutes, are within four times their standard error."""
    tx = transactions(spark, sf_dir)
    minutes = S.minute_sketches(tx.withColumn("user_id", F.col("category")), (), ("transaction_id",), bits=8)
    found = S.estimates(S.merged(minutes, "user_id", bits=8)).select(F.col("user_id").alias("category"), "unique_transaction_id")
    exact = tx.groupBy("category").agg(F.count_distinct("transaction_id").alias("n"))
    off = F.abs(F.col("unique_transaction_id") - F.col("n"))
    return found.join(exact, "category").select("category", (F.col("n") > 256).alias("many"), (off <= 4 * F.col("n") / 16).alias("close"))


@query("a4_hourly_spend_approx")
def a4_hourly_spend_approx(spark, sf_dir):
    """The default form with sketches for the distinct counts."""
    return _hourly(A.hourly_spend(transactions(spark, sf_dir)))


@query("a4_hourly_approx_error", with_tx("""
SELECT (sec // 3600) * 3600 AS window_start, user_id, count(*) AS transaction_count_hourly, TRUE AS close
FROM tx GROUP BY 1, 2"""))
def a4_hourly_approx_error(spark, sf_dir):
    """The sketches are within a fifth of the exact distinct counts, four times their standard error."""
    tx, keys = transactions(spark, sf_dir), ["window_start", "window_end", "user_id"]
    exact = A.hourly_spend(tx, exact=True).select(*keys, F.col("unique_merchants").alias("m"), F.col("unique_categories").alias("c"))
    near = [F.abs(F.col(a) - F.col(b)) <= F.greatest(F.lit(0.0), 0.2 * F.col(b)) for a, b in
            (("unique_merchants", "m"), ("unique_categories", "c"))]
    return A.hourly_spend(tx).join(exact, keys).select(
        epoch("window_start").alias("window_start"), "user_id", "transaction_count_hourly", (near[0] & near[1]).alias("close"))


def _hourly(agg):
    money = ["total_amount_hourly", "food_spending", "shopping_spending", "entertainment_spending"]
    return agg.select(
        epoch("window_start").alias("window_start"), "user_id", "transaction_count_hourly", "unique_merchants",
        "unique_categories", *[F.round(c, 2).alias(c) for c in money])


@query("a4_hourly_devices", with_tx("""
SELECT (sec // 3600) * 3600 AS window_start, user_id, """ + PAGE_SQL.format("device_id") + """,
       string_agg(DISTINCT device_id, ',' ORDER BY device_id) AS devices_used FROM tx GROUP BY 1, 2, 3"""))
def a4_hourly_devices(spark, sf_dir):
    return A.hourly_devices(transactions(spark, sf_dir)).select(
        epoch("window_start").alias("window_start"), "user_id", "page",
        F.concat_ws(",", "devices_used").alias("devices_used"))


SESSION_SQL = """, gaps AS (
  SELECT *, sec - lag(sec) OVER (PARTITION BY user_id ORDER BY timestamp, transaction_id) AS gap FROM tx),
numbered AS (
  SELECT *, sum(CASE WHEN gap > 1800 THEN 1 ELSE 0 END) OVER (
    PARTITION BY user_id ORDER BY timestamp, transaction_id ROWS UNBOUNDED PRECEDING) AS session_id FROM gaps)"""


@query("a5_sessions", with_tx(SESSION_SQL + """
SELECT user_id, CAST(session_id AS BIGINT) AS session_id, count(*) AS session_transaction_count,
       round(sum(amount), 2) AS session_total_amount, min(sec) AS session_start, max(sec) AS session_end
FROM numbered GROUP BY 1, 2"""))
def a5_sessions(spark, sf_dir):
    return L.sessions(transactions(spark, sf_dir)).select(
        "user_id", F.col("session_id").cast("long").alias("session_id"), "session_transaction_count",
        F.round("session_total_amount", 2).alias("session_total_amount"),
        epoch("session_start").alias("session_start"), epoch("session_end").alias("session_end"))


@query("w1_session_transactions", with_tx(SESSION_SQL + """
SELECT user_id, CAST(session_id AS BIGINT) AS session_id, transaction_id, amount, merchant, category, sec AS at
FROM numbered"""))
def w1_session_transactions(spark, sf_dir):
    return L.session_transactions(transactions(spark, sf_dir)).select(
        "user_id", F.col("session_id").cast("long").alias("session_id"), "transaction_id", "amount", "merchant",
        "category", epoch("timestamp").alias("at"))


TRAILING_SQL = """, spent AS (
  SELECT *, sum(amount) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS h,
         sum(amount) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS d
  FROM tx)"""


@query("w2_trailing_spend", with_tx(TRAILING_SQL + """
SELECT transaction_id, user_id, round(h, 2) AS hourly_spending, round(d, 2) AS daily_spending FROM spent"""))
def w2_trailing_spend(spark, sf_dir):
    return L.trailing_spend(transactions(spark, sf_dir)).select(
        "transaction_id", "user_id", F.round("hourly_spending", 2).alias("hourly_spending"),
        F.round("daily_spending", 2).alias("daily_spending"))


# Averages per user keep 8 digits: cents divided by up to 64 rows end there, so no value is a tie that the two engines
# would round apart.
PROFILE_COLUMNS = """round(avg(amount), 8) AS avg_transaction_amount,
       round(stddev_samp(amount), 6) AS std_transaction_amount, round(avg(hour(timestamp)), 8) AS avg_transaction_hour,
       string_agg(DISTINCT CAST(dayofweek(timestamp) + 1 AS VARCHAR), ',' ORDER BY CAST(dayofweek(timestamp) + 1 AS VARCHAR))
         AS active_days,
       count(DISTINCT merchant) AS total_unique_merchants, count(DISTINCT category) AS total_unique_categories,
       count(DISTINCT location) AS total_unique_locations, count(DISTINCT device_id) AS total_devices_used"""


def _profile_columns():
    return [F.round("avg_transaction_amount", 8).alias("avg_transaction_amount"),
            F.round("std_transaction_amount", 6).alias("std_transaction_amount"),
            F.round("avg_transaction_hour", 8).alias("avg_transaction_hour"),
            F.concat_ws(",", F.col("active_days").cast("array<string>")).alias("active_days"),
            "total_unique_merchants", "total_unique_categories", "total_unique_locations", "total_devices_used"]


@query("a6_user_profile", with_tx(f"SELECT user_id, {PROFILE_COLUMNS} FROM tx GROUP BY 1"))
def a6_user_profile(spark, sf_dir):
    return A.user_profile(transactions(spark, sf_dir)).select("user_id", *_profile_columns())


USED = ("FOOD", "TRANSPORT", "SHOPPING", "BILLS", "ENTERTAINMENT", "HEALTHCARE", "EDUCATION", "OTHER")
PIVOT_COLUMNS = ", ".join(
    f"round(sum(amount) FILTER (category = '{c}'), 2) AS \"{c}_total\", "
    f"nullif(count(*) FILTER (category = '{c}'), 0) AS \"{c}_count\"" for c in USED)


def _pivot_columns():
    return [c for name in USED for c in (F.round(f"{name}_total", 2).alias(f"{name}_total"), F.col(f"{name}_count"))]


@query("a7_category_distribution", with_tx(f"SELECT user_id, {PIVOT_COLUMNS} FROM tx GROUP BY 1"))
def a7_category_distribution(spark, sf_dir):
    return A.category_distribution(transactions(spark, sf_dir)).select("user_id", *_pivot_columns())


VELOCITY_COLUMNS = """round(max(h), 2) AS max_hourly_spending, round(avg(h), 8) AS avg_hourly_spending,
       round(max(d), 2) AS max_daily_spending, round(avg(d), 8) AS avg_daily_spending,
       round(stddev_samp(h), 4) AS std_hourly_spending, round(stddev_samp(d), 4) AS std_daily_spending"""


def _velocity_columns():
    digits = {"max": 2, "avg": 8, "std": 4}
    return [F.round(f"{kind}_{span}_spending", n).alias(f"{kind}_{span}_spending")
            for kind, n in digits.items() for span in ("hourly", "daily")]


@query("a8_velocity_metrics", with_tx(TRAILING_SQL + f"SELECT user_id, {VELOCITY_COLUMNS} FROM spent GROUP BY 1"))
def a8_velocity_metrics(spark, sf_dir):
    return L.velocity_metrics(transactions(spark, sf_dir)).select("user_id", *_velocity_columns())


METRICS_SQL = with_tx(TRAILING_SQL + f"""
SELECT user_id, {PROFILE_COLUMNS}, {PIVOT_COLUMNS}, {VELOCITY_COLUMNS}, round(sum(amount), 2) AS total_spending,
       CAST(epoch(TIMESTAMP '{AS_OF}') AS BIGINT) AS calculated_at
FROM spent GROUP BY 1""")


@query("a9_user_metrics", METRICS_SQL)
def a9_user_metrics(spark, sf_dir):
    return A.user_metrics(transactions(spark, sf_dir), as_of=AS_OF).select(
        "user_id", *_profile_columns(), *_pivot_columns(), *_velocity_columns(),
        F.round("total_spending", 2).alias("total_spending"), epoch("calculated_at").alias("calculated_at"))


@query("j1_metrics_join", with_tx(TRAILING_SQL + f""", profile AS (
  SELECT user_id, {PROFILE_COLUMNS} FROM tx GROUP BY 1), velocity AS (
  SELECT user_id, {VELOCITY_COLUMNS} FROM spent GROUP BY 1), pivoted AS (
  SELECT user_id, {PIVOT_COLUMNS} FROM tx GROUP BY 1)
SELECT * FROM profile LEFT JOIN pivoted USING (user_id) LEFT JOIN velocity USING (user_id)"""))
def j1_metrics_join(spark, sf_dir):
    """The three metric frames joined as frames; all are hashed by user, so the join adds no shuffle."""
    tx = transactions(spark, sf_dir)
    return (A.user_profile(tx, exact=True).join(A.category_distribution(tx), "user_id", "left")
            .join(L.velocity_metrics(tx), "user_id", "left")
            .select("user_id", *_profile_columns(), *_pivot_columns(), *_velocity_columns()))


@query("r1_recommendations", with_tx(TRAILING_SQL + f""", m AS (
  SELECT user_id, avg(d) AS daily, sum(amount) FILTER (category = 'FOOD') / sum(amount) AS food,
         avg(hour(timestamp)) AS late, count(DISTINCT device_id) AS devices FROM spent GROUP BY 1)
SELECT user_id, concat_ws('|',
         CASE WHEN daily > 150 THEN 'Consider setting a daily spending limit'
              ELSE 'Your spending patterns look healthy' END,
         CASE WHEN food > 0.3 THEN 'High food spending. Consider meal planning' END,
         CASE WHEN late > 12 THEN 'Late night spending detected. Consider setting limits' END,
         CASE WHEN devices > 3 THEN 'Multiple devices used. Ensure all are secure' END) AS recommendations,
       CAST(epoch(TIMESTAMP '{AS_OF}') AS BIGINT) AS generated_at FROM m"""))
def r1_recommendations(spark, sf_dir):
    metrics = A.user_metrics(transactions(spark, sf_dir), as_of=AS_OF, exact=True)
    advice = alerts.recommendations(metrics, daily_limit=150, food_share=0.3, late_hour=12, devices=3)
    return advice.select("user_id", F.concat_ws("|", "recommendations").alias("recommendations"),
                         epoch("generated_at").alias("generated_at"))


@query("p6_high_velocity_alerts", with_tx(A1_SQL + f"""
SELECT 'HIGH_SPENDING_VELOCITY' AS alert_type, user_id, round(total / 5, 6) AS spending_velocity,
       CAST(epoch(TIMESTAMP '{AS_OF}') AS BIGINT) AS alert_time
FROM agg WHERE total / 5 > 40"""))
def p6_high_velocity_alerts(spark, sf_dir):
    agg = A.spending_velocity(A.sliding_spend(transactions(spark, sf_dir)))
    return alerts.high_velocity_alerts(agg, threshold=40, as_of=AS_OF).select(
        "alert_type", "user_id", F.round("spending_velocity", 6).alias("spending_velocity"),
        epoch("alert_time").alias("alert_time"))


@query("a12_pattern_summary", with_tx("""
SELECT user_id, round(sum(amount), 2) AS total_volume, count(*) AS transaction_count,
       round(avg(amount), 8) AS average_amount FROM tx GROUP BY 1"""))
def a12_pattern_summary(spark, sf_dir):
    return A.pattern_summary(transactions(spark, sf_dir), "user_id").select(
        "user_id", F.round("total_volume", 2).alias("total_volume"), "transaction_count",
        F.round("average_amount", 8).alias("average_amount"))


@query("w9_newest_transactions", with_tx("""
SELECT user_id, transaction_id, amount, CAST(position AS INTEGER) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, transaction_id DESC) AS position FROM tx)
WHERE position <= 20"""))
def w9_newest_transactions(spark, sf_dir):
    return A.newest_per_user(transactions(spark, sf_dir), 20).select("user_id", "transaction_id", "amount", "position")


@query("w10_moving_average", with_tx("""
, daily AS (SELECT user_id, CAST(timestamp AS DATE) AS day, sum(amount) AS spend FROM tx GROUP BY 1, 2)
SELECT user_id, CAST(day AS VARCHAR) AS day, round(spend, 2) AS daily_spend,
       round(avg(spend) OVER (PARTITION BY user_id ORDER BY day ROWS 6 PRECEDING), 6) AS moving_average FROM daily"""))
def w10_moving_average(spark, sf_dir):
    return L.daily_moving_average(transactions(spark, sf_dir)).select(
        "user_id", F.col("day").cast("string").alias("day"), F.round("daily_spend", 2).alias("daily_spend"),
        F.round("moving_average", 6).alias("moving_average"))


@query("t1_list_transactions", with_tx("""
SELECT transaction_id, status, amount, currency, sec AS at FROM tx
ORDER BY timestamp, transaction_id LIMIT 100 OFFSET 200"""))
def t1_list_transactions(spark, sf_dir):
    return A.list_transactions(transactions(spark, sf_dir), skip=200, limit=100).select(
        "transaction_id", "status", "amount", "currency", epoch("timestamp").alias("at"))


@query("t1_deep_page", with_tx("""
SELECT transaction_id, amount, sec AS at FROM tx
ORDER BY timestamp, transaction_id LIMIT 100 OFFSET (SELECT count(*) * 9 // 10 FROM tx)"""))
def t1_deep_page(spark, sf_dir):
    """The page behind nine tenths of the table; one range of time is sorted."""
    tx = transactions(spark, sf_dir)
    return A.deep_page(tx, tx.count() * 9 // 10, few=1000).select("transaction_id", "amount", epoch("timestamp").alias("at"))


@query("p12_get_transaction", with_tx(
    "SELECT transaction_id, status, amount, currency, sec AS at FROM tx WHERE transaction_id = '42'"))
def p12_get_transaction(spark, sf_dir):
    return A.get_transaction(transactions(spark, sf_dir), "42").select(
        "transaction_id", "status", "amount", "currency", epoch("timestamp").alias("at"))


@query("p5_spending_velocity", with_tx(A1_SQL + """
SELECT user_id, category, window_end, round(total / 5, 6) AS spending_velocity FROM agg"""))
def p5_spending_velocity(spark, sf_dir):
    agg = A.spending_velocity(A.sliding_spend(transactions(spark, sf_dir)))
    return agg.select("user_id", "category", epoch("window_end").alias("window_end"),
                      F.round("spending_velocity", 6).alias("spending_velocity"))


@query("e12_advice_counts", with_tx(TRAILING_SQL + """, m AS (
  SELECT user_id, avg(d) AS daily, sum(amount) FILTER (category = 'FOOD') / sum(amount) AS food,
         avg(hour(timestamp)) AS late, count(DISTINCT device_id) AS devices FROM spent GROUP BY 1)
SELECT user_id, 1 + CASE WHEN food > 0.25 THEN 1 ELSE 0 END + CASE WHEN late > 11 THEN 1 ELSE 0 END
  + CASE WHEN devices > 3 THEN 1 ELSE 0 END AS texts FROM m"""))
def e12_advice_counts(spark, sf_dir):
    """Length of the advice array after the empty texts are filtered out."""
    metrics = A.user_metrics(transactions(spark, sf_dir), as_of=AS_OF, exact=True)
    advice = alerts.recommendations(metrics, daily_limit=150, food_share=0.25, late_hour=11, devices=3)
    return advice.select("user_id", F.size("recommendations").alias("texts"))


@query("e11_json_rows", with_tx("""
SELECT '{"transaction_id":"' || transaction_id || '","user_id":"' || user_id || '","category":"' || category || '"}'
  AS value FROM tx"""))
def e11_json_rows(spark, sf_dir):
    return sinks.as_messages(transactions(spark, sf_dir).select("transaction_id", "user_id", "category"))
