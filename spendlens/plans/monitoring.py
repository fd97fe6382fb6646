"""Metric rules and dashboard figures."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from spendlens.operators import metrics as Q, sketches as S
from spendlens.plans.registry import ORACLE, query
from spendlens.plans.tables import AS_OF, REQUESTS_SQL, accounts, epoch, lags, requests, transactions, with_tx


def _at(df, **rounded):
    out = df.withColumn("evaluated_at", epoch("evaluated_at"))
    return out.withColumns({name: F.round(name, digits) for name, digits in rounded.items()})


def _episodes(df):
    return df.withColumns({**{c: epoch(c) for c in ("pending_since", "firing_since", "last_true")},
                           "peak": F.round("peak", 6)})


def held_sql(source: str, condition: str, value: str, hold: int, keys: str = "", step: int = 60) -> str:
    by = f"PARTITION BY {keys}" if keys else ""
    select = f"{keys}, " if keys else ""
    return f""", true_at AS (
  SELECT *, evaluated_at // {step} - row_number() OVER ({by} ORDER BY evaluated_at) AS island FROM {source} WHERE {condition}),
episodes AS (SELECT {select} island, min(evaluated_at) AS pending_since, max(evaluated_at) AS last_true, max({value}) AS peak
  FROM true_at GROUP BY {select} island)
SELECT {select} pending_since, pending_since + {hold * 60} AS firing_since, last_true, round(peak, 6) AS peak
FROM episodes WHERE last_true - pending_since >= {hold * 60}"""


RATE_SQL = """, rate AS (
  SELECT (sec // 60) * 60 + 60 * (i + 1) AS evaluated_at, count(*) AS transactions, count(*) / 300 AS rate
  FROM tx, range(5) AS r(i) GROUP BY 1)"""


@query("q1_transaction_rate", with_tx(RATE_SQL + "SELECT evaluated_at, transactions, round(rate, 6) AS rate FROM rate"))
def q1_transaction_rate(spark, sf_dir):
    return _at(Q.transaction_rate(transactions(spark, sf_dir)), rate=6)


@query("q1_high_volume", with_tx(RATE_SQL + held_sql("rate", "rate > 0.009", "rate", 3)))
def q1_high_volume(spark, sf_dir):
    return _episodes(Q.high_volume(transactions(spark, sf_dir), threshold=0.009, hold_minutes=3))


FRAUD_SQL = """, share AS (
  SELECT (sec // 60) * 60 + 60 * (i + 1) AS evaluated_at, count(*) FILTER (status = 'FRAUD') AS bad, count(*) AS events,
         count(*) FILTER (status = 'FRAUD') / count(*) AS share FROM tx, range(60) AS r(i) GROUP BY 1)"""


@query("q2_fraud_rate", with_tx(FRAUD_SQL + "SELECT evaluated_at, bad, events, round(share, 6) AS share FROM share"))
def q2_fraud_rate(spark, sf_dir):
    return _at(Q.fraud_rate(transactions(spark, sf_dir)), share=6)


@query("q2_high_fraud_rate", with_tx(FRAUD_SQL + held_sql("share", "share > 0.01", "share", 15)))
def q2_high_fraud_rate(spark, sf_dir):
    return _episodes(Q.high_fraud_rate(transactions(spark, sf_dir)))


def _with_requests(sql: str) -> str:
    return f"WITH {REQUESTS_SQL}{sql}"


def _histogram_sql(bounds) -> str:
    counts = ", ".join(f"count(*) FILTER (duration_s <= {b}) AS c{i}" for i, b in enumerate(bounds))
    cases = []
    for i, bound in enumerate(bounds):
        low, below = (bounds[i - 1], f"c{i - 1}") if i else (0.0, "0")
        cases.append(f"WHEN c{i} >= n * 0.95::DOUBLE THEN {low}::DOUBLE + ({bound}::DOUBLE - {low}::DOUBLE) * "
                     f"((n * 0.95::DOUBLE - {below}) / (c{i} - {below}))")
    return f""", sums AS (
  SELECT CAST(floor(epoch(ts)) AS BIGINT) // 60 * 60 + 60 * (i + 1) AS evaluated_at, count(*) AS n, {counts}
  FROM requests, range(5) AS r(i) GROUP BY 1),
quantiles AS (SELECT evaluated_at, n AS events, CASE {' '.join(cases)} ELSE {bounds[-1]}::DOUBLE END AS quantile FROM sums)"""


@query("q3_p95_histogram", _with_requests(_histogram_sql(Q.LATENCY_BUCKETS) + """
SELECT evaluated_at, events, round(quantile, 6) AS quantile FROM quantiles"""))
def q3_p95_histogram(spark, sf_dir):
    return _at(Q.histogram_quantile(requests(spark, sf_dir)), quantile=6)


@query("q3_slow_responses", _with_requests(_histogram_sql(Q.LATENCY_BUCKETS) + held_sql(
    "quantiles", "quantile > 0.9", "quantile", 3)))
def q3_slow_responses(spark, sf_dir):
    return _episodes(Q.slow_responses(requests(spark, sf_dir), threshold=0.9, hold_minutes=3))


@query("q3_p95_exact", _with_requests("""
SELECT endpoint, CAST(epoch(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS window_start, count(*) AS events,
       round(quantile_cont(duration_s, 0.95), 6) AS quantile FROM requests GROUP BY 1, 2"""))
def q3_p95_exact(spark, sf_dir):
    out = Q.exact_quantile(requests(spark, sf_dir), duration="1 day", keys=["endpoint"])
    return out.select("endpoint", epoch("window_start").alias("window_start"), "events",
                      F.round("quantile", 6).alias("quantile"))


@query("q3_p95_approximate")
def q3_p95_approximate(spark, sf_dir):
    return Q.approximate_quantile(requests(spark, sf_dir), duration="1 day", keys=["endpoint"])


@query("q3_p95_approximate_error", _with_requests("""
SELECT endpoint, CAST(epoch(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS window_start, count(*) AS events, TRUE AS close
FROM requests GROUP BY 1, 2"""))
def q3_p95_approximate_error(spark, sf_dir):
    sketch = Q.approximate_quantile(requests(spark, sf_dir), duration="1 day", keys=["endpoint"])
    return _compared(sketch, requests(spark, sf_dir)).select(
        "endpoint", epoch("window_start").alias("window_start"), "events", "close")


@query("q3_p95_from_minutes_error", ORACLE["q3_p95_approximate_error"])
def q3_p95_from_minutes_error(spark, sf_dir):
    """Days merged from the quantile sketches of minutes."""
    minutes = S.minute_quantiles(requests(spark, sf_dir), ["endpoint"])
    sketch = S.quantile_from_minutes(minutes, duration="1 day", keys=["endpoint"])
    return _compared(sketch, requests(spark, sf_dir)).select(
        "endpoint", epoch("window_start").alias("window_start"), "events", "close")


def _compared(sketch, rows, q=0.95, few=100):
    """The sketch with ``close``: its value lies between the exact quantiles a hundredth below and above, or in a group of
    few rows between the two values around the rank."""
    keys = ["endpoint", "window_start", "window_end"]
    out = sketch
    for name, at in (("low", q - 0.01), ("high", q + 0.01)):
        exact = Q.exact_quantile(rows, at, duration="1 day", keys=["endpoint"])
        out = out.join(exact.select(*keys, F.col("quantile").alias(name)), keys)
    window, rank = F.window("ts", "1 day").alias("w"), (F.col("events") - 1) * q
    small = rows.filter("duration_s IS NOT NULL").select("endpoint", window, "duration_s").select(
        "endpoint", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "duration_s").join(
        sketch.filter(F.col("events") < few).select(*keys, "events"), keys)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("duration_s")) - 1
    around = small.withColumn("place", place).groupBy(*keys).agg(
        F.min(F.when(F.col("place") == F.floor(rank), F.col("duration_s"))).alias("below"),
        F.min(F.when(F.col("place") == F.ceil(rank), F.col("duration_s"))).alias("above"))
    return out.join(around, keys, "left").withColumn(
        "close", F.col("quantile").between(F.coalesce("below", "low"), F.coalesce("above", "high")))


ERROR_SQL = """, share AS (
  SELECT CAST(floor(epoch(ts)) AS BIGINT) // 60 * 60 + 60 * (i + 1) AS evaluated_at, count(*) FILTER (status_code >= 500) AS bad,
         count(*) AS events, count(*) FILTER (status_code >= 500) / count(*) AS share
  FROM requests, range(5) AS r(i) GROUP BY 1)"""


@query("q4_error_share", _with_requests(ERROR_SQL + "SELECT evaluated_at, bad, events, round(share, 6) AS share FROM share"))
def q4_error_share(spark, sf_dir):
    return _at(Q.error_share(requests(spark, sf_dir)), share=6)


@query("q4_high_error_rate", _with_requests(ERROR_SQL + held_sql("share", "share > 0.05", "share", 5)))
def q4_high_error_rate(spark, sf_dir):
    return _episodes(Q.high_error_rate(requests(spark, sf_dir)))


def _lag_sql(key: str, function: str, threshold: int) -> str:
    column = "event_type" if key == "topic" else "'G' || (event_id % 3)"
    return f"""WITH levels AS (
  SELECT {column} AS {key}, (CAST(floor(epoch(ts)) AS BIGINT) // 3600 + 1) * 3600 AS evaluated_at,
         {function}(floor(value * 10)) AS lag FROM events GROUP BY 1, 2)""" + held_sql(
        "levels", f"lag > {threshold}", "lag", 120, key, 3600)


@query("q5_lag_by_group", _lag_sql("consumer_group", "avg", 400))
def q5_lag_by_group(spark, sf_dir):
    return _episodes(Q.high_lag(lags(spark, sf_dir), "consumer_group", "avg", 400, 120, 60))


@query("q5_lag_by_topic", _lag_sql("topic", "sum", 1000))
def q5_lag_by_topic(spark, sf_dir):
    return _episodes(Q.high_lag(lags(spark, sf_dir), "topic", "sum", 1000, 120, 60))


@query("q6_low_cash", """
SELECT CAST(c_custkey AS VARCHAR) AS user_id, round(avg(c_acctbal), 6) AS avg_balance FROM customer
WHERE c_mktsegment = 'BUILDING' GROUP BY 1 HAVING avg(c_acctbal) < 1000""")
def q6_low_cash(spark, sf_dir):
    return Q.low_cash(accounts(spark, sf_dir)).select("user_id", F.round("avg_balance", 6).alias("avg_balance"))


@query("q7_silent_sources", f"""
SELECT CAST(user_id AS VARCHAR) AS source, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_seen FROM events GROUP BY 1
HAVING max(ts) < TIMESTAMP '{AS_OF}' - INTERVAL 720 MINUTE""")
def q7_silent_sources(spark, sf_dir):
    beats = transactions(spark, sf_dir).select(F.col("user_id").alias("source"), F.col("timestamp").alias("ts"))
    return Q.silent_sources(beats, AS_OF, minutes=720).withColumn("last_seen", epoch("last_seen"))


@query("q8_counts_by_endpoint", _with_requests("""
SELECT endpoint, status_code, count(*) AS events FROM requests GROUP BY 1, 2"""))
def q8_counts_by_endpoint(spark, sf_dir):
    return Q.counts_by(requests(spark, sf_dir), "endpoint", "status_code")


@query("q9_hold_per_endpoint", _with_requests("""
, counts AS (SELECT endpoint, CAST(floor(epoch(ts)) AS BIGINT) // 60 * 60 + 60 * (i + 1) AS evaluated_at, count(*) AS events
  FROM requests, range(30) AS r(i) GROUP BY 1, 2)""" + held_sql("counts", "events >= 4", "events", 10, "endpoint")))
def q9_hold_per_endpoint(spark, sf_dir):
    series = Q.sliding_sums(requests(spark, sf_dir), {"events": F.count("*")}, 30, ["endpoint"], ts="ts")
    out = Q.held(series, F.col("events") >= 4, 10, F.col("events"), ["endpoint"])
    return out.withColumns({c: epoch(c) for c in ("pending_since", "firing_since", "last_true")})


@query("b1_category_shares", with_tx("""
, spend AS (SELECT user_id, category, sum(amount) AS spend FROM tx GROUP BY 1, 2)
SELECT user_id, category, round(spend, 2) AS spend,
       round(spend / sum(spend) OVER (PARTITION BY user_id) * 100, 1) AS share_pct FROM spend"""))
def b1_category_shares(spark, sf_dir):
    return Q.category_shares(transactions(spark, sf_dir)).withColumn("spend", F.round("spend", 2))


@query("b2_daily_change", with_tx("""
, daily AS (SELECT user_id, CAST(timestamp AS DATE) AS day, sum(amount) AS spend FROM tx GROUP BY 1, 2),
l AS (SELECT *, lag(spend) OVER (PARTITION BY user_id ORDER BY day) AS previous FROM daily)
SELECT user_id, CAST(day AS VARCHAR) AS day, round(spend, 2) AS spend, round(previous, 2) AS previous_spend,
       round((spend - previous) / previous * 100, 1) AS change_pct FROM l"""))
def b2_daily_change(spark, sf_dir):
    return Q.daily_change(transactions(spark, sf_dir)).select(
        "user_id", F.col("day").cast("string").alias("day"), F.round("spend", 2).alias("spend"),
        F.round("previous_spend", 2).alias("previous_spend"), "change_pct")


@query("b3_category_against_average", with_tx("""
, a AS (SELECT user_id, category, avg(amount) FILTER (timestamp >= TIMESTAMP '2024-01-01' AND
    timestamp < TIMESTAMP '2024-01-15') AS month_avg, avg(amount) AS overall_avg FROM tx GROUP BY 1, 2)
SELECT user_id, category, round(month_avg, 6) AS month_avg, round(overall_avg, 6) AS overall_avg,
       round((month_avg - overall_avg) / overall_avg * 100, 1) AS change_pct FROM a"""))
def b3_category_against_average(spark, sf_dir):
    return Q.category_against_average(transactions(spark, sf_dir), "2024-01-15 00:00:00").withColumns({
        "month_avg": F.round("month_avg", 6), "overall_avg": F.round("overall_avg", 6)})
