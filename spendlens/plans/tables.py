"""The given parquet tables as transactions, accounts, positions, corpora, vectors and requests.

Each mapping exists twice: as a DataFrame function and as the SQL the check runs on the same files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp").cast("long")


EVENT_CATEGORY = {"view": "FOOD", "click": "TRANSPORT", "purchase": "SHOPPING", "signup": "BILLS",
                  "error": "ENTERTAINMENT"}


def as_transactions(events: DataFrame) -> DataFrame:
    """Works on the table and on a stream of it."""
    k = F.get_json_object("props", "$.k").cast("long")
    ts = F.col("ts").cast("timestamp")
    category = F.lit(None).cast("string")
    for event_type, name in EVENT_CATEGORY.items():
        category = F.when(F.col("event_type") == event_type, F.lit(name)).otherwise(category)
    night = (F.hour(ts) >= 22) | (F.hour(ts) <= 6)
    return events.select(
        F.col("event_id").cast("string").alias("transaction_id"), F.col("user_id").cast("string").alias("user_id"),
        F.col("value").alias("amount"), F.lit("USD").alias("currency"),
        F.concat(F.lit("M"), k % 20).alias("merchant"), category.alias("category"), ts.alias("timestamp"),
        F.concat(F.lit("L"), k % 5).alias("location"),
        F.concat(F.lit("D"), F.col("event_id") % 4).alias("device_id"), F.lit(None).cast("string").alias("ip_address"),
        F.when((F.col("value") > 100) & night, "FRAUD").otherwise("COMPLETED").alias("status"),
        F.lit(None).cast("string").alias("description"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_transactions(table(spark, sf_dir, "events"))


TX_SQL = """tx AS (
  SELECT CAST(event_id AS VARCHAR) AS transaction_id, CAST(user_id AS VARCHAR) AS user_id, value AS amount,
         'USD' AS currency, 'M' || (k % 20) AS merchant,
         CASE event_type WHEN 'view' THEN 'FOOD' WHEN 'click' THEN 'TRANSPORT' WHEN 'purchase' THEN 'SHOPPING'
              WHEN 'signup' THEN 'BILLS' WHEN 'error' THEN 'ENTERTAINMENT' END AS category,
         ts AS timestamp, CAST(floor(epoch(ts)) AS BIGINT) AS sec, 'L' || (k % 5) AS location,
         'D' || (event_id % 4) AS device_id,
         CASE WHEN value > 100 AND (hour(ts) >= 22 OR hour(ts) <= 6) THEN 'FRAUD' ELSE 'COMPLETED' END AS status
  FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events))"""


def with_tx(sql: str) -> str:
    return f"WITH {TX_SQL}{sql}" if sql.lstrip().startswith(",") else f"WITH {TX_SQL} {sql}"


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "CHECKING").otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("user_id"), F.col("c_acctbal").alias("balance"),
        kind.alias("account_type"), F.col("c_name").alias("name"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-up data derived from the customers: some addresses, numbers and dates are malformed or shared."""
    nation = F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("user_id"),
        F.concat(F.lower("c_mktsegment"), F.col("c_custkey") % 700,
                 F.when(nation % 5 == 0, "#").otherwise("@"), F.lit("bank.example")).alias("email"),
        F.concat(F.when(nation % 7 == 0, "0").otherwise("+"), nation + 1, F.col("c_custkey")).alias("phone"),
        F.concat(1950 + nation, F.when(nation % 3 == 0, "/").otherwise("-"), F.lit("01-15")).alias("birth_date"),
        F.concat(nation * 11, F.lit("."), F.col("c_custkey") % 300, F.lit(".0.1")).alias("ip_address"),
        F.concat(F.when(nation % 2 == 0, "Pass").otherwise("pass"), F.col("c_custkey"),
                 F.when(nation % 3 == 0, "!").otherwise("")).alias("password"),
        F.when(nation % 4 == 0, None).otherwise(F.col("c_name")).alias("account_number"))


CUSTOMERS_SQL = """signup AS (
  SELECT CAST(c_custkey AS VARCHAR) AS user_id,
         lower(c_mktsegment) || (c_custkey % 700) || CASE WHEN c_nationkey % 5 = 0 THEN '#' ELSE '@' END
           || 'bank.example' AS email,
         CASE WHEN c_nationkey % 7 = 0 THEN '0' ELSE '+' END || (c_nationkey + 1) || c_custkey AS phone,
         (1950 + c_nationkey) || CASE WHEN c_nationkey % 3 = 0 THEN '/' ELSE '-' END || '01-15' AS birth_date,
         (c_nationkey * 11) || '.' || (c_custkey % 300) || '.0.1' AS ip_address,
         CASE WHEN c_nationkey % 2 = 0 THEN 'Pass' ELSE 'pass' END || c_custkey
           || CASE WHEN c_nationkey % 3 = 0 THEN '!' ELSE '' END AS password,
         CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE c_name END AS account_number
  FROM customer)"""


def raw_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as holdings. The join order and strategy are left to the optimizer."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_retailprice")
    kind = F.col("p_type")
    asset = (F.when(kind.isin("ECONOMY", "STANDARD"), "STOCK").when(kind == "SMALL", "BOND")
             .when(kind == "MEDIUM", "CASH").when(kind == "LARGE", "ALTERNATIVE").when(kind == "PROMO", "COMMODITY"))
    return (lines.join(orders, lines.l_orderkey == orders.o_orderkey)
            .join(parts, lines.l_partkey == parts.p_partkey)
            .select(F.col("o_custkey").cast("string").alias("user_id"), F.col("p_partkey").cast("string").alias("symbol"),
                    asset.alias("asset_type"), F.col("l_quantity").alias("quantity"),
                    (F.col("l_extendedprice") / F.col("l_quantity")).alias("average_price"),
                    F.col("p_retailprice").alias("current_price")))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spendlens.operators.portfolio import valued

    return valued(raw_positions(spark, sf_dir))


def risk_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of most customers; every tenth has none."""
    segment = F.col("c_mktsegment")
    tolerance = (F.when(segment == "BUILDING", "conservative").when(segment == "MACHINERY", "AGGRESSIVE")
                 .when(segment == "FURNITURE", "unknown").otherwise("MODERATE"))
    return table(spark, sf_dir, "customer").filter("c_custkey % 10 <> 3").select(
        F.col("c_custkey").cast("string").alias("user_id"), tolerance.alias("risk_tolerance"))


POSITIONS_SQL = """holdings AS (
  SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(p_partkey AS VARCHAR) AS symbol,
         CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'STOCK' WHEN p_type = 'SMALL' THEN 'BOND'
              WHEN p_type = 'MEDIUM' THEN 'CASH' WHEN p_type = 'LARGE' THEN 'ALTERNATIVE'
              WHEN p_type = 'PROMO' THEN 'COMMODITY' END AS asset_type,
         l_quantity AS quantity, l_extendedprice / l_quantity AS average_price, p_retailprice AS current_price,
         l_quantity * p_retailprice AS market_value,
         l_quantity * p_retailprice - l_quantity * (l_extendedprice / l_quantity) AS unrealized_pnl
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
pos AS (SELECT *, market_value / sum(market_value) OVER (PARTITION BY user_id) AS allocation FROM holdings)"""

PROFILES_SQL = """profiles AS (
  SELECT CAST(c_custkey AS VARCHAR) AS user_id,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'CONSERVATIVE' WHEN 'MACHINERY' THEN 'AGGRESSIVE'
              ELSE 'MODERATE' END AS profile FROM customer WHERE c_custkey % 10 <> 3
  UNION ALL SELECT DISTINCT user_id, 'MODERATE' FROM pos WHERE CAST(user_id AS BIGINT) % 10 = 3),
targets(profile, asset_class, target) AS (VALUES
  ('CONSERVATIVE', 'STOCK', 0.40::DOUBLE), ('CONSERVATIVE', 'BOND', 0.50), ('CONSERVATIVE', 'CASH', 0.10),
  ('MODERATE', 'STOCK', 0.60), ('MODERATE', 'BOND', 0.35), ('MODERATE', 'CASH', 0.05),
  ('AGGRESSIVE', 'STOCK', 0.80), ('AGGRESSIVE', 'BOND', 0.15), ('AGGRESSIVE', 'ALTERNATIVE', 0.05))"""


def with_positions(sql: str) -> str:
    return f"WITH {POSITIONS_SQL}{sql}" if sql.lstrip().startswith(",") else f"WITH {POSITIONS_SQL} {sql}"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_requests(table(spark, sf_dir, "events"))


def as_requests(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("endpoint"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
        (F.col("value") / 100).alias("duration_s"))


REQUESTS_SQL = """requests AS (
  SELECT ts, event_type AS endpoint, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
         value / 100 AS duration_s FROM events)"""


def lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consumer lag reports derived from the events."""
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("topic"),
        F.concat(F.lit("G"), F.col("event_id") % 3).alias("consumer_group"),
        F.floor(F.col("value") * 10).alias("lag"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.col("label").cast("string").alias("category"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("content"),
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("metadata"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with the model that answered; one of the names has no price."""
    names = F.array(*[F.lit(m) for m in MODELS])
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "role", "text", F.get(names, (F.col("conv_id") % len(MODELS)).cast("int")).alias("model"))


MODELS = ("gpt-4", "gpt-4-turbo", "gpt-3.5-turbo", "claude-2", "unlisted")
