"""Wire decoding, normalization, validation, masking and idempotent inserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from spendlens.functions import columns as C
from spendlens.operators import normalize as N
from spendlens.plans.registry import query
from spendlens.plans.tables import AS_OF, CUSTOMERS_SQL, customers, epoch, table, transactions, with_tx
from spendlens import sinks, sources


def wire_json(spark, sf_dir):
    """The events as producers would send them: epoch milliseconds, ISO text, bare records and broken ones."""
    ts = F.col("ts").cast("timestamp")
    k = F.get_json_object("props", "$.k").cast("long")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    full = F.to_json(F.struct(
        F.col("event_id").cast("string").alias("transaction_id"), F.col("user_id").cast("string").alias("user_id"),
        F.col("value").alias("amount"), F.lit("USD").alias("currency"), F.concat(F.lit("M"), k % 20).alias("merchant"),
        F.lit("FOOD").alias("category"), F.unix_millis(ts).alias("timestamp"), F.lit("PENDING").alias("status")))
    iso_form = F.to_json(F.struct(
        F.col("event_id").cast("string").alias("id"), F.col("value").alias("amount"),
        F.lit("Groceries").alias("category"), iso.alias("timestamp")))
    bare = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), iso.alias("timestamp")))
    broken = F.concat(F.lit("{broken "), F.col("event_id"))
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.when(kind == "view", full).when(kind == "click", iso_form).when(kind == "error", broken)
        .otherwise(bare).alias("value"))


WIRE_SQL = """WITH wire AS (
  SELECT *, epoch_us(ts) // 1000 AS millis, 'M' || (CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) % 20) AS m
  FROM events) """


@query("p1_normalize", WIRE_SQL + """
SELECT CASE WHEN event_type = 'error' THEN NULL ELSE CAST(event_id AS VARCHAR) END AS transaction_id,
       CASE WHEN event_type = 'view' THEN CAST(user_id AS VARCHAR) END AS user_id,
       CASE WHEN event_type IN ('view', 'click') THEN value END AS amount, 'USD' AS currency,
       CASE WHEN event_type = 'view' THEN m END AS merchant,
       CASE WHEN event_type = 'view' THEN 'FOOD' ELSE 'OTHER' END AS category,
       CASE WHEN event_type <> 'error' THEN CAST(floor(epoch(ts)) AS BIGINT) END AS at, 'PENDING' AS status
FROM wire""")
def p1_normalize(spark, sf_dir):
    """Three record shapes and broken text to one shape; broken records stay as empty rows for quarantine."""
    return N.normalize(sources.decode_json(wire_json(spark, sf_dir))).select(
        "transaction_id", "user_id", "amount", "currency", "merchant", "category", epoch("timestamp").alias("at"),
        "status")


@query("s3_decode_json", WIRE_SQL + """
SELECT CASE WHEN event_type <> 'view' AND event_type <> 'error' THEN CAST(event_id AS VARCHAR) END AS id,
       CASE WHEN event_type = 'view' THEN CAST(event_id AS VARCHAR) END AS transaction_id,
       CASE WHEN event_type IN ('view', 'click') THEN value END AS amount,
       CASE WHEN event_type = 'view' THEN CAST(millis AS VARCHAR)
            WHEN event_type <> 'error' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS timestamp,
       CASE WHEN event_type = 'error' THEN '{broken ' || event_id END AS bad_value
FROM wire""")
def s3_decode_json(spark, sf_dir):
    return sources.decode_json(wire_json(spark, sf_dir), keep_bad=True).select(
        "id", "transaction_id", "amount", "timestamp", "bad_value")


@query("s6_ingest_defaults", WIRE_SQL + f"""
SELECT CASE WHEN event_type = 'error' THEN NULL ELSE CAST(event_id AS VARCHAR) END AS id,
       CASE WHEN event_type IN ('view', 'click') THEN value ELSE 0 END AS amount, 'USD' AS currency,
       '' AS description, CASE WHEN event_type = 'view' THEN m ELSE '' END AS merchant,
       CASE WHEN event_type = 'view' THEN 'FOOD' ELSE 'OTHER' END AS category,
       CASE WHEN event_type = 'view' THEN 'PENDING' ELSE 'COMPLETED' END AS status,
       CAST(CASE WHEN event_type = 'error' THEN epoch(TIMESTAMP '{AS_OF}') ELSE floor(epoch(ts)) END AS BIGINT) AS at
FROM wire""")
def s6_ingest_defaults(spark, sf_dir):
    """Generated ids (36 characters) are left out of the result."""
    out = sources.ingest_json(wire_json(spark, sf_dir), as_of=AS_OF)
    return out.select(F.when(F.length("transaction_id") < 36, F.col("transaction_id")).alias("id"), "amount",
                      "currency", "description", "merchant", "category", "status", epoch("timestamp").alias("at"))


@query("p2_flatten", "SELECT event_id, user_id, value FROM events")
def p2_flatten(spark, sf_dir):
    nested = table(spark, sf_dir, "events").select(F.struct("event_id", "user_id", "value").alias("record"))
    return sources.flatten(nested, "record")


@query("p3_processing_time", with_tx(
    f"SELECT transaction_id, CAST(epoch(TIMESTAMP '{AS_OF}') AS BIGINT) AS processed_at FROM tx"))
def p3_processing_time(spark, sf_dir):
    return N.with_processing_time(transactions(spark, sf_dir), as_of=AS_OF).select(
        "transaction_id", epoch("processing_timestamp").alias("processed_at"))


def _questionable(spark, sf_dir):
    """Transactions with the kinds of faults that occur: amounts, currencies, categories, addresses."""
    tx = transactions(spark, sf_dir)
    kind, merchant = F.col("category"), F.col("merchant")
    return tx.withColumns({
        "amount": F.when(kind == "FOOD", F.col("amount") - 20).when(kind == "BILLS", F.col("amount") * 10_000)
                   .otherwise(F.col("amount")),
        "currency": F.when(kind == "TRANSPORT", "usd").otherwise(F.col("currency")),
        "category": F.when(merchant == "M3", "GAMBLING").otherwise(kind),
        "ip_address": F.when(merchant == "M1", "256.1.1.1").when(merchant == "M2", "10.0.0.1")
                       .when(merchant == "M4", "fe80::1"),
        "location": F.when(merchant == "M5", F.repeat(F.lit("x"), 256)).otherwise(F.col("location")),
    })


QUESTIONABLE_SQL = """, q AS (SELECT transaction_id, merchant,
  CASE category WHEN 'FOOD' THEN amount - 20 WHEN 'BILLS' THEN amount * 10000 ELSE amount END AS amount,
  CASE WHEN category = 'TRANSPORT' THEN 'usd' ELSE 'USD' END AS currency,
  CASE WHEN merchant = 'M3' THEN 'GAMBLING' ELSE category END AS category FROM tx),
checked AS (SELECT *, concat_ws(',', CASE WHEN NOT amount > 0 THEN 'amount_positive' END,
  CASE WHEN amount > 1000000 THEN 'amount_limit' END, CASE WHEN currency = 'usd' THEN 'currency_format' END,
  CASE WHEN category = 'GAMBLING' THEN 'category_domain' END, CASE WHEN merchant = 'M5' THEN 'location_length' END,
  CASE WHEN merchant = 'M1' THEN 'ip_address_format' END) AS violations FROM q)"""


@query("v1_validate", with_tx(QUESTIONABLE_SQL + """
SELECT transaction_id, round(amount, 2) AS amount, violations, violations = '' AS is_valid FROM checked"""))
def v1_validate(spark, sf_dir):
    return N.validate(_questionable(spark, sf_dir)).select(
        "transaction_id", "amount", F.concat_ws(",", "violations").alias("violations"), "is_valid")


@query("v1_quarantine", with_tx(QUESTIONABLE_SQL + """
SELECT transaction_id, violations FROM checked WHERE violations <> ''"""))
def v1_quarantine(spark, sf_dir):
    return N.split_valid(_questionable(spark, sf_dir))[1].select(
        "transaction_id", F.concat_ws(",", "violations").alias("violations"))


def _with_signup(sql: str) -> str:
    return f"WITH {CUSTOMERS_SQL} {sql}"


@query("v2_ipv4", _with_signup("""
SELECT user_id, ip_address, list_max(list_transform(string_split(ip_address, '.'), lambda o: CAST(o AS INTEGER))) <= 255
  AS is_ipv4 FROM signup"""))
def v2_ipv4(spark, sf_dir):
    return customers(spark, sf_dir).select("user_id", "ip_address", C.is_ipv4("ip_address").alias("is_ipv4"))


@query("v3_contact_formats", _with_signup(r"""
SELECT user_id, regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$') AS email_ok,
       regexp_matches(phone, '^\+?[1-9]\d{1,14}$') AS phone_ok,
       regexp_matches(birth_date, '^\d{4}-\d{2}-\d{2}$') AS birth_date_ok, length(email) BETWEEN 5 AND 24 AS length_ok
FROM signup"""))
def v3_contact_formats(spark, sf_dir):
    return customers(spark, sf_dir).select(
        "user_id", C.is_email("email").alias("email_ok"), C.is_phone("phone").alias("phone_ok"),
        C.is_birth_date("birth_date").alias("birth_date_ok"), C.length_between("email", 5, 24).alias("length_ok"))


@query("v4_password_strength", _with_signup(r"""
SELECT user_id, length(password) >= 8 AS length, regexp_matches(password, '[A-Z]') AS uppercase,
       regexp_matches(password, '[a-z]') AS lowercase, regexp_matches(password, '\d') AS digit,
       regexp_matches(password, '[!@#$%^&*(),.?":{}|<>]') AS special FROM signup"""))
def v4_password_strength(spark, sf_dir):
    return customers(spark, sf_dir).select("user_id", C.password_strength("password").alias("s")).select("user_id", "s.*")


@query("v5_duplicate_emails", _with_signup(
    "SELECT email, count(*) AS occurrences FROM signup GROUP BY 1 HAVING count(*) > 1"))
def v5_duplicate_emails(spark, sf_dir):
    return N.duplicate_values(customers(spark, sf_dir), "email")


@query("v6_sanitize", r"""
SELECT page_id, replace(replace(replace(replace(replace(html, '<', '&lt;'), '>', '&gt;'), '"', '&quot;'),
       '''', '&#x27;'), '/', '&#x2F;') AS clean FROM pages""")
def v6_sanitize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.sanitize("html").alias("clean"))


@query("v7_mask_sensitive", _with_signup("""
SELECT user_id, email, phone, birth_date, ip_address, '*******' AS password,
       CASE WHEN account_number IS NOT NULL THEN '*******' END AS account_number FROM signup"""))
def v7_mask_sensitive(spark, sf_dir):
    return N.mask_sensitive(customers(spark, sf_dir))


INSERT_SQL = """SELECT transaction_id, user_id, amount, status FROM tx"""


@query("k8_idempotent_insert", with_tx(INSERT_SQL))
def k8_idempotent_insert(spark, sf_dir):
    """Everything is delivered twice to a table that already holds the completed rows."""
    tx = transactions(spark, sf_dir)
    existing = tx.filter("status = 'COMPLETED'")
    added = sinks.new_rows(tx.unionByName(tx), existing)
    return existing.unionByName(added).select("transaction_id", "user_id", "amount", "status")


@query("j4_anti_join", with_tx("SELECT transaction_id, amount FROM tx WHERE status <> 'COMPLETED'"))
def j4_anti_join(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    return sinks.new_rows(tx, tx.filter("status = 'COMPLETED'")).select("transaction_id", "amount")


@query("x11_distinct_ids", with_tx("SELECT transaction_id, amount FROM tx"))
def x11_distinct_ids(spark, sf_dir):
    """Batch form of the stream's deduplication."""
    tx = transactions(spark, sf_dir)
    return sinks.first_per_id(tx.unionByName(tx)).select("transaction_id", "amount")


@query("s9_user_feed", with_tx("""
SELECT 'event' AS type, 'user_' || user_id || '_transactions' AS topic, count(*) AS events FROM tx GROUP BY ALL
UNION ALL SELECT 'event', 'user_' || user_id || '_alerts', count(*) FROM tx WHERE status = 'FRAUD' GROUP BY ALL
UNION ALL SELECT 'event', 'system_alerts', count(*) FROM tx WHERE amount > 300"""))
def s9_user_feed(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    feed = sources.user_feed({"transactions": tx, "alerts": tx.filter("status = 'FRAUD'"),
                              "system_alerts": tx.filter("amount > 300")}, as_of=AS_OF)
    return feed.groupBy("type", "topic").agg(F.count("data").alias("events"))
