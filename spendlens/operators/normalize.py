"""Bringing raw records to the one transaction shape, checking them, and masking what must not leak."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from spendlens import domain
from spendlens.functions import columns as C


def _timestamp_of(df: DataFrame, name: str = "timestamp") -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.col(name).cast("timestamp")
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return F.timestamp_millis(F.col(name))
    millis = F.col(name).try_cast("long")
    return F.coalesce(F.timestamp_millis(millis), F.try_to_timestamp(F.col(name)))


def normalize(raw: DataFrame, as_of=None, default_status: str = "PENDING",
              categories: Sequence[str] = domain.CATEGORIES) -> DataFrame:
    """Any of the record shapes in use -> the 12 transaction columns.

    Missing columns become NULL; epoch milliseconds and ISO text both give a timestamp; a category outside the
    domain becomes OTHER. Extra columns are dropped, but for ``bad_value``, the text of a record that could not be decoded.
    """
    have = set(raw.columns)

    def field(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast(domain.TRANSACTION_SCHEMA[name].dataType)

    category = F.upper(F.trim(field("category")))
    names = [n for n in ("transaction_id", "id") if n in have]
    out = {f.name: field(f.name).cast(f.dataType) for f in domain.TRANSACTION_SCHEMA.fields
           if f.name != "timestamp"}
    out["transaction_id"] = F.coalesce(*[F.col(n).cast("string") for n in names]) if names else field("transaction_id")
    out["amount"] = F.round(out["amount"], 2)
    out["currency"] = F.coalesce(field("currency"), F.lit("USD"))
    out["category"] = F.when(category.isin(*categories), category).otherwise(F.lit("OTHER"))
    out["status"] = F.coalesce(F.upper(field("status")), F.lit(default_status))
    out["timestamp"] = _timestamp_of(raw) if "timestamp" in have else F.lit(None).cast("timestamp")
    if as_of is not None:
        out["timestamp"] = F.coalesce(out["timestamp"], C.as_of_or_now(as_of))
    broken = [n for n in ("bad_value",) if n in have]
    return raw.select(*[out[f.name].alias(f.name) for f in domain.TRANSACTION_SCHEMA.fields], *broken)


def with_defaults(raw: DataFrame, as_of=None) -> DataFrame:
    """Ingest defaults of the consumer: every absent field gets a value, then the record is normalized."""
    have = set(raw.columns)
    # Defaults per field.
    defaults = {"amount": 0.0, "currency": "USD", "description": "", "merchant": "", "category": "OTHER",
                "status": "COMPLETED"}
    filled = raw.withColumns({
        name: F.coalesce(F.col(name), F.lit(value)) if name in have else F.lit(value)
        for name, value in defaults.items()
    })
    out = normalize(filled, default_status="COMPLETED")
    return out.withColumns({
        "transaction_id": F.coalesce("transaction_id", F.expr("uuid()")),
        "timestamp": F.coalesce("timestamp", C.as_of_or_now(as_of)),
    })


def with_processing_time(df: DataFrame, name: str = "processing_timestamp", as_of=None) -> DataFrame:
    return df.withColumn(name, C.as_of_or_now(as_of))


def violations(tx: DataFrame) -> Column:
    """Names of the rules a transaction breaks, in a fixed order."""
    have = set(tx.columns)
    rules = [
        ("amount_positive", F.coalesce(F.col("amount") > 0, F.lit(False))),
        ("amount_limit", F.coalesce(F.col("amount") <= domain.MAX_AMOUNT, F.lit(True))),
        ("currency_format", F.coalesce(F.col("currency").rlike(C.CURRENCY), F.lit(False))),
        ("category_domain", F.coalesce(F.col("category").isin(*domain.CATEGORIES), F.lit(False))),
        ("timestamp_present", F.col("timestamp").isNotNull()),
    ]
    if "bad_value" in have:
        rules.insert(0, ("decodable", F.col("bad_value").isNull()))
    for name, limit in domain.MAX_LENGTHS.items():
        if name in have:
            rules.append((f"{name}_length", F.coalesce(F.length(name) <= limit, F.lit(True))))
    if "ip_address" in have:
        ip = F.col("ip_address")
        rules.append(("ip_address_format", F.coalesce((ip == "") | C.is_ip_address(ip), F.lit(True))))
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules]))


def validate(tx: DataFrame) -> DataFrame:
    """Adds ``violations`` and ``is_valid``; amounts are rounded to cents."""
    return (tx.withColumn("violations", violations(tx))
              .withColumn("is_valid", F.size("violations") == 0)
              .withColumn("amount", F.round("amount", 2)))


def split_valid(tx: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined); nothing is lost between the two."""
    checked = validate(tx)
    valid = checked.filter("is_valid").drop("violations", "is_valid")
    return valid, checked.filter("NOT is_valid").drop("is_valid")


def duplicate_values(df: DataFrame, column: str) -> DataFrame:
    """Values that break a uniqueness constraint, with how often they occur."""
    return df.groupBy(column).agg(F.count("*").alias("occurrences")).filter("occurrences > 1")


def new_values_only(incoming: DataFrame, existing: DataFrame, column: str) -> DataFrame:
    """Rows of ``incoming`` whose unique value is not taken yet."""
    return incoming.join(existing.select(column), column, "left_anti")


def is_sensitive(name: str) -> bool:
    lowered = name.lower()
    return any(word in lowered for word in domain.SENSITIVE_NAMES)


def mask_sensitive(df: DataFrame) -> DataFrame:
    """Replace the values of secret columns, and of secret keys inside string maps; NULL stays NULL."""
    def masked(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if is_sensitive(field.name):
            return F.when(c.isNotNull(), F.lit(domain.MASK)).alias(field.name)
        if isinstance(field.dataType, T.MapType) and isinstance(field.dataType.valueType, T.StringType):
            pattern = "(?i)" + "|".join(domain.SENSITIVE_NAMES)
            return F.transform_values(
                c, lambda k, v: F.when(k.rlike(pattern) & v.isNotNull(), F.lit(domain.MASK)).otherwise(v)
            ).alias(field.name)
        return c

    return df.select(*[masked(f) for f in df.schema.fields])
