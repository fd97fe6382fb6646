"""Fixed values of the transaction domain: enumerations, schemas, limits and lookup rows."""

from __future__ import annotations

import json

from pyspark.sql import types as T

# --- fixed values: enumerations ---------------------------------------------------------------------
WIRE_CATEGORIES = ("FOOD", "TRANSPORT", "SHOPPING", "BILLS", "ENTERTAINMENT", "OTHER")
CATEGORIES = ("FOOD", "TRANSPORT", "SHOPPING", "BILLS", "ENTERTAINMENT", "HEALTHCARE", "EDUCATION", "OTHER")
WIRE_STATUSES = ("PENDING", "COMPLETED", "FAILED", "FRAUD")
STATUSES = WIRE_STATUSES + ("CANCELLED",)

# --- fixed values: validation limits ----------------------------------------------------------------
MAX_AMOUNT = 1_000_000
MAX_LENGTHS = {"merchant": 255, "description": 500, "location": 255, "device_id": 100, "ip_address": 45}

# --- fixed values: column names that hold secrets -----------------------------------------------------
SENSITIVE_NAMES = ("password", "token", "api_key", "secret", "credit_card", "ssn", "account_number")
MASK = "*******"

# --- fixed values: portfolio assumptions --------------------------------------------------------------
BENCHMARK_RETURNS = {"SPY": 0.12, "AGG": 0.04, "GLD": 0.06}
TARGET_ALLOCATIONS = {
    "CONSERVATIVE": {"STOCK": 0.40, "BOND": 0.50, "CASH": 0.10},
    "MODERATE": {"STOCK": 0.60, "BOND": 0.35, "CASH": 0.05},
    "AGGRESSIVE": {"STOCK": 0.80, "BOND": 0.15, "ALTERNATIVE": 0.05},
}
TECH_SYMBOLS = ("AAPL", "MSFT", "GOOGL")

# --- fixed values: price per 1000 tokens (input, output) ----------------------------------------------
TOKEN_PRICES = {
    "gpt-4": (0.03, 0.06),
    "gpt-4-turbo": (0.01, 0.03),
    "gpt-3.5-turbo": (0.0015, 0.002),
    "claude-2": (0.01102, 0.03268),
}
DEFAULT_MODEL = "gpt-4"

# --- fixed values: keyword rules, first match wins ----------------------------------------------------
DOCUMENT_CATEGORIES = (
    ("compliance", ("regulation", "compliance", "law", "rule")),
    ("investment", ("investment", "portfolio", "stock", "bond")),
    ("risk", ("risk", "security", "fraud")),
    ("tax", ("tax", "irs", "vat")),
)
ADVICE_ROUTES = (
    ("portfolio_advisor", ("portfolio", "invest")),
    ("tax_advisor", ("tax",)),
)

# The one record every operator works on.
TRANSACTION_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("currency", T.StringType()),
    T.StructField("merchant", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("location", T.StringType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("ip_address", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("description", T.StringType()),
])

# JSON on the wire: producers send either epoch milliseconds or an ISO string, so the timestamp is read as
# text and resolved by ``normalize``. ``id`` is the older name of ``transaction_id``.
WIRE_SCHEMA = T.StructType(
    [T.StructField("id", T.StringType())]
    + [T.StructField(f.name, T.StringType() if f.name == "timestamp" else f.dataType)
       for f in TRANSACTION_SCHEMA.fields]
)


def avro_schema(namespace: str | None = None) -> str:
    """The Avro record of the ``transactions`` topic: also a reader schema for records without the optional fields.

    A registry that compares full names wants the topic's ``namespace`` as well.
    """
    def enum(name, symbols):
        return {"type": "enum", "name": name, "symbols": list(symbols)}

    optional = ["null", "string"]
    types = {
        "transaction_id": "string", "user_id": "string", "amount": "double", "currency": "string",
        "merchant": optional, "category": enum("Category", WIRE_CATEGORIES),
        "timestamp": {"type": "long", "logicalType": "timestamp-millis"},
        "location": optional, "device_id": optional, "ip_address": optional,
        "status": enum("Status", WIRE_STATUSES),
    }
    # Defaults of the record.
    defaults = {"merchant": None, "location": None, "device_id": None, "ip_address": None, "status": "PENDING"}
    fields = [{"name": name, "type": kind} | ({"default": defaults[name]} if name in defaults else {})
              for name, kind in types.items()]
    record = {"type": "record", "name": "Transaction", "fields": fields}
    return json.dumps(record | ({"namespace": namespace} if namespace else {}))
