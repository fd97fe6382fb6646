"""Decoding, normalization, validation, masking."""

import datetime as dt
import ipaddress
import json

import pytest
from helpers import frame, tx
from pyspark.sql import functions as F

from spendlens import domain, sources
from spendlens.functions import columns as C
from spendlens.operators import normalize as N


def wire(spark, *records):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in records], "value string")


def test_normalize_reconciles_record_shapes(spark):
    df = wire(spark,
              {"transaction_id": "a", "user_id": "u", "amount": 10.126, "category": "food", "timestamp": 1704067200500},
              {"id": "b", "amount": 5, "category": "Groceries", "timestamp": "2024-01-01T00:00:01.250000"},
              {"id": "c", "timestamp": "no date"}, "{broken")
    rows = N.normalize(sources.decode_json(df)).collect()
    assert [r.transaction_id for r in rows] == ["a", "b", "c", None]
    assert [r.amount for r in rows] == [10.13, 5.0, None, None]
    assert [r.category for r in rows] == ["FOOD", "OTHER", "OTHER", "OTHER"]
    assert rows[0].timestamp == dt.datetime(2024, 1, 1, 0, 0, 0, 500000)
    assert rows[1].timestamp == dt.datetime(2024, 1, 1, 0, 0, 1, 250000)
    assert rows[2].timestamp is None and rows[0].status == "PENDING"


def test_normalize_accepts_typed_timestamps(spark):
    stamp = dt.datetime(2024, 1, 1, 12)
    for value, kind in ((stamp, "timestamp"), (stamp, "timestamp_ntz"), (1704110400000, "bigint")):
        df = spark.createDataFrame([("a", value)], f"transaction_id string, timestamp {kind}")
        assert N.normalize(df).first().timestamp == stamp


def test_broken_records_are_kept_for_quarantine(spark):
    rows = sources.decode_json(wire(spark, {"id": "a"}, "{broken", "[1]"), keep_bad=True).collect()
    assert [r.bad_value is not None for r in rows] == [False, True, True]


def test_ingest_defaults(spark):
    r = sources.ingest_json(wire(spark, {}), as_of="2024-01-31 00:00:00").first()
    assert (r.amount, r.currency, r.description, r.merchant, r.category, r.status) == (
        0.0, "USD", "", "", "OTHER", "COMPLETED")
    assert len(r.transaction_id) == 36 and r.timestamp == dt.datetime(2024, 1, 31)


@pytest.mark.parametrize("change, rule", [
    ({"amount": 0.0}, "amount_positive"), ({"amount": -1.0}, "amount_positive"), ({"amount": None}, "amount_positive"),
    ({"amount": 1_000_000.01}, "amount_limit"), ({"amount": 1_000_000.0}, None), ({"currency": "usd"}, "currency_format"),
    ({"currency": None}, "currency_format"), ({"category": "GROCERIES"}, "category_domain"),
    ({"category": None}, "category_domain"), ({"merchant": None}, None), ({"merchant": "x" * 256}, "merchant_length"),
    ({"ip_address": "256.1.1.1"}, "ip_address_format"), ({"ip_address": "::1"}, None), ({"ip_address": ""}, None),
    ({"timestamp": None}, "timestamp_present"), ({"device_id": "d" * 101}, "device_id_length"),
])
def test_validation_rules(spark, change, rule):
    row = tx(1, "u", 5, 0)
    row.update(change)
    got = N.validate(frame(spark, [row])).first()
    assert got.violations == ([rule] if rule else []) and got.is_valid == (rule is None)


def test_split_valid_loses_nothing(spark):
    df = frame(spark, [tx(1, "u", 5, 0), tx(2, "u", -5, 0), tx(3, "u", None, 0)])
    valid, bad = N.split_valid(df)
    assert [r.transaction_id for r in valid.collect()] == ["1"]
    assert {r.transaction_id for r in bad.collect()} == {"2", "3"}


ADDRESSES = ["1.2.3.4", "256.1.1.1", "01.2.3.4", "1.2.3", "::", "::1", "fe80::1%eth0", "1::2::3", "12345::", "g::1",
             "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7::", "::ffff:10.0.0.1", "::ffff:300.0.0.1", ":1", "1:",
             "2001:db8::a:b", "abc", "1:2:3:4:5:6:7:8:9"]


def test_ip_addresses_like_the_standard_library(spark):
    def valid(a):
        try:
            return bool(ipaddress.ip_address(a))
        except ValueError:
            return False

    df = spark.createDataFrame([(a,) for a in ADDRESSES], "a string")
    got = {r.a: r.ok for r in df.select("a", C.is_ip_address("a").alias("ok")).collect()}
    assert got == {a: valid(a) for a in ADDRESSES}


def test_ipv4_allows_leading_zeros(spark):
    df = spark.createDataFrame([("001.2.3.4",), ("255.255.255.255",), ("256.1.1.1",), ("1.2.3",), ("a.b.c.d",)], "a string")
    assert [r[0] for r in df.select(C.is_ipv4("a")).collect()] == [True, True, False, False, False]


def test_formats(spark):
    df = spark.createDataFrame([("a.b+c@x-y.org", "+491234", "1990-01-31"), ("a@b", "0123", "1990/01/31")],
                               "e string, p string, d string")
    got = df.select(C.is_email("e"), C.is_phone("p"), C.is_birth_date("d")).collect()
    assert [tuple(r) for r in got] == [(True, True, True), (False, False, False)]


def test_sanitize_keeps_ampersands(spark):
    df = spark.createDataFrame([("<a href='/x'>&\"",), (None,)], "t string")
    assert [r[0] for r in df.select(C.sanitize("t")).collect()] == ["&lt;a href=&#x27;&#x2F;x&#x27;&gt;&&quot;", ""]


def test_mask_by_name(spark):
    df = spark.createDataFrame([("u", "pw", None, {"api_key": "k", "note": "n"})],
                               "user string, User_Password string, ssn string, info map<string,string>")
    r = N.mask_sensitive(df).first()
    assert tuple(r) == ("u", domain.MASK, None, {"api_key": domain.MASK, "note": "n"})


def test_unique_values(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "email string")
    assert [tuple(r) for r in N.duplicate_values(df, "email").collect()] == [("a", 2)]
    taken = spark.createDataFrame([("b",)], "email string")
    assert {r.email for r in N.new_values_only(df, taken, "email").collect()} == {"a"}


def test_avro_schema_is_the_topic_record():
    schema = json.loads(domain.avro_schema())
    assert [f["name"] for f in schema["fields"]] == [f.name for f in domain.TRANSACTION_SCHEMA.fields][:11]
    assert schema["fields"][6]["type"] == {"type": "long", "logicalType": "timestamp-millis"}


def test_user_feed(spark):
    a = frame(spark, [tx(1, "u", 1, 0), tx(2, "v", 1, 0)])
    news = spark.createDataFrame([("up",)], "text string")
    feed = sources.user_feed({"transactions": a, "market_updates": news}, user_id="u").collect()
    assert sorted(r.topic for r in feed) == ["market_updates", "user_u_transactions"]
    assert json.loads([r.data for r in feed if r.topic == "market_updates"][0]) == {"text": "up"}


def test_keyword_classes_take_the_first_rule(spark):
    names = {"Tax_Rules.pdf": "compliance", "Stock guide": "investment", "fraud.txt": "risk", "irs.md": "tax",
             "notes": "general"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.c for r in df.select("n", C.document_category("n").alias("c")).collect()} == names
    routes = {"How to INVEST after tax?": "portfolio_advisor", "Tax?": "tax_advisor", "Hi": "general_financial_advisor"}
    df = spark.createDataFrame([(n,) for n in routes], "n string")
    assert {r.n: r.c for r in df.select("n", C.advice_route("n").alias("c")).collect()} == routes


def test_snippet_and_tokens(spark):
    df = spark.createDataFrame([("x" * 700,), ("abcdefg",)], "t string")
    got = df.select(C.snippet("t"), C.token_estimate("t"), F.length(C.snippet("t"))).collect()
    assert got[1][0] == "abcdefg..." and got[1][1] == 1 and got[0][2] == 503


def test_avro_defaults_serve_a_reader():
    fields = {f["name"]: f for f in json.loads(domain.avro_schema("a.b"))["fields"]}
    assert json.loads(domain.avro_schema("a.b"))["namespace"] == "a.b" and "namespace" not in json.loads(domain.avro_schema())
    assert {n: f["default"] for n, f in fields.items() if "default" in f} == {
        "merchant": None, "location": None, "device_id": None, "ip_address": None, "status": "PENDING"}
    assert all(f["type"][0] == "null" for f in fields.values() if f.get("default", 0) is None)


def test_value_formats(spark):
    from spendlens.sources import decode

    rows = spark.createDataFrame([('{"transaction_id": "a", "amount": 1}',)], "value string")
    assert decode(rows).first().amount == 1 and decode(rows, "json", keep_bad=True).first().bad_value is None
    for kind, message in (("xml", "none of"), ("avro", "(?i)avro")):
        with pytest.raises(Exception, match=message):
            decode(rows, kind).collect()
