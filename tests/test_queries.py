"""Every registered query with SQL gives the same rows as DuckDB on the same files."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check import compare, duck  # noqa: E402

from spendlens.plans import ORACLE, QUERIES, live  # noqa: E402

@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE:
        outcome = compare(df, duck(sf_dir), ORACLE[name])
        assert outcome.startswith("ok"), outcome
    else:
        assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)


@pytest.mark.parametrize("name", ["k2_live_upsert", "k4_live_topics", "k5_live_hourly_csv", "k7_live_alerts", "x2_live_tumbling",
                                  "x4_live_sessions", "x10_live_ingest", "x11_live_distinct"])
def test_live_queries_on_a_folder_of_unordered_files(spark, sf_dir, tmp_path, monkeypatch, name):
    """Every file is a micro-batch of its own and holds times from everywhere."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(live.event_stream, "__defaults__", (None, 1))
    outcome = compare(QUERIES[name](spark, str(tmp_path)), duck(sf_dir), ORACLE[name])
    assert outcome.startswith("ok"), outcome


def test_live_fraud_features_on_a_folder_of_unordered_files(spark, sf_dir, tmp_path, monkeypatch):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(live.event_stream, "__defaults__", (None, 1))
    name = "x9_live_fraud_features"
    outcome = compare(QUERIES[name](spark, str(tmp_path)), duck(sf_dir), ORACLE[name])
    assert outcome.startswith("ok"), outcome


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.queries().keys() >= QUERIES.keys()
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
