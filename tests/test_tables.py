"""Tables that micro-batches write: inserts that do not read them, upserts that do not grow."""

import datetime as dt
import glob
import random

import pytest
from helpers import frame, tx
from pyspark.sql import functions as F

from spendlens import sinks

HEAD = "window_start timestamp, user_id string, total double"


def ids(spark, path):
    return sorted(r.transaction_id for r in spark.read.parquet(path).collect())


def test_new_ids_read_next_to_nothing(spark, tmp_path):
    """Of eight earlier batches, only the buckets that hold an id of the ninth are read."""
    path = str(tmp_path / "t")
    for b in range(8):
        sinks.append_new(frame(spark, [tx(1000 * b + i, "u", 1, i) for i in range(200)]), path, b)
    new = frame(spark, [tx(100_000 + i, "u", 1, i) for i in range(200)])
    assert sinks.possible_buckets(new.withColumn("bucket", sinks._bucket("transaction_id", sinks.BUCKETS)), path, 8, "transaction_id") == []
    some = frame(spark, [tx(i, "u", 9, 0) for i in (5, 3007, 7199)] + [tx(100_000, "u", 9, 0)])
    marked = some.withColumn("bucket", sinks._bucket("transaction_id", sinks.BUCKETS))
    folders = sinks.possible_buckets(marked, path, 8, "transaction_id")
    buckets = {r.transaction_id: r.bucket for r in marked.collect()}
    assert folders == sorted([(0, buckets["5"]), (3, buckets["3007"]), (7, buckets["7199"])])
    read = sinks.possibly_taken(marked, path, 8, "transaction_id").inputFiles()
    everything = spark.read.parquet(path).inputFiles()
    assert 0 < len(read) < len(everything) / 20
    sinks.append_new(some, path, 8)
    assert ids(spark, path) == sorted([str(1000 * b + i) for b in range(8) for i in range(200)] + ["100000"])
    assert spark.read.parquet(path).filter("amount = 9").count() == 1


def test_filters_never_lose_an_id(spark, tmp_path):
    """Batches of very different sizes, ids that come again in any of them, and a batch that is repeated."""
    rng, path, seen = random.Random(3), str(tmp_path / "t"), set()
    for b, n in enumerate([1, 3000, 40, 0, 700, 12_000]):
        batch = [str(rng.randrange(20_000)) for _ in range(n)]
        df = spark.createDataFrame([(i, b) for i in batch], "transaction_id string, timestamp int")
        for _ in range(2 if b in (1, 4) else 1):
            sinks.append_new(df, path, b)
        seen |= set(batch)
        assert ids(spark, path) == sorted(seen)


def test_missing_ids(spark, tmp_path):
    path = str(tmp_path / "t")
    for b in range(2):
        sinks.append_new(spark.createDataFrame([(None, 1), ("a", 1)], "transaction_id string, timestamp int"), path, b)
    assert [r.transaction_id for r in spark.read.parquet(path).orderBy("transaction_id").collect()] == [None, None, "a"]


def rows(spark, pairs):
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(start + dt.timedelta(days=d, hours=h), u, v) for d, h, u, v in pairs], HEAD)


def current(spark, path):
    return {(r.window_start, r.user_id): r.total for r in sinks.read_current(spark, path).collect()}


def test_fifty_batches_leave_two_folders_a_date(spark, tmp_path):
    rng, path, want = random.Random(4), str(tmp_path / "t"), {}
    start = dt.datetime(2024, 1, 1)
    for b in range(50):
        keys = {(rng.randrange(3) if b % 7 else 3, rng.randrange(24), rng.choice("uvw")) for _ in range(12)}
        batch = [(*k, float(b)) for k in keys]
        want |= {(start + dt.timedelta(days=d, hours=h), u): v for d, h, u, v in batch}
        sinks.upsert(rows(spark, batch), path, b, ["window_start", "user_id"])
        if b % 10 == 9:
            for _ in range(2):  # the last batch once more
                assert current(spark, path) == want
                sinks.upsert(rows(spark, batch), path, b, ["window_start", "user_id"])
    assert current(spark, path) == want
    folders = glob.glob(f"{path}/date=*/batch_id=*")
    assert len(glob.glob(f"{path}/date=*")) == 4 and len(folders) <= 8


def test_a_batch_touches_its_dates_only(spark, tmp_path):
    path, keys = str(tmp_path / "t"), ["window_start", "user_id"]
    sinks.upsert(rows(spark, [(0, 1, "u", 1.0), (1, 1, "u", 2.0), (2, 1, "u", 3.0)]), path, 0, keys)
    sinks.upsert(rows(spark, [(1, 1, "u", 5.0), (1, 2, "v", 6.0)]), path, 1, keys)
    assert sinks.date_folders(spark, path) == {"2024-01-01": [0], "2024-01-02": [0, 1], "2024-01-03": [0]}
    assert sorted(current(spark, path).values()) == [1.0, 3.0, 5.0, 6.0]
    sinks.upsert(rows(spark, []), path, 2, keys)
    assert sorted(current(spark, path).values()) == [1.0, 3.0, 5.0, 6.0]


def test_a_later_batch_may_bring_a_column(spark, tmp_path):
    path, keys = str(tmp_path / "t"), ["window_start", "user_id"]
    sinks.upsert(rows(spark, [(0, 1, "u", 1.0), (0, 2, "u", 2.0)]), path, 0, keys)
    sinks.upsert(rows(spark, [(0, 1, "u", 3.0)]).withColumn("note", F.lit("new")), path, 1, keys)
    got = sorted((r.total, r.note) for r in sinks.read_current(spark, path).collect())
    assert got == [(2.0, None), (3.0, "new")]


def test_no_table_yet(spark, tmp_path):
    assert sinks.date_folders(spark, str(tmp_path / "none")) == {}
    with pytest.raises(Exception):
        sinks.read_current(spark, str(tmp_path / "none")).count()


def test_a_date_is_few_files_without_adaptive_execution(spark, tmp_path):
    """As in streams with state, where each task wrote a file of every date."""
    path, keys = str(tmp_path / "t"), ["window_start", "user_id"]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for b in range(2):
            sinks.upsert(rows(spark, [(d, h, f"u{h}", float(b)) for d in range(6) for h in range(20 + b)]), path, b, keys)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert {len(glob.glob(f"{folder}/*.parquet")) for folder in glob.glob(f"{path}/date=*/batch_id=*")} == {1}
    got = current(spark, path)
    assert len(got) == 6 * 21 and set(got.values()) == {1.0}


def test_a_large_date_is_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "ROWS_PER_FILE", 10)
    path = str(tmp_path / "t")
    many = [(0, i % 24, f"u{i}", float(i)) for i in range(400)] + [(1, 1, "u", 1.0)] + [(1, 2, None, 2.0)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sinks.upsert(rows(spark, many), path, 0, ["window_start", "user_id"])
        sinks.upsert(rows(spark, [(0, 0, "u0", -1.0), (1, 2, None, 3.0)]), path, 1, ["window_start", "user_id"])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = {(w, u): v for w, u, v in rows(spark, many + [(0, 0, "u0", -1.0), (1, 2, None, 3.0)]).collect()}
    assert current(spark, path) == want and sinks.read_current(spark, path).count() == len(want)
    assert len(glob.glob(f"{path}/date=2024-01-01/batch_id=0/*.parquet")) > 1


def test_newest_versions_of_numbers_are_not_sorted(spark):
    versions = spark.createDataFrame([("a", 0, 1, 1.0), ("a", 1, None, 2.0), ("b", 0, 3, None)], "k string, batch_id long, n long, x double")
    newest = sinks.latest_version(versions, ["k"])
    assert "SortAggregate" not in newest._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, newest.collect())) == [("a", None, 2.0), ("b", 3, None)]
    named = versions.withColumn("s", F.concat("k", F.col("batch_id").cast("string")))
    assert sorted(map(tuple, sinks.latest_version(named, ["k"]).collect())) == [("a", None, 2.0, "a1"), ("b", 3, None, "b0")]


def test_a_csv_batch_is_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(row):
        seen.add(1)
        return row

    batch = spark.createDataFrame(spark.sparkContext.parallelize([("a", 1), ("b", 2)], 2).map(counted), "s string, n long")
    sinks.write_csv(batch, str(tmp_path / "csv"), 0)
    assert seen.value == 2
    assert sorted(map(tuple, spark.read.option("header", "true").csv(f"{tmp_path}/csv/batch_id=0").collect())) == [("a", "1"), ("b", "2")]
