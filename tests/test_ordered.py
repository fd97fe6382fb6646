"""Event-time operators with state and timers: each row once, exact, in any order of rows and files."""

import datetime as dt
import random
import time
from pathlib import Path

import pandas as pd
import pytest
from helpers import START, close, frame, skewed_rows, tx
from pyspark.sql import functions as F

from spendlens import domain
from spendlens.operators import metrics as Q, timeline as L
from spendlens.sources import read_stream
from spendlens.streaming import jobs, lag, ordered


@pytest.fixture
def folder(tmp_path):
    return lambda name: str(tmp_path / name)


def add(spark, rows, path, last=False):
    """A file of rows; the last one also holds a row far behind all others."""
    frame(spark, rows + ([tx("end", "heartbeat", 1, 10_000_000)] if last else [])).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return read_stream(spark, "parquet", domain.TRANSACTION_SCHEMA, path, maxFilesPerTrigger=1)


def features(spark, folder, watermark="100 days"):
    out = ordered.ordered_features(stream(spark, folder("in")), watermark)
    jobs.run_to_end(spark, jobs.write_append(out, "f", folder("out"), folder("cp"), True))
    return spark.read.parquet(folder("out")).collect()


def same(got, want):
    assert sorted(r.transaction_id for r in got) == sorted(r.transaction_id for r in want)  # each row once
    got = {r.transaction_id: r for r in got}
    for w in want:
        g = got[w.transaction_id]
        assert close(g.avg_last_10, w.avg_last_10) and close(g.std_last_10, w.std_last_10), (g, w)
        assert g.count_last_hour == w.count_last_hour, (g, w)
        assert all(g[f] == w[f] for f in domain.TRANSACTION_SCHEMA.names)


def test_unordered_files(spark, folder):
    rows = skewed_rows(300)
    random.Random(1).shuffle(rows)
    for i in range(0, 300, 75):
        add(spark, rows[i:i + 75], folder("in"), last=i == 225)
    same(features(spark, folder, "100 days"), L.recent_history(frame(spark, rows)).collect())


def test_a_user_of_many_arrow_batches(spark, folder):
    rows = skewed_rows(600)
    add(spark, rows[:300], folder("in"))
    add(spark, rows[300:], folder("in"), last=True)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        got = features(spark, folder, "100 days")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    same(got, L.recent_history(frame(spark, rows)).collect())


def test_rows_come_when_the_watermark_has_passed_them(spark, folder):
    """Ordered by time within the allowed lateness; what is final is written, the rest waits for its batch."""
    rows = [tx(i, "u", i, s) for i, s in enumerate([100, 50, 400, 380, 700, 100_000])]
    for row in rows:
        add(spark, [row], folder("in"))
    got = features(spark, folder, "10 minutes")
    assert sorted(r.transaction_id for r in got) == ["0", "1", "2", "3", "4"]  # the last one still waits
    same(got, [r for r in L.recent_history(frame(spark, rows)).collect() if r.transaction_id != "5"])
    add(spark, [tx(6, "u", 1, 100_000), tx(7, "u", 1, 20)], folder("in"))  # one in the waiting second, one too late
    add(spark, [tx(8, "v", 1, 200_000)], folder("in"))
    rows += [tx(6, "u", 1, 100_000)]
    same(features(spark, folder, "10 minutes"), L.recent_history(frame(spark, rows)).collect())


class Kept:
    """A state variable outside of Spark."""

    def __init__(self):
        self.values = []

    def exists(self):
        return bool(self.values)

    def get(self):
        return iter(self.values) if self.listed else self.values[0]

    def appendValue(self, value):
        self.values.append(value)

    def update(self, value):
        self.values = [value]

    def clear(self):
        self.values = []


class Handle:
    def getListState(self, *_):
        return self.made(True)

    def getValueState(self, *_):
        return self.made(False)

    def made(self, listed):
        out = Kept()
        out.listed = listed
        return out

    def registerTimer(self, at):
        self.at = at

    def deleteTimer(self, at):
        pass


def test_waiting_rows_are_one_value_each_batch():
    class Watermark:
        def getCurrentWatermarkInMs(self):
            return int(1000 * (START.replace(tzinfo=dt.timezone.utc).timestamp() + 200))

    features = ordered.OrderedFeatures()
    features.init(handle := Handle())
    rows = [tx(i, "u", None if i == 4 else i, (7 * i) % 40 * 10) for i in range(40)]
    pieces = [pd.DataFrame(rows[k:k + 20]) for k in (0, 20)]
    for p in pieces:
        p["amount"] = p["amount"].astype(float)
    assert not list(features.handleInputRows(("u",), iter(pieces), None)) and len(features.waiting.values) == 2
    out = pd.concat(features.handleExpiredTimer(("u",), Watermark(), None))
    due = sorted((r for r in rows if r["timestamp"] < START + dt.timedelta(seconds=200)), key=lambda r: r["timestamp"])
    assert out["transaction_id"].tolist() == [r["transaction_id"] for r in due]
    assert out["timestamp"].tolist() == [r["timestamp"] for r in due]
    assert out["ip_address"].tolist() == [None] * len(due) and out["count_last_hour"].tolist() == list(range(1, len(due) + 1))
    assert len(features.waiting.values) == 1
    assert handle.at == 1000 * int(START.replace(tzinfo=dt.timezone.utc).timestamp() + 201)


def test_rows_without_user_or_time(spark, folder):
    rows = [tx(1, "u", None, 0), tx(2, None, 7, 10), tx(3, "u", 9, 0, timestamp=None), tx(4, "u", 3, 20, merchant=None)]
    add(spark, rows, folder("in"))
    add(spark, [], folder("in"), last=True)
    got = {r.transaction_id: (r.avg_last_10, r.count_last_hour, r.merchant, r.hour_of_day) for r in features(spark, folder)}
    assert got == {"1": (None, 1, "M1", 0), "2": (None, None, "M1", 0), "3": (None, None, "M1", None), "4": (None, 2, None, 0)}


# --- rules ------------------------------------------------------------------------------------------------

EVENTS = "ts timestamp, series string"


def held(spark, folder, hold=3, window=2):
    events = read_stream(spark, "parquet", spark.createDataFrame([], EVENTS).schema, folder("in"), maxFilesPerTrigger=1)
    series = ordered.live_sliding(events, {"n": F.count("*")}, window, ["series"], "ts", "1000 days")
    out = ordered.live_hold(series, F.col("n") >= 3, hold, F.col("n"), ["series"])
    jobs.run_to_end(spark, jobs.write_append(out, "r", folder("out"), folder("cp"), True))
    return spark.read.parquet(folder("out")).collect()


def events(minutes, series, per_minute=2):
    return [(START + dt.timedelta(minutes=m, seconds=7 * i), series) for m in minutes for i in range(per_minute)]


@pytest.mark.parametrize("files", [1, 4])
def test_episodes_equal_batch(spark, folder, files):
    rng = random.Random(2)
    rows = []
    for s in "abc":
        minutes = [m for m in range(0, 300) if rng.random() < 0.8 and m // 37 % 2 == 0]
        rows += events(minutes, s, rng.choice([2, 3])) + events(range(1430, 1450), s)
    rng.shuffle(rows)
    batch = spark.createDataFrame(rows, EVENTS)
    want = Q.held(Q.sliding_sums(batch, {"n": F.count("*")}, 2, ["series"], "ts"), F.col("n") >= 3, 3, F.col("n"), ["series"]).collect()
    for i in range(files):
        part = rows[i::files] + ([(START + dt.timedelta(days=5000), "end")] if i == files - 1 else [])
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(folder("in"))
    changes = held(spark, folder)
    got = [r for r in changes if r.state == "resolved"]
    assert len(want) > 5
    key = ("series", "pending_since", "firing_since", "last_true", "peak")
    assert sorted(tuple(r[c] for c in key) for r in got) == sorted(tuple(r[c] for c in key) for r in want)
    fired = [r for r in changes if r.state == "firing"]
    assert sorted((r.series, r.pending_since) for r in fired) == sorted((r.series, r.pending_since) for r in got)
    assert all(r.at == r.firing_since for r in fired) and all(r.at == r.last_true + dt.timedelta(minutes=1) for r in got)


def rule(hold=120):
    return ordered.HeldRule(["k"], hold, 60)


def states(evaluations, hold=120, start=None):
    episode, out = rule(hold).advanced(("s",), start, evaluations)
    return episode, [(r[1], r[2]) for r in out]


def test_state_machine():
    up = [(60 * m, True, float(m)) for m in range(5)]
    assert states(up) == ((0, 240, 4.0), [("pending", 0), ("firing", 120)])
    assert states(up[:2] + [(120, False, 9.0)]) == (None, [("pending", 0)])  # forgotten before it fired
    assert states(up + [(300, False, 9.0)]) == (None, [("pending", 0), ("firing", 120), ("resolved", 300)])
    gap = up + [(420, True, 1.0)]  # the evaluation of 300 is missing
    assert states(gap) == ((420, 420, 1.0), [("pending", 0), ("firing", 120), ("resolved", 300), ("pending", 420)])
    assert states([(0, True, 1.0)], hold=0) == ((0, 0, 1.0), [("pending", 0), ("firing", 0)])
    assert states(up[3:], start=(0, 120, 2.0)) == ((0, 240, 4.0), [])  # it fires once
    assert states(up[2:], start=(0, 60, 1.0)) == ((0, 240, 4.0), [("firing", 120)])


def test_an_episode_goes_on_over_micro_batches(spark, folder):
    for lo, hi in ((0, 4), (4, 9), (9, 12)):
        spark.createDataFrame(events(range(lo, hi), "a"), EVENTS).coalesce(1).write.mode("append").parquet(folder("in"))
    spark.createDataFrame([(START + dt.timedelta(days=5000), "end")], EVENTS).coalesce(1).write.mode("append").parquet(folder("in"))
    resolved = [r for r in held(spark, folder) if r.state == "resolved"]
    assert [(r.series, r.pending_since, r.last_true, r.peak) for r in resolved] == [
        ("a", START + dt.timedelta(minutes=2), START + dt.timedelta(minutes=12), 4.0)]


# --- the engine's own lag -----------------------------------------------------------------------------------

def test_offsets():
    assert lag.offset_total('{"t": {"0": 5, "1": 7}, "u": {"0": 1}}') == 13
    assert lag.offset_total({"logOffset": 3}) == 3 and lag.offset_total("8") == 8 and lag.offset_total(2) == 2
    assert lag.offset_total(None) is None and lag.offset_total("none") is None and lag.offset_total({"a": None}) is None


def test_lag_of_a_report():
    report = {"timestamp": "2024-01-01T00:10:00.000Z", "name": "spend", "id": "i", "runId": "r", "batchId": 4, "batchDuration": 2500,
              "eventTime": {"watermark": "2024-01-01T00:00:00.000Z"}, "sources": [
                  {"description": "Kafka[t]", "numInputRows": 9, "endOffset": {"t": {"0": 90, "1": 10}}, "latestOffset": {"t": {"0": 95, "1": 30}}},
                  {"description": "File[f]", "numInputRows": 1, "endOffset": {"logOffset": 3}, "latestOffset": None}]}
    rows = lag.lag_rows(report)
    assert [(r["topic"], r["consumer_group"], r["lag"], r["batch_seconds"]) for r in rows] == [
        ("Kafka[t]", "spend", 25, 2.5), ("File[f]", "spend", None, 2.5)]


def test_lag_rules_on_a_live_query_with_an_interval(spark, folder):
    """Under its processing-time trigger a query takes a file per batch; its reports become the table that the rules read."""
    for i in range(3):
        add(spark, [tx(i, "u", 1, 60 * i)], folder("in"))
    listener = lag.LagListener(spark, folder("lag"), every=2)
    spark.streams.addListener(listener)
    try:
        query = jobs.foreach_batch(stream(spark, folder("in")), lambda batch, i: batch.count(), "lagging", folder("cp"), "append", "1 second")
        while (query.lastProgress or {"batchId": -1})["batchId"] < 2 and query.isActive:
            query.awaitTermination(1)
        query.stop()
        for _ in range(50):  # reports come from a thread of their own
            listener.flush()
            if Path(folder("lag")).exists() and lag.read_lag(spark, folder("lag")).where("input_rows > 0").count() >= 3:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    table = lag.read_lag(spark, folder("lag"))
    rows = table.where("input_rows > 0").orderBy("batch_id").collect()
    assert [(r.consumer_group, r.batch_id, r.input_rows, r.lag) for r in rows] == [("lagging", i, 1, None) for i in range(3)]
    slow = Q.lag_levels(table.withColumn("lag", F.col("batch_seconds")), "consumer_group", "sum", 60)
    assert slow.where("lag > 0").count() >= 1
    assert Q.high_lag(table.withColumn("lag", F.lit(5000)), "consumer_group", "avg", hold_minutes=0).count() >= 1
