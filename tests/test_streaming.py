"""Streams over files: same results as batch, late rows, replays, sinks."""

import json
import random
from pathlib import Path

import pytest
from helpers import by_user, close, frame, skewed_rows, tx
from pyspark.sql import functions as F

from spendlens import domain, sinks
from spendlens.operators import aggregates as A, timeline as L
from spendlens.sources import decode_json, read_stream
from spendlens.streaming import jobs
from spendlens.streaming.fraud_state import read_live, stream_features, write_features


@pytest.fixture
def folder(tmp_path):
    def path(name):
        return str(tmp_path / name)

    return path


def add_file(spark, rows, path):
    frame(spark, rows).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, **options):
    return read_stream(spark, "parquet", domain.TRANSACTION_SCHEMA, path, maxFilesPerTrigger=1, **options)


def ordered_files(spark, rows, path, files):
    rows = sorted(rows, key=lambda r: r["timestamp"])
    size = -(-len(rows) // files)
    for i in range(0, len(rows), size):
        add_file(spark, rows[i:i + size], path)


def test_versioned_upsert_equals_batch(spark, folder):
    rows = skewed_rows(200)
    ordered_files(spark, rows, folder("in"), 4)
    query = jobs.process_transactions(stream(spark, folder("in")), folder("out"), folder("cp"), 50, available_now=True)
    jobs.run_to_end(spark, query)
    table = sinks.read_latest(spark, folder("out/user_spending_aggregates"), jobs.SPEND_KEYS)
    batch = A.spending_velocity(A.sliding_spend(frame(spark, rows)))
    columns = jobs.SPEND_KEYS + ["transaction_count"]
    assert sorted(map(tuple, table.select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect()))
    alerts = [json.loads(r.value) for r in spark.read.text(folder("out/alerts")).collect()]
    assert alerts and all(a["spending_velocity"] > 50 for a in alerts)
    sinks.compact(spark, folder("out/user_spending_aggregates"), jobs.SPEND_KEYS, folder("compact"), 99)
    compacted = spark.read.parquet(folder("compact"))
    assert compacted.count() == table.count() and "date" in compacted.columns
    assert sinks.read_latest(spark, folder("compact"), jobs.SPEND_KEYS).count() == table.count()


def test_changed_window_replaces_its_older_version(spark, folder):
    add_file(spark, [tx(1, "u", 1, 300)], folder("in"))
    add_file(spark, [tx(2, "u", 2, 310)], folder("in"))
    jobs.run_to_end(spark, jobs.process_transactions(stream(spark, folder("in")), folder("out"), folder("cp"),
                                                     available_now=True))
    path = folder("out/user_spending_aggregates")
    assert spark.read.parquet(path).count() == 10
    rows = sinks.read_latest(spark, path, jobs.SPEND_KEYS).collect()
    assert [(r.transaction_count, r.total_amount) for r in rows] == [(2, 3.0)] * 5


def minutes_of_users(spark, folder):
    """One file with a transaction a minute; about 5,000 windows of one or two days."""
    add_file(spark, [tx(i, f"u{i % 50}", i % 97, 60 * i) for i in range(1000)], folder("in"))


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = [files.apply(i) for i in range(files.size())]
    return {f.getName(): f.length() for f in files if f.getName().startswith("shuffle_")}


def test_live_spend_drops_its_shuffles(spark, folder, monkeypatch):
    minutes_of_users(spark, folder)
    earlier, left, write = shuffle_files(spark), [], sinks.write_messages

    def spy(df, topic, *args, **options):
        left.append(sum(size for name, size in shuffle_files(spark).items() if name not in earlier))
        write(df, topic, *args, **options)

    monkeypatch.setattr(sinks, "write_messages", spy)
    jobs.run_to_end(spark, jobs.process_transactions(stream(spark, folder("in")), folder("out"), folder("cp"), 10,
                                                     available_now=True))
    assert left and max(left) < 10_000, left  # of counts; the shuffle of the windows alone has over 100,000 bytes
    assert sinks.read_current(spark, folder("out/user_spending_aggregates")).count() == 5000


def test_upsert_keeps_the_setting_for_shuffles(spark, folder):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    sinks.upsert(A.sliding_spend(frame(spark, [tx(1, "u", 1, 0)])), folder("t"), 0, jobs.SPEND_KEYS)
    assert spark.conf.get(key) == before


def test_topics_are_compressed_in_files_of_bounded_length(spark, folder, monkeypatch):
    monkeypatch.setattr(sinks, "MESSAGES_PER_FILE", 1000, raising=False)
    minutes_of_users(spark, folder)
    jobs.run_to_end(spark, jobs.process_transactions(stream(spark, folder("in")), folder("out"), folder("cp"), 10,
                                                     available_now=True))
    for topic in ("user_aggregations", "alerts"):
        files = list(Path(folder(f"out/{topic}")).rglob("part-*"))
        text = spark.read.text(folder(f"out/{topic}"))
        assert sum(f.stat().st_size for f in files) < sum(len(r.value) for r in text.collect()) / 4
        assert max(r["count"] for r in text.groupBy(F.input_file_name()).count().collect()) <= 1000
    messages = [json.loads(r.value) for r in spark.read.text(folder("out/user_aggregations")).collect()]
    assert len({(m["window_start"], m["user_id"]) for m in messages}) == len(messages) == 5000


def test_replayed_batch_changes_nothing(spark, folder):
    df = frame(spark, [tx(1, "u", 1, 0), tx(2, "u", 2, 0), tx(2, "u", 3, 5)])
    for _ in range(2):
        sinks.append_new(df, folder("t"), 0)
    sinks.append_new(frame(spark, [tx(2, "u", 9, 0), tx(3, "u", 1, 0)]), folder("t"), 1)
    rows = {(r.transaction_id, r.amount) for r in spark.read.parquet(folder("t")).collect()}
    assert rows == {("1", 1.0), ("2", 2.0), ("3", 1.0)}


def test_late_rows_are_counted(spark, folder):
    add_file(spark, [tx(1, "u", 1, 10_000)], folder("in"))
    add_file(spark, [tx(2, "u", 1, 20_000)], folder("in"))
    add_file(spark, [tx(3, "u", 1, 100), tx(4, "u", 1, 20_010)], folder("in"))
    out = A.tumbling_spend(stream(spark, folder("in")), watermark="5 minutes", suffix="")
    query = jobs.run_to_end(spark, jobs.write_append(out, "late", folder("out"), folder("cp"), True))
    assert jobs.late_rows(query) == 1
    assert [r.transaction_count for r in spark.read.parquet(folder("out")).collect()] == [1]


def test_sessions_equal_batch(spark, folder):
    rows = [tx(i, u, 1, s) for u in ("a", "b") for i, s in enumerate((0, 1800, 3601, 3601.4, 5401, 90_000))]
    rows = [dict(r, transaction_id=r["user_id"] + r["transaction_id"]) for r in rows]
    ordered_files(spark, rows, folder("in"), 5)
    add_file(spark, [tx("end", "z", 1, 300_000)], folder("in"))
    query = jobs.write_append(jobs.live_sessions(stream(spark, folder("in"))), "s", folder("out"), folder("cp"), True)
    jobs.run_to_end(spark, query)
    columns = ["user_id", "session_transaction_count", "session_start", "session_end"]
    batch = L.sessions(frame(spark, rows)).select(columns)
    got = spark.read.parquet(folder("out")).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_distinct_ids_across_batches(spark, folder):
    add_file(spark, [tx(1, "u", 1, 0), tx(1, "u", 1, 0)], folder("in"))
    add_file(spark, [tx(1, "u", 1, 30), tx(2, "u", 1, 30)], folder("in"))
    out = jobs.live_distinct(stream(spark, folder("in")))
    jobs.run_to_end(spark, jobs.write_append(out, "d", folder("out"), folder("cp"), True))
    assert sorted(r.transaction_id for r in spark.read.parquet(folder("out")).collect()) == ["1", "2"]


@pytest.mark.parametrize("files", [1, 6])
def test_fraud_features_equal_batch(spark, folder, files):
    rows = skewed_rows(240)
    # Rows of one timestamp stay together, as the order between files decides the history of a stream.
    for group in by_user(rows).values():
        for a, b in zip(group, group[1:]):
            if b["timestamp"] <= a["timestamp"]:
                b["timestamp"] = a["timestamp"].replace(microsecond=min(999_999, a["timestamp"].microsecond + 1))
    ordered_files(spark, rows, folder("in"), files)
    query = jobs.write_append(stream_features(stream(spark, folder("in"))), "f", folder("out"), folder("cp"), True)
    jobs.run_to_end(spark, query)
    got = {r.transaction_id: r for r in spark.read.parquet(folder("out")).collect()}
    want = L.recent_history(frame(spark, rows)).collect()
    assert len(got) == len(want)
    for w in want:
        g = got[w.transaction_id]
        assert close(g.avg_last_10, w.avg_last_10) and close(g.std_last_10, w.std_last_10), (g, w)
        if files == 1:
            assert g.count_last_hour == w.count_last_hour


def same_history(got, want):
    got = {r.transaction_id: r for r in got}
    assert len(got) == len(want)
    for w in want:
        g = got[w.transaction_id]
        assert close(g.avg_last_10, w.avg_last_10) and close(g.std_last_10, w.std_last_10), (g, w)
        assert g.count_last_hour == w.count_last_hour, (g, w)


def shuffled(rows):
    rows = list(rows)
    random.Random(7).shuffle(rows)
    return rows


def test_fraud_features_of_a_user_with_many_arrow_batches(spark, folder):
    rows = shuffled(skewed_rows(400))
    add_file(spark, rows, folder("in"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        query = jobs.write_append(stream_features(stream(spark, folder("in"))), "f", folder("out"), folder("cp"), True)
        jobs.run_to_end(spark, query)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    same_history(spark.read.parquet(folder("out")).collect(), L.recent_history(frame(spark, rows)).collect())


def test_live_fraud_features_of_unordered_files(spark, folder):
    """Rows come in later files than younger ones, which are then corrected."""
    rows = shuffled(skewed_rows(300))
    for i in range(0, 300, 75):
        add_file(spark, rows[i:i + 75], folder("in"))
    jobs.run_to_end(spark, write_features(stream(spark, folder("in")), folder("out"), folder("cp"), True))
    got = read_live(spark, folder("out/features")).collect()
    assert len(got) == len(rows)
    same_history(got, L.recent_history(frame(spark, rows)).collect())


def test_newest_scores_without_a_sort_of_all_rows(spark, folder):
    """Fraud no more, fraud only later, fraud in both versions, fraud without a second version."""
    columns = "origin long, row_number long, transaction_id string, prediction double"
    for batch, rows in enumerate([[(0, 1, "a", 1.0), (0, 2, "b", 0.0), (0, 3, "c", 1.0)],
                                  [(0, 1, "a", 0.0), (0, 2, "b", 1.0), (0, 3, "c", 1.0), (1, 1, "d", 1.0)],
                                  [(0, 2, "b", 1.0), (2, 1, "e", 0.0)]]):
        sinks.write_version(spark.createDataFrame(rows, columns), folder("scores"), batch)
    got = {n: read_live(spark, folder("scores"), n) for n in (False, True)}
    assert got[True].columns == got[False].columns == ["transaction_id", "prediction"]
    assert sorted(map(tuple, got[False].collect())) == [("a", 0.0), ("b", 1.0), ("c", 1.0), ("d", 1.0), ("e", 0.0)]
    assert sorted(map(tuple, got[True].collect())) == [("b", 1.0), ("c", 1.0), ("d", 1.0)]
    assert "SortAggregate" not in got[True]._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("form", ["state", "history"])
def test_rows_without_user_or_time_keep_their_row_features(spark, folder, form):
    rows = [tx(1, "u", 5, 0), tx(2, None, 7, 10), tx(3, "u", 9, 0, timestamp=None), tx(4, "u", 3, 20)]
    add_file(spark, rows, folder("in"))
    add_file(spark, [tx(5, None, 8, 30)], folder("in"))
    source = stream(spark, folder("in"))
    if form == "state":
        jobs.run_to_end(spark, jobs.write_append(stream_features(source), "f", folder("out"), folder("cp"), True))
        got = spark.read.parquet(folder("out"))
    else:
        jobs.run_to_end(spark, write_features(source, folder("out"), folder("cp"), True))
        got = read_live(spark, folder("out/features"))
    found = {r.transaction_id: (r.avg_last_10, r.count_last_hour, r.hour_of_day) for r in got.collect()}
    assert found == {"1": (None, 1, 0), "2": (None, None, 0), "3": (None, None, None), "4": (5.0, 2, 0), "5": (None, None, 0)}


def test_all_aggregations_run_side_by_side(spark, folder):
    add_file(spark, skewed_rows(60), folder("in"))
    queries = jobs.process_transaction_stream(stream(spark, folder("in")), folder("out"), folder("cp"), console=True,
                                              available_now=True)
    jobs.await_all(queries)
    assert len(queries) == 4 and not any(q.exception() for q in queries)
    assert spark.read.text(folder("out/aggregations_five_minute")).count() > 0
    assert spark.read.option("header", "true").csv(folder("out/hourly")).count() > 0


def test_ingest_quarantines(spark, folder):
    lines = [{"id": "a", "amount": 5, "category": "FOOD"}, {"id": "a", "amount": 5}, {"id": "b", "amount": -1}, {"amount": 2}]
    spark.createDataFrame([(json.dumps(r),) for r in lines], "value string").write.text(folder("in"))
    raw = decode_json(read_stream(spark, "text", path=folder("in")))
    jobs.run_to_end(spark, jobs.ingest(raw, folder("out"), folder("cp"), available_now=True))
    ids = [r.transaction_id for r in spark.read.parquet(folder("out/transactions")).collect()]
    assert len(ids) == 2 and "a" in ids
    bad = spark.read.parquet(folder("out/quarantine")).collect()
    assert [(r.transaction_id, r.violations) for r in bad] == [("b", ["amount_positive"])]


def test_category_distribution_of_a_stream(spark, folder):
    add_file(spark, [tx(1, "u", 3, 0), tx(2, "u", 4, 10, category="BILLS"), tx(3, "u", 1, 400_000)], folder("in"))
    out = jobs.live_distribution(stream(spark, folder("in")))
    jobs.run_to_end(spark, jobs.write_append(out, "c", folder("out"), folder("cp"), True))
    r = spark.read.parquet(folder("out")).first()
    assert (r.FOOD_total, r.BILLS_count, r.OTHER_total) == (3.0, 1, None)


def test_windows_are_kept_outside_the_heap(spark, folder):
    """Also in a session whose store is the default."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        add_file(spark, [tx(1, "u", 3, 0)], folder("in"))
        jobs.run_to_end(spark, jobs.process_transactions(stream(spark, folder("in")), folder("out"), folder("cp"), available_now=True))
    finally:
        spark.conf.set(name, before)
    assert list(Path(folder("cp")).glob("transactions/state/0/*/*.changelog"))


def test_empty_batch_leaves_no_csv(spark, folder):
    sinks.write_csv(frame(spark, []), folder("csv"), 0)
    with pytest.raises(Exception):
        spark.read.csv(folder("csv"))


def test_connectors_pass_their_options(spark):
    from spendlens.sources import read_jdbc_transactions, read_kafka

    for call in (lambda: read_kafka(spark, "host:1", ["a", "b"], max_offsets_per_trigger=5),
                 lambda: read_jdbc_transactions(spark, "jdbc:none://x")):
        with pytest.raises(Exception, match="(?i)kafka|driver|avro"):
            call()


def test_subscriptions_change_between_batches(spark, folder):
    """A version that comes after the first batch counts from the second one on; the last change of a subscription holds."""
    def subscribe(rows, version):
        jobs.subscribe(spark.createDataFrame(rows, "user_id string, kind string, active boolean"), folder("s"), version)

    def run():
        source = stream(spark, folder("in"))
        jobs.run_to_end(spark, jobs.live_feed({"transactions": source, "system_alerts": source.filter("amount > 5")}, folder("s"),
                                              folder("out"), folder("cp"), True))
        rows = spark.read.parquet(folder("out")).collect()
        return sorted((r.subscriber, r.topic, json.loads(r.data)["transaction_id"]) for r in rows)

    subscribe([("a", "transactions", True), ("b", "system_alerts", True), ("c", "transactions", False)], 0)
    add_file(spark, [tx(1, "a", 1, 0), tx(2, "b", 9, 0), tx(3, "c", 9, 0)], folder("in"))
    first = [("a", "user_a_transactions", "1"), ("b", "system_alerts", "2"), ("b", "system_alerts", "3")]
    assert run() == first
    subscribe([("a", "transactions", False), ("c", "transactions", True), ("c", "transactions", True)], 1)
    subscribe([("a", "system_alerts", True)], 2)
    add_file(spark, [tx(4, "a", 7, 0), tx(5, "c", 1, 0)], folder("in"))
    assert run() == sorted(first + [("a", "system_alerts", "4"), ("b", "system_alerts", "4"), ("c", "user_c_transactions", "5")])


def test_a_broadcast_event_is_written_once(spark, folder):
    """Many subscribers hear it, and only those of the micro-batch it came with; nobody's events are not written."""
    def step(rows, events, version):
        jobs.subscribe(spark.createDataFrame(rows, "user_id string, kind string, active boolean"), folder("s"), version)
        add_file(spark, events, folder("in"))
        source = stream(spark, folder("in"))
        jobs.run_to_end(spark, jobs.live_topics({"transactions": source, "system_alerts": source.filter("amount > 5")},
                                                folder("s"), folder("out"), folder("cp"), True))
        events = jobs.topic_events(spark, folder("out"))
        every = jobs.heard(events, spark, folder("out")).collect()
        return events.count(), sorted((r.subscriber, r.topic, json.loads(r.data)["transaction_id"]) for r in every)

    fans = [(f"f{i:02d}", "system_alerts", True) for i in range(40)]
    written, first = step([("a", "transactions", True), *fans], [tx(1, "a", 1, 0), tx(2, "b", 9, 0), tx(3, None, 2, 0)], 0)
    assert written == 2
    assert first == [("a", "user_a_transactions", "1")] + [(f, "system_alerts", "2") for f, _, _ in fans]
    off = [(f, kind, False) for f, kind, _ in fans]
    written, both = step([("b", "transactions", True), ("b", "transactions", True), *off], [tx(4, "b", 9, 0), tx(5, "c", 9, 0)], 1)
    assert written == 3 and both == sorted(first + [("b", "user_b_transactions", "4")])
