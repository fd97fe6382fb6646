"""Streaming queries: windowed aggregates, sessions, deduplication, ingest, and their sinks.

Every query has its own checkpoint folder. Triggers default to the live intervals; ``available_now`` drains the
source and stops, which the tests and the registered queries use.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from spendlens import sinks
from spendlens.operators import aggregates as A, alerts, normalize as N
from spendlens.session import use_rocksdb
from spendlens.sources.transactions import BROADCAST_TOPICS, user_feed

# Trigger intervals of the live queries.
INTERVALS = {"aggregates": "1 minute", "hourly": "5 minutes", "console": "30 seconds"}
SPEND_KEYS = ["window_start", "window_end", "user_id", "category"]


def _triggered(writer: DataStreamWriter, interval: str, available_now: bool) -> DataStreamWriter:
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)


def _writer(df: DataFrame, name: str, checkpoint: str, mode: str, interval: str,
            available_now: bool) -> DataStreamWriter:
    writer = df.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", f"{checkpoint}/{name}")
    return _triggered(writer, interval, available_now)


def foreach_batch(df: DataFrame, write: Callable[[DataFrame, int], None], name: str, checkpoint: str,
                  mode: str = "update", interval: str = INTERVALS["aggregates"],
                  available_now: bool = False) -> StreamingQuery:
    return _writer(df, name, checkpoint, mode, interval, available_now).foreachBatch(write).start()


# --- transformations that only make sense on streams ----------------------------------------------------

def live_spend(tx: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Sliding spend per user and category with its velocity."""
    return A.spending_velocity(A.sliding_spend(tx, watermark=watermark))


def live_sessions(tx: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """Sessions as they close (append mode).

    Windows open at whole seconds, so a pause of exactly the gap continues the session. The session ends with its
    last transaction, not with the end of the window.
    """
    whole = tx.withColumn("second", F.date_trunc("second", "timestamp")).withWatermark("second", watermark)
    session = F.session_window("second", gap)
    return whole.groupBy(session.alias("window"), "user_id").agg(
        F.count("*").alias("session_transaction_count"), F.sum("amount").alias("session_total_amount"),
        F.min("timestamp").alias("session_start"), F.max("timestamp").alias("session_end")).drop("window")


def live_distinct(tx: DataFrame, key: str = "transaction_id", watermark: str = "10 minutes") -> DataFrame:
    """The first arrival of every id; state is dropped once the watermark has passed."""
    return tx.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark([key])


def live_distribution(tx: DataFrame, duration: str = "1 day", watermark: str = "2 hours") -> DataFrame:
    """Category totals per user and window as conditional sums, because a stream cannot be pivoted."""
    return A.split_window(
        tx.withWatermark("timestamp", watermark).groupBy(F.window("timestamp", duration), "user_id")
        .agg(*A._distribution(A.domain.CATEGORIES)))


# --- sinks --------------------------------------------------------------------------------------------

def fan_out(path: str, velocity_threshold: float = 1000, servers: str | None = None,
            as_of=None) -> Callable[[DataFrame, int], None]:
    """Micro-batch writer: upserted table, aggregate topic and alert topic, from one computation of the batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        computed = batch._jdf.queryExecution().toRdd()
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            batch.count()
            # The rows are kept now, so the shuffle they came from may go; if a part is lost, Spark computes it again.
            computed.cleanShuffleDependencies(True)
            sinks.upsert(batch, f"{path}/user_spending_aggregates", batch_id, SPEND_KEYS)
            sinks.write_messages(batch, "user_aggregations", servers, path, batch_id)
            found = alerts.high_velocity_alerts(batch, velocity_threshold, as_of, ["window_start", "category"])
            if not found.isEmpty():
                sinks.write_messages(found, "alerts", servers, path, batch_id)
        finally:
            batch.unpersist()

    return write


def process_transactions(tx: DataFrame, path: str, checkpoint: str, velocity_threshold: float = 1000,
                         servers: str | None = None, available_now: bool = False, as_of=None,
                         watermark: str = "10 minutes") -> StreamingQuery:
    """Live spend into all sinks, in update mode."""
    use_rocksdb(tx.sparkSession)  # a row of state per window, user and category may outgrow the heap
    return foreach_batch(live_spend(tx, watermark), fan_out(path, velocity_threshold, servers, as_of), "transactions", checkpoint,
                         available_now=available_now)


def write_topic(df: DataFrame, name: str, checkpoint: str, servers: str | None = None, path: str | None = None,
                available_now: bool = False) -> StreamingQuery:
    """Changed aggregates as JSON to ``aggregations_{name}``: Kafka, or text below ``path``."""
    topic = f"aggregations_{name}"
    if servers:
        writer = _writer(sinks.as_messages(df), topic, checkpoint, "update", INTERVALS["aggregates"], available_now)
        return writer.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).start()
    return foreach_batch(df, lambda batch, i: sinks.write_messages(batch, topic, path=path, batch_id=i), topic,
                         checkpoint, available_now=available_now)


def write_console(df: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    writer = _writer(df, "console", checkpoint, "update", INTERVALS["console"], available_now)
    return writer.format("console").option("truncate", False).start()


def write_aggregations(aggregations: Mapping[str, DataFrame], path: str, checkpoint: str, servers: str | None = None,
                       console: bool = False, available_now: bool = False) -> list[StreamingQuery]:
    """One query per aggregation: hourly figures as csv, the short windows as topics."""
    queries = []
    for name, df in aggregations.items():
        use_rocksdb(df.sparkSession)
        if name == "hourly":
            queries.append(foreach_batch(
                df, lambda batch, i: sinks.write_csv(batch, f"{path}/hourly", i), "hourly", checkpoint,
                interval=INTERVALS["hourly"], available_now=available_now))
        else:
            queries.append(write_topic(df, name, checkpoint, servers, path, available_now))
    if console:
        queries.append(write_console(aggregations["one_minute"], checkpoint, available_now))
    return queries


def process_transaction_stream(tx: DataFrame, path: str, checkpoint: str, servers: str | None = None,
                               console: bool = False, available_now: bool = False,
                               late: Mapping[str, str] | None = None) -> list[StreamingQuery]:
    """All live aggregations of one stream; ``late`` replaces the allowed lateness by name."""
    return write_aggregations(A.stream_aggregates(tx, late), path, checkpoint, servers, console, available_now)


def ingest(raw: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Consumer: decoded records, defaults, validation, insert of unseen ids; rejected rows go to ``quarantine``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        checked = N.validate(N.with_defaults(batch)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            sinks.append_new(checked.filter("is_valid").drop("violations", "is_valid", "bad_value"), f"{path}/transactions",
                             batch_id)
            rejected = checked.filter("NOT is_valid").drop("is_valid")  # with the text of broken records
            rejected.write.mode("overwrite").parquet(f"{path}/quarantine/batch_id={batch_id}")
        finally:
            checked.unpersist()

    return foreach_batch(raw, write, "ingest", checkpoint, mode="append", available_now=available_now)


def live_feed(streams: Mapping[str, DataFrame], subscriptions: str, path: str, checkpoint: str, available_now: bool = False,
              as_of=None) -> StreamingQuery:
    """The events of several streams for those who subscribe to them, as one query.

    ``streams`` maps a kind to its stream, as for ``sources.user_feed``. ``subscriptions`` is a folder that ``subscribe`` writes;
    every micro-batch is joined with its newest version, so a change counts from the next batch on. Subscribers of a kind
    get the events of their own user; subscribers of a broadcast topic get all of its events. Events go out when they
    arrive, in no order between streams, and late ones as well: nothing waits, so there is no watermark.
    """
    feed = user_feed(streams, as_of=as_of)

    def write(batch: DataFrame, batch_id: int) -> None:
        heard = _audience(batch.sparkSession, subscriptions)
        batch.join(heard, "topic").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return foreach_batch(feed, write, "feed", checkpoint, "append", available_now=available_now)


def _audience(spark: SparkSession, subscriptions: str) -> DataFrame:
    """Who hears which topic at present."""
    topic = F.when(F.col("kind").isin(*BROADCAST_TOPICS), F.col("kind")).otherwise(
        F.concat(F.lit("user_"), F.col("user_id"), F.lit("_"), F.col("kind")))
    wanted = current_subscriptions(spark, subscriptions)
    return wanted.select(F.col("user_id").alias("subscriber"), topic.alias("topic")).distinct()


def live_topics(streams: Mapping[str, DataFrame], subscriptions: str, path: str, checkpoint: str, available_now: bool = False,
                as_of=None) -> StreamingQuery:
    """``live_feed`` with each event written once, however many hear it.

    A broadcast event has as many copies in ``live_feed`` as it has subscribers, so copies grow with events times users.
    Here ``events`` holds the events of the topics that anyone hears, and ``audience`` who heard which topic in the micro-batch;
    ``heard`` brings them together, after the events have been reduced where that will do.
    """
    feed = user_feed(streams, as_of=as_of)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _audience(spark, subscriptions).write.mode("overwrite").parquet(f"{path}/audience/batch_id={batch_id}")
        topics = spark.read.schema("subscriber string, topic string").parquet(
            f"{path}/audience/batch_id={batch_id}").select("topic").distinct()
        to_all = F.col("topic").isin(*BROADCAST_TOPICS)
        wanted = [r["topic"] for r in topics.filter(to_all).collect()]  # at most the fixed ones
        own = batch.filter(~to_all).join(topics, "topic", "left_semi").select(*batch.columns)
        events = own.unionByName(batch.filter(F.col("topic").isin(wanted))) if wanted else own
        events.write.mode("overwrite").parquet(f"{path}/events/batch_id={batch_id}")

    return foreach_batch(feed, write, "feed", checkpoint, "append", available_now=available_now)


def topic_events(spark: SparkSession, path: str) -> DataFrame:
    """The events that ``live_topics`` has written, with their ``batch_id``; each once."""
    return spark.read.schema("type string, data string, topic string, timestamp timestamp, batch_id int").parquet(f"{path}/events")


def heard(figures: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Events of ``topic_events``, or figures of them by ``batch_id`` and ``topic``, for everyone who heard the topic then."""
    audience = spark.read.schema("subscriber string, topic string, batch_id int").parquet(f"{path}/audience")
    return audience.join(figures, ["batch_id", "topic"])


def subscribe(changes: DataFrame, path: str, version: int) -> None:
    """Changes of subscriptions (user_id, kind, active) as a further version; a repeated version replaces itself."""
    changes.select("user_id", "kind", "active").write.mode("overwrite").parquet(f"{path}/version={version}")


def current_subscriptions(spark: SparkSession, path: str) -> DataFrame:
    """user_id and kind of what is subscribed after the newest change of each."""
    changes = spark.read.schema("user_id string, kind string, active boolean, version int").parquet(path)
    return changes.groupBy("user_id", "kind").agg(F.max_by("active", "version").alias("active")).filter("active").drop("active")


def write_append(df: DataFrame, name: str, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Final rows of an append-mode query to parquet."""
    writer = _writer(df, name, checkpoint, "append", INTERVALS["aggregates"], available_now)
    return writer.format("parquet").option("path", path).start()


def await_all(queries: list[StreamingQuery]) -> None:
    for query in queries:
        query.awaitTermination()


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark in the recent micro-batches."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0))
               for progress in query.recentProgress for op in progress["stateOperators"])


def run_to_end(spark: SparkSession, query: StreamingQuery) -> StreamingQuery:
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return query
