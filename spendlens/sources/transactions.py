"""Transaction sources: Kafka or file streams, wire decoding, training tables, JDBC."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from spendlens import domain
from spendlens.functions.columns import as_of_or_now
from spendlens.operators.normalize import with_defaults


def read_stream(spark: SparkSession, fmt: str, schema: T.StructType | None = None, path: str | None = None,
                **options) -> DataFrame:
    """Any streaming source by format name; every other option goes to the source as it is."""
    reader = spark.readStream.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path) if path else reader.load()


def read_kafka(spark: SparkSession, servers: str, topics: str | Sequence[str], starting_offsets: str = "latest",
               max_offsets_per_trigger: int | None = None, **options) -> DataFrame:
    """Kafka subscription. ``max_offsets_per_trigger`` bounds one micro-batch, which is the back-pressure knob
    of Structured Streaming."""
    conf = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topics if isinstance(topics, str) else ",".join(topics),
        "startingOffsets": starting_offsets,
        "failOnDataLoss": "false",
        **options,
    }
    if max_offsets_per_trigger:
        conf["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return read_stream(spark, "kafka", **conf)


def flatten(df: DataFrame, struct: str) -> DataFrame:
    """The fields of a struct column as top-level columns."""
    return df.select(f"{struct}.*")


def decode_json(df: DataFrame, schema: T.StructType = domain.WIRE_SCHEMA, keep_bad: bool = False) -> DataFrame:
    """``value`` -> columns. A record that is no JSON object gives NULL fields; ``keep_bad`` adds its text as
    ``bad_value`` so that it can be quarantined."""
    text = F.col("value").cast("string")
    if not keep_bad:
        return flatten(df.select(F.from_json(text, schema).alias("data")), "data")
    checked = T.StructType(schema.fields + [T.StructField("bad_value", T.StringType())])
    data = F.from_json(text, checked, {"columnNameOfCorruptRecord": "bad_value"})
    return flatten(df.select(data.alias("data")), "data")


def decode_avro(df: DataFrame, schema: str | None = None) -> DataFrame:
    """``value`` -> columns for Avro records; needs the spark-avro package on the classpath."""
    from pyspark.sql.avro.functions import from_avro

    return flatten(df.select(from_avro(F.col("value"), schema or domain.avro_schema()).alias("data")), "data")


def decode(df: DataFrame, value_format: str = "json", **options) -> DataFrame:
    """``value`` -> columns by the wire format of the topic, ``json`` or ``avro``."""
    decoders = {"json": decode_json, "avro": decode_avro}
    if value_format not in decoders:
        raise ValueError(f"value_format {value_format!r} is none of {sorted(decoders)}")
    return decoders[value_format](df, **options)


def ingest_json(df: DataFrame, as_of=None) -> DataFrame:
    """Consumer ingest: decode, then a default for every absent field."""
    return with_defaults(decode_json(df), as_of)


def read_training_data(spark: SparkSession, path: str, label: str = "is_fraud") -> DataFrame:
    """Labelled transactions; without a label column a FRAUD status is the label."""
    df = spark.read.parquet(path)
    if label not in df.columns:
        df = df.withColumn(label, (F.col("status") == "FRAUD").cast("int"))
    return df


def read_jdbc_transactions(spark: SparkSession, url: str, table: str = "transactions",
                           split: Mapping[str, object] | None = None, **options) -> DataFrame:
    """Relational scan. ``split`` = {partitionColumn, lowerBound, upperBound, numPartitions} reads in parallel;
    without it JDBC delivers the table through one task."""
    conf = {"url": url, "dbtable": table, **{k: str(v) for k, v in (split or {}).items()}, **options}
    return spark.read.format("jdbc").options(**conf).load()


# Topics that go to all users.
BROADCAST_TOPICS = ("market_updates", "system_alerts")


def user_feed(streams: Mapping[str, DataFrame], user_id: str | None = None, broadcast_topics=BROADCAST_TOPICS,
              as_of=None) -> DataFrame:
    """Union of topics wrapped as ``(type, data, topic, timestamp)``.

    ``streams`` maps a topic kind (``transactions``, ``alerts``, ``recommendations``) or a broadcast topic to its
    frame. Per-user kinds need a ``user_id`` column and appear under ``user_{id}_{kind}``; with ``user_id`` given
    only that user's rows and the broadcast topics are kept.
    """
    out = None
    for kind, frame in streams.items():
        if kind in broadcast_topics:
            topic = F.lit(kind)
        else:
            frame = frame if user_id is None else frame.filter(F.col("user_id") == user_id)
            topic = F.concat(F.lit("user_"), F.col("user_id"), F.lit(f"_{kind}"))
        part = frame.select(
            F.lit("event").alias("type"), F.to_json(F.struct("*")).alias("data"), topic.alias("topic"),
            as_of_or_now(as_of).alias("timestamp"),
        )
        out = part if out is None else out.unionByName(part)
    return out
