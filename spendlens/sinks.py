"""Writers. Those to files can be repeated for the same batch without leaving duplicates behind; a topic or a
database table gets the rows again, as their connectors deliver at least once."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from spendlens.functions.columns import as_json


# --- inserts --------------------------------------------------------------------------------------------

def first_per_id(df: DataFrame, key: str = "transaction_id", order_by: str = "timestamp") -> DataFrame:
    """One row per id, the earliest. The aggregate keeps one row per id in each map task, so many copies of a row
    cost one row per task in the shuffle."""
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), order_by).alias("_row")).select("_row.*")


def new_rows(incoming: DataFrame, existing: DataFrame, key: str = "transaction_id",
             order_by: str = "timestamp") -> DataFrame:
    """Insert with conflicts ignored: rows whose id is neither in the table nor twice in the batch."""
    return first_per_id(incoming, key, order_by).join(existing.select(key), key, "left_anti")


#: A Bloom filter has this many bits in each of its blocks, and takes this many bits per id, of which it sets ``HASHES``.
BLOCK_BITS, BITS_PER_ID, HASHES = 32_768, 32, 8
BUCKETS = 16


def append_new(incoming: DataFrame, path: str, batch_id: int, key: str = "transaction_id", buckets: int = BUCKETS) -> None:
    """Append the rows with unseen ids of a micro-batch to a parquet table of folders ``batch_id=N/bucket=B``.

    Every folder has a Bloom filter of its ids, below ``_filters``, so of the table only those buckets of earlier batches are
    read, and of them only the ids, that may hold an id of this batch: for new ids next to none. A repeated batch replaces
    its own folder and filter and does not count as existing. The number of buckets must not change for a table.
    """
    rows = first_per_id(incoming, key).withColumn("bucket", _bucket(key, buckets)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        taken = possibly_taken(rows, path, batch_id, key)
        unseen = rows if taken is None else rows.join(taken.select(key), key, "left_anti")
        folder = f"{path}/batch_id={batch_id}"
        unseen.write.mode("overwrite").partitionBy("bucket").parquet(folder)
        schema = unseen.schema
    finally:
        rows.unpersist()
    written = incoming.sparkSession.read.schema(schema).parquet(folder)
    id_filters(written, key).write.mode("overwrite").parquet(f"{path}/_filters/batch_id={batch_id}")


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _bits(key: str) -> Column:
    """Which bits of a block stand for an id."""
    a, b = F.xxhash64(F.lit(1), key), F.xxhash64(F.lit(2), key)
    return F.array(*[F.pmod(F.shiftright(a, 8) + i * F.shiftright(b, 8), F.lit(BLOCK_BITS)) for i in range(HASHES)])


def _block(key: str, level: Column) -> Column:
    """The block of an id in a filter of 2 ^ ``level`` blocks."""
    return F.pmod(F.xxhash64(F.lit(3), key), F.pow(F.lit(2.0), level).cast("long"))


def id_filters(rows: DataFrame, key: str) -> DataFrame:
    """Bloom filters of the ids of each bucket, a row per block; the blocks follow from the largest bucket."""
    sizes = rows.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0
    level = max(0, (max(1, -(-sizes * BITS_PER_ID // BLOCK_BITS)) - 1).bit_length())
    bits = rows.select("bucket", F.lit(level).alias("level"), _block(key, F.lit(level)).alias("block"), F.explode(_bits(key)).alias("bit"))
    return bits.groupBy("bucket", "level", "block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def possible_buckets(rows: DataFrame, path: str, before: int, key: str) -> list[tuple[int, int]]:
    """Batch and bucket of the earlier folders whose filters may hold an id of ``rows`` (with its ``bucket``)."""
    filters = read_before(rows.sparkSession, f"{path}/_filters", before)
    if filters is None:
        return []
    levels = [r["level"] for r in filters.select("level").distinct().collect()]  # one for each power of two of sizes
    if not levels:
        return []
    probes = rows.select("bucket", F.col(key), F.explode(F.array(*[F.lit(n) for n in levels])).alias("level")) \
        .select("bucket", "level", _block(key, F.col("level")).alias("block"), _bits(key).alias("probe"))

    def is_set(bit: Column) -> Column:
        byte = F.conv(F.hex(F.substr("bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
        return F.getbit(byte, (bit % 8).cast("int")) == 1

    met = probes.join(filters, ["bucket", "level", "block"]).where(F.forall("probe", is_set)).select("batch_id", "bucket").distinct()
    return sorted((r["batch_id"], r["bucket"]) for r in met.collect())  # at most the folders of the table


def possibly_taken(rows: DataFrame, path: str, before: int, key: str) -> DataFrame | None:
    """The stored ids in the folders that may hold an id of ``rows``, or None."""
    folders = possible_buckets(rows, path, before, key)
    if not folders:
        return None
    spark = rows.sparkSession
    return spark.read.schema(rows.select(key).schema).parquet(*[f"{path}/batch_id={b}/bucket={k}" for b, k in folders])


def read_before(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    """What earlier micro-batches have written, or None."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.parquet(path)
    except AnalysisException:  # nothing has been written yet
        return None
    return df.filter(F.col("batch_id") < before)


# --- upserts by version -----------------------------------------------------------------------------------

def write_version(batch: DataFrame, path: str, batch_id: int) -> None:
    """The rows of a micro-batch as one version of the table, below ``batch_id=N``.

    An update-mode stream sends a window again whenever it changes. Versions are only added, so nothing is read or
    rewritten here, and a repeated batch replaces its own folder.
    """
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def latest_version(versions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest row per key."""
    return _newest(versions, keys, [c for c in versions.columns if c not in (*keys, "batch_id", "date")])


#: Values of these types can be replaced in place, so an aggregate over them hashes its keys.
FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _newest(versions: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys and values of the row with the highest ``batch_id`` of each key.

    A whole row as one value, which other types need, makes the aggregate sort all rows by key, twice.
    """
    if values and all(isinstance(versions.schema[c].dataType, FIXED) for c in values):
        return versions.groupBy(*keys).agg(*[F.max_by(c, "batch_id").alias(c) for c in values])
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_row")).select(*keys, "_row.*")


def read_latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    return latest_version(spark.read.option("mergeSchema", "true").parquet(path), keys)


def compact(spark: SparkSession, path: str, keys: Sequence[str], target: str, upto: int,
            date_from: str = "window_start") -> None:
    """Write the newest rows of all versions up to ``upto`` as the first version of another table, by date.

    The rebalance hint gives files of even size: small dates share a task, a large date is split over several.
    """
    versions = spark.read.parquet(path).filter(F.col("batch_id") <= upto)
    newest = latest_version(versions, keys).withColumn("date", F.to_date(date_from))
    newest.hint("rebalance", "date").write.mode("overwrite").partitionBy("date").parquet(f"{target}/batch_id={upto}")


# --- upserts by date ----------------------------------------------------------------------------------------

def upsert(batch: DataFrame, path: str, batch_id: int, keys: Sequence[str], date_from: str = "window_start") -> None:
    """Replace rows of the same keys in a table of folders ``date=D/batch_id=N``, each the whole of its date.

    Only the dates of the micro-batch are read, merged and written again, as new folders; of each date the newest folder
    counts. The folder before it stays, for a repeated batch (which starts from it again and replaces its own) and for readers
    that still use it; older ones are deleted. So there are never more than two folders of a date.
    """
    spark = batch.sparkSession
    dated = batch.withColumn("date", F.to_date(date_from))
    sizes = _sizes(dated)
    dates = list(sizes)
    known = date_folders(spark, path)
    current = {d: max((n for n in known.get(d, []) if n < batch_id), default=None) for d in dates}
    merged = dated.withColumn("batch_id", F.lit(batch_id).cast("long"))
    if any(n is not None for n in current.values()):
        earlier = _read_dates(spark, path, {d: n for d, n in current.items() if n is not None})
        for d, n in _sizes(earlier).items():
            sizes[d] += n
        merged = merged.unionByName(earlier.withColumn("date", F.col("date").cast("date")).withColumn(
            "batch_id", F.col("batch_id").cast("long")), allowMissingColumns=True)
    values = [c for c in merged.columns if c not in (*keys, "date", "batch_id")]
    newest = _newest(_dealt(merged, sizes, keys), ["date", "_share", *keys], values).drop("_share")
    with shuffles_dropped(spark):
        newest.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite") \
            .option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch_id").parquet(path)
    for d in dates:
        for old in known.get(d, []):
            if old < batch_id and old != current[d]:
                _delete(spark, f"{path}/date={d}/batch_id={old}")


#: A date is written as one file for so many rows, or for more where the shuffle has few partitions.
ROWS_PER_FILE, FILES_PER_TASK = 10_000, 4


def _sizes(dated: DataFrame) -> dict[str, int]:
    """Rows of each date of a micro-batch."""
    return {str(r["date"]): r["count"] for r in dated.groupBy("date").count().collect()}


def _dealt(rows: DataFrame, sizes: Mapping[str, int], keys: Sequence[str]) -> DataFrame:
    """``rows`` by date and ``_share``, a part of the keys of a date; dates have shares by their ``sizes``.

    Rows of a key meet in one task, which holds a few shares, so one shuffle serves the aggregate and the files. A rebalance
    hint would need adaptive execution, which streams with state do without: then each task would write a file of every date.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per_file = max(ROWS_PER_FILE, sum(sizes.values()) / (FILES_PER_TASK * tasks))
    shares = F.lit(1)
    if sizes:
        counts = F.create_map(*[F.lit(x) for d, n in sizes.items() for x in (d, int(-(-n // per_file)))])
        shares = F.coalesce(F.try_element_at(counts, F.col("date").cast("string")), shares)
    return rows.withColumn("_share", F.pmod(F.xxhash64(*keys), shares).cast("int")).repartition("date", "_share")


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table that ``upsert`` has written."""
    newest = {d: max(numbers) for d, numbers in date_folders(spark, path).items()}
    return _read_dates(spark, path, newest).drop("date", "batch_id")


def date_folders(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """The batch numbers of the folders of each date."""
    store, root = _store(spark, path)
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/date=*/batch_id=*")
    found: dict[str, list[int]] = {}
    for status in (store.globStatus(pattern) or []) if store.exists(root) else []:
        folder = status.getPath()
        found.setdefault(folder.getParent().getName().removeprefix("date="), []).append(int(folder.getName().removeprefix("batch_id=")))
    return {d: sorted(numbers) for d, numbers in found.items()}


def _read_dates(spark: SparkSession, path: str, folders: Mapping[str, int]) -> DataFrame:
    return spark.read.option("basePath", path).option("mergeSchema", "true").parquet(
        *[f"{path}/date={d}/batch_id={n}" for d, n in sorted(folders.items())])


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files; otherwise they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _store(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _delete(spark: SparkSession, path: str) -> None:
    store, folder = _store(spark, path)
    store.delete(folder, True)


# --- topics, files, databases -------------------------------------------------------------------------------

def as_messages(df: DataFrame) -> DataFrame:
    """One JSON document per row in ``value``."""
    return df.select(as_json().alias("value"))


#: A compressed file is read by one task, so a file holds at most so many messages.
MESSAGES_PER_FILE = 1_000_000


def write_messages(df: DataFrame, topic: str, servers: str | None = None, path: str | None = None,
                   batch_id: int | None = None) -> None:
    """JSON messages to a Kafka topic, or below ``path`` as gzipped text where there is no broker."""
    messages = as_messages(df)
    if servers:
        messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
        return
    folder = f"{path}/{topic}" + ("" if batch_id is None else f"/batch_id={batch_id}")
    messages.write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", MESSAGES_PER_FILE).text(folder)


def write_csv(batch: DataFrame, path: str, batch_id: int) -> None:
    """A csv folder per batch, written by the executors; an empty batch leaves nothing."""
    spark, folder = batch.sparkSession, f"{path}/batch_id={batch_id}"
    batch.write.mode("overwrite").option("header", "true").csv(folder)
    # Looked up in what was written: asking the batch first would compute it, and its state, twice.
    if spark.read.text(folder).filter(F.col("value") != ",".join(batch.columns)).isEmpty():
        _delete(spark, folder)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", partitions: int = 16, **options) -> None:
    """Table append over at most ``partitions`` connections."""
    (df.write.format("jdbc").options(url=url, dbtable=table, numPartitions=str(partitions), **options)
     .mode(mode).save())


def add_documents(corpus: DataFrame, path: str) -> None:
    """Append the documents whose id, the hash of their text, is not in the corpus yet."""
    from pyspark.errors import AnalysisException

    rows = first_per_id(corpus, "doc_id", "content")
    try:
        rows = new_rows(rows, corpus.sparkSession.read.parquet(path), "doc_id", "content")
    except AnalysisException:  # the corpus starts with these documents
        pass
    rows.write.mode("append").parquet(path)
