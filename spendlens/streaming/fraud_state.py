"""Fraud features on a stream, in two forms.

``write_features`` is exact in whatever order rows and files come: each micro-batch is united with the stored history
and featured like a batch, and rows that an older one changes are written again as a new version.

``stream_features`` sends every row once, when it arrives. The state of a user is ten amounts and at most 3,601
(second, count) pairs, whatever the traffic; an hour after the watermark has passed a user's last row the pairs are
dropped. The rows of a user in a micro-batch are put in time order as a whole; a row that is older than rows of an
earlier micro-batch is featured against the history known when it arrives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spendlens import domain, sinks
from spendlens.functions import columns as C
from spendlens.operators import fraud, timeline
from spendlens.streaming import jobs

HISTORY_ROWS = 10
HOUR = 3_600

STATE = T.StructType([
    T.StructField("amounts", T.ArrayType(T.DoubleType())),
    T.StructField("seconds", T.ArrayType(T.LongType())),
    T.StructField("counts", T.ArrayType(T.LongType())),
])

FEATURES = T.StructType(domain.TRANSACTION_SCHEMA.fields + [
    T.StructField("avg_last_10", T.DoubleType()),
    T.StructField("std_last_10", T.DoubleType()),
    T.StructField("count_last_hour", T.LongType()),
])


def _history(amounts: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample deviation of up to ten amounts before each of the last ``rows`` entries."""
    padded = np.concatenate([np.full(HISTORY_ROWS, np.nan), amounts])
    before = np.lib.stride_tricks.sliding_window_view(padded, HISTORY_ROWS)[len(amounts) - rows:len(amounts)]
    n = np.sum(~np.isnan(before), axis=1)
    total = np.nansum(before, axis=1)
    mean = np.divide(total, n, out=np.full(rows, np.nan), where=n > 0)
    squares = np.nansum((before - mean[:, None]) ** 2, axis=1)
    deviation = np.sqrt(np.divide(squares, n - 1, out=np.full(rows, np.nan), where=n > 1))
    return mean, deviation


def featured(rows: pd.DataFrame, amounts: list, seconds: list, counts: list):
    """Features of time-ordered rows and the state after them."""
    known = np.asarray(amounts, dtype=float)
    mean, deviation = _history(np.concatenate([known, rows["amount"].to_numpy(dtype=float)]), len(rows))
    sec = rows["timestamp"].astype("datetime64[us]").astype("int64").to_numpy() // 1_000_000
    own, own_counts = np.unique(sec, return_counts=True)
    times = np.concatenate([np.asarray(seconds, dtype="int64"), own])
    weights = np.concatenate([np.asarray(counts, dtype="int64"), own_counts])
    order = np.argsort(times, kind="stable")
    times, upto = times[order], np.concatenate([[0], np.cumsum(weights[order])])
    # Rows of the same second count for each other; later ones do not.
    in_hour = upto[np.searchsorted(times, sec, "right")] - upto[np.searchsorted(times, sec - HOUR, "left")]
    out = rows.assign(avg_last_10=mean, std_last_10=deviation, count_last_hour=in_hour)
    keep = times >= times[-1] - HOUR
    merged, places = np.unique(times[keep], return_inverse=True)
    sums = np.zeros(len(merged), dtype="int64")
    np.add.at(sums, places, weights[order][keep])
    tail = np.concatenate([known, rows["amount"].to_numpy(dtype=float)])[-HISTORY_ROWS:]
    return out, tail.tolist(), merged.tolist(), sums.tolist()


def _update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    amounts, seconds, counts = state.get if state.exists else ([], [], [])
    if state.hasTimedOut:
        state.update((list(amounts), [], []))
        return
    # Rows come in no order and in pieces of Arrow batch size, so nothing can be featured before the last piece.
    rows = pd.concat(list(batches), ignore_index=True).sort_values(["timestamp", "transaction_id"])
    if len(rows):
        out, amounts, seconds, counts = featured(rows, list(amounts), list(seconds), list(counts))
        yield out[[f.name for f in FEATURES.fields]]
    state.update((amounts, seconds, counts))
    if seconds:
        state.setTimeoutTimestamp(max(1000 * (seconds[-1] + HOUR + 1), state.getCurrentWatermarkMs() + 1))


def stream_features(tx: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Fraud features of a transaction stream (append mode), each row once; rows without a user or a time have no history
    and pass by the state."""
    rows = tx.select(*[f.name for f in domain.TRANSACTION_SCHEMA.fields])
    recent = timeline.placed(rows).withWatermark("timestamp", watermark).groupBy("user_id").applyInPandasWithState(
        _update, FEATURES, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    history = FEATURES.fields[len(domain.TRANSACTION_SCHEMA.fields):]
    others = rows.filter("user_id IS NULL OR timestamp IS NULL").withColumns(
        {f.name: F.lit(None).cast(f.dataType) for f in history})
    return recent.unionByName(others).withColumns(fraud.row_features())


def predict_streaming(tx: DataFrame, model: PipelineModel, only_fraud: bool = True, as_of=None,
                      watermark: str = "1 hour") -> DataFrame:
    """Frauds in a stream of transactions; the caller starts the query."""
    return fraud.score(stream_features(tx, watermark), model, only_fraud, as_of)


# --- exact in any order ---------------------------------------------------------------------------------

#: Which micro-batch a row came with, and its number there.
ROW_KEY = ["origin", "row_number"]


def _needed_history(earlier: DataFrame, batch: DataFrame) -> DataFrame:
    """Earlier rows that the features of a micro-batch need, and in ``_write`` whether their own may change.

    Of each user of the batch: what lies in the hour before their first new second or later, and the ten rows before that.
    """
    first = timeline.placed(batch).groupBy("user_id").agg(F.min(C.epoch_second()).alias("_first"))
    known = timeline.placed(earlier).join(first, "user_id")
    near: Column = C.epoch_second() >= F.col("_first") - HOUR
    newest = Window.partitionBy("user_id").orderBy(F.desc("timestamp"), F.desc("transaction_id"))
    before = known.filter(~near).withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= HISTORY_ROWS)
    needed = known.filter(near).unionByName(before.drop("_rank"))
    return needed.withColumn("_write", C.epoch_second() >= F.col("_first")).drop("_first")


def write_features(tx: DataFrame, path: str, checkpoint: str, available_now: bool = False,
                   model: PipelineModel | None = None, as_of=None) -> StreamingQuery:
    """Fraud features of a stream below ``path``, and with a model the scores, as versions per micro-batch.

    The newest version of a row (``read_live``) has the features of ``timeline.recent_history`` over all rows so far. No
    window holds a user's whole history; every micro-batch reads the stored transactions once.
    """
    names = [f.name for f in domain.TRANSACTION_SCHEMA.fields]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, history = batch.sparkSession, f"{path}/history"
        numbered = batch.select(*names, F.lit(batch_id).cast("long").alias("origin"),
                                F.monotonically_increasing_id().alias("row_number"))
        earlier = sinks.read_before(spark, history, batch_id)
        sinks.write_version(numbered, history, batch_id)
        rows = spark.read.schema(numbered.schema).parquet(f"{history}/batch_id={batch_id}")
        marked = rows.withColumn("_write", F.lit(True))
        if earlier is not None:
            marked = marked.unionByName(_needed_history(earlier.select(*rows.columns), rows))
        recent = timeline.recent_history(marked, HISTORY_ROWS).filter("_write").drop("_write")
        sinks.write_version(recent.withColumns(fraud.row_features()), f"{path}/features", batch_id)
        if model is not None:
            features = spark.read.parquet(f"{path}/features/batch_id={batch_id}")
            scores = fraud.score(features, model, False, as_of, ROW_KEY)
            sinks.write_version(scores, f"{path}/scores", batch_id)

    return jobs.foreach_batch(tx, write, "features", checkpoint, "append", available_now=available_now)


def read_live(spark: SparkSession, path: str, only_fraud: bool = False) -> DataFrame:
    """The newest version of the features or scores in a folder that ``write_features`` has written.

    A row's first version comes with its own micro-batch, so only later ones can replace another; rows are not sorted or
    aggregated to find theirs.
    """
    versions = spark.read.option("mergeSchema", "true").parquet(path)
    again = versions.filter("batch_id > origin").groupBy(*ROW_KEY).agg(F.max("batch_id").alias("_newest"))
    rows = versions.filter(F.col("prediction") == 1) if only_fraud else versions
    newest = rows.join(again, ROW_KEY, "left").filter("_newest IS NULL OR batch_id = _newest")
    return newest.drop(*ROW_KEY, "batch_id", "_newest")
