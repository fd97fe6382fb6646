"""How far live queries are behind, as a table: one row per micro-batch and source, written by a listener of the engine.

``lag`` is the number of offsets that a source has beyond the ones read (for Kafka records, summed over partitions); NULL for
sources that do not say what they have, such as files. ``batch_seconds`` is what a micro-batch took, and ``behind_seconds`` how
far the watermark is behind the start of the micro-batch. The rules on lag (``metrics.high_lag``) run on this table.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

LAG = ("ts timestamp, topic string, consumer_group string, run string, batch_id long, input_rows long, batch_seconds double, "
       "behind_seconds double, lag long")


def offset_total(offset) -> int | None:
    """The sum of the numbers in a source's offset: a number, or JSON of any depth."""
    if isinstance(offset, str):
        try:
            offset = json.loads(offset)
        except ValueError:
            return None
    if isinstance(offset, Mapping):
        parts = [offset_total(v) for v in offset.values()]
        return None if not parts or None in parts else sum(parts)
    return offset if isinstance(offset, int) and not isinstance(offset, bool) else None


def lag_rows(progress: Mapping) -> list[dict]:
    """The rows of one progress report (its JSON)."""
    watermark = progress.get("eventTime", {}).get("watermark")
    out = []
    for source in progress.get("sources", []):
        latest, end = offset_total(source.get("latestOffset")), offset_total(source.get("endOffset"))
        out.append({
            "at": progress["timestamp"], "topic": source["description"], "consumer_group": progress.get("name") or progress["id"],
            "run": progress["runId"], "batch_id": progress["batchId"], "input_rows": source.get("numInputRows"),
            "batch_seconds": progress.get("batchDuration", 0) / 1000, "watermark": watermark,
            "lag": None if latest is None or end is None else max(latest - end, 0)})
    return out


class LagListener(StreamingQueryListener):
    """Writes the lag of all queries of a session to a folder, ``every`` reports at a time and at the end of a query.

    To be added with ``spark.streams.addListener``; ``flush`` writes what is left.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 20):
        self.spark, self.path, self.every, self.rows = spark, path, every, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows += lag_rows(json.loads(event.progress.json))
        if len(self.rows) >= self.every:
            self.flush()

    def onQueryTerminated(self, event) -> None:
        self.flush()

    def flush(self) -> None:
        rows, self.rows = self.rows, []
        if rows:
            raw = self.spark.createDataFrame(rows, "at string, topic string, consumer_group string, run string, batch_id long, "
                                                   "input_rows long, batch_seconds double, watermark string, lag long")
            at, mark = F.col("at").cast("timestamp"), F.col("watermark").cast("timestamp")
            behind = F.when(mark > F.lit("1970-01-01").cast("timestamp"), at.cast("double") - mark.cast("double"))
            raw.select(at.alias("ts"), "topic", "consumer_group", "run", "batch_id", "input_rows", "batch_seconds",
                       behind.alias("behind_seconds"), "lag").coalesce(1).write.mode("append").parquet(self.path)


def read_lag(spark: SparkSession, path: str) -> DataFrame:
    """The lag table; a report that was written again counts once."""
    return spark.read.schema(LAG).parquet(path).dropDuplicates(["run", "topic", "batch_id", "ts"])
