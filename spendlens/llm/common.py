"""What several corpus operators share: tables, words, shared storage, caches, clean column sets."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; words are the runs of all other characters.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further ones of any name cannot clash with what an operator adds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def words(text: Column) -> Column:
    """The words of a text; none for NULL, empty and blank texts."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, BLANK_RUN)).otherwise(F.array().cast("array<string>"))


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in one process the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Workspace:
    """Tables in the shared folder for the time of one job; on leaving, all but those named by ``keep`` are deleted."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.kept = spark, f"{work_dir(spark)}/llm-{name}-{uuid.uuid4().hex}", set()

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, failure: type | None, *_: object) -> None:
        kept = self.kept if failure is None else set()
        for name in [t for t in self.tables if t not in kept] if kept else [""]:
            self.drop(name)

    @property
    def tables(self) -> list[str]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        store = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in store.listStatus(folder)] if store.exists(folder) else []

    def stored(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        """``df`` written and read again; ``keep`` for what a lazy result still reads after the job."""
        df.write.parquet(f"{self.root}/{name}")
        if keep:
            self.kept.add(name)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def map_batches(df: DataFrame, make: Callable[[pa.RecordBatch], list | pa.RecordBatch], schema: str,
                rows: int | None = None) -> DataFrame:
    """``make`` turns each Arrow batch, in pieces of ``rows`` where these are given, into the columns of ``schema``, in order.

    Workers keep the memory of their largest piece, so pieces should be small where each row makes many values.
    """
    spark = df.sparkSession
    arrow = to_arrow(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = rows or max(1, batch.num_rows)
            for start in range(0, max(1, batch.num_rows), step):
                made = make(batch.slice(start, step))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(made, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def to_arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


class Memo(dict):
    """Results by key, computed on first use; emptied when it holds ``limit`` keys. Keys longer than ``longest`` are not
    remembered, so memory is bounded in bytes."""

    longest = 64

    def __init__(self, compute: Callable, limit: int = 400_000):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file, looked up where it is used (each executor has its own copy)."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


#: Letters, digits and blanks below U+0180, in the sense of the Unicode classes L, N and White_Space.
LATIN_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ſ"
LATIN_NUMBERS = "0-9²³¹¼-¾"
LATIN_BLANKS = "\t-\r \x85\xa0"
BEYOND_LATIN = re.compile("[^\x00-ſ]")
