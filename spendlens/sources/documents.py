"""Document sources: files by extension and seed tables, all as ``(doc_id, content, metadata)``."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spendlens.functions import columns as C

TEXT_EXTENSIONS = ("txt", "md", "html")


def metadata_map(**entries: Column) -> Column:
    return F.create_map(*[part for key, value in entries.items() for part in (F.lit(key), value)])


def as_corpus(df: DataFrame, content: Column, metadata: Column) -> DataFrame:
    """Content-addressed documents: the id is the hash of the text."""
    return df.select(F.sha2(content, 256).alias("doc_id"), content.alias("content"), metadata.alias("metadata"))


def _file_metadata(name: Column) -> Column:
    return metadata_map(source=name, type=F.lower(F.substring_index(name, ".", -1)),
                        category=C.document_category(name))


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """All txt, md and html files below ``path`` whole, csv files one document per line; other files are left out.

    Metadata: ``source`` = file name, ``type`` = extension, ``category`` by file name.
    """
    def files(pattern, reader):
        return reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")

    name = F.col("_metadata.file_name")
    frames = []
    for extension in TEXT_EXTENSIONS:
        df = files(f"*.{extension}", spark.read).text(path, wholetext=True).select("value", name.alias("name"))
        content = C.html_to_text("value") if extension == "html" else F.col("value")
        frames.append(as_corpus(df, content, _file_metadata(F.col("name"))))
    rows = files("*.csv", spark.read).text(path).select("value", name.alias("name"))
    rows = rows.filter(F.length(F.trim("value")) > 0)
    frames.append(as_corpus(rows, F.col("value"), _file_metadata(F.col("name"))))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def seed_documents(spark: SparkSession, rows: Iterable[tuple[str, Mapping[str, str]]]) -> DataFrame:
    """A hand-written set of ``(content, metadata)`` rows as a corpus."""
    df = spark.createDataFrame([(c, dict(m)) for c, m in rows], "content string, metadata map<string,string>")
    return as_corpus(df, F.col("content"), F.col("metadata"))


def union_corpora(*corpora: DataFrame) -> DataFrame:
    """Bag union of sources with different columns."""
    out = corpora[0]
    for corpus in corpora[1:]:
        out = out.unionByName(corpus, allowMissingColumns=True)
    return out
