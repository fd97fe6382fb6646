"""From raw documents to packed training sequences: five stages, each written as Parquet and read again for the next.

1. quality: documents that the learned rules or the base checks reject go.
2. language: documents without a recognisable language go.
3. near_duplicates: of each group of near-duplicates the document with the smallest id stays.
4. personal_data: personal data in the texts are replaced by their kind.
5. packing: the texts as pieces of token sequences.

All stages but the last return the columns of ``documents``. Empty tables pass through all stages; a NULL text has no
words, so the first stage rejects it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm import language, neardup, packing, pii, rules
from spendlens.llm.common import columns, stored, table, work_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least 20 words, few repeated ones, and no rule against them."""
    found = rules.judged(docs, rules.learn(docs, table(spark, sf_dir, "labels")), *COLUMNS)
    return found.where("kept").select(*COLUMNS)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; learned from the languages that the documents themselves name."""
    found = language.predict(docs, language.learn(docs), *COLUMNS)
    return found.where(F.col("lang_pred") != language.UNDETERMINED).select(*COLUMNS)


def first_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (80 % of the shingles or more), rows of equal id and text once.

    Of different texts under one id, one goes by that id and the others by ids of their own, above 2^62, for this stage. Of
    rows of equal id and text, the one with the smallest lang, source and n_chars stays. What goes is decided on ids and
    hashes, which are written once; texts are only shuffled where such rows, or a hash, leave it open, and once at the end, those that stay.
    """
    rows = columns(docs, *COLUMNS).withColumn("text_hash", F.xxhash64("text")).withColumn("row_key", F.xxhash64("doc_id", "text_hash"))
    own = F.xxhash64("doc_id", "text").bitwiseAND(F.lit(2 ** 62 - 1)).bitwiseOR(F.lit(2 ** 62))
    light = stored(rows.where("doc_id is not null").select("doc_id", "text_hash", "row_key", own.alias("own")), "light")
    several = stored(light.groupBy("doc_id").agg(F.min("text_hash").alias("low"), F.max("text_hash").alias("high"))
                     .where("low <> high").select("doc_id", "low"), "several")
    flagged = neardup.marked(rows, several, "doc_id")
    shared = flagged.where("_marked").join(several, "doc_id", "left").withColumn(
        "key", F.when(F.col("text_hash") != F.col("low"), own).otherwise(F.col("doc_id"))).drop("low")
    keyed = flagged.where("not _marked").withColumn("key", F.col("doc_id")).unionByName(shared.select(*rows.columns, "_marked", "key")) \
        .drop("_marked")
    found = neardup.near_duplicates(keyed.select(F.col("key").alias("doc_id"), "text"))
    removed = stored(found.where("not kept").select(F.col("doc_id").alias("key")).distinct(), "removed")
    copies = stored(light.groupBy("row_key").count().where("count > 1").select("row_key"), "copies")
    keys = light.join(several, "doc_id", "left").select(
        F.when(F.col("text_hash") != F.col("low"), F.col("own")).otherwise(F.col("doc_id")).alias("key"))
    left = neardup.marked(neardup.without(keyed, removed, "key", keys), copies, "row_key")
    once = left.where("_marked and doc_id is not null").groupBy("doc_id", "text_hash").agg(
        F.min(F.struct("lang", "source", "n_chars", "text")).alias("row")).select("doc_id", "row.*")
    kept = left.where("not _marked or doc_id is null").select(*COLUMNS).unionByName(once.select(*COLUMNS))
    return kept.hint("rebalance")  # one shuffle of what stays: later stages get tasks of even, moderate size


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data, and their new lengths."""
    return pii.masked_documents(docs, *COLUMNS).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the token sequences."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("language", known_language), ("near_duplicates", first_of_group),
          ("personal_data", masked), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, the result of each in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    root = f"{work_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{root}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The rules and the language model are learned, which SQL does not express; tests hold the stages against brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLE = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
