"""Lempel-Ziv phrase fingerprints (operator 2).

A document is parsed into dictionary phrases: each phrase is the shortest run of characters that is not in the
dictionary yet, and enters it. The phrases are hashed, and the smallest hashes are the document's signature. Two texts
that would compress well together share many phrases, and the share is estimated from the two signatures.

The edited text of a document takes its ending from the next document in descending order of ``doc_id``. Documents are
dealt out by ranges of ``doc_id``, once; the first document of each range also goes to the end of the one before it, so no
task sees the whole order. An id (or the lack of one) with many rows has ranges of its own, by the hash of the text.

NULL texts count as empty. An empty text has an empty fingerprint, like another empty one (1.0) and unlike all others
(0.0). Rows without a ``doc_id`` come after all others; rows with one ``doc_id`` are ordered by the hash of their text, repeated rows
follow one another. A table of one document has that document as its own next one, an empty table gives an empty result.
Texts of any length are parsed whole. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import columns, to_arrow

SCHEMA = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
LOWEST = -(1 << 63)
#: Ranges of documents for each shuffle partition, so that hashing the ranges fills partitions evenly.
RANGES = 4


def parse(text: str, dictionary: set[str], phrase: str, found: list[str]) -> str:
    """Adds the new phrases of ``text`` to ``dictionary`` and ``found``; gives the unfinished one."""
    for c in text:
        phrase += c
        if phrase not in dictionary:
            dictionary.add(phrase)
            found.append(phrase)
            phrase = ""
    return phrase


def hashed(phrases: list[str]) -> np.ndarray:
    from xxhash import xxh32_intdigest

    return np.fromiter(map(xxh32_intdigest, phrases), np.uint32, len(phrases))


def smallest(hashes: np.ndarray, size: int) -> np.ndarray:
    return np.unique(hashes)[:size]


def likeness(a: np.ndarray, b: np.ndarray, size: int) -> float:
    """Share of common phrases among all phrases of two texts, from the smallest hashes of both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:size]
    return float(np.isin(both, a, True).astype(bool)[np.isin(both, b, True)].sum() / len(both))


def shown(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def signature(text: str, size: int = 128) -> np.ndarray:
    """The smallest phrase hashes of a text."""
    phrases: list[str] = []
    parse(text, set(), "", phrases)
    return smallest(hashed(phrases), size)


class Parsed:
    """A document with the state of its parse where an edit would begin."""

    def __init__(self, doc: int | None, text: str, size: int):
        self.doc, self.text, self.size = doc, text, size
        self.keep = len(text) - len(text) // 2
        seen: set[str] = set()
        self.head: list[str] = []
        self.phrase = parse(text[:self.keep], seen, "", self.head)
        tail: list[str] = []
        parse(text[self.keep:], seen, self.phrase, tail)
        self.hashes = hashed(self.head)
        self.signature = smallest(np.concatenate([self.hashes, hashed(tail)]), size)

    def row(self, after: Parsed) -> tuple:
        ending = after.text[:len(self.text) - self.keep]
        new: list[str] = []
        parse(ending, set(self.head), self.phrase, new)
        edited = smallest(np.concatenate([self.hashes, hashed(new)]), self.size)
        text = self.text[:self.keep] + ending
        return (self.doc, len(self.text), hashlib.sha256(text.encode()).hexdigest(), shown(self.signature), shown(edited),
                likeness(self.signature, edited, self.size), likeness(self.signature, after.signature, self.size))


class Ranges:
    """At most ``parts`` ranges of (key, order), numbered in that order, that rows of ``ids`` fill about evenly.

    A key that is several of the percentiles has as many ranges of its own, equal parts of all orders (64-bit hashes).
    """

    def __init__(self, ids: DataFrame, parts: int):
        shares = [k / parts for k in range(1, parts)]
        found = ids.agg(F.percentile_approx("key", shares, 10_000).alias("b")).first()["b"] if shares else None
        self.bounds, self.times = np.unique(np.array(found or [], np.int64), return_counts=True)
        self.stride = parts + 2
        numbered = F.pandas_udf(self.number, "bigint")
        heads = ids.groupBy(numbered("key", "order").alias("range")).agg(F.max(F.struct("key", "order")).alias("head")) \
            .orderBy("range").collect()  # at most a row per range
        self.used = np.array([h["range"] for h in heads], np.int64)
        self.heads = np.array([tuple(h["head"]) for h in heads], np.int64).reshape(-1, 2)

    def number(self, key: pd.Series, order: pd.Series) -> pd.Series:
        keys = key.to_numpy()
        at = np.searchsorted(self.bounds, keys, "left")
        inside = np.minimum(at, max(len(self.bounds) - 1, 0))
        times = np.where(self.bounds[inside] == keys, self.times[inside], 1) if len(self.bounds) else np.ones(len(keys), np.int64)
        share = ((order.to_numpy() >> 1) + (1 << 62)) / 2.0 ** 63
        own = np.minimum(np.floor(share * times), times - 1).astype(np.int64) + 1
        return pd.Series(at * self.stride + np.where(times > 1, own, 0))

    def places(self, key: pd.Series, order: pd.Series) -> pd.Series:
        """2 * range of a document, and 2 * range + 1 where it follows the last document of another range."""
        own = self.number(key, order).to_numpy()
        at = np.searchsorted(self.used, own)
        higher = self.used[(at + 1) % len(self.used)] if len(self.used) else own
        first = (key.to_numpy() == self.heads[at, 0]) & (order.to_numpy() == self.heads[at, 1]) if len(self.used) else own == own
        return pd.Series([[2 * o, 2 * h + 1] if f else [2 * o] for o, h, f in zip(own, higher, first)])


def fingerprints(documents: DataFrame, size: int = 128) -> DataFrame:
    """Fingerprints of each text and its edited text, and their likeness to each other and to the next document."""
    spark = documents.sparkSession
    docs = columns(documents, "doc_id", "text").select(
        "*", F.coalesce("doc_id", F.lit(LOWEST)).alias("key"), F.xxhash64("text").alias("order"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = F.pandas_udf(Ranges(docs.select("key", "order"), RANGES * partitions).places, "array<bigint>")
    dealt = docs.select("doc_id", "text", "key", "order", F.explode(places("key", "order")).alias("place")) \
        .withColumn("range", F.expr("place div 2")).repartition(partitions, "range") \
        .sortWithinPartitions("place", F.desc("key"), F.desc("order"), F.desc("text")).select("doc_id", "text", "place")
    schema = to_arrow(spark, SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []
        for batch in batches:
            for doc, text, place in zip(*(c.to_pylist() for c in batch.columns)):
                if place % 2 and last is None:
                    continue  # only the first of several rows that could follow
                one = Parsed(doc, text or "", size)
                if last is not None:
                    rows.append(last.row(one))
                last = None if place % 2 else one
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                rows = []

    return dealt.mapInArrow(run, SCHEMA)
