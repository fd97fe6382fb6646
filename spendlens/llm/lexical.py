"""Ranked lexical search (operator 13): pair-bound MaxScore.

The index is a table of segments, each one row with the postings of a bounded number of documents. It is written in two
steps, because impacts need the corpus statistics: postings with document lengths, then impacts per posting with, for every
term, the largest impact in the segment, and for every pair of terms that the queries put together, the list of documents
that hold both, with the largest joint impact.

A query's terms are taken in pairs, the most frequent ones together. What a pair can add to a document is bounded by its
joint maximum where the document is in the pair's list, else by the larger of the two single maxima; both are at most the sum
of the single maxima that plain MaxScore adds up. Pairs whose bounds together stay below the k-th best score so far
cannot lift a document by themselves: their postings are not scanned, only looked up for documents that other terms brought
up and that the remaining bounds still allow, with the pair's list deciding which bound holds. A segment whose bounds stay
below the threshold is skipped. The threshold of a task carries over from segment to segment; nothing is lost, as it never
exceeds the true one.

Only terms of the queries are indexed. Queries are taken in blocks of about ``block_terms`` terms, each block with its own
index and its terms in the memory of driver and tasks. A segment holds at most ``SEGMENT_DOCS`` documents and, but for the
last document, ``SEGMENT_POSTINGS`` postings.

NULL, empty and blank texts have no terms: as documents they are not counted, as queries they find nothing. Texts of any
length are read whole. Each row is a document, and each row a query, also where ids repeat; documents without an id come
after others of equal score. Empty tables give an empty result. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.common import Workspace, columns, to_arrow
from spendlens.llm.resampling import byte_table, pieces

#: Term characters besides all beyond ASCII; A-Z are lower-cased (fixed value).
LETTERS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
SMALL = byte_table(LETTERS)
SEGMENT_DOCS, SEGMENT_POSTINGS = 1 << 14, 1 << 19
NO_ID = np.iinfo(np.int64).max


def term_counts(text: bytes | None, vocabulary: dict[bytes, int] | None = None) -> tuple[int, dict[bytes, int]]:
    """Number of terms of a text, and how often each term (of the vocabulary) occurs."""
    total, found = 0, Counter()
    for piece in pieces((text or b"").translate(SMALL)):
        terms = piece.split()
        total += len(terms)
        own = Counter(terms)
        if vocabulary is None:
            found.update(own)
        else:
            for term in own.keys() & vocabulary.keys():
                found[term] += own[term]
    return total, found


# Queries

def queries(items: DataFrame) -> DataFrame:
    """row (unique), item_id and the counted terms of each query that has any."""
    kind = items.schema["item_id"].dataType.simpleString()
    schema = f"row bigint, item_id {kind}, terms array<binary>, times array<bigint>"
    arrow = to_arrow(items.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                found = sorted(term_counts(text)[1].items())
                if found:
                    rows.append((row, item, [t for t, _ in found], [n for _, n in found]))
                row += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t.type) for k, t in enumerate(arrow)], schema=arrow)

    return columns(items, "item_id", "text").withColumn("text", F.col("text").cast("binary")).mapInArrow(run, schema)


# Index

POSTINGS = "doc_ids binary, lengths binary, terms binary, starts binary, positions binary, times binary, n_docs bigint, n_terms bigint"


def postings(documents: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Segments: the documents with a term of the vocabulary, and the postings ordered by term."""
    arrow = to_arrow(documents.sparkSession, POSTINGS)
    known = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {k: [] for k in ("id", "length", "term", "position", "times")}
        counted = [0, 0]

        def flush() -> pa.RecordBatch:
            term = np.array(held["term"], np.int32)
            order = np.argsort(term, kind="stable")
            terms, starts = np.unique(term[order], return_index=True)
            parts = [np.array(held["id"], np.int64), np.array(held["length"], np.int64), terms,
                     np.append(starts, len(term)).astype(np.int32), np.array(held["position"], np.int32)[order],
                     np.array(held["times"], np.int64)[order]]
            row = [[p.tobytes()] for p in parts] + [[c] for c in counted]
            for values in held.values():
                values.clear()
            counted[:] = 0, 0
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(row, arrow)], schema=arrow)

        for batch in batches:
            texts = batch.column("text")
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                length, found = term_counts(texts[i].as_py(), known.value)
                counted[0] += length > 0
                counted[1] += length
                if found:
                    held["position"].extend([len(held["id"])] * len(found))
                    held["id"].append(NO_ID if doc_id is None else doc_id)
                    held["length"].append(length)
                    held["term"].extend([known.value[t] for t in found])
                    held["times"].extend(found.values())
                    if len(held["id"]) >= SEGMENT_DOCS or len(held["term"]) >= SEGMENT_POSTINGS:
                        yield flush()
        if counted[0]:
            yield flush()

    return columns(documents, "doc_id", "text").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, POSTINGS)


def document_counts(segments: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term of a vocabulary of that size occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for terms, starts in zip(batch.column("terms"), batch.column("starts")):
                total[np.frombuffer(terms.as_buffer(), np.int32)] += np.diff(np.frombuffer(starts.as_buffer(), np.int32))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], ["term", "n"])

    total = np.zeros(size, np.int64)
    sent = segments.select("terms", "starts").mapInArrow(run, "term bigint, n bigint")
    for term, n in sent.groupBy("term").agg(F.sum("n")).collect():  # at most a row per term of the block
        total[term] = n
    return total


def term_weights(n_docs: int, counts: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how rare a term is, rounded down."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * c + 1))) for c in counts.tolist()], np.int64)


def length_factors(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """75 plus a quarter of each length over the mean length, in hundredths, rounded down."""
    return np.array([75 + 25 * n * n_docs // n_terms for n in lengths.tolist()], np.int64)


def pairs_of(terms: list[int], counts: np.ndarray) -> list[tuple[int, ...]]:
    """The terms of a query in pairs, from the most frequent ones on; an odd one stays alone. Terms in no document go."""
    order = sorted((t for t in terms if counts[t]), key=lambda t: (-counts[t], t))
    return [tuple(sorted(order[i:i + 2])) for i in range(0, len(order), 2)]


INDEX = "doc_ids binary, terms binary, starts binary, positions binary, impacts binary, tops binary, " \
        "pairs binary, pair_starts binary, pair_positions binary, pair_tops binary"


def impacts(segments: DataFrame, weights: np.ndarray, pairs: list[tuple[int, int]], n_docs: int, n_terms: int) -> DataFrame:
    """Segments with the impact of each posting, the largest one of each term, and the list and joint maximum of each pair."""
    arrow = to_arrow(segments.sparkSession, INDEX)
    shared = segments.sparkSession.sparkContext.broadcast((weights, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, pairs = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                lengths, times = np.frombuffer(row["lengths"], np.int64), np.frombuffer(row["times"], np.int64)
                terms, starts = np.frombuffer(row["terms"], np.int32), np.frombuffer(row["starts"], np.int32)
                positions = np.frombuffer(row["positions"], np.int32)
                factors = length_factors(lengths, n_docs, n_terms)
                impact = np.repeat(weights[terms], np.diff(starts)) * (1_000_000_000 * times // (1000 * times + 12 * factors[positions]))
                tops = np.maximum.reduceat(impact, starts[:-1]) if len(terms) else np.empty(0, np.int64)
                at = dict(zip(terms.tolist(), zip(starts[:-1].tolist(), starts[1:].tolist())))
                numbers, lists, joint = [], [], []
                for k, (a, b) in enumerate(pairs):
                    if a in at and b in at:
                        (a0, a1), (b0, b1) = at[a], at[b]
                        both, i, j = np.intersect1d(positions[a0:a1], positions[b0:b1], assume_unique=True, return_indices=True)
                        if len(both):
                            numbers.append(k)
                            lists.append(both)
                            joint.append((impact[a0:a1][i] + impact[b0:b1][j]).max())
                found = [row["doc_ids"], row["terms"], row["starts"], row["positions"], impact.tobytes(), tops.tobytes(),
                         np.array(numbers, np.int32).tobytes(), np.cumsum([0] + [len(x) for x in lists]).astype(np.int32).tobytes(),
                         (np.concatenate(lists) if lists else np.empty(0, np.int32)).tobytes(), np.array(joint, np.int64).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([c], t.type) for c, t in zip(found, arrow)], schema=arrow)

    return segments.mapInArrow(run, INDEX)


# Search

class Segment:
    """One row of the index, its lists by term and by pair."""

    def __init__(self, row: dict):
        names = ("doc_ids", "impacts", "tops", "pair_tops")
        part = {k: np.frombuffer(v, np.int64 if k in names else np.int32) for k, v in row.items()}
        self.doc_ids, self.size = part["doc_ids"], len(part["doc_ids"])
        s, p = part["starts"].tolist(), part["pair_starts"].tolist()
        self.lists = {t: (part["positions"][a:b], part["impacts"][a:b], top)
                      for t, a, b, top in zip(part["terms"].tolist(), s, s[1:], part["tops"].tolist())}
        self.pairs = {k: (part["pair_positions"][a:b], top)
                      for k, a, b, top in zip(part["pairs"].tolist(), p, p[1:], part["pair_tops"].tolist())}


class Unit:
    """A pair of a query's terms (or a single one) in a segment: its lists and what it can add to a document."""

    def __init__(self, segment: Segment, terms: tuple[int, ...], times: dict[int, int], pair: int | None):
        self.lists = [(*segment.lists[t], times[t]) for t in terms if t in segment.lists]
        tops = [top * n for _, _, top, n in self.lists]
        self.single, self.both, self.joint = max(tops, default=0), None, 0
        if len(tops) == 2 and pair in segment.pairs:
            self.both, top = segment.pairs[pair]
            least = min(n for *_, n in self.lists)
            self.joint = least * top + sum((n - least) * t for _, _, t, n in self.lists)
        self.bound = max(self.single, self.joint)

    def upper_bounds(self, docs: np.ndarray) -> np.ndarray | int:
        """The bound of each of the documents: the joint one only for those in the pair's list."""
        return self.single if self.both is None else np.where(member(self.both, docs)[1], self.bound, self.single)


def member(sorted_list: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``docs`` in a sorted list, and whether they are there."""
    at = np.minimum(np.searchsorted(sorted_list, docs), len(sorted_list) - 1)
    return at, sorted_list[at] == docs


class Best:
    """The k best documents so far, and how many postings were scanned and looked up for them."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.scanned, self.probed = k, np.empty(0, np.int64), np.empty(0, np.int64), 0, 0

    @property
    def threshold(self) -> int:
        """Lower scores are of no use; equal ones may be, by their ids."""
        return max(int(self.scores[-1]) if len(self.scores) == self.k else 0, 1)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[scores >= least], ids[scores >= least]
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[:self.k]
        self.scores, self.ids = scores[order], ids[order]


def search_segment(segment: Segment, units: list[Unit], best: Best) -> None:
    """Puts the documents of a segment that are among the best into ``best``."""
    units = sorted((u for u in units if u.bound), key=lambda u: u.bound)
    below = np.cumsum([0] + [u.bound for u in units]).tolist()  # below[i]: what the units before i can add
    if below[-1] < best.threshold:
        return
    first = max(i for i in range(len(units)) if below[i] < best.threshold)
    total = np.zeros(segment.size, np.int64)
    for unit in units[first:]:
        for positions, impact, _, n in unit.lists:
            total[positions] += impact * n
            best.scanned += len(positions)
    docs = np.flatnonzero((total > 0) & (total + below[first] >= best.threshold))
    scores = total[docs]
    for i in range(first - 1, -1, -1):
        if not len(docs):
            return
        allowed = scores + units[i].upper_bounds(docs) + below[i] >= best.threshold
        docs, scores = docs[allowed], scores[allowed]
        for positions, impact, _, n in units[i].lists:
            at, there = member(positions, docs)
            scores = scores + np.where(there, impact[at] * n, 0)
            best.probed += len(docs)
        allowed = scores + below[i] >= best.threshold
        docs, scores = docs[allowed], scores[allowed]
    best.add(scores, segment.doc_ids[docs])


HITS = "row bigint, doc_id bigint, score bigint"


def hits(index: DataFrame, wanted: list[tuple], k: int) -> DataFrame:
    """row (of the query), doc_id, score: the k best of each query among the segments of a task.

    ``wanted`` holds for each query its row, how often it has each term, and its units as (terms, number of the pair).
    """
    shared = index.sparkSession.sparkContext.broadcast(wanted)
    arrow = to_arrow(index.sparkSession, HITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in shared.value]
        for batch in batches:
            for i in range(batch.num_rows):
                segment = Segment(batch.slice(i, 1).to_pylist()[0])
                for (_, times, units), found in zip(shared.value, best):
                    search_segment(segment, [Unit(segment, terms, times, pair) for terms, pair in units], found)
        rows = np.repeat([row for row, *_ in shared.value], [len(b.scores) for b in best])
        ids, scores = np.concatenate([b.ids for b in best]), np.concatenate([b.scores for b in best])
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64(), mask=ids == NO_ID),
                                          pa.array(scores, pa.int64())], schema=arrow)

    return index.mapInArrow(run, HITS)


def search_block(work: Workspace, name: str, documents: DataFrame, block: list, k: int) -> DataFrame:
    """Hits of a block of queries (rows of ``queries``), at least the k best of each."""
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for q in block for t in q["terms"]}))}
    segments = work.stored(postings(documents, vocabulary), f"{name}-postings")
    n_docs, n_terms = segments.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    counts = document_counts(segments, len(vocabulary))
    asked = [(q["row"], dict(zip((vocabulary[bytes(t)] for t in q["terms"]), q["times"]))) for q in block]
    units = [pairs_of(list(times), counts) for _, times in asked]
    pairs = {p: i for i, p in enumerate(sorted({p for u in units for p in u if len(p) == 2}))}
    index = work.stored(impacts(segments, term_weights(n_docs, counts), list(pairs), n_docs, n_terms), f"{name}-index")
    work.drop(f"{name}-postings")
    wanted = [(row, times, [(p, pairs.get(p)) for p in u]) for (row, times), u in zip(asked, units)]
    found = work.stored(hits(index, wanted, k), f"{name}-hits", keep=True)
    work.drop(f"{name}-index")
    return found


def search(documents: DataFrame, items: DataFrame, k: int = 20, block_terms: int = 1 << 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best ``documents`` (doc_id, text) for each of ``items`` (item_id, text)."""
    spark = documents.sparkSession
    with Workspace(spark, "search") as work:
        asked = work.stored(queries(items), "queries", keep=True)
        terms = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
        blocks = -(-terms // block_terms)
        found = spark.createDataFrame([], HITS)
        for b in range(blocks):
            block = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).collect()
            if block:
                found = found.unionAll(search_block(work, f"block{b}", documents, block, k))
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k).join(asked.select("row", "item_id"), "row") \
        .select("item_id", "rank", "doc_id", "score")


#: The same by scoring every document for every item, in DuckDB's SQL.
SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS nr, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
asked AS (
  SELECT nr, item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS nr, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
corpus AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM texts),
tf AS (
  SELECT nr, doc_id, n, term, count(*) AS tf FROM (SELECT nr, doc_id, len(terms) AS n, unnest(terms) AS term FROM texts)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
impact AS (
  SELECT nr, doc_id, term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
    * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))) AS w
  FROM tf JOIN df USING (term) CROSS JOIN corpus),
scored AS (
  SELECT a.nr AS query, a.item_id, i.nr, i.doc_id, sum(w * times)::BIGINT AS score FROM asked a JOIN impact i USING (term) GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0)
SELECT item_id, place::INT AS rank, doc_id, score FROM ranked WHERE place <= 20"""
