"""Target-distribution importance resampling (operator 12).

Documents that look like a target set are drawn more often: hashed n-gram features give each bucket the log ratio of its
shares in the target and in the corpus, a document weighs the mean gain of its features, and Gumbel noise turns the ranking
into a draw without replacement.

N-grams come from one overlapped scan: the separators of a text are collapsed to single spaces, and an overlapped regular
expression, tied to spaces on both sides, matches at every word the longest run of words wanted. Its span, and the begins
of the matches after it, are the spans of all n-grams that begin there; their CRC-32 is computed from the bytes in place,
for many spans at once. The scan runs once; the counts per document are kept in the shared folder (about two bytes for a
feature) and read for the totals, then for the weights. Memory holds one Arrow batch and ``PIECE`` spans.

The draw sorts ids and scores only, by ranges; no task sees all of them.

NULL, empty and blank texts have no feature, weight 0 and too few words to be drawn. Texts of any length are scanned whole.
Rows without a ``doc_id`` draw their noise from the empty id and come after others of equal score; repeated rows count and
compete each on its own. An empty target gives every bucket the gain against no occurrence; an empty corpus gives an empty
result. Further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import Workspace, columns, to_arrow

#: Word characters besides all beyond ASCII; A-Z are lower-cased (fixed value).
LETTERS = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that are scanned together, and most spans at a time.
GROUP, PIECE = 1 << 20, 1 << 20
LONG = 48


def byte_table(letters: bytes) -> bytes:
    """For ``bytes.translate``: A-Z to small letters, all other ASCII but ``letters`` to blanks."""
    lower = bytes(range(256)).lower()
    return bytes(c if c in letters or c > 127 else 32 for c in lower)


SMALL = byte_table(LETTERS)


def pieces(text: bytes, size: int = GROUP) -> Iterator[bytes]:
    """``text``, in which blanks stand between words, cut at blanks into parts of at least ``size`` bytes."""
    begin = 0
    while begin < len(text):
        end = text.find(b" ", begin + size)
        end = len(text) if end < 0 else end
        yield text[begin:end]
        begin = end


def collapsed(text: bytes | None) -> bytes:
    """The words of a text with a single space before, between and after them; a space where there is none."""
    words = [b" ".join(p.split()) for p in pieces((text or b"").translate(SMALL))]
    return b" ".join([b"", *[w for w in words if w], b""]) if any(words) else b" "


def crc_table() -> np.ndarray:
    """What a byte does to a CRC-32 (the polynomial of zlib)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


def extended(crc: np.ndarray, data: np.ndarray, raw: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``crc`` of bytes before ``begin`` carried on to ``end``, for all spans at once; long spans one by one."""
    table, out = crc_table(), crc.copy()
    size = end - begin
    for i in np.flatnonzero(size > LONG):
        out[i] = zlib.crc32(raw[begin[i]:end[i]], int(out[i]))
    short = np.flatnonzero(size <= LONG)
    order = short[np.argsort(-size[short], kind="stable")]
    left = np.searchsorted(-size[order], -np.arange(1, LONG + 1), side="right")  # spans that have a j-th byte
    c, at = ~out[order], begin[order]
    for j, n in enumerate(left):
        if not n:
            break
        c[:n] = table[(c[:n] ^ data[at[:n] + j]) & 0xFF] ^ c[:n] >> np.uint32(8)
    out[order] = ~c
    return out


def hashed_features(raw: bytes, ngrams: tuple[int, int], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Begins and buckets of the n-grams of collapsed texts, which line ends separate."""
    low, high = ngrams
    scan = regex.compile(rb" [^ \n]++(?: [^ \n]++){0,%d}(?= )" % (high - 1))
    data = np.frombuffer(raw, np.uint8)
    found = (m.span() for m in scan.finditer(raw, overlapped=True))
    ahead = np.empty((0, 2), np.int64)
    while True:
        spans = np.fromiter(chain.from_iterable(islice(found, PIECE)), np.int64).reshape(-1, 2)
        spans = np.concatenate([ahead, spans])
        last = len(spans) < PIECE
        whole = len(spans) if last else len(spans) - high  # the others wait for the matches after them
        begins, limit = spans[:, 0] + 1, spans[:whole, 1]
        crc, at = np.zeros(whole, np.uint32), begins[:whole]
        for n in range(1, high + 1):
            # An n-gram ends before the n-th match from here begins; the longest ends where its own match does.
            end = np.full(whole, np.iinfo(np.int64).max)
            following = begins[n:n + whole] - 1
            end[:len(following)] = following
            end = np.where(end < limit, end, limit)
            inside = end > at  # else fewer than n words are left
            crc[inside] = extended(crc[inside], data, raw, at[inside], end[inside])
            at = np.where(inside, end, at)
            if n >= low:
                yield begins[:whole][inside], crc[inside].astype(np.int64) % buckets
        if last:
            return
        ahead = spans[whole:]


def counted(batch: pa.RecordBatch, ngrams: tuple[int, int], buckets: int) -> Iterator[tuple]:
    """For each text of a batch: number of words, of features, distinct buckets, those found again, how often again."""
    texts = batch.column("text")
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    group: list[bytes] = []

    def flush() -> Iterator[tuple]:
        starts = np.cumsum([0] + [len(g) + 1 for g in group])
        totals = np.zeros(len(group), np.int64)
        keys, times = np.empty(0, np.int64), np.empty(0, np.int64)
        for begins, bucket in hashed_features(b"\n".join(group), ngrams, buckets):
            doc = np.searchsorted(starts, begins, side="right") - 1
            totals += np.bincount(doc, minlength=len(group))
            new, n = np.unique(doc * buckets + bucket, return_counts=True)
            if len(keys):
                new, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
                n = np.bincount(where, np.concatenate([times, n])).astype(np.int64)
            keys, times = new, n
        cuts = np.searchsorted(keys, np.arange(len(group) + 1) * buckets)
        for i, words in enumerate(group):
            own, n = keys[cuts[i]:cuts[i + 1]] - i * buckets, times[cuts[i]:cuts[i + 1]] - 1
            yield (max(words.count(b" ") - 1, 0), int(totals[i]), own.astype(kind).tobytes(), own[n > 0].astype(kind).tobytes(),
                   n[n > 0].astype(np.uint32).tobytes())
        group.clear()

    held = 0
    for i in range(len(texts)):
        group.append(collapsed(texts[i].as_py()))
        held += len(group[-1])
        if held >= GROUP:
            yield from flush()
            held = 0
    if group:
        yield from flush()


def features(documents: DataFrame, ngrams: tuple[int, int], buckets: int) -> DataFrame:
    """doc_id, row (unique), n_words, n_features and the counts of its buckets for each document."""
    schema = "doc_id bigint, row bigint, n_words bigint, n_features bigint, distinct binary, again binary, times binary"
    arrow = to_arrow(documents.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            found = list(zip(*counted(batch, ngrams, buckets)))
            if found:
                rows = pa.array(range(row, row + batch.num_rows), pa.int64())
                row += batch.num_rows
                parts = [pa.array(c, t.type) for c, t in zip(found, list(arrow)[2:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), rows, *parts], schema=arrow)

    return documents.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def slices(column: pa.Array, kind: type) -> list[np.ndarray]:
    """The values of a binary column as arrays."""
    return [np.frombuffer(v.as_buffer(), kind) for v in column]


def totals(counts: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs; every task sends a row per bucket that it met."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            distinct, again, times = batch.columns
            for column, weights in ((distinct, None), (again, times)):
                values = slices(column, kind)
                if values:
                    n = None if weights is None else np.concatenate(slices(weights, np.uint32))
                    total += np.bincount(np.concatenate(values), n, minlength=buckets).astype(np.int64)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], ["bucket", "n"])

    sent = counts.select("distinct", "again", "times").mapInArrow(run, "bucket bigint, n bigint")
    total = np.zeros(buckets, np.int64)
    for bucket, n in sent.groupBy("bucket").agg(F.sum("n")).collect():  # at most a row per bucket
        total[bucket] = n
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in target and corpus, rounded down."""
    in_corpus, in_target, buckets = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1) * (in_corpus + buckets) / ((s + 1) * (in_target + buckets))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Thousandths of Gumbel noise that follows from the id, rounded down."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(counts: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """doc_id, row, n_words, n_features, weight and score of each document."""
    kind = np.uint16 if len(gain) <= 1 << 16 else np.uint32
    schema = "doc_id bigint, row bigint, n_words bigint, n_features bigint, weight bigint, score bigint"
    arrow = to_arrow(counts.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = []
            for n, distinct, again, times in zip(batch.column("n_features").to_pylist(), *[
                    slices(batch.column(c), k) for c, k in (("distinct", kind), ("again", kind), ("times", np.uint32))]):
                weights.append((int(gain[distinct].sum()) + int(gain[again] @ times.astype(np.int64))) // n if n else 0)
            scores = [w + noise(d, seed) for w, d in zip(weights, batch.column("doc_id").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(weights, pa.int64()), pa.array(scores, pa.int64())],
                                             schema=arrow)

    return counts.mapInArrow(run, schema)


def resample(documents: DataFrame, target: DataFrame, percent: int = 25, ngrams: tuple[int, int] = (1, 2), buckets: int = 10_000,
             seed: int = 7, min_words: int = 20) -> DataFrame:
    """doc_id, n_features, weight, score of each document, and the rank of the ``percent`` % that are drawn.

    ``target`` has a column ``text``. Only documents of at least ``min_words`` words can be drawn.
    """
    spark = documents.sparkSession
    with Workspace(spark, "resampling") as work:
        counts = work.stored(features(columns(documents, "doc_id", "text"), ngrams, buckets), "features")
        aim = totals(features(target.select(F.lit(None).cast("bigint").alias("doc_id"), F.col("`text`").alias("text")), ngrams, buckets),
                     buckets)
        marked = scored(counts, gains(totals(counts, buckets), aim), seed).withColumn("may", F.col("n_words") >= min_words)
        # Ranges of (may, score, id): a row's place is the number of rows in earlier ranges and its place in its own.
        order = [F.desc("may"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
        placed = marked.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order) \
            .withColumn("place", F.monotonically_increasing_id())
        kept = work.stored(placed.drop("n_words", "row"), "placed", keep=True)
        sizes = kept.groupBy(F.shiftright("place", 33).alias("part")).agg(
            F.count(F.lit(1)).alias("n"), F.count_if("may").alias("able")).orderBy("part").collect()  # a row per range
    before = np.cumsum([0] + [r["n"] for r in sizes]).tolist()
    drawn = percent * sum(r["able"] for r in sizes) // 100
    offsets = spark.createDataFrame([(r["part"], b) for r, b in zip(sizes, before)], "part bigint, before bigint")
    numbered = kept.withColumn("part", F.shiftright("place", 33)).join(F.broadcast(offsets), "part")
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return numbered.select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))


#: The same in DuckDB's SQL, for the default settings; the CRC-32 of each distinct feature byte by byte.
SQL = r"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
    ORDER BY n) AS t FROM range(256) numbers(n)),
texts AS (
  SELECT TRUE AS corpus, row_number() OVER () AS nr, doc_id, text FROM documents
  UNION ALL SELECT FALSE, row_number() OVER (), NULL, text FROM benchmark),
w AS (
  SELECT corpus, nr, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
f AS (
  SELECT corpus, nr, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])))
    AS feature FROM w),
counted AS (SELECT corpus, nr, feature, count(*) AS n FROM f GROUP BY ALL),
bytes AS (
  SELECT feature, list_transform(range(1, octet_length(encode(feature)) + 1),
    lambda i: ('0x' || substr(hex(encode(feature)), 2 * i - 1, 2))::BIGINT) AS b FROM (SELECT DISTINCT feature FROM counted)),
hashed AS (
  SELECT feature, xor(list_reduce(list_prepend(4294967295::BIGINT, b),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM bytes, crc_table),
per_text AS (SELECT corpus, nr, bucket, sum(n) AS n FROM counted JOIN hashed USING (feature) GROUP BY ALL),
sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (corpus), 0) AS s, coalesce(sum(n) FILTER (NOT corpus), 0) AS t FROM per_text GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE)
    / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS g FROM sums),
total AS (SELECT nr, sum(n)::BIGINT AS n_features, sum(g * n)::BIGINT AS g FROM per_text JOIN gain USING (bucket) WHERE corpus GROUP BY nr),
weighed AS (
  SELECT nr, doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features,
         coalesce(floor(g::DOUBLE / n_features), 0)::BIGINT AS weight,
         ('0x' || left(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT AS h
  FROM w LEFT JOIN total USING (nr) WHERE corpus),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
         count(*) FILTER (n_words >= 20) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * able // 100 THEN place END AS rank FROM placed"""
