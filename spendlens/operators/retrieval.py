"""Document chunks and exact vector search."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spendlens import domain
from spendlens.functions import columns as C
from spendlens.functions import text as X

# About how many queries a block has. A task holds one block at a time; the corpus is shuffled once per block.
QUERIES_PER_BLOCK = 10_000


# --- chunks and collections -----------------------------------------------------------------------------

def chunk_documents(corpus: DataFrame, size: int = X.CHUNK_SIZE, overlap: int = X.CHUNK_OVERLAP) -> DataFrame:
    """``(doc_id, chunk_no, chunk)`` with the other columns of the document."""
    others = [c for c in corpus.columns if c not in ("doc_id", "content")]
    chunks = corpus.withColumn("_chunks", X.chunks_of(F.col("content"), size, overlap))
    return chunks.select("doc_id", F.posexplode("_chunks").alias("chunk_no", "chunk"), *others)


def upsert(collection: DataFrame, incoming: DataFrame, key: str = "vec_id", order_by: str | None = None) -> DataFrame:
    """The collection with incoming rows replacing those of the same key; within ``incoming`` the row that is last
    by ``order_by`` wins (any of them without it)."""
    if order_by:
        row = F.max_by(F.struct(*incoming.columns), order_by)
        newest = incoming.groupBy(key).agg(row.alias("_row")).select("_row.*")
    else:
        newest = incoming.dropDuplicates([key])
    kept = collection.join(newest.select(key), key, "left_anti")
    return kept.select(*collection.columns).unionByName(newest.select(*collection.columns))


def delete_points(collection: DataFrame, ids: DataFrame, key: str = "vec_id") -> DataFrame:
    return collection.join(ids.select(key), key, "left_anti")


def clear(collection: DataFrame) -> DataFrame:
    return collection.limit(0)


def collection_info(collection: DataFrame, vector: str = "embedding", category: str = "category") -> DataFrame:
    """Points and largest dimension per category."""
    return collection.groupBy(category).agg(
        F.count("*").alias("points_count"), F.max(F.size(vector)).alias("vector_size"))


def save_document(content: str, metadata: Mapping[str, str], spark) -> DataFrame:
    """One new document as a corpus row."""
    from spendlens.sources.documents import seed_documents

    return seed_documents(spark, [(content, metadata)])


# --- search -------------------------------------------------------------------------------------------

def sizes(vectors: pa.Array) -> np.ndarray:
    """Number of elements of each vector, -1 for NULL."""
    return pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """Vectors of one size as the rows of a matrix, divided by their lengths; a vector without a length stays zero."""
    matrix = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def _hits(ids: np.ndarray, corpus: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int | None,
          threshold: float) -> Iterator[pd.DataFrame]:
    """Hits among the given rows for 200 queries at a time, the best ``k`` of every query or all.

    Scores are rounded to 12 digits, so that equal vectors have equal scores wherever they stand in a matrix.
    """
    for start in range(0, len(query_ids), 200):
        scores = (corpus @ queries[start:start + 200].T).round(12)
        rows, cols = np.nonzero(scores >= threshold)
        hits = pd.DataFrame({"query_id": query_ids[start:start + 200][cols], "hit_id": ids[rows],
                             "score": scores[rows, cols]})
        yield hits if k is None else _best(hits, k)


def _best(hits: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best ``k`` of every query; ties go to the smaller id."""
    ranked = hits.sort_values(["query_id", "score", "hit_id"], ascending=[True, False, True])
    return ranked.groupby("query_id", sort=False).head(k)


def matches(batches: Iterator[pa.RecordBatch], schema: pa.Schema, k: int | None,
             threshold: float) -> Iterator[pa.RecordBatch]:
    """Hits of pairs of a query block and a corpus part, which come one after the other, for each size of vectors the queries first.

    The queries of one block are held, of the corpus an Arrow batch; hits go on in pieces, or with ``k`` at the end of the
    pair.
    """
    at = query_ids = queries = best = None
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def written(hits: pd.DataFrame) -> pa.RecordBatch:
        return pa.RecordBatch.from_pandas(hits, schema, preserve_index=False)

    for batch in batches:
        kinds = np.stack([batch.column(name).to_numpy() for name in ("_part", "_block", "_dims", "_kind")], axis=1)
        starts = [0, *(np.flatnonzero((kinds[1:] != kinds[:-1]).any(axis=1)) + 1)] if len(kinds) else []
        for start, end in zip(starts, [*starts[1:], len(kinds)]):
            rows, pair = batch.slice(start, end - start), tuple(kinds[start, :3])
            if pair != at:
                if best is not None:
                    yield written(best)
                at, query_ids, queries, best, waiting = pair, None, None, None, []
            vectors = unit_rows(rows.column("_vector"))
            if kinds[start, 3] == 0:
                waiting.append((rows.column("_query").to_numpy(zero_copy_only=False), vectors))
                continue
            if waiting:
                query_ids, queries = (np.concatenate(parts) for parts in zip(*waiting))
                waiting = []
            if queries is None:
                continue
            found = _hits(rows.column("_point").to_numpy(zero_copy_only=False), vectors, query_ids, queries, k, threshold)
            if k is None:
                yield from map(written, found)
            else:
                best = _best(pd.concat([*([] if best is None else [best]), *found]), k)
    if best is not None:
        yield written(best)


def similar(corpus: DataFrame, queries: DataFrame, threshold: float, criteria: Mapping[str, object] | None = None,
            key: str = "vec_id", vector: str = "embedding", query_blocks: int | None = None,
            k: int | None = None) -> DataFrame:
    """Every pair ``(query_id, hit_id, score)`` with a cosine similarity of ``threshold`` or more.

    ``queries`` has ``query_id`` and the vector column. Metadata ``criteria`` filter the corpus before any vector is
    touched. Blocks of queries meet parts of the corpus, which multiplies the two matrices a piece at a time. The queries
    are counted first for as many blocks as ``QUERIES_PER_BLOCK`` asks for, unless ``query_blocks`` says how many. With
    ``k``, a pair of block and part passes on the best ``k`` per query only. Rows without a vector have no similarity, nor
    have vectors with different numbers of elements.
    """
    if criteria:
        corpus = corpus.filter(C.payload_matches(criteria))
    if query_blocks is None:
        query_blocks = max(1, -(-queries.count() // QUERIES_PER_BLOCK))
    parts = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    types = {"query_id": queries.schema["query_id"].dataType, "hit_id": corpus.schema[key].dataType}
    schema = T.StructType([*[T.StructField(name, kind) for name, kind in types.items()], T.StructField("score", T.DoubleType())])
    same = corpus.schema[vector].dataType.simpleString() == queries.schema[vector].dataType.simpleString()

    def dealt(df, kind, column, own, other, n_own, n_other):
        ids = {"_query": types["query_id"], "_point": types["hit_id"]}
        filled = [(F.col(column) if name == kind else F.lit(None)).cast(t).alias(name) for name, t in ids.items()]
        df = df.filter(F.col(vector).isNotNull()).select(
            *filled, (F.col(vector) if same else F.col(vector).cast("array<double>")).alias("_vector"),
            F.pmod(F.xxhash64(column), F.lit(n_own)).cast("int").alias(own), F.lit(int(kind == "_point")).alias("_kind"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    left = dealt(corpus, "_point", key, "_part", "_block", parts, query_blocks)
    right = dealt(queries, "_query", "query_id", "_block", "_part", query_blocks, parts)
    arrow = to_arrow_schema(schema)
    # A task for every pair: hashing the pairs would leave tasks empty and give others several.
    pairs = left.unionByName(right).withColumn("_dims", F.size("_vector")) \
        .repartitionById(parts * query_blocks, F.col("_part") * query_blocks + F.col("_block")) \
        .sortWithinPartitions("_part", "_block", "_dims", "_kind")
    return pairs.mapInArrow(lambda batches: matches(batches, arrow, k, threshold), schema)


def search(corpus: DataFrame, queries: DataFrame, k: int = 5, threshold: float = 0.7,
           criteria: Mapping[str, object] | None = None, key: str = "vec_id", vector: str = "embedding",
           query_blocks: int | None = None) -> DataFrame:
    """Exact top ``k`` by cosine similarity per query: ``(query_id, hit_id, score, position)``.

    Of each pair of a query block and a corpus part, k hits per query are left to be ranked.
    """
    hits = similar(corpus, queries, threshold, criteria, key, vector, query_blocks, k)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "hit_id")
    return hits.withColumn("position", F.row_number().over(best)).filter(F.col("position") <= k)


def with_payload(hits: DataFrame, corpus: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Hits with the columns of the document they point to."""
    payload = corpus.drop(vector).withColumnRenamed(key, "hit_id")
    return hits.join(payload, "hit_id")


def citations(hits: DataFrame, content: str = "content", metadata: str = "metadata") -> DataFrame:
    """Display form: snippet, source and type with their defaults."""
    return hits.select(
        "query_id", "position", C.snippet(content).alias("content"),
        F.coalesce(F.col(metadata)["source"], F.lit("Unknown")).alias("source"),
        F.coalesce(F.col(metadata)["type"], F.lit("general")).alias("type"))


def build_corpus(*sources: DataFrame, size: int = X.CHUNK_SIZE, overlap: int = X.CHUNK_OVERLAP) -> DataFrame:
    """Bag union of the sources, cut into chunks."""
    from spendlens.sources.documents import union_corpora

    return chunk_documents(union_corpora(*sources), size, overlap)


# --- token costs ---------------------------------------------------------------------------------------

def price_table(spark) -> DataFrame:
    """Price per 1000 tokens and model: four fixed rows."""
    rows = [(model, *prices) for model, prices in domain.TOKEN_PRICES.items()]
    return spark.createDataFrame(rows, "model string, input_price double, output_price double")


def with_prices(usage: DataFrame) -> DataFrame:
    """Prices of the row's model; an unknown model is priced as the default one."""
    prices = price_table(usage.sparkSession)
    default_in, default_out = domain.TOKEN_PRICES[domain.DEFAULT_MODEL]
    return (usage.join(F.broadcast(prices), "model", "left")
            .withColumns({"input_price": F.coalesce("input_price", F.lit(default_in)),
                          "output_price": F.coalesce("output_price", F.lit(default_out))}))


def token_costs(messages: DataFrame, *keys: str, digits: int = 6) -> DataFrame:
    """Tokens and cost per key. ``messages``: role (user = input, assistant = output), text, model."""
    tokens = C.token_estimate("text")
    usage = messages.groupBy(*keys, "model").agg(
        F.sum(F.when(F.col("role") == "user", tokens).otherwise(0)).alias("input_tokens"),
        F.sum(F.when(F.col("role") == "assistant", tokens).otherwise(0)).alias("output_tokens"))
    cost = F.col("input_tokens") / 1000 * F.col("input_price") + F.col("output_tokens") / 1000 * F.col("output_price")
    return with_prices(usage).select(*keys, "model", "input_tokens", "output_tokens", F.round(cost, digits).alias("cost"))
