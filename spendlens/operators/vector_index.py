"""Exact vector search that reads only what can match.

An index puts vectors into cells, each around a centre, and the vectors of a cell into rings by their angle to the centre.
For a query at the angle a to the centre, no vector of a ring between the angles n and f is closer than ``max(0, a - f, n - a)``
(the triangle inequality on the sphere), so a ring whose nearest possible vector is below the threshold, or below the k-th
hit so far, is never read. The bounds hold for every vector: results are those of a search over everything.

The index is two tables in a folder: ``vectors``, ordered by ring, so that files and row groups of other rings are skipped,
and ``rings`` (at most ``MAX_CELLS`` times ``BANDS`` rows). Centres come from k-means on a bounded sample. A ring with more
than ``rows_per_part`` vectors is dealt into parts, so a task holds the vectors of one part batch by batch, whatever share of
the vectors is alike. In a search every query is sent to its rings, and the vectors of these rings are shuffled once, not once
per block of queries; only for rings that more than ``QUERIES_PER_BLOCK`` queries visit there is a copy per block.

Vectors of no length are near nothing and have the score 0; they form a cell of their own. Vectors whose number of elements
is not the index's, and NULL vectors, have no similarity with anything.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spendlens.functions import columns as C
from spendlens.functions import text as X
from spendlens.operators import retrieval as R

MAX_CELLS = 1024
#: Steps of angle between the centre of a cell and the opposite point; rings begin and end at steps.
BANDS = 256
SAMPLE_PER_CELL = 64
ROWS_PER_PART = 20_000
#: Taken off every angle between a query and a ring, for rounding (radians).
MARGIN = 1e-6
FLAT, OTHER = -1, -2


@dataclass
class VectorIndex:
    """A stored index: all columns of the corpus with ``_ring`` and ``_split``, the rings, the centres of the cells."""

    vectors: DataFrame
    rings: DataFrame
    centres: np.ndarray
    key: str
    vector: str


def _with_cells(corpus: DataFrame, centres: np.ndarray, dims: int, vector: str) -> DataFrame:
    """``corpus`` with the nearest centre of each vector of ``dims`` elements, and the angle to it."""
    shared = corpus.sparkSession.sparkContext.broadcast(centres)
    schema = T.StructType([*corpus.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_angle", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            cell, angle = np.full(batch.num_rows, OTHER, np.int32), np.zeros(batch.num_rows)
            column = batch.column(vector)
            for rows in _pieces(np.flatnonzero(R.sizes(column) == dims)):
                unit = R.unit_rows(column.take(pa.array(rows)))
                flat = ~unit.any(axis=1)
                cell[rows] = FLAT
                if len(centres):  # there are none if all vectors are flat
                    near = unit @ centres.T
                    best = near.argmax(axis=1)
                    cell[rows] = np.where(flat, FLAT, best)
                    angle[rows] = np.where(flat, 0.0, np.arccos(np.clip(near[np.arange(len(rows)), best], -1, 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], schema=arrow)

    return corpus.mapInArrow(run, schema)


def _pieces(rows: np.ndarray, size: int = 4096) -> Iterator[np.ndarray]:
    for start in range(0, len(rows), size):
        yield rows[start:start + size]


def build(corpus: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", cells: int | None = None,
          rows_per_part: int = ROWS_PER_PART) -> VectorIndex:
    """Writes the index of ``corpus`` into the folder ``path`` and opens it.

    The most frequent number of elements is the index's. There are about half as many cells as the square root of the number
    of vectors, at most ``MAX_CELLS``, unless ``cells`` says how many.
    """
    sizes = corpus.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), "size").first()
    dims, n = (sizes["size"], sizes["count"]) if sizes else (0, 0)
    if cells is None:
        cells = int(min(MAX_CELLS, max(1, n ** 0.5 / 2)))
    wanted = cells * SAMPLE_PER_CELL
    same = corpus.where(F.size(vector) == dims).select(F.col(vector).cast("array<double>").alias("v"), F.xxhash64(key, vector).alias("h"))
    sample = same.where((X.norm(F.col("v")) > 0) & (F.shiftrightunsigned("h", 1) / 2.0 ** 63 <= 2 * wanted / max(n, 1))) \
        .limit(4 * wanted).select(array_to_vector(X.unit_vector("v")).alias("features"))
    known = same.where(X.norm(F.col("v")) > 0).select("h").distinct().limit(cells).count()
    centres = np.zeros((0, dims))
    if known:
        fitted = KMeans(k=known, distanceMeasure="cosine", seed=1, maxIter=10, initMode="random").fit(sample.coalesce(8)) if known > 1 else None
        centres = np.array(fitted.clusterCenters() if fitted else [sample.first()["features"].toArray()])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    celled = _with_cells(corpus, centres, dims, vector).withColumn("_band", F.least(F.floor(F.col("_angle") / (np.pi / BANDS)), F.lit(BANDS - 1)).cast("int"))
    # Rings are runs of bands with about a part's rows together; at most a row per cell and band.
    counts = celled.groupBy("_cell", "_band").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("_cell").orderBy("_band")) - F.col("n")
    full = counts.withColumn("_full", F.floor(before / rows_per_part))
    number = F.dense_rank().over(Window.partitionBy("_cell").orderBy("_full")) - 1
    ringed = full.withColumn("_ring", (F.col("_cell") * BANDS + number).cast("int"))
    splits = ringed.groupBy("_ring").agg(F.greatest(F.ceil(F.sum("n") / rows_per_part), F.lit(1)).cast("int").alias("_splits"))
    bands = ringed.join(splits, "_ring").select("_cell", "_band", "_ring", "_splits")
    placed = celled.join(F.broadcast(bands), ["_cell", "_band"]) \
        .withColumn("_split", (F.monotonically_increasing_id() % F.col("_splits")).cast("int"))
    files = max(1, -(-n // (8 * rows_per_part)))
    placed.drop("_band", "_splits").repartitionByRange(files, "_ring", "_split").sortWithinPartitions("_ring", "_split") \
        .write.mode("overwrite").parquet(f"{path}/vectors")
    spark = corpus.sparkSession
    spark.read.parquet(f"{path}/vectors").groupBy("_ring", "_cell").agg(
        F.min("_angle").alias("near"), F.max("_angle").alias("far"), F.count(F.lit(1)).alias("n"),
        (F.max("_split") + 1).alias("splits")).coalesce(1).write.mode("overwrite").parquet(f"{path}/rings")
    known_size = [(FLAT, [0.0] * dims)]  # the size of vectors, also where there is no centre
    spark.createDataFrame(known_size + [(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1) \
        .write.mode("overwrite").parquet(f"{path}/centres")
    return open_index(spark, path, key, vector)


def open_index(spark: SparkSession, path: str, key: str = "vec_id", vector: str = "embedding") -> VectorIndex:
    known = [r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()]  # at most MAX_CELLS and one
    return VectorIndex(spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/rings"), np.array(known, float)[1:], key, vector)


def visits(index: VectorIndex, queries: DataFrame, threshold: float, nearest: int = 0, rest: bool = True) -> DataFrame:
    """The rings that a query must visit: ``(query_id, <vector>, rings)``.

    ``queries`` has ``query_id``, the vector and optionally ``least``, a score that hits must reach beside ``threshold``. The
    nearest rings that hold ``nearest`` vectors are left out, or, without ``rest``, the only ones.
    """
    spark, vector = queries.sparkSession, index.vector
    rows = index.rings.where(F.col("_cell") != OTHER).orderBy("_ring").collect()  # at most MAX_CELLS * BANDS
    shared = spark.sparkContext.broadcast((index.centres, [np.array([r[c] for r in rows]) for c in ("_ring", "_cell", "near", "far", "n")]))
    asked = queries.where(F.col(vector).isNotNull()).select(
        "query_id", vector, F.coalesce(F.col("least") if "least" in queries.columns else F.lit(None), F.lit(threshold)).cast("double").alias("least"))
    schema = T.StructType([*asked.schema.fields[:2], T.StructField("rings", T.ArrayType(T.IntegerType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, (ring, cell, near, far, size) = shared.value
        flat = cell == FLAT
        for batch in batches:
            column, least = batch.column(vector), batch.column("least").to_numpy()
            found: list[np.ndarray] = [np.empty(0, np.int32)] * batch.num_rows
            for rows in _pieces(np.flatnonzero(R.sizes(column) == centres.shape[1]) if len(ring) else np.empty(0, np.int64), 256):
                unit = R.unit_rows(column.take(pa.array(rows)))
                near_centres = unit @ centres.T if len(centres) else np.zeros((len(unit), 1))  # without centres all are flat
                angle = np.arccos(np.clip(near_centres, -1, 1))[:, np.maximum(cell, 0)]
                gap = np.maximum(np.maximum(angle - far, near - angle), 0.0)
                bound = np.where(flat | ~unit.any(axis=1)[:, None], 0.0, np.cos(np.maximum(gap - MARGIN, 0.0)))
                # Scores are rounded to 12 digits, which must not lift one over a bound.
                may = bound + 1e-9 >= np.maximum(least[rows], threshold)[:, None]
                for i, row in enumerate(rows):
                    early = np.zeros(len(ring), bool)
                    if nearest:
                        order = np.lexsort((np.abs(angle[i] - (near + far) / 2), -bound[i]))
                        early[order[:np.searchsorted(np.cumsum(size[order]), nearest) + 1]] = True
                    found[row] = ring[may[i] & (early != rest)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, arrow[2].type)], schema=arrow)

    return asked.mapInArrow(run, schema)


def _hits(index: VectorIndex, wanted: DataFrame, threshold: float, criteria: Mapping[str, object] | None, k: int | None) -> DataFrame:
    """Hits of queries among the vectors of their rings, for ``k`` at least the k best of each part."""
    corpus = index.vectors.where(F.col(index.vector).isNotNull())
    if criteria:
        corpus = corpus.filter(C.payload_matches(criteria))
    asked = wanted.select("query_id", F.col(index.vector).alias("_vector"), F.explode("rings").alias("_ring"))
    busy = asked.groupBy("_ring").agg(F.ceil(F.count(F.lit(1)) / R.QUERIES_PER_BLOCK).cast("int").alias("_blocks")) \
        .join(F.broadcast(index.rings.select("_ring", "splits")), "_ring")  # at most a row per ring
    types = {"query_id": wanted.schema["query_id"].dataType, "hit_id": index.vectors.schema[index.key].dataType}
    schema = T.StructType([*[T.StructField(n, t) for n, t in types.items()], T.StructField("score", T.DoubleType())])
    same = index.vectors.schema[index.vector].dataType.simpleString() == wanted.schema[index.vector].dataType.simpleString()

    def side(df: DataFrame, query, point, vector, split, block, kind: int) -> DataFrame:
        return df.select(
            query.cast(types["query_id"]).alias("_query"), point.cast(types["hit_id"]).alias("_point"),
            (vector if same else vector.cast("array<double>")).alias("_vector"),
            (F.col("_ring").cast("long") * (1 << 20) + split).alias("_part"), block.cast("int").alias("_block"),
            F.lit(kind).alias("_kind"))

    asking = asked.join(F.broadcast(busy), "_ring").withColumn("_split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
    left = side(asking, F.col("query_id"), F.lit(None), F.col("_vector"), F.col("_split"),
                F.pmod(F.xxhash64("query_id"), F.col("_blocks")), 0)
    answering = corpus.join(F.broadcast(busy), "_ring").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    right = side(answering, F.lit(None), F.col(index.key), F.col(index.vector), F.col("_split"), F.col("_block"), 1)
    arrow = to_arrow_schema(schema)
    pairs = left.unionByName(right).withColumn("_dims", F.size("_vector")).repartition("_part", "_block") \
        .sortWithinPartitions("_part", "_block", "_dims", "_kind")
    return pairs.mapInArrow(lambda batches: R.matches(batches, arrow, k, threshold), schema)


def similar(index: VectorIndex, queries: DataFrame, threshold: float, criteria: Mapping[str, object] | None = None) -> DataFrame:
    """Every pair ``(query_id, hit_id, score)`` with a cosine similarity of ``threshold`` or more."""
    return _hits(index, visits(index, queries, threshold), threshold, criteria, None)


def search(index: VectorIndex, queries: DataFrame, k: int = 5, threshold: float = 0.7,
           criteria: Mapping[str, object] | None = None) -> DataFrame:
    """Exact top ``k`` by cosine similarity per query: ``(query_id, hit_id, score, position)``.

    The nearest rings first; what they give is the score to reach for all others.
    """
    asked, nearest = queries.select("query_id", index.vector), 4 * k
    found = _hits(index, visits(index, asked, threshold, nearest, rest=False), threshold, criteria, k)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "hit_id")
    kth = found.withColumn("place", F.row_number().over(best)).where(F.col("place") == k).select("query_id", F.col("score").alias("least"))
    rest = visits(index, asked.join(kth, "query_id", "left"), threshold, nearest)
    hits = found.unionByName(_hits(index, rest, threshold, criteria, k))
    return hits.withColumn("position", F.row_number().over(best)).filter(F.col("position") <= k)


def share_read(index: VectorIndex, queries: DataFrame, threshold: float) -> DataFrame:
    """Per query: rings visited and the share of all vectors in them, for a search of everything above ``threshold``."""
    total = index.rings.agg(F.sum("n")).first()[0]
    visited = visits(index, queries, threshold).select("query_id", F.explode_outer("rings").alias("_ring")) \
        .join(F.broadcast(index.rings.select("_ring", "n")), "_ring", "left")
    return visited.groupBy("query_id").agg(F.count("_ring").alias("rings"), F.coalesce(F.sum("n"), F.lit(0)).alias("vectors")) \
        .withColumn("share", F.try_divide("vectors", F.lit(total)))
