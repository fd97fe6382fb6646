"""Near-duplicate documents by min-max hashing (operator 8).

A document's set are the hashes of its distinct shingles of five words. One pass of permutations gives a minimum *and* a
maximum per permutation, so 160 signature values take 80 hash evaluations; they are banded by five. Then:

1. Equal sets are one set, named after its smallest document.
2. Every member of a band's bucket is paired with the bucket's smallest member, never with all others. The pairs are
   confirmed on the full sets.
3. Two members of a bucket that both differ from its smallest one may still be alike. They lie in one connected group of
   buckets, so inside such groups, and only between what is not connected yet, documents that share one of their rarest
   shingles are confirmed as well. One more than the share that may differ of a document's shingles suffices for that
   (prefix filter), so nothing is lost and no group is squared.

Components come from alternating stars. Only texts with a candidate partner are shuffled, once: a bit map of fixed size
holds back nearly all others.

Documents without words and NULL texts have an empty set, are linked with nothing and kept; texts of any length are read
whole. Rows with one ``doc_id`` count as one document: all their sets are in one component. Rows without a ``doc_id`` cannot
be named: their component is NULL and they are kept. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import columns, map_batches, stored
from spendlens.llm.components import components

SHINGLE = 5
#: Bits of the map of candidate documents: 16 for each of them, within these bounds (at most 64 MB).
LEAST_SLOTS, MOST_SLOTS = 1 << 22, 1 << 29
#: Rows of one key that meet in one task of a join; more are dealt over several.
ROWS_PER_SALT = 1_000
#: Documents that a Python worker handles at a time.
ROWS_PER_PIECE = 500
ODD = np.uint64(0x9E3779B97F4A7C15)
SIGNS = "doc_id bigint, n_shingles bigint, set_high bigint, set_low bigint, bands array<bigint>"


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``size`` words, A-Z lower-cased; a shorter text is one shingle."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode().lower().split()  # on bytes both steps know ASCII only
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    size, whole = min(size, n), size
    out = hashes[:n - size + 1].copy()
    for k in range(1, size):
        out = out * ODD + hashes[k:n - size + 1 + k]
    return np.unique(mixed(out + np.uint64(whole - size)))


class MinMax:
    """Bands over minima and maxima of ``permutations`` hashes; a band has values of different permutations."""

    def __init__(self, permutations: int, rows: int, seed: int = 8):
        rng = np.random.default_rng(seed)
        self.rows = rows
        self.times = rng.integers(0, 1 << 63, permutations, np.uint64) << np.uint64(1) | np.uint64(1)
        self.plus = rng.integers(0, 1 << 63, permutations, np.uint64)
        self.weight = rng.integers(0, 1 << 63, rows, np.uint64) << np.uint64(1) | np.uint64(1)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        low = np.full(len(self.times), 0xFFFFFFFF, np.uint64)
        high = np.zeros(len(self.times), np.uint64)
        for k in range(0, len(hashes), 4096):
            values = (hashes[k:k + 4096, None] * self.times + self.plus) >> np.uint64(32)
            np.minimum(low, values.min(0), out=low)
            np.maximum(high, values.max(0), out=high)
        return np.concatenate([low, high])

    def bands(self, hashes: np.ndarray) -> np.ndarray:
        signature = self.signature(hashes).reshape(-1, self.rows)
        band = np.arange(1, len(signature) + 1, dtype=np.uint64) * ODD
        return mixed(mixed(signature * self.weight).sum(1, dtype=np.uint64) + band).view(np.int64)


@lru_cache(maxsize=2)
def min_max(permutations: int, rows: int) -> MinMax:
    return MinMax(permutations, rows)


def signed(documents: DataFrame, permutations: int = 60, rows: int = 5) -> DataFrame:
    """Size and 128-bit name of each document's set, and its band keys."""

    def sign(batch: pa.RecordBatch) -> list:
        from xxhash import xxh3_128_digest

        maker = min_max(permutations, rows)
        n, high, low, bands = [], [], [], []
        for text in batch.column(1).to_pylist():
            hashes = shingle_set(text)
            n.append(len(hashes))
            name = np.frombuffer(xxh3_128_digest(hashes.tobytes()), np.int64) if len(hashes) else (None, None)
            high.append(name[0])
            low.append(name[1])
            bands.append(maker.bands(hashes) if len(hashes) else [])
        return [batch.column(0), n, high, low, bands]

    return map_batches(columns(documents, "doc_id", "text"), sign, SIGNS, ROWS_PER_PIECE)


def shingle_sets(documents: DataFrame) -> DataFrame:
    """doc_id, n and the shingle hashes of each document."""

    def make(batch: pa.RecordBatch) -> list:
        found = [shingle_set(t) for t in batch.column(1).to_pylist()]
        return [batch.column(0), [len(s) for s in found], [s.view(np.int64) for s in found]]

    return map_batches(columns(documents, "doc_id", "text"), make, "doc_id bigint, n bigint, shingles array<bigint>", ROWS_PER_PIECE)


def worth_shuffling(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """``documents`` without most of those whose ``doc_id`` is not in ``ids``.

    The hashed ids mark bits of a map of bounded size; it goes to every task in place of the ids themselves. A join still has
    to follow.
    """
    return marked(documents, ids, "doc_id").where("_marked").drop("_marked")


def marked(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``_marked``: false only where ``key`` (not NULL) is not among the ``keys``, and nearly always then.

    Without ``keys`` it is a constant, so plans lose whatever follows for marked rows only.
    """
    n = keys.count()
    if not n:
        return rows.withColumn("_marked", F.lit(False))
    slots = min(max(1 << (16 * n - 1).bit_length(), LEAST_SLOTS), MOST_SLOTS)

    def slot(column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(slots))

    marks = keys.select(slot(key).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    place = slot(key)
    placed = rows.select("*", F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).cast("int").alias("position"))
    byte = F.conv(F.hex(F.substring("bits", F.expr("position div 8 + 1").cast("int"), F.lit(1))), 16, 10).cast("int")
    found = F.expr("1 << (position % 8)").bitwiseAND(byte) != 0
    return placed.join(F.broadcast(marks), "part", "left").select(*rows.columns, F.coalesce(found, F.lit(False)).alias("_marked"))


def without(rows: DataFrame, removed: DataFrame, key: str, keys: DataFrame | None = None) -> DataFrame:
    """``rows`` whose ``key`` is not among the ``removed`` ones, with next to none of their other columns shuffled.

    A map of the removed keys passes most rows that stay. Keys of the others are compared exactly; the few that were marked
    by chance get a map of their own, and only rows in that one are joined with them. ``keys`` has the keys of ``rows`` where
    these are costly to read.
    """
    flagged = marked(rows, removed, key).withColumn("_marked", F.col("_marked") & F.col(key).isNotNull())
    light = flagged if keys is None else marked(keys.select(key).where(F.col(key).isNotNull()), removed, key)
    by_chance = stored(light.where("_marked").select(key).distinct().join(removed.select(key), key, "left_anti"), "by-chance")
    doubtful = marked(flagged.where("_marked").drop("_marked"), by_chance, key).where("_marked").drop("_marked")
    return flagged.where("not _marked").drop("_marked").unionByName(doubtful.join(by_chance, key, "left_semi").select(*rows.columns))


def alike(both: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    """Whether ``both`` shared shingles are ``percent`` of the union of sets of ``n_a`` and ``n_b``."""
    return 100 * both >= percent * (n_a + n_b - both)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike.

    A document ``a`` may have any number of partners: the sets of these are joined first, then each block of partners meets
    one copy of the set of ``a``.
    """
    first = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a"))
    second = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b"))
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / ROWS_PER_SALT).cast("int").alias("salts"))
    salted = pairs.join(blocks, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")).drop("salts")
    centres = first.join(blocks, "a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    sized = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    near = alike(F.size(F.array_intersect("s_a", "s_b")), F.col("n_a"), F.col("n_b"), percent)
    return salted.join(second, "b").join(centres, ["a", "salt"]).where(sized & near).select("a", "b").distinct()


def bucket_stars(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of each bucket's smallest document with its other ones."""
    keys = sets.select("doc_id", F.explode("bands").alias("key"))
    centers = keys.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("last")).where("a < last")
    return keys.join(centers.select("key", "a"), "key").where("a < doc_id").select("a", F.col("doc_id").alias("b")).distinct()


def prefix_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one group but different parts that may be alike.

    ``members`` has group, part and doc_id. A document's shingles are ordered by how many members of its group have them.
    Two documents that are alike share one of the first ``n - ceil(percent n) + 1``, and behind the first shared one
    there are enough left.
    """
    tokens = members.join(sets, "doc_id").select("group", "part", "doc_id", "n", F.explode("shingles").alias("s"))
    common = tokens.groupBy("group", "s").agg(F.count("*").alias("df")).where("df > 1")
    ordered = tokens.join(common, ["group", "s"], "left").groupBy("group", "part", "doc_id", "n").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "s"))).alias("x"))
    length = F.expr(f"int(n - ({percent} * n + 99) div 100 + 1)")
    first = stored(ordered.select("group", "part", "doc_id", "n", F.posexplode(F.slice("x", F.lit(1), length)))
                   .select("group", "part", "doc_id", "n", "pos", "col.*").where("df > 1").drop("df"), "prefixes")
    parts = first.groupBy("group", "s", "part").count().groupBy("group", "s").agg(
        F.max_by("part", "count").alias("main"), F.count("*").alias("parts"),
        F.ceil(F.sum("count") / ROWS_PER_SALT).cast("int").alias("salts")).where("parts > 1").drop("parts")
    # A shingle of many members is dealt over several tasks: each holds a share of all and a copy of the smaller parts.
    known = first.join(parts, ["group", "s"])
    minor = known.where("part <> main").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("x")
    other = known.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")).alias("y")
    needed = F.expr(f"({percent} * (x.n + y.n) + {99 + percent}) div {100 + percent}")
    joined = minor.join(other, (F.col("x.group") == F.col("y.group")) & (F.col("x.s") == F.col("y.s"))
                        & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.part") != F.col("y.part"))
                        & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
                        & (F.least(F.expr("x.n - x.pos"), F.expr("y.n - y.pos")) >= needed))
    return joined.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()


def open_groups(stars: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (group, part, doc_id) of the bucket groups in which some pairs of different parts were not compared."""
    group = labels.where("graph = 0").select(F.col("node").alias("doc_id"), F.col("component").alias("group"))
    part = labels.where("graph = 1").select(F.col("node").alias("doc_id"), F.col("component").alias("part"))
    members = group.join(part, "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id"))
    compared = stars.join(group.withColumnRenamed("doc_id", "a"), "a").groupBy("group").agg(F.count("*").alias("compared"))
    todo = members.groupBy("group").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n")) \
        .join(compared, "group").where("low < high and compared < n * (n - 1) div 2").select("group")
    return members.join(todo, "group").select("group", "part", "doc_id")


def joined_parts(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """part and whole, the smallest part that it is connected with by further pairs in the open groups ``rest``."""
    # Written before they are used several times: a plan that repeats them would fill the driver.
    more = stored(confirmed(stored(prefix_pairs(rest, sets, percent), "open"), sets, percent), "more")
    part = rest.select("doc_id", "part")
    joined = more.join(part.withColumnRenamed("doc_id", "a").withColumnRenamed("part", "x"), "a") \
        .join(part.withColumnRenamed("doc_id", "b").withColumnRenamed("part", "y"), "b") \
        .select(F.lit(2).alias("graph"), F.col("x").alias("a"), F.col("y").alias("b"))
    return components(joined).select(F.col("node").alias("part"), F.col("component").alias("whole"))


def same_id(named: DataFrame, firsts: DataFrame, name: list[str]) -> DataFrame:
    """Links between the first documents of different sets that have one ``doc_id``."""
    shape = F.struct(*name)
    several = named.groupBy("doc_id").agg(F.min(shape).alias("low"), F.max(shape).alias("high")).where("low <> high").select("doc_id")
    ends = named.join(several, "doc_id").join(firsts, name).select("doc_id", "first").distinct()
    least = ends.groupBy("doc_id").agg(F.min("first").alias("a"))
    return ends.join(least, "doc_id").where("a < first").select("a", F.col("first").alias("b"))


def near_duplicates(documents: DataFrame, percent: int = 80, permutations: int = 80, rows: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest connected doc_id) and kept (is that document) of each row.

    A pair whose sets are ``percent`` alike is in no common bucket with a chance of
    ``(1 - (percent / 100) ** rows) ** (2 * permutations / rows)``: 3e-6 by default.
    """
    light = stored(signed(documents, permutations, rows), "signed")
    named = light.where("n_shingles > 0 and doc_id is not null")
    name = ["n_shingles", "set_high", "set_low"]
    firsts = named.groupBy(name).agg(F.min("doc_id").alias("first"))
    unique = named.join(firsts.select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi")
    stars = stored(bucket_stars(unique), "stars")
    candidates = stored(stars.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "candidates")
    # An inner join: a semi join would be moved below the bit map.
    texts = worth_shuffling(columns(documents, "doc_id", "text"), candidates).join(candidates, "doc_id")
    sets = stored(shingle_sets(texts), "sets")
    links = stored(confirmed(stars, sets, percent).unionByName(same_id(named, firsts, name)), "links")
    labels = stored(components(stars.withColumn("graph", F.lit(0)).unionByName(links.withColumn("graph", F.lit(1)))), "labels")
    rest = stored(open_groups(stars, labels), "rest")
    known = labels.where("graph = 1").select(F.col("node").alias("first"), F.col("component").alias("part"))
    parts = firsts.join(known, "first", "left").withColumn("part", F.coalesce("part", "first"))
    found = parts.withColumn("whole", F.col("part")) if rest.isEmpty() else parts.join(
        joined_parts(rest, sets, percent), "part", "left")
    found = found.select(*name, F.coalesce("whole", "part").alias("component"))
    component = F.coalesce("component", "doc_id")
    return light.join(found, name, "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
