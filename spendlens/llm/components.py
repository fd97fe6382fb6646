"""Connected components of undirected links by alternating stars; links stay distributed throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import stored


def _smallest(links: DataFrame) -> DataFrame:
    """For each ``b``, the smallest linked ``a``."""
    return links.groupBy("graph", "b").agg(F.min("a").alias("least"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour or itself."""
    both = links.select("graph", "a", "b").unionByName(links.select("graph", F.col("b").alias("a"), F.col("a").alias("b")))
    least = _smallest(both).withColumn("least", F.least("least", "b"))
    larger = both.where("a > b").join(least, ["graph", "b"])
    return larger.select("graph", F.col("least").alias("a"), F.col("a").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these."""
    joined = links.join(_smallest(links), ["graph", "b"])
    ends = joined.select("graph", F.col("least").alias("a"),
                         F.explode(F.array(F.col("a"), F.col("b"))).alias("b"))
    return ends.where("a < b").distinct()


def components(links: DataFrame) -> DataFrame:
    """graph, node, component: the smallest node that each node is connected with, for several graphs at once.

    ``links`` has graph, a, b. Nodes without a link to another node do not occur in the result.
    """
    links = stored(links.select("graph", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    before = None
    while True:
        links = stored(_small_star(_large_star(links)), "links")
        state = links.agg(F.count("*"), F.bit_xor(F.xxhash64("graph", "a", "b"))).first()
        if state == before or not state[0]:
            break
        before = state
    return links.select("graph", F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        links.select("graph", F.col("a").alias("node"), F.col("a").alias("component")).distinct())
