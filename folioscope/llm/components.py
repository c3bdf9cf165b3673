"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm._spark import cut, cut_small


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node with an edge (columns a, b), the least node that it is connected to. Large-star and
    small-star steps alternate until the edges are stars; each round's edges are written out, so that a lost executor
    repeats one round at most. A hub's edges are combined for their minimum before any shuffle, and the join of the
    edges with the minima can be split where a hub is frequent."""
    now = cut_small(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    parts, before = now.rdd.getNumPartitions(), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(parts)
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").coalesce(parts).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").filter("a != b").coalesce(parts).distinct()
        now = cut(small.coalesce(parts))
        # edges are distinct, so the same number and the same sum of hashes are the same edges
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).head()
        if state == before:
            break
        before = state
    return now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
