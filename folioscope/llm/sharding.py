"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks and shards, each with a weight. A row descends from the root: at each level every child draws
-ln(u) / weight, u a hash of the row's key and of the child's name, and the least draw wins. A child whose weight stays
keeps its draws, so a changed weight moves rows only into or out of the subtree that it belongs to. A new shard is put
into a region of its own: only the root's choice is changed, so one more shard takes rows only into itself. The law is
`key`: the key and the tree decide, whatever other rows there are.

Slots number a shard's rows without gaps, by a hash's bucket and then (doc_id, size, crc). Equal rows are counted first;
there are so many buckets that one has about BUCKET different rows, whatever the ids are; ranks are summed within buckets,
and the buckets' sums, one row each, are cumulated apart. So no task sorts a whole shard.

Defined cases: null text has size 1 and the crc of the empty text; null doc_ids are one key. Repeated rows have one shard
and a slot each. An empty table gives an empty result. with_shards passes other columns through; those
named as its own (shard, __region, __rack) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm._spark import cut

Tree = list[list[list[float]]]  # regions of racks of shards' weights; shards are numbered in this order

#: Different rows, in the mean, of a bucket in which slots are ranked together.
BUCKET = 1 << 13


def grown_tree(shards: int, base: int = 16, rack: int = 4, racks: int = 2) -> Tree:
    """A tree of equal shards: the first base ones in full racks and regions, each further one in a region of its own."""
    count = min(shards, base)
    flat = [[1.0] * min(rack, count - at) for at in range(0, count, rack)]
    return [flat[i : i + racks] for i in range(0, len(flat), racks)] + [[[1.0]] for _ in range(shards - count)]


def _choice(key: Column, path: list[Column], level: str, weights: Column) -> Column:
    """The child of least draw; weights: an array of the children's weights."""

    def draw(weight: Column, i: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), *path, i), 11)
        u = (bits.cast("double") + 0.5) / F.lit(float(1 << 53))
        return F.struct(F.when(weight > 0, -F.log(u) / weight).otherwise(F.lit(float("inf"))).alias("draw"), i.alias("i"))

    return F.array_min(F.transform(weights, draw))["i"]


def _array(values: list, depth: int) -> Column:
    return F.array(*(_array(v, depth - 1) if depth > 1 else F.lit(float(v)) for v in values))


def with_shards(docs: DataFrame, tree: Tree, key: str = "doc_id", to: str = "shard") -> DataFrame:
    """docs with the shard that the tree gives each key, and the way to it: __region and, in that, __rack. Projections
    only, one a level; all other columns stay."""
    regions = _array([sum(map(sum, r)) for r in tree], 1)
    racks = _array([[sum(k) for k in r] for r in tree], 2)
    shards = _array(tree, 3)
    before, at = [], 0
    for r in tree:
        before.append([at + sum(map(len, r[:i])) for i in range(len(r))])
        at += sum(map(len, r))
    first = F.array(*(F.array(*map(F.lit, x)) for x in before))
    region, rack = F.col("__region"), F.col("__rack")
    docs = docs.withColumn("__region", _choice(F.col(key), [], "region", regions))
    docs = docs.withColumn("__rack", _choice(F.col(key), [region], "rack", F.get(racks, region)))
    shard = _choice(F.col(key), [region, rack], "shard", F.get(F.get(shards, region), rack))
    return docs.withColumn(to, (F.get(F.get(first, region), rack) + shard).cast("int"))


def with_slots(rows: DataFrame) -> DataFrame:
    """rows of doc_id, size, text_crc32, shard and others that these decide, with a slot each."""
    names = rows.columns
    same = cut(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("__n")))
    buckets = 1 + same.count() // BUCKET
    same = same.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)))
    within = Window.partitionBy("shard", "__bucket").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    ranked = same.withColumn("__before", F.coalesce(F.sum("__n").over(within), F.lit(0)))
    sums = same.groupBy(F.col("shard").alias("__shard"), F.col("__bucket").alias("__b")).agg(F.sum("__n").alias("__sum"))
    earlier = Window.partitionBy("__shard").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__shard", "__b", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start"))
    joined = ranked.join(starts, (ranked["shard"] == starts["__shard"]) & (ranked["__bucket"] == starts["__b"]))
    return joined.select(*names, (F.col("__start") + F.col("__before")).alias("__first"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).alias("__i")).select(*names, (F.col("__first") + F.col("__i")).alias("slot"))


def op5_sharding(spark: SparkSession, sf_dir: str, shards: int = 16) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("law", F.lit("key"))
    rows = with_shards(with_shards(rows, grown_tree(shards)), grown_tree(shards + 1), to="grown_shard").drop("__region", "__rack")
    return with_slots(rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
