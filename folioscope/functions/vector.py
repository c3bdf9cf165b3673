"""Vector functions as column expressions. Sums are taken in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return cosine_of(a, b, dot(a, a), dot(b, b))


def cosine_of(a: Column, b: Column, aa: Column, bb: Column) -> Column:
    """The cosine with both vectors' squares given; 0 if a vector has no length."""
    length = F.sqrt(aa * bb)
    return F.when(length > 0, dot(a, b) / length).otherwise(0.0)


def certainty(similarity: Column) -> Column:
    return (1 + similarity) / 2


def hashed(terms: Column, size: int = 16) -> Column:
    """A text's vector by feature hashing: how many terms fall into each of the buckets that md5 gives."""
    # as an array's one element, the buckets are found once and not once for each i
    each = lambda of, value: F.get(F.transform(F.array(value), of), F.lit(0))
    if size == 16:  # the eighth digit is the bucket: digits in one string are counted without a call for each term
        digits = F.array_join(F.transform(terms, lambda t: F.substring(F.md5(t), 8, 1)), "")
        count = lambda found: F.array(*((F.length(found) - F.length(F.replace(found, F.lit(f"{i:x}"), F.lit("")))).cast("double") for i in range(16)))
        return each(count, digits)
    bucket = lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint"), F.lit(size))
    count = lambda found: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(found, lambda b: b == i)).cast("double"))
    return each(count, F.transform(terms, bucket))


def pooled(tokens: Column, size: int = 16, limit: int = 8192) -> Column:
    """A text's vector by mean pooling: of its first limit tokens, hashed one by one; no token gives zeros."""
    taken = F.slice(tokens, 1, limit)
    return F.transform(hashed(F.transform(taken, F.lower), size), lambda x: x / F.greatest(F.size(taken), F.lit(1)))


def mean_vectors(df: DataFrame, by: list[str], vector: str, weight: Column | None = None) -> DataFrame:
    """(by, dim, mean): the elementwise mean of a group's vectors, masked by a weight. Counts are at least 1e-9."""
    weight = F.lit(1.0) if weight is None else weight.cast("double")
    each = df.select(*by, weight.alias("__w"), F.posexplode(vector).alias("dim", "__x"))
    return each.groupBy(*by, "dim").agg((F.sum(F.col("__w") * F.col("__x").cast("double")) / F.greatest(F.sum("__w"), F.lit(1e-9))).alias("mean"))
