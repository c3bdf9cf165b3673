"""Windows, spans and chunks. Sequential rules are folds over a document's sentences that carry numbers only; what a fold
needs of vectors is computed before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.functions.vector import cosine


def token_windows(df: DataFrame, count: str, limit: int, overlap: int = 256) -> DataFrame:
    """A row (k, start, stop) for each overlapping window over count tokens: none for no token, else windows start every
    limit - overlap tokens until one reaches the end."""
    if limit <= overlap:
        raise ValueError("the limit must exceed the overlap")
    step = limit - overlap
    last = F.greatest(F.ceil((F.col(count) - limit) / step), F.lit(0)).cast("int")
    each = df.filter(F.col(count) > 0).withColumn("k", F.explode(F.sequence(F.lit(0), last)))
    return each.withColumn("start", F.col("k") * step).withColumn("stop", F.least(F.col("k") * step + limit, F.col(count)).cast("int"))


def fixed_chunks(df: DataFrame, tokens: str, size: int = 512) -> DataFrame:
    """A row (k, start, stop, content) for each stretch of size tokens, the last one shorter."""
    n = F.size(tokens)
    each = df.filter(n > 0).withColumn("k", F.explode(F.sequence(F.lit(0), ((n - 1) / size).cast("int"))))
    each = each.withColumn("start", F.col("k") * size).withColumn("stop", F.least(F.col("k") * size + size, F.size(tokens)))
    return each.withColumn("content", F.array_join(F.slice(tokens, F.col("start") + 1, size), " "))


def sentence_spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx, sentence, n_tokens, start, stop): sentences and the tokens before and up to each."""
    each = df.select(key, F.posexplode(X.sentences(F.col(text))).alias("idx", "sentence")).withColumn("n_tokens", F.size(X.tokens(F.col("sentence"))))
    upto = F.sum("n_tokens").over(Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return each.withColumn("stop", upto.cast("int")).withColumn("start", F.col("stop") - F.col("n_tokens"))


def consecutive_similarity(df: DataFrame, by: list[str], order: str, vector: str, to: str = "sim") -> DataFrame:
    """The cosine of each row's vector with the one before it; null for a group's first."""
    before = F.lag(vector).over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("__before", before).withColumn(to, F.when(F.col("__before").isNotNull(), cosine(F.col("__before"), F.col(vector)))).drop("__before")


def greedy_numbers(items: Column, limit: int, threshold: float) -> Column:
    """The chunk of each of a document's sentences, given as an ordered array of structs with n (tokens) and sim (to the
    sentence before). A chunk closes before a sentence that would exceed the limit or is less alike than the threshold; a
    sentence beyond the limit is a chunk of its own."""
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("tokens"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        close = (s["tokens"] > 0) & ((s["tokens"] + x["n"] > limit) | F.coalesce(x["sim"] < threshold, F.lit(False)))
        chunk = s["chunk"] + F.when(close, 1).otherwise(0)
        return F.struct(chunk.alias("chunk"), (F.when(close, F.lit(0)).otherwise(s["tokens"]) + x["n"]).cast("long").alias("tokens"), F.concat(s["out"], F.array(chunk)).alias("out"))

    return F.aggregate(items, start, step, lambda s: s["out"])


def greedy_chunks(df: DataFrame, key: str, order: str, count: str, sim: str, limit: int, threshold: float) -> DataFrame:
    """(key, order, count, chunk): rows numbered as by greedy_numbers within each key. The fold carries the chunk that is open, and
    a row is numbered by the chunk that it lies in."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(count).cast("int").alias("n"), F.col(sim).alias("sim"), F.col(count).alias("count"))))
    grouped = df.groupBy(key).agg(items.alias("items")).withColumn("spans", greedy_spans(F.col("items"), limit, threshold))
    inside = lambda s: F.slice("items", s["first"] + 1, s["last"] - s["first"] + 1)
    rows = F.flatten(F.transform("spans", lambda s, i: F.transform(inside(s), lambda x: F.struct(x["o"].alias(order), x["count"].alias(count), i.alias("chunk")))))
    return grouped.select(key, F.explode(rows).alias("x")).select(key, "x.*")


def merge_numbers(chunks: Column, limit: int) -> Column:
    """The merged chunk of each of a document's chunks, given as an ordered array of structs with n (tokens) and size
    (sentences): a chunk of one sentence joins the one before it if both have limit tokens at most."""
    start = F.struct(F.lit(-1).alias("chunk"), F.lit(0).cast("long").alias("tokens"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        join = (s["chunk"] >= 0) & (x["size"] == 1) & (s["tokens"] + x["n"] <= limit)
        chunk = s["chunk"] + F.when(join, 0).otherwise(1)
        return F.struct(chunk.alias("chunk"), (F.when(join, s["tokens"]).otherwise(F.lit(0)) + x["n"]).cast("long").alias("tokens"), F.concat(s["out"], F.array(chunk)).alias("out"))

    return F.aggregate(chunks, start, step, lambda s: s["out"])


def merged_chunks(numbered: DataFrame, key: str, count: str, limit: int) -> DataFrame:
    """(key, merged, n_tokens, n_sentences, first_chunk): what greedy_chunks gives, with single sentences merged."""
    chunks = numbered.groupBy(key, "chunk").agg(F.sum(count).alias("n"), F.count(F.lit(1)).alias("size"))
    listed = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk", "n", "size"))).alias("items")).withColumn("to", merge_numbers(F.col("items"), limit))
    each = listed.select(key, F.explode(F.arrays_zip("items", "to")).alias("x"))
    return each.groupBy(key, F.col("x.to").alias("merged")).agg(F.sum("x.items.n").alias("n_tokens"), F.sum("x.items.size").alias("n_sentences"), F.min("x.items.chunk").alias("first_chunk"))


def greedy_spans(items: Column, limit: int, threshold: float) -> Column:
    """The chunks that greedy_numbers tells, as structs: first and last sentence, start and stop token. items: an ordered
    array of structs with n and sim. A chunk is appended when it closes, so nothing is copied for every sentence."""
    chunk = "struct<first:int,last:int,start:int,stop:int>"
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("first"), F.lit(0).alias("start"), F.lit(0).alias("stop"), F.array().cast(f"array<{chunk}>").alias("out"))

    def ended(s: Column) -> Column:
        now = F.struct(s["first"].alias("first"), (s["at"] - 1).alias("last"), s["start"].alias("start"), s["stop"].alias("stop"))
        return F.concat(s["out"], F.array(now))

    def step(s: Column, x: Column) -> Column:
        filled = s["at"] > s["first"]
        close = filled & ((s["stop"] - s["start"] + x["n"] > limit) | F.coalesce(x["sim"] < threshold, F.lit(False)))
        return F.struct(
            (s["at"] + 1).alias("at"), F.when(close, s["at"]).otherwise(s["first"]).alias("first"), F.when(close, s["stop"]).otherwise(s["start"]).alias("start"),
            (s["stop"] + x["n"]).alias("stop"), F.when(close, ended(s)).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(items, start, step, lambda s: F.when(s["at"] > 0, ended(s)).otherwise(s["out"]))


def merge_spans(spans: Column, limit: int) -> Column:
    """greedy_spans with chunks of one sentence joined to the one before where both have limit tokens at most."""
    chunk = "struct<first:int,last:int,start:int,stop:int>"
    start = F.struct(F.lit(None).cast(chunk).alias("now"), F.array().cast(f"array<{chunk}>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        now = s["now"]
        join = now.isNotNull() & (x["first"] == x["last"]) & (x["stop"] - now["start"] <= limit)
        both = F.struct(now["first"].alias("first"), x["last"].alias("last"), now["start"].alias("start"), x["stop"].alias("stop"))
        done = F.when(join | now.isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(now)))
        return F.struct(F.when(join, both).otherwise(x).alias("now"), done.alias("out"))

    return F.aggregate(spans, start, step, lambda s: F.when(s["now"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["now"]))))


def semantic_spans(distances: Column, share: float = 0.95) -> Column:
    """Structs of first and last sentence: a chunk ends where the distance to the next sentence exceeds the row's percentile of
    distances. distances: an array with one element fewer than there are sentences."""
    def cut(limit: Column) -> Column:
        ends = F.filter(F.transform(distances, lambda d, i: F.when(d > limit, i)), lambda i: i.isNotNull())
        firsts = F.concat(F.array(F.lit(0)), F.transform(ends, lambda i: i + 1))
        lasts = F.concat(ends, F.array(F.size(distances)))
        return F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("first"), b.alias("last")))

    def percentile(ordered: Column) -> Column:
        at = (F.size(ordered) - 1) * F.lit(share)
        low, high = F.get(ordered, F.floor(at).cast("int")), F.get(ordered, F.ceil(at).cast("int"))
        return F.round(low + (high - low) * (at - F.floor(at)), 9)

    # as an array's one element, the percentile is found once and not for each sentence
    return F.get(F.transform(F.array(percentile(F.array_sort(distances))), cut), F.lit(0))


def percentile_breaks(df: DataFrame, key: str, distance: str, share: float = 0.95) -> DataFrame:
    """df with __limit, the group's percentile of the distances, and __break where a distance exceeds it."""
    limits = df.groupBy(key).agg(F.percentile(distance, F.lit(share)).alias("__limit"))
    return df.join(limits, key).withColumn("__break", F.coalesce(F.col(distance) > F.col("__limit"), F.lit(False)))
