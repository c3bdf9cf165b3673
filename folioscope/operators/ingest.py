"""Documents to chunks, vectors and triples, as one job.

A document of at most the limit's tokens is one window; a longer one is cut into overlapping windows of that many tokens,
each of which is chunked apart. In a window: sentences, the tokens before and up to each, a vector for each (the masked mean
of its tokens' vectors), chunks closed greedily, single sentences merged, and the chunk's vector as the mean over its span of
tokens, so that it is pooled after the whole window was read. Everything happens in the window's row, of which the limit
bounds the size; only the numbering of chunks over windows is a shuffle, by document.

The token model is a column expression from a sentence's tokens to the sum of their vectors; the default hashes features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.functions import vector as V
from folioscope.functions.models import Embedder
from folioscope.operators import chunking, graph
from folioscope.session import Settings

TokenModel = Callable[[Column], Column]


def token_sums(tokens: Column) -> Column:
    """The default token model: each token is one in the bucket that its hash names."""
    return V.hashed(F.transform(tokens, F.lower))


def identified(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with a text key; rows without one get a random identifier."""
    return docs.withColumn(key, F.coalesce(F.col(key).cast("string"), F.uuid()))


def windows(docs: DataFrame, key: str, text: str, settings: Settings) -> DataFrame:
    """(key, window, content, tokens): a document's only window is its text, longer ones are words joined by a space."""
    words = docs.select(key, F.col(text).alias("__text"), X.tokens(F.col(text)).alias("__w")).withColumn("__n", F.size("__w"))
    each = chunking.token_windows(words, "__n", settings.token_limit, settings.overlap)
    part = F.array_join(F.slice("__w", F.col("start") + 1, F.col("stop") - F.col("start")), " ")
    return each.select(key, F.col("k").alias("window"), F.when(F.col("__n") <= settings.token_limit, F.col("__text")).otherwise(part).alias("content"), (F.col("stop") - F.col("start")).alias("tokens"))


def sentences(content: Column, model: TokenModel) -> Column:
    """Structs of a window's sentences: text, n (tokens), v (the sum of their vectors)."""

    def described(s: Column) -> Column:
        tokens = X.tokens(s)
        return F.struct(s.alias("text"), F.size(tokens).alias("n"), model(tokens).alias("v"))

    return F.transform(X.sentences(content), described)


def with_similarity(items: Column) -> Column:
    """The sentences with sim, the cosine with the one before; null for the first."""

    def near(x: Column, i: Column) -> Column:
        before = F.get(items, i - 1)["v"]
        return F.struct(x["text"].alias("text"), x["n"].alias("n"), x["v"].alias("v"), F.when(i > 0, F.round(V.cosine(before, x["v"]), 6)).alias("sim"))

    return F.transform(items, near)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def window_chunks(content: Column, settings: Settings, model: TokenModel = token_sums) -> Column:
    """The chunks of one window: content, n_sentences, start, stop, sums."""

    def described(items: Column, x: Column) -> Column:
        inside = F.slice(items, x["first"] + 1, x["last"] - x["first"] + 1)
        none = F.transform(F.get(items, x["first"])["v"], lambda y: y * 0)
        sums = F.aggregate(inside, none, lambda s, y: F.zip_with(s, y["v"], lambda a, b: a + b))
        text = F.array_join(F.transform(inside, lambda y: y["text"]), " ")
        return F.struct(text.alias("content"), (x["last"] - x["first"] + 1).alias("n_sentences"), x["start"].alias("start"), x["stop"].alias("stop"), sums.alias("sums"))

    def cut(items: Column) -> Column:
        spans = chunking.merge_spans(chunking.greedy_spans(with_similarity(items), settings.chunk_limit, settings.similarity), settings.chunk_limit)
        return F.transform(spans, lambda x: described(items, x))

    return let(sentences(content, model), cut)


def semantic_chunks(content: Column, share: float = 0.95, model: TokenModel = token_sums) -> Column:
    """The chunks of one text, cut where neighbouring sentences are farther apart than the text's percentile: content,
    n_sentences. A text without sentences has none."""

    def described(items: Column, x: Column) -> Column:
        size = x["last"] - x["first"] + 1
        text = F.array_join(F.transform(F.slice(items, x["first"] + 1, size), lambda y: y["text"]), " ")
        return F.struct(text.alias("content"), size.alias("n_sentences"))

    def cut(items: Column) -> Column:
        far = F.transform(F.slice(items, 2, F.size(items)), lambda y: F.round(1 - y["sim"], 6))
        return F.when(F.size(items) > 0, let(chunking.semantic_spans(far, share), lambda spans: F.transform(spans, lambda x: described(items, x))))

    return let(sentences(content, model), lambda items: let(with_similarity(items), cut))


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings | None = None, model: TokenModel = token_sums) -> DataFrame:
    """(key, window, chunk_order, content, n_sentences, start, stop, sums): the chunks of all documents. start and stop are
    tokens of the window; sums / (stop - start) is the chunk's vector. A null or blank text has none."""
    settings = settings or Settings.from_environment()
    each = windows(docs, key, text, settings).select(key, "window", F.posexplode(window_chunks(F.col("content"), settings, model)).alias("i", "x"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("window", "i")) - 1
    return each.select(key, "window", number.alias("chunk_order"), "x.*")


def document_vectors(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings | None = None, model: TokenModel = token_sums) -> DataFrame:
    """(key, dim, mean): the mean of the tokens' vectors; of a document with several windows the mean of the windows' means."""
    each = windows(docs, key, text, settings or Settings.from_environment()).select(key, "tokens", model(X.tokens(F.col("content"))).alias("v"))
    means = each.select(key, F.transform("v", lambda x: x / F.col("tokens")).alias("v"))
    return V.mean_vectors(means, [key], "v")


def embedded(df: DataFrame, text: str, to: str, embedder: Embedder) -> DataFrame:
    """df with the vectors that a model gives to a text column, a batch at a time."""
    return df.withColumn(to, F.pandas_udf(embedder, "array<double>")(F.col(text)))


def late_chunks(docs: DataFrame, size: int, matrix: Callable[[str], tuple[list[str], np.ndarray]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_order, content, vector): stretches of so many tokens, each with the mean of its rows in the matrix that a model
    gives to the whole text's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, rows = matrix(batch.column(1)[i].as_py())
                at = np.arange(0, len(words), size)
                if len(at):
                    means = np.add.reduceat(rows, at, axis=0) / np.diff(np.append(at, len(words)))[:, None]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(at), i))), pa.array(np.arange(len(at), dtype=np.int32)), pa.array([" ".join(words[a : a + size]) for a in at]), pa.array(list(means), pa.list_(pa.float64()))], [key, "chunk_order", "content", "vector"])

    return docs.select(key, text).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, chunk_order int, content string, vector array<double>")


def process(docs: DataFrame, graph_name: str, settings: Settings | None = None, model: TokenModel = token_sums) -> dict[str, DataFrame]:
    """The rows to store for documents (doc_id, text, lang): chunks with vectors, document vectors, and triples. Writing them
    with sources.sinks is the caller's; each is lazy."""
    docs = identified(docs)
    made = chunks(docs, settings=settings, model=model).join(docs.select("doc_id", "lang"), "doc_id")
    vector = F.transform("sums", lambda x: (x / F.greatest(F.col("stop") - F.col("start"), F.lit(1))).cast("float"))
    part = F.concat_ws("/", "doc_id", F.col("chunk_order").cast("string"))
    stored = made.select("content", F.col("lang").alias("language"), part.alias("chunk_id"), "doc_id", "chunk_order", vector.alias("vector"))
    return {"chunks": stored, "documents": document_vectors(docs, settings=settings, model=model), "triples": graph.chunk_triples(made, graph_name)}
