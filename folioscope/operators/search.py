"""Search: nearest vectors, BM25, both fused, two levels, keywords. Queries are a stated set; if they are measured to be small,
they and what has a few rows for each of them are broadcast, and the collection is read in its own partitions. Larger sets
meet it in blocks, one pair of partitions a task, or by a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.functions.vector import certainty, cosine_of, dot
from folioscope.operators import kernels as K
from folioscope.operators.sizes import BROADCAST_BYTES, broadcast_if, fits


def top(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with rank; Spark keeps k rows a group and partition before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def rounded(x: Column, digits: int) -> Column:
    """A double rounded as SQL does: its product with a power of ten, halves away from zero. Spark's round goes by the shortest
    decimal, and so takes 0.79485 elsewhere."""
    y = F.abs(x * 10.0**digits)
    value = (F.floor(y) + F.when(y - F.floor(y) >= 0.5, 1).otherwise(0)) / F.lit(10.0**digits)
    return F.when(x < 0, -value).otherwise(value)


def sure(cos: Column) -> Column:
    """The certainty of a cosine of six digits, to six digits: rounded as a decimal, so that halves go up."""
    return F.round(certainty(cos).cast("decimal(18,8)"), 6).cast("double")


def fixed(number: Column) -> Column:
    """A number to three digits as C prints it: by its exact binary value. Java's format goes by the shortest decimal instead, and
    so takes halves such as 0.0045 elsewhere."""
    return F.when(number.isNotNull(), F.pandas_udf(lambda x: x.map("{:.3f}".format), "string")(number))


def results_page(hits: DataFrame, by: str, key: str) -> DataFrame:
    """(by, html): each query's hits (key, certainty, rank) as a list; names are escaped."""
    name = F.col(key).cast("string")
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        name = F.replace(name, F.lit(raw), F.lit(safe))
    item = F.concat(F.lit("<li>"), name, F.lit(" ("), fixed(F.col("certainty")), F.lit(")</li>"))
    items = hits.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))).alias("x"))
    return items.select(by, F.concat(F.lit("<ol>"), F.array_join("x.item", ""), F.lit("</ol>")).alias("html"))


def near_vectors(queries: DataFrame, rows: DataFrame, row_key: str, least: float | None = None) -> DataFrame:
    """Rows scored for each query (columns qid, qvec); rows has vector. With least, only those of that certainty and more: of a
    small query set other pairs aren't written at all. Without it every pair is asked for, and given."""
    asked = queries.select("qid", "qvec")
    if least is not None and fits(asked):
        return near_in_blocks(queries, rows, row_key, None, least=least).withColumn("certainty", sure(F.col("cos")))
    small, q, v = fits(asked), F.col("qvec"), F.col("vector")
    # squares are taken once a vector, not once a pair
    both = rows.withColumn("__vv", dot(v, v)).join(broadcast_if(small, asked.withColumn("__qq", dot(q, q))))
    scored = both.withColumn("cos", rounded(cosine_of(q, v, F.col("__qq"), F.col("__vv")), 6)).drop("qvec", "vector", "__qq", "__vv")
    scored = scored.withColumn("certainty", sure(F.col("cos")))
    return scored if least is None else scored.filter(F.col("certainty") >= least)


def certainty_report(queries: DataFrame, rows: DataFrame, row_key: str, above: float) -> DataFrame:
    """(qid, n, best, least): how many rows have more than that certainty, and their greatest and least cosine, as text; queries
    without any are left out. Pairs of a small query set aren't written: a task gives a row for each query."""
    if fits(queries.select("qid", "qvec")):
        qid, q = stated(queries)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, most, fewest = np.zeros(len(q), np.int64), np.full(len(q), -np.inf), np.full(len(q), np.inf)
            for batch in batches:
                batch = batch.filter(batch.column(0).is_valid())
                v = K.matrix(batch.column(0), batch.num_rows) if batch.num_rows else None
                for s, r in K.blocks(len(q), batch.num_rows):
                    cos = K.cosines(q[s], v[r])
                    more = K.millionths(cos) > round(1e6 * above)
                    n[s] += more.sum(1)
                    most[s] = np.maximum(most[s], np.where(more, cos, -np.inf).max(1))
                    fewest[s] = np.minimum(fewest[s], np.where(more, cos, np.inf).min(1))
            yield pa.RecordBatch.from_arrays([x.filter(pa.array(n > 0)) for x in (qid, pa.array(n), pa.array(most), pa.array(fewest))], ["qid", "n", "most", "fewest"])

        each = rows.select("vector").mapInArrow(run, f"qid {dict(queries.dtypes)['qid']}, n long, most double, fewest double")
    else:
        found = near_vectors(queries, rows, row_key, above).filter(F.col("certainty") > above)
        each = found.select("qid", F.lit(1).cast("long").alias("n"), F.col("cos").alias("most"), F.col("cos").alias("fewest"))
    summed = each.groupBy("qid").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.min("fewest").alias("fewest"))
    return summed.select("qid", "n", fixed(F.col("most")).alias("best"), fixed(F.col("fewest")).alias("least"))


def near_vector_topk(queries: DataFrame, rows: DataFrame, row_key: str, k: int = 3, least: float | None = None) -> DataFrame:
    """(qid, columns of rows but vector, cos, certainty, rank). Queries measured to be small are compared batch by batch, and
    only the k nearest of a batch leave it; larger sets meet the rows pair by pair."""
    if fits(queries.select("qid", "qvec")):
        near = near_in_blocks(queries, rows, row_key, k).withColumn("certainty", sure(F.col("cos")))
        near = near if least is None else near.filter(F.col("certainty") >= least)
    else:
        near = near_vectors(queries, rows, row_key, least)
    return top(near, ["qid"], [F.desc("cos"), F.col(row_key)], k)


def hybrid_topk(queries: DataFrame, rows: DataFrame, key: str, text: str, k: int = 3, alpha: float = 0.25) -> DataFrame:
    """(qid, key, score, rank): the best rows by the fused score. queries: qid, query, qvec (measured to be small); rows: key,
    text, vector.

    No pair is written: texts are read once, into the postings of the queries' terms, which are kept on disk; from these a
    task finds each query's bounds, and then its k best rows by both scores."""
    asked = queries.select("qid", "qvec", X.terms(F.col("query")).alias("w")).toArrow().combine_chunks()
    words, size = K.words_of(_flat(asked["qid"]), asked["w"].to_pylist()), max((len(x) for x in asked["qvec"].to_pylist() if x is not None), default=0)
    q = np.array([[np.nan] * size if x is None else x for x in asked["qvec"].to_pylist()], np.float64).reshape(len(words.qid), size)
    index, model = indexed(rows, key, text, words, ["vector"], kept=True)
    names = [key, "vector", "n", "ids", "tfs", "lens"]

    def scored(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """From which row on, and (queries, rows) of cosines and of keyword scores; NaN without one."""
        valid = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        v = np.full((batch.num_rows, size), np.nan)
        if valid.any():
            v[valid] = K.matrix(batch.column(1).filter(pa.array(valid)), valid.sum())
        none = np.isnan(q).any(1)
        for at, to, found in K.keyword_scores(batch.num_rows, *model.weights(*(batch.column(i) for i in range(2, 6))), words):
            cos = K.cosines(q, v[at:to])
            cos[none], cos[:, ~valid[at:to]] = np.nan, np.nan
            yield at, cos, np.where(np.isfinite(found), found, np.nan).T

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full((2, len(q)), np.inf), np.full((2, len(q)), -np.inf)
        for batch in batches:
            for _, *both in scored(batch):
                for i, x in enumerate(both):
                    low[i], high[i] = np.fmin(low[i], np.fmin.reduce(x, axis=1)), np.fmax(high[i], np.fmax.reduce(x, axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.arange(len(q), dtype=np.int32), *low, *high)], ["q", "a", "b", "c", "d"])

    found = index.select(*names).mapInArrow(bounds, "q int, a double, b double, c double, d double").groupBy("q").agg(F.min("a"), F.min("b"), F.max("c"), F.max("d")).collect()
    limits = np.array([tuple(r)[1:] for r in sorted(found)], np.float64).reshape(len(found), 4)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = K.Best(k, len(q))
        for batch in batches:
            batch = K.ordered(batch.filter(batch.column(0).is_valid()), key)
            for at, *both in scored(batch):
                total = np.zeros(both[0].shape)
                for i, (x, share) in enumerate(zip(both, (alpha, 1 - alpha), strict=True)):
                    low, high = limits[:, i, None], limits[:, i + 2, None]
                    value = np.divide(x - low, high - low, out=np.ones_like(x), where=high > low)
                    total += share * np.where(np.isnan(x), 0.0, value)
                total = np.where(np.isnan(both[0]) & np.isnan(both[1]), -np.inf, K.rounded(total, 4))
                which, place = K.best_cells(total, k)
                kept.add(which, batch.select([key]).take(pa.array(at + place)), total[which, place])
        yield from kept.rows(words.qid, "score")

    nearest = index.select(*names).mapInArrow(best, f"qid {dict(queries.dtypes)['qid']}, `{key}` {dict(rows.dtypes)[key]}, score double")
    return top(nearest, ["qid"], [F.desc("score"), F.col(key)], k)


def _flat(column: pa.ChunkedArray) -> pa.Array:
    found = column.combine_chunks()
    return found if isinstance(found, pa.Array) else pa.concat_arrays(found.chunks)


def vocabulary(queries: DataFrame) -> K.Words:
    """The terms of queries (qid, query) that are measured to be small."""
    asked = queries.select("qid", X.terms(F.col("query")).alias("w")).toArrow()
    return K.words_of(_flat(asked["qid"]), asked["w"].to_pylist())


def indexed(docs: DataFrame, key: str, text: str, words: K.Words, other: list[str], k1: float = 1.2, b: float = 0.75, kept: bool = False, repeats: bool | None = None) -> tuple[DataFrame, K.Bm25]:
    """(key, other, n, ids, tfs, lens): documents with their length and the postings of the terms in words, and what weighs them by
    the statistics of all documents. Nothing but counts is shuffled, unless documents share a key: their postings are brought
    together as those of one, with the lengths of their texts in lens. kept: on disk, for several uses. repeats: whether documents share a key, if
    that is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *K.postings(batch.column(batch.num_columns - 1), words)], [*batch.schema.names[:-1], "n", "ids", "tfs"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (key, *other)), "n int, ids array<int>, tfs array<int>"])
    each = docs.select(key, *other, X.terms(F.col(text)).alias("w")).mapInArrow(run, schema)
    if kept:
        each = each.persist(StorageLevel.DISK_ONLY)
    twice = docs.groupBy(F.col(key).alias("__key")).count().filter("count > 1").select("__key")
    none = F.lit(None).cast("array<int>")
    single, groups = each, None
    if repeats or (repeats is None and twice.head(1)):
        shared = broadcast_if(fits(twice), twice)
        same = F.col(key).eqNullSafe(F.col("__key"))
        single, several = each.join(shared, same, "left_anti"), each.join(shared, same, "left_semi")
        groups = several.select(F.col(key).alias("__key"), "n", F.explode(F.arrays_zip("ids", "tfs")).alias("x")).groupBy("__key", "n", F.col("x.ids").alias("id")).agg(F.sum("x.tfs").cast("int").alias("tf"))
        sizes = several.select(F.explode(F.array(F.struct(F.lit(-2).alias("id"), F.lit(1).cast("long").alias("n")), F.struct(F.lit(-1).alias("id"), F.col("n").cast("long").alias("n")))).alias("x")).select("x.id", "x.n")
    rows = single.withColumn("lens", none)
    if groups is not None:
        listed = groups.groupBy("__key").agg(F.collect_list(F.struct("id", "tf", "n")).alias("x")).select("__key", F.col("x.id").alias("ids"), F.col("x.tf").alias("tfs"), F.col("x.n").alias("lens"))
        # without other columns, documents of one key are one row
        several = several.select(key, *other, "n") if other else several.groupBy(key).agg(F.max("n").alias("n"))
        rows = rows.unionByName(several.join(listed, same, "left").select(key, *other, "n", "ids", "tfs", "lens"))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(words.terms), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(1).flatten().to_numpy(zero_copy_only=False), minlength=len(df))[: len(df)]
            n += (batch.num_rows, pc.sum(batch.column(0)).as_py() or 0)
        used = np.concatenate(([0, 1], 2 + np.flatnonzero(df)))
        yield pa.RecordBatch.from_arrays([pa.array(used - 2, pa.int32()), pa.array(np.concatenate((n, df))[used])], ["id", "n"])

    found = single.select("n", "ids").mapInArrow(counts, "id int, n long")
    if groups is not None:
        found = found.unionByName(groups.groupBy("id").agg(F.count(F.lit(1)).alias("n")))
        found = found.unionByName(sizes)
    sums = {r["id"]: r["n"] for r in found.groupBy("id").agg(F.sum("n").alias("n")).collect()}
    df, total = np.array([sums.get(i, 0) for i in range(len(words.terms))], np.float64), sums.get(-2) or 0
    return rows, K.Bm25(np.log(1 + (total - df + 0.5) / (df + 0.5)), (sums.get(-1) or 0) / total if total else 1.0, k1, b)


def bm25_topk(queries: DataFrame, docs: DataFrame, key: str, text: str, k: int = 5, digits: int = 4) -> DataFrame:
    """(qid, key, bm25, rank): the best documents by BM25 of so many digits. Queries measured to be small are scored where the
    documents lie, and a task gives only the k best of each."""
    if not fits(queries.select("qid", "query")):
        return top(bm25(queries, docs, key, text).withColumn("bm25", rounded(F.col("bm25"), digits)), ["qid"], [F.desc("bm25"), F.col(key)], k)
    words = vocabulary(queries)
    index, model = indexed(docs, key, text, words, [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = K.Best(k, len(words.qid))
        for batch in batches:
            batch = K.ordered(batch, key)
            for at, _, found in K.keyword_scores(batch.num_rows, *model.weights(*(batch.column(i) for i in range(1, 5))), words):
                score = np.where(np.isfinite(found), K.rounded(found, digits), -np.inf).T
                which, place = K.best_cells(score, k)
                best.add(which, batch.select([key]).take(pa.array(at + place)), score[which, place])
        yield from best.rows(words.qid, "bm25")

    found = index.select(key, "n", "ids", "tfs", "lens").mapInArrow(run, f"qid {dict(queries.dtypes)['qid']}, `{key}` {dict(docs.dtypes)[key]}, bm25 double")
    return top(found, ["qid"], [F.desc("bm25"), F.col(key)], k)


def postings(docs: DataFrame, key: str, text: str, only: DataFrame | None = None) -> DataFrame:
    """(key, term, tf, length): an inverted index with the documents' lengths; of the terms in only, if it is given."""
    words = docs.select(key, X.terms(F.col(text)).alias("w"))
    each = words.select(key, F.size("w").alias("length"), F.explode("w").alias("term"))
    if only is not None:
        each = each.join(only, "term", "left_semi")
    return each.groupBy(key, "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(queries: DataFrame, docs: DataFrame, key: str, text: str, k1: float = 1.2, b: float = 0.75, pairs: DataFrame | None = None, repeats: bool | None = None) -> DataFrame:
    """(qid, key, bm25) for documents with a term of the query (columns qid, query). Other terms than the queries' are gone
    before anything is counted or shuffled; corpus statistics are of all documents. pairs (qid, key, text), if given, are the
    only ones that are scored, and of other documents nothing is shuffled but counts of terms. repeats: whether documents
    share a key, if that is known; texts are then looked for in docs again."""
    asked = queries.select("qid", F.explode(F.array_distinct(X.terms(F.col("query")))).alias("term"))
    small = fits(asked)
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avgdl")))
    if pairs is not None and small:
        words = vocabulary(queries)
        _, model = indexed(docs, key, text, words, [], k1, b, repeats=repeats)
        known = docs.sparkSession.createDataFrame(pa.table({"term": words.terms, "idf": model.idf}), "term string, idf double")
        weights = asked.join(F.broadcast(known), "term").withColumn("avgdl", F.lit(float(model.avgdl)))
        texts = pairs.select(key, text).dropDuplicates([key])
        if repeats is not False:
            names = texts.select(key)
            texts = docs.join(broadcast_if(fits(names), names), key, "left_semi")
        used = postings(texts, key, text, F.broadcast(known.select("term")))
        met = used.join(pairs.select("qid", key).distinct(), key).join(F.broadcast(weights), ["qid", "term"])
        return met.groupBy("qid", key).agg(rounded(F.sum(part), 6).alias("bm25"))
    used = postings(docs, key, text, broadcast_if(small, asked.select("term").distinct()))
    stats = docs.select(F.size(X.terms(F.col(text))).alias("n")).agg(F.count(F.lit(1)).alias("N"), F.avg("n").alias("avgdl"))
    df = used.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = asked.join(df, "term").join(F.broadcast(stats)).withColumn("idf", F.log(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    # weights has no more rows than asked, stats has one
    found = used.join(broadcast_if(small, weights.drop("df", "N")), "term").groupBy("qid", key).agg(rounded(F.sum(part), 6).alias("bm25"))
    return found if pairs is None else found.join(pairs.select("qid", key), ["qid", key], "left_semi")


def fuse(vector: DataFrame, keyword: DataFrame, key: str, alpha: float = 0.25, queries: DataFrame | None = None) -> DataFrame:
    """(qid, key, score): alpha times the vector score plus the rest times the keyword score, each scaled to 0 to 1 by its
    least and greatest for the query (1 if these are equal); a missing score is 0. With the queries (column qid) given, their
    bounds, one row each, can be broadcast."""
    small = queries is not None and fits(queries.select("qid"), BROADCAST_BYTES // 4)

    def scaled(df: DataFrame, c: str) -> DataFrame:
        bounds = df.groupBy("qid").agg(F.min(c).alias("lo"), F.max(c).alias("hi"))
        value = F.when(F.col("hi") > F.col("lo"), (F.col(c) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
        return df.join(broadcast_if(small, bounds), "qid").select("qid", key, value.alias(c))

    both = scaled(vector, "cos").join(scaled(keyword, "bm25"), ["qid", key], "full")
    return both.select("qid", key, rounded(alpha * F.coalesce("cos", F.lit(0.0)) + (1 - alpha) * F.coalesce("bm25", F.lit(0.0)), 6).alias("score"))


def keyword(docs: DataFrame, text: str, words: str) -> DataFrame:
    """Documents whose text has the words, case aside; signs of patterns have no meaning."""
    return docs.filter(F.contains(F.lower(text), F.lit(words.lower())))


def fetch(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first rows by order: a report of bounded size. Spark keeps that many of each partition."""
    return df.orderBy(*order).limit(limit)


def chunks_of(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """chunks (chunk_id) with doc_id, the part of their name before the first stroke, of the documents (doc_id) given."""
    return chunks.withColumn("doc_id", F.split_part("chunk_id", F.lit("/"), F.lit(1))).join(documents.select("doc_id").distinct(), "doc_id", "left_semi")


def asked(queries: DataFrame, query: str = "query") -> DataFrame:
    """Queries that aren't blank."""
    return queries.filter(F.trim(F.coalesce(F.col(query), F.lit(""))) != "")


def page(queries: DataFrame, rows: DataFrame, key: str, text: str, least: float = 0.7, k: int = 5) -> DataFrame:
    """(qid, key, cos, certainty, score, explain, rank): the search page's list. queries: qid, query, like, qvec; rows: key,
    text, vector. Of the rows whose text has like, case aside, those with enough certainty, the nearest k; blank queries
    have none. Words are looked for before vectors are compared."""
    some = asked(queries).select("qid", "qvec", F.lower("like").alias("__like"))
    words = some.select("qid", "__like")
    # case is taken away once a row, not once a pair
    lower = rows.select(key, "vector", F.lower(text).alias("__text"))
    found = lower.join(broadcast_if(fits(words), words), F.contains("__text", F.col("__like")))
    scored = paired(some, found.select("qid", key, "vector"))
    scored = scored.withColumn("certainty", sure(F.col("cos"))).filter(F.col("certainty") >= least)
    best = top(scored, ["qid"], [F.desc("cos"), F.col(key)], k)
    told = F.concat(F.lit("distance "), fixed(1 - F.col("cos")), F.lit(", certainty "), fixed(F.col("certainty")))
    return best.select("qid", key, "cos", "certainty", fixed(F.col("certainty")).alias("score"), told.alias("explain"), "rank")


def paired(queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (qid, ..., vector) with cos, the cosine with their query, instead of vector; none without a vector."""
    asked = queries.select("qid", "qvec")
    if fits(asked):
        return cosines(asked.filter("qvec IS NOT NULL"), pairs.join(F.broadcast(asked.filter("qvec IS NOT NULL").select("qid")), "qid", "left_semi"))
    q, v = F.col("qvec"), F.col("vector")
    return pairs.filter("vector IS NOT NULL").join(asked, "qid").withColumn("cos", rounded(cosine_of(q, v, dot(q, q), dot(v, v)), 6)).drop("qvec", "vector")


def layered_hybrid(queries: DataFrame, parents: DataFrame, children: DataFrame, parent: str, child: str, text: str, k_parents: int = 10, k: int = 3, alpha: float = 0.25, embed: Callable[[Column], Column] | None = None, repeats: bool | None = None) -> DataFrame:
    """(mode, qid, parent, child, score, rank): within each query's best parents, the nearest children (mode vector) and the
    best by the fused score (mode hybrid). queries: qid, query, qvec; parents and children have vector, children also
    parent and text. Children are filtered before they are scored, and before embed, if it is given, makes their vectors of
    their text; BM25's statistics are those of all children. repeats: whether children share a name, if that is known."""
    small = fits(queries.select("qid"), BROADCAST_BYTES // (4 * k_parents))
    best = near_vector_topk(queries, parents, parent, k_parents).select("qid", parent)
    pool = children.join(broadcast_if(small, best), parent)
    pool = pool.withColumn("vector", embed(F.col(text))) if embed else pool
    # both are used several times, and have rows of the best parents only
    met = paired(queries, pool.select("qid", parent, child, text, "vector")).persist()
    near = met.drop(text)
    words = bm25(queries.select("qid", "query"), children.select(child, text), child, text, pairs=met.select("qid", child, text), repeats=repeats).persist()
    fused = fuse(near, words, child, alpha, queries).withColumn("score", rounded(F.col("score"), 4)).join(near.select("qid", child, parent), ["qid", child])
    of = lambda rows, mode: top(rows.select("qid", parent, child, "score"), ["qid"], [F.desc("score"), F.col(child)], k).withColumn("mode", F.lit(mode))
    return of(near.withColumn("score", F.col("cos")), "vector").unionByName(of(fused, "hybrid"))


def stated(queries: DataFrame) -> tuple[pa.Array, np.ndarray]:
    """The names and vectors of queries that are measured to be small; those without a vector are left out."""
    rows = queries.select("qid", "qvec").filter(F.col("qvec").isNotNull()).toArrow()
    qid = rows["qid"].combine_chunks()
    return qid, np.array(rows["qvec"].to_pylist(), np.float64).reshape(len(qid), -1) if len(qid) else np.zeros((0, 0))


def near_in_blocks(queries: DataFrame, rows: DataFrame, key: str, k: int | None, least: float = 0.0, within: tuple[str, dict] | None = None) -> DataFrame:
    """(qid, columns of rows but vector, cos): the k nearest rows that a task sees of each query (None: all), of at least that
    certainty; queries are measured to be small. One matrix product for a block of queries and rows. within: a column of
    rows, and for each of its values the names of the queries that meet its rows; the others meet none."""
    qid, q = stated(queries)
    names = [key, *(c for c in rows.columns if c not in (key, "vector"))]
    by, meets = within or (None, {})
    if within:
        of: dict = {}
        for i, x in enumerate(qid.to_pylist()):
            of.setdefault(x, []).append(i)
        meets = {v: np.array([i for x in xs for i in of.get(x, [])], np.int64) for v, xs in meets.items()}

    def shared(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of queries and of rows that meet."""
        if by is None:
            yield np.arange(len(q)), np.arange(batch.num_rows)
            return
        group = batch.column(batch.schema.get_field_index(by)).dictionary_encode()
        at = pc.fill_null(group.indices, -1).to_numpy(zero_copy_only=False)
        order = np.argsort(at, kind="stable")
        for i, value in enumerate(group.dictionary.to_pylist()):
            if len(meets.get(value, ())):
                yield meets[value], order[slice(*np.searchsorted(at[order], [i, i + 1]))]

    def found(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Numbers of queries and of rows of a batch, and their cosines."""
        v = K.matrix(batch.column(len(names)), batch.num_rows)
        for which, at in shared(batch):
            for s, r in K.blocks(len(which), len(at)):
                cos = K.cosines(q[which[s]], v[at[r]])
                # in ten-millionths; a certainty is rounded to six digits, halves up
                score = cos if least <= 0 else np.where(np.round(5e6 * (1 + cos)) >= np.round(1e7 * least) - 5, cos, -np.inf)
                a, b = K.best_cells(score, k) if k is not None else np.nonzero(score > -np.inf)
                yield which[s][a], at[r][b], cos[a, b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = K.Best(k, len(q)) if k is not None else None
        for batch in batches:
            batch = batch.filter(batch.column(len(names)).is_valid())
            if not batch.num_rows or not len(q):
                continue
            batch = K.ordered(batch, key)
            plain = batch.select(names)
            for which, at, cos in found(batch):
                if best:
                    best.add(which, plain.take(pa.array(at)), cos)
                    continue
                for i in range(0, len(which), 1 << 16):
                    s = slice(i, i + (1 << 16))
                    yield pa.RecordBatch.from_arrays([qid.take(pa.array(which[s])), *plain.take(pa.array(at[s])).columns, pa.array(cos[s])], ["qid", *names, "cos"])
        if best:
            yield from best.rows(qid, "cos")

    kinds = dict(rows.dtypes)
    schema = ", ".join([f"qid {dict(queries.dtypes)['qid']}", *(f"`{c}` {kinds[c]}" for c in names), "cos double"])
    return rows.select(*names, "vector").mapInArrow(run, schema)


def cosines(queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (qid, ..., vector) with cos instead of vector; queries are measured to be small."""
    qid, q = stated(queries)
    of = {x: i for i, x in enumerate(qid.to_pylist())}
    names = ["qid", *(c for c in pairs.columns if c not in ("qid", "vector"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(len(names)).is_valid())
            if batch.num_rows:
                at = batch.column(0).dictionary_encode()
                a = q[np.array([of[x] for x in at.dictionary.to_pylist()])[at.indices.to_numpy()]]
                v = K.matrix(batch.column(len(names)), batch.num_rows)
                length = np.sqrt(K.squares(a) * K.squares(v))
                cos = K.rounded(np.divide((a * v).sum(1), length, out=np.zeros_like(length), where=length > 0), 6)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(cos)], [*names, "cos"])

    kinds = dict(pairs.dtypes)
    return pairs.select(*names, "vector").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "cos double"]))


def layered(queries: DataFrame, parents: DataFrame, children: DataFrame, parent: str, child: str, k_parents: int, k: int) -> DataFrame:
    """(qid, parent, child, cos, rank): the best children of each query's best parents. Both have vector, children also
    parent."""
    small = fits(queries.select("qid"), BROADCAST_BYTES // (4 * k_parents))
    best = near_vector_topk(queries, parents, parent, k_parents).select("qid", parent)
    asked = queries.select("qid", "qvec")
    if small and fits(asked):
        meets: dict = {}
        for r in best.collect():  # k_parents rows a query
            meets.setdefault(r[parent], []).append(r["qid"])
        near = near_in_blocks(queries, children, child, k, within=(parent, meets)).withColumn("certainty", sure(F.col("cos")))
        return top(near, ["qid"], [F.desc("cos"), F.col(child)], k)
    # a child meets the queries of its parent only
    pool = children.join(broadcast_if(small, best), parent).join(broadcast_if(fits(asked), asked), "qid")
    q, v = F.col("qvec"), F.col("vector")
    scored = pool.withColumn("cos", rounded(cosine_of(q, v, dot(q, q), dot(v, v)), 6)).drop("qvec", "vector").withColumn("certainty", sure(F.col("cos")))
    return top(scored, ["qid"], [F.desc("cos"), F.col(child)], k)
