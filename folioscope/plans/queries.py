"""The catalogue of queries: each with the operators it shows and, where SQL can tell it, the same in DuckDB's SQL.

Queries of searches are a stated set: the vectors whose id is divisible by 100, or all benchmark questions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import models
from folioscope.functions import text as X
from folioscope.functions import vector as V
from folioscope.operators import chunking, graph, ingest, linking, maintenance, monitoring, search
from folioscope.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    return rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("vector").alias("qvec")), rows


_COS = "round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6)"
_SCORED = f"s AS (SELECT q.vec_id AS qid, e.vec_id, e.label, {_COS} AS cos FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0)"
_TOKENS = r"list_filter(regexp_split_to_array(coalesce({0}, ''), '[ \t\n\r\f]+'), lambda x: x != '')"
_TERMS = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x != '')"


@query(f"WITH {_SCORED} SELECT qid, vec_id, label, cos, round(((1 + cos) / 2)::DECIMAL(18, 8), 6)::DOUBLE AS certainty, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= 3")
def near_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.near_vector_topk(*vectors(spark, sf_dir), "vec_id")


@query(f"WITH {_SCORED} SELECT qid, vec_id, label, cos, round(((1 + cos) / 2)::DECIMAL(18, 8), 6)::DOUBLE AS certainty FROM s WHERE round(((1 + cos) / 2)::DECIMAL(18, 8), 6)::DOUBLE >= 0.7")
def near_vector_certainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.near_vectors(*vectors(spark, sf_dir), "vec_id", least=0.7)


@query(f"WITH {_SCORED} SELECT qid, vec_id, label, cos, round(((1 + cos) / 2)::DECIMAL(18, 8), 6)::DOUBLE AS certainty, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, vec_id)::INT AS rank FROM s WHERE label IN (1, 3, 5) QUALIFY rank <= 5")
def near_vector_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, rows = vectors(spark, sf_dir)
    return search.near_vector_topk(asked, rows.filter(F.col("label").isin(1, 3, 5)), "vec_id", 5)


@query(f"WITH {_SCORED} SELECT qid, count(*) AS n, format('{{:.3f}}', max(cos)) AS best, format('{{:.3f}}', min(cos)) AS least FROM s WHERE round(((1 + cos) / 2)::DECIMAL(18, 8), 6)::DOUBLE > 0.6 GROUP BY qid")
def certainty_threshold_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.certainty_report(*vectors(spark, sf_dir), "vec_id", 0.6)


@query("SELECT label, dim::INT - 1 AS dim, round(avg(x::DOUBLE), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS dim FROM embeddings) GROUP BY label, dim")
def doc_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.mean_vectors(table(spark, sf_dir, "embeddings"), ["label"], "embedding").withColumn("mean", F.round("mean", 6))


@query("""SELECT label, dim::INT - 1 AS dim, round(sum(w * x::DOUBLE) / greatest(sum(w), 1e-9), 6) AS mean
FROM (SELECT label, (CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE 1.0 END)::DOUBLE AS w, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS dim FROM embeddings) GROUP BY label, dim""")
def masked_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return V.mean_vectors(rows, ["label"], "embedding", F.when(F.col("vec_id") % 3 == 0, 0.0).otherwise(1.0)).withColumn("mean", F.round("mean", 6))


def _centroids(rows: DataFrame) -> DataFrame:
    means = V.mean_vectors(rows, ["label"], "vector").withColumn("mean", F.round("mean", 6))
    return means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "mean"))).alias("v")).select("label", F.col("v.mean").alias("vector"))


@query(f"""WITH c AS (SELECT label, list(mean ORDER BY dim) AS v FROM (SELECT label, dim, round(avg(x::DOUBLE), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS dim FROM embeddings) GROUP BY label, dim) GROUP BY label),
p AS (SELECT q.vec_id AS qid, c.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], c.v), 6) DESC, c.label) AS r FROM embeddings q, c WHERE q.vec_id % 100 = 0 QUALIFY r <= 2),
{_SCORED}
SELECT 'layered' AS mode, qid, label, vec_id, cos, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, vec_id)::INT AS rank FROM s JOIN p USING (qid, label) QUALIFY rank <= 3
UNION ALL SELECT 'flat' AS mode, qid, label, vec_id, cos, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= 3""")
def layered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, rows = vectors(spark, sf_dir)
    two = search.layered(asked, _centroids(rows), rows, "label", "vec_id", 2, 3).drop("certainty").withColumn("mode", F.lit("layered"))
    return two.unionByName(search.near_vector_topk(asked, rows, "vec_id").drop("certainty").withColumn("mode", F.lit("flat")))


_SIM = "c AS (SELECT vec_id, doc, round(list_cosine_similarity(embedding::DOUBLE[], (lag(embedding) OVER (PARTITION BY doc ORDER BY vec_id))::DOUBLE[]), 6) AS sim FROM (SELECT *, vec_id // 40 AS doc FROM embeddings))"


def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty vectors in a row stand for the sentences of a document."""
    rows = chunking.consecutive_similarity(table(spark, sf_dir, "embeddings").withColumn("doc", F.expr("vec_id div 40")), ["doc"], "vec_id", "embedding")
    return rows.select("vec_id", "doc", F.round("sim", 6).alias("sim"))


@query(f"WITH {_SIM} SELECT vec_id, doc, sim FROM c")
def consecutive_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar(spark, sf_dir)


_FOLD = f"""WITH RECURSIVE {_SIM}, r AS (SELECT doc, vec_id, 1 + vec_id % 40 AS n, sim, row_number() OVER (PARTITION BY doc ORDER BY vec_id) AS i FROM c),
f AS (SELECT doc, vec_id, n, i, 0 AS chunk, n AS tokens FROM r WHERE i = 1 UNION ALL
  SELECT r.doc, r.vec_id, r.n, r.i, f.chunk + (CASE WHEN f.tokens + r.n > 64 OR r.sim < 0.1 THEN 1 ELSE 0 END), CASE WHEN f.tokens + r.n > 64 OR r.sim < 0.1 THEN r.n ELSE f.tokens + r.n END FROM f JOIN r ON r.doc = f.doc AND r.i = f.i + 1)"""


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.greedy_chunks(_similar(spark, sf_dir).withColumn("n", 1 + F.col("vec_id") % 40), "doc", "vec_id", "n", "sim", 64, 0.1)


@query(f"{_FOLD} SELECT doc, vec_id, n, chunk::INT AS chunk FROM f")
def semantic_chunk_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folded(spark, sf_dir)


@query(f"""{_FOLD}, k AS (SELECT doc, chunk, sum(n) AS n, count(*) AS size, row_number() OVER (PARTITION BY doc ORDER BY chunk) AS i FROM f GROUP BY doc, chunk),
m AS (SELECT doc, chunk, n, size, i, 0 AS merged, n AS tokens FROM k WHERE i = 1 UNION ALL
  SELECT k.doc, k.chunk, k.n, k.size, k.i, m.merged + (CASE WHEN k.size = 1 AND m.tokens + k.n <= 96 THEN 0 ELSE 1 END), CASE WHEN k.size = 1 AND m.tokens + k.n <= 96 THEN m.tokens + k.n ELSE k.n END FROM m JOIN k ON k.doc = m.doc AND k.i = m.i + 1)
SELECT doc, merged::INT AS merged, sum(n)::BIGINT AS n_tokens, sum(size)::BIGINT AS n_sentences, min(chunk)::INT AS first_chunk FROM m GROUP BY doc, merged""")
def singleton_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.merged_chunks(_folded(spark, sf_dir), "doc", "n", 96)


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x != '') AS l FROM documents),
e AS (SELECT doc_id, unnest(l) AS sentence, unnest(range(len(l))) AS idx FROM s),
n AS (SELECT *, len(""" + _TOKENS.format("sentence") + r""")::INT AS n_tokens FROM e)
SELECT doc_id, idx::INT AS idx, sentence, n_tokens, (sum(n_tokens) OVER w)::INT AS stop, (sum(n_tokens) OVER w)::INT - n_tokens AS start FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY idx)""")
def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.sentence_spans(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""WITH d AS (SELECT doc_id, len({_TOKENS.format('text')})::INT AS n FROM documents)
SELECT doc_id, n, k::INT AS k, (k * 256)::INT AS start, least(k * 256 + 512, n)::INT AS stop FROM (SELECT doc_id, n, unnest(range(0, 1 + greatest(0, ceil((n - 512) / 256.0))::INT)) AS k FROM d WHERE n > 0)""")
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "documents").select("doc_id", F.size(X.tokens(F.col("text"))).alias("n"))
    return chunking.token_windows(counted, "n", 512)


@query(f"""WITH d AS (SELECT doc_id, {_TOKENS.format('text')} AS w FROM documents)
SELECT doc_id, k::INT AS k, (k * 512)::INT AS start, least(k * 512 + 512, len(w))::INT AS stop, md5(array_to_string(w[k * 512 + 1:k * 512 + 512], ' ')) AS content_md5 FROM (SELECT doc_id, w, unnest(range(0, ceil(len(w) / 512.0)::INT)) AS k FROM d)""")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("w"))
    return chunking.fixed_chunks(words, "w").select("doc_id", "k", "start", "stop", F.md5("content").alias("content_md5"))


@query(f"WITH {_SIM}, d AS (SELECT *, round(1 - sim, 6) AS distance FROM c) SELECT vec_id, doc, distance, coalesce(distance > quantile_cont(distance, 0.95) OVER (PARTITION BY doc), false) AS breaks FROM d")
def percentile_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _similar(spark, sf_dir).withColumn("distance", F.round(1 - F.col("sim"), 6))
    return chunking.percentile_breaks(rows, "doc", "distance").select("vec_id", "doc", "distance", F.col("__break").alias("breaks"))


_BM25 = f"""d AS MATERIALIZED (SELECT doc_id, {_TERMS.format('text')} AS w FROM documents),
q AS (SELECT DISTINCT item_id AS qid, unnest({_TERMS.format('text')}) AS term FROM benchmark),
st AS (SELECT count(*) AS N, avg(len(w)) AS avgdl FROM d),
p AS MATERIALIZED (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
k AS MATERIALIZED (SELECT qid, doc_id, round(sum(ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / avgdl))), 6) AS bm25 FROM q JOIN p USING (term) JOIN df USING (term), st GROUP BY qid, doc_id)"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


@query(f"WITH {_BM25} SELECT qid, doc_id, round(bm25, 4) AS bm25, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 4) DESC, doc_id)::INT AS rank FROM k QUALIFY rank <= 5")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25_topk(_questions(spark, sf_dir), table(spark, sf_dir, "documents"), "doc_id", "text", 5)


_HASHED = "list_transform(range(16), lambda i: len(list_filter({0}, lambda t: ('0x' || substr(md5(t), 1, 8))::UBIGINT % 16 = i))::DOUBLE)"


@query(f"""WITH {_BM25}, qv AS (SELECT item_id AS qid, {_HASHED.format('w')} AS v FROM (SELECT item_id, {_TERMS.format('text')} AS w FROM benchmark)),
dv AS MATERIALIZED (SELECT doc_id, {_HASHED.format('w')} AS v FROM d),
c AS MATERIALIZED (SELECT qid, doc_id, coalesce(round(CASE WHEN list_sum(qv.v) * list_sum(dv.v) > 0 THEN list_cosine_similarity(qv.v, dv.v) ELSE 0 END, 6), 0) AS cos FROM qv, dv),
cs AS (SELECT qid, doc_id, CASE WHEN max(cos) OVER w > min(cos) OVER w THEN (cos - min(cos) OVER w) / (max(cos) OVER w - min(cos) OVER w) ELSE 1 END AS x FROM c WINDOW w AS (PARTITION BY qid)),
ks AS (SELECT qid, doc_id, CASE WHEN max(bm25) OVER w > min(bm25) OVER w THEN (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w) ELSE 1 END AS y FROM k WINDOW w AS (PARTITION BY qid)),
h AS (SELECT qid, doc_id, round(0.25 * coalesce(x, 0) + 0.75 * coalesce(y, 0), 4) AS score FROM cs FULL JOIN ks USING (qid, doc_id))
SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank FROM h QUALIFY rank <= 3""")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", V.hashed(X.terms(F.col("text"))).alias("vector"))
    asked = _questions(spark, sf_dir).select("qid", "query", V.hashed(X.terms(F.col("query"))).alias("qvec"))
    return search.hybrid_topk(asked, docs, "doc_id", "text")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE lower(text) LIKE '%ing of%'")
def keyword_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.keyword(table(spark, sf_dir, "documents"), "text", "ing of").select("doc_id", "lang", "n_chars")


def _lcs_sql(a: str, b: str) -> str:
    """The longest common subsequence's length as nested folds; a row of hits a character of a."""
    row = "list_transform(string_split({b}, ''), lambda d: (CASE WHEN c = d THEN 1 ELSE 0 END)::BIGINT)".format(b=b)
    hits = f"list_transform(string_split({a}, ''), lambda c: {row})"
    cell = f"list_reduce(range(1, length({b}) + 1), lambda acc, j: list_append(acc, greatest(prev[j + 1], acc[len(acc)], CASE WHEN hit[j] = 1 THEN prev[j] + 1 ELSE 0 END)), [0::BIGINT])"
    return f"list_reduce({hits}, lambda prev, hit: {cell}, list_transform(range(length({b}) + 1), lambda z: 0::BIGINT))[length({b}) + 1]"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_name").distinct()


def _sharing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different names that share a word."""
    words = _names(spark, sf_dir).select("p_name", F.explode(X.terms(F.col("p_name"))).alias("w"))
    other = words.select(F.col("p_name").alias("other"), "w")
    return words.join(other, "w").filter("p_name < other").select(F.col("p_name").alias("a"), F.col("other").alias("b")).distinct()


_PAIRS = "n AS (SELECT DISTINCT p_name, unnest(string_split(p_name, ' ')) AS w FROM part), p AS MATERIALIZED (SELECT DISTINCT x.p_name AS a, y.p_name AS b FROM n x JOIN n y USING (w) WHERE x.p_name < y.p_name)"


@query(f"WITH {_PAIRS} SELECT a, b, round_even(200.0 * {_lcs_sql('a', 'b')} / (length(a) + length(b)), 0)::INT AS ratio FROM p")
def fuzzy_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sharing(spark, sf_dir).select("a", "b", X.ratio(F.col("a"), F.col("b")).alias("ratio"))


_SWAP = "SELECT a, array_to_string(list_reverse(string_split(b, ' ')), ' ') AS b FROM p"


@query(f"WITH {_PAIRS}, s AS ({_SWAP}), t AS (SELECT a, b, array_to_string(list_sort(string_split(lower(a), ' ')), ' ') AS x, array_to_string(list_sort(string_split(lower(b), ' ')), ' ') AS y FROM s) SELECT a, b, round_even(200.0 * {_lcs_sql('x', 'y')} / (length(x) + length(y)), 0)::INT AS ratio FROM t")
def token_sort_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    swapped = _sharing(spark, sf_dir).select("a", F.array_join(F.reverse(F.split("b", " ")), " ").alias("b"))
    return swapped.select("a", "b", X.token_sort_ratio(F.col("a"), F.col("b")).alias("ratio"))


@query(f"""WITH f AS (SELECT DISTINCT p_name FROM part WHERE p_type != 'SMALL' OR p_size < 5), l AS (SELECT DISTINCT string_split(p_name, ' ')[-1] AS w FROM f),
s AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS p_name FROM part)
SELECT p_name FROM f UNION ALL SELECT p_name FROM s WHERE NOT EXISTS (SELECT 1 FROM l WHERE round_even(200.0 * {_lcs_sql('p_name', 'w')} / (length(p_name) + length(w)), 0) >= 85)""")
def mention_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    full = parts.filter("p_type != 'SMALL' OR p_size < 5").select("p_name")
    return linking.reduce_mentions(full.unionByName(parts.select(F.explode(F.split("p_name", " ")).alias("p_name"))), "p_name")


@query(f"""WITH m AS (SELECT DISTINCT p_name AS mention FROM part), e AS (SELECT min(p_partkey) AS id, p_brand || ' ' || p_name AS name FROM part GROUP BY p_brand || ' ' || p_name),
mt AS (SELECT mention, unnest(string_split(mention, ' ')) AS t FROM m), et AS (SELECT DISTINCT id, name, unnest({_TERMS.format('name')}) AS t FROM e),
s AS (SELECT mention, id, name, round(count(*) / 2.0, 6) AS score FROM mt JOIN et USING (t) GROUP BY mention, id, name),
k AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY score DESC, id) AS r FROM s QUALIFY r <= 8),
z AS (SELECT *, array_to_string(list_sort({_TERMS.format('mention')}), ' ') AS x, array_to_string(list_sort(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda q: q != '')), ' ') AS y FROM k)
SELECT mention, id, name, score, round_even(200.0 * {_lcs_sql('y', 'x')} / (length(x) + length(y)), 0)::INT AS fuzzy FROM z WHERE score > 0.4 AND fuzzy >= 65""")
def candidate_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    known = parts.groupBy(F.concat_ws(" ", "p_brand", "p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    return linking.candidates(_names(spark, sf_dir).withColumnRenamed("p_name", "mention"), known, 8, 0.4, 65)


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 'um 1900' ELSE (1900 + c_custkey % 95)::VARCHAR END AS birth,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE (1940 + c_custkey % 60)::VARCHAR || '.0' END AS death FROM customer)
SELECT o_orderkey, c_custkey, birth, death FROM orders JOIN c ON o_custkey = c_custkey
WHERE coalesce(make_date(try_cast(split_part(death, '.', 1) AS INT), 1, 1) >= o_orderdate::DATE - 7300, true) AND coalesce(make_date(try_cast(split_part(birth, '.', 1) AS INT), 1, 1) <= o_orderdate::DATE - 7300, true)""")
def lifespan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    people = table(spark, sf_dir, "customer").select("c_custkey", F.when(key % 7 == 0, None).when(key % 11 == 0, "um 1900").otherwise((1900 + key % 95).cast("string")).alias("birth"), F.when(key % 5 == 0, None).otherwise(F.concat((1940 + key % 60).cast("string"), F.lit(".0"))).alias("death"))
    both = table(spark, sf_dir, "orders").join(people, F.col("o_custkey") == key)
    return both.filter(linking.alive("birth", "death", F.to_date("o_orderdate"))).select("o_orderkey", "c_custkey", "birth", "death")


@query("""WITH l AS (SELECT 'n' || n_nationkey AS part, 'LOC' AS kind, CASE WHEN n_nationkey % 4 = 0 THEN 'urn:other:' ELSE 'urn:place:' END || n_name AS url FROM nation
UNION ALL SELECT 's' || s_suppkey, 'ORG', 'urn:org:' || s_name FROM supplier UNION ALL SELECT 'c' || c_custkey, 'PER', CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'urn:person:' || c_name END FROM customer)
SELECT 'urn:part:' || part AS subject, CASE WHEN kind = 'LOC' THEN 'rico:hasPlace' ELSE 'rico:hasSubject' END AS predicate, url AS object FROM l
WHERE (kind = 'LOC' AND contains(url, ':place:')) OR (kind = 'ORG' AND contains(url, ':org:')) OR (kind = 'PER' AND contains(url, ':person:'))""")
def link_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s, c = (table(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    made = n.select(F.concat(F.lit("n"), "n_nationkey").alias("part"), F.lit("LOC").alias("kind"), F.concat(F.when(F.col("n_nationkey") % 4 == 0, "urn:other:").otherwise("urn:place:"), "n_name").alias("url"))
    made = made.unionByName(s.select(F.concat(F.lit("s"), "s_suppkey").alias("part"), F.lit("ORG").alias("kind"), F.concat(F.lit("urn:org:"), "s_name").alias("url")))
    made = made.unionByName(c.select(F.concat(F.lit("c"), "c_custkey").alias("part"), F.lit("PER").alias("kind"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("urn:person:"), "c_name")).alias("url")))
    return linking.link_triples(made, {"LOC": ":place:", "ORG": ":org:", "PER": ":person:"})


@query(r"""WITH c AS (SELECT doc_id AS part, 'PER' AS kind, 'urn:person:' || doc_id AS url, CASE WHEN doc_id % 4 = 0 THEN 'the ' || source WHEN doc_id % 4 = 1 THEN source END AS description FROM documents WHERE doc_id % 4 != 3
UNION ALL SELECT doc_id, 'ORG', 'urn:org:' || source, NULL FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'LOC', 'urn:place:' || lang, NULL FROM documents WHERE doc_id % 5 = 0),
w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents)
SELECT part, kind, url FROM c JOIN w ON part = doc_id WHERE kind != 'PER' OR list_has_any(w, regexp_extract_all(lower(coalesce(description, '')), '[\p{L}\p{N}_]+'))""")
def plausible_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People whom the default judge accepts, beside the organisations and places of the same text."""
    docs, d = table(spark, sf_dir, "documents"), F.col("doc_id")
    known = lambda kind, url, told: F.struct(F.lit(kind).alias("kind"), url.alias("url"), told.cast("string").alias("description"))
    told = F.when(d % 4 == 0, F.concat(F.lit("the "), "source")).when(d % 4 == 1, F.col("source"))
    each = F.array(
        F.when(d % 4 != 3, known("PER", F.concat(F.lit("urn:person:"), d), told)),
        F.when(d % 3 == 0, known("ORG", F.concat(F.lit("urn:org:"), "source"), F.lit(None))),
        F.when(d % 5 == 0, known("LOC", F.concat(F.lit("urn:place:"), "lang"), F.lit(None))),
    )
    found = docs.select(d.alias("part"), F.explode(F.array_compact(each)).alias("x")).select("part", "x.*")
    return linking.plausible(found, docs.select(d.alias("part"), "text"), models.overlap_judge).select("part", "kind", "url")


@query("""WITH c AS (SELECT doc_id, text AS content, lang, 'urn:doc:' || doc_id AS doc, 'urn:doc:' || doc_id || '/0' AS part FROM documents)
SELECT 'urn:graph' AS graph, doc AS subject, 'rico:hasOrHadPart' AS predicate, part AS object, NULL::VARCHAR AS lang FROM c UNION ALL SELECT 'urn:graph', part, 'rdf:type', 'rico:RecordPart', NULL FROM c
UNION ALL SELECT 'urn:graph', part, 'rico:textualValue', replace(replace(replace(replace(content, '/', ''), '{', ''), '}', ''), '\\', ''), lang FROM c""")
def chunk_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return graph.chunk_triples(docs.select("doc_id", F.lit(0).alias("chunk_order"), F.col("text").alias("content"), "lang"), "urn:graph")


@query("SELECT lang, source, count(*) AS n, count(quality) AS labelled, sum(toxic)::BIGINT AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (lang, source)")
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return both.rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("labelled"), F.sum("toxic").alias("toxic"))


@query("SELECT CASE WHEN lang IN ('de', 'fr', 'it') THEN lang ELSE 'other' END AS bucket, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY bucket")
def lang_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.when(F.col("lang").isin("de", "fr", "it"), F.col("lang")).otherwise("other").alias("bucket")
    return table(spark, sf_dir, "documents").groupBy(bucket).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT md5(text) AS key, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY text")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.keep_first(table(spark, sf_dir, "documents").select(F.md5("text").alias("key"), "doc_id", "source"), ["key"], "doc_id")


@query("SELECT strftime(o_orderdate, '%d.%m.%Y') AS day, max(o_orderkey) AS o_orderkey FROM orders GROUP BY day")
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "dd.MM.yyyy").alias("day"), "o_orderkey")
    return maintenance.last_write(rows, ["day"], "o_orderkey", "o_orderkey")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def processed_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.pending(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang")


@query("SELECT doc_id, l.doc_id IS NULL AS missing, quality FROM documents LEFT JOIN labels l USING (doc_id)")
def missing_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, lost = maintenance.split_missing(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return found.select("doc_id", F.lit(False).alias("missing"), "quality").unionByName(lost.select("doc_id", F.lit(True).alias("missing"), F.lit(None).cast("int").alias("quality")))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type")
def log_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.transitions(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


@query("""SELECT a.event_id AS purchase, arg_min(b.event_id, (abs(epoch_us(a.ts) - epoch_us(b.ts)), epoch_us(b.ts), b.event_id)) AS error, min(abs(epoch_us(a.ts) - epoch_us(b.ts)))::BIGINT AS micros
FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'error' GROUP BY a.event_id""")
def nearest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    left = e.filter("event_type = 'purchase'").withColumnRenamed("event_id", "purchase")
    return monitoring.nearest(left, e.filter("event_type = 'error'").withColumnRenamed("event_id", "error"), "user_id", "ts", "purchase", "error")


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS owner FROM events")
def propagate_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    marker = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return monitoring.filled(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], marker, "owner").select("event_id", "user_id", "owner")


@query("""WITH f AS (SELECT user_id, arg_min(value, (ts, event_id)) AS value, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id), k AS (SELECT o_custkey AS user_id, count(*) AS orders FROM orders GROUP BY o_custkey)
SELECT c_custkey AS user_id, event_id, value, orders FROM customer JOIN f ON f.user_id = c_custkey LEFT JOIN k ON k.user_id = c_custkey""")
def energy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("user_id"))
    metrics = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.struct("ts", "event_id").alias("at"))
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("long").alias("user_id")).agg(F.count(F.lit(1)).alias("orders"))
    return monitoring.report(docs, metrics, counts, "user_id", "at").select("user_id", "event_id", "value", "orders")


@query(r"""WITH l AS (SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ',' || lpad(((epoch_us(ts) // 1000) % 1000)::VARCHAR, 3, '0') || ' INFO: ' || CASE WHEN event_type = 'view' THEN 'HTTP Request: ' ELSE '' END || CASE WHEN event_type = 'error' THEN 'failed' ELSE 'Stored triples for chunk ' || user_id || '/' || event_id END AS value FROM events)
SELECT event_id, strptime(regexp_extract(value, '^([0-9-]{10} [0-9:]{8},[0-9]{3})', 1), '%Y-%m-%d %H:%M:%S,%g') AS ts, regexp_extract(value, 'chunk ([0-9]+)/', 1) AS root FROM l
WHERE regexp_matches(value, 'Stored triples for chunk [0-9]+/') AND NOT contains(value, 'HTTP Request:')""")
def log_regex_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" INFO: "), F.when(kind == "view", "HTTP Request: ").otherwise(""), F.when(kind == "error", "failed").otherwise(F.concat(F.lit("Stored triples for chunk "), "user_id", F.lit("/"), "event_id")))
    return monitoring.parsed(table(spark, sf_dir, "events").select("event_id", line.alias("value"))).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "root")


_TRIPLES = """t AS (SELECT 'r' || r_regionkey AS s, 'rdf:type' AS p, 'Region' AS o FROM region UNION ALL SELECT 'r' || r_regionkey, 'name', r_name FROM region
UNION ALL SELECT 'n' || n_nationkey, 'rdf:type', 'Nation' FROM nation UNION ALL SELECT 'n' || n_nationkey, 'name', n_name FROM nation UNION ALL SELECT 'n' || n_nationkey, 'within', 'r' || n_regionkey FROM nation
UNION ALL SELECT 's' || s_suppkey, 'rdf:type', 'Supplier' FROM supplier UNION ALL SELECT 's' || s_suppkey, 'name', s_name FROM supplier UNION ALL SELECT 's' || s_suppkey, 'seat', 'n' || s_nationkey FROM supplier)"""


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(name: str, mark: str, key: str, kind: str, label: str, edge: tuple[str, str, str] | None) -> DataFrame:
        pairs = [F.struct(F.lit(graph.TYPE).alias("predicate"), F.lit(kind).alias("object")), F.struct(F.lit("name").alias("predicate"), F.col(label).alias("object"))]
        if edge:
            pairs.append(F.struct(F.lit(edge[0]).alias("predicate"), F.concat(F.lit(edge[1]), edge[2]).alias("object")))
        return table(spark, sf_dir, name).select(F.concat(F.lit(mark), key).alias("subject"), F.explode(F.array(*pairs)).alias("x")).select("subject", "x.*")

    return of("region", "r", "r_regionkey", "Region", "r_name", None).unionByName(of("nation", "n", "n_nationkey", "Nation", "n_name", ("within", "r", "n_regionkey"))).unionByName(of("supplier", "s", "s_suppkey", "Supplier", "s_name", ("seat", "n", "s_nationkey")))


@query(f"WITH {_TRIPLES} SELECT s AS subject, p AS predicate, o AS object FROM t WHERE s IN (SELECT s FROM t WHERE p = 'rdf:type' AND o = 'Nation')")
def construct_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.of_type(_triples(spark, sf_dir), "Nation").select("subject", "predicate", "object")


@query(f"""WITH {_TRIPLES}, h AS (SELECT a.s, b.o AS nation, c.o AS region, d.o AS label FROM t k JOIN t a ON a.s = k.s AND a.p = 'rdf:type' JOIN t b ON b.s = a.s AND b.p = 'seat' LEFT JOIN t c ON c.s = b.o AND c.p = 'within' LEFT JOIN t d ON d.s = c.o AND d.p = 'name' WHERE k.p = 'rdf:type' AND k.o = 'Supplier')
SELECT DISTINCT subject, predicate, object FROM (SELECT s AS subject, 'seat' AS predicate, nation AS object FROM h UNION ALL SELECT nation, 'within', region FROM h UNION ALL SELECT region, 'name', label FROM h) WHERE object IS NOT NULL""")
def construct_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _triples(spark, sf_dir)
    start = t.filter((F.col("predicate") == graph.TYPE) & (F.col("object") == "Supplier")).select(F.col("subject").alias("s"))
    path = graph.hop(t, graph.hop(t, graph.hop(t, start, "s", "seat", "nation"), "nation", "within", "region", True), "region", "name", "label", True)
    made = F.array(*(F.struct(F.col(a).alias("subject"), F.lit(p).alias("predicate"), F.col(b).alias("object")) for a, p, b in (("s", "seat", "nation"), ("nation", "within", "region"), ("region", "name", "label"))))
    return path.select(F.explode(made).alias("x")).select("x.*").filter("object IS NOT NULL").distinct()


@query("""SELECT r_name, string_agg(DISTINCT n_name, '; ' ORDER BY n_name) AS nations, count(DISTINCT s_suppkey) AS suppliers FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_name NOT LIKE '%3' LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name""")
def group_concat_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    both = r.join(n.filter("n_name NOT LIKE '%3'"), F.col("n_regionkey") == F.col("r_regionkey"), "left").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    names = F.array_sort(F.collect_set("n_name"))
    return both.groupBy("r_name").agg(F.when(F.size(names) > 0, F.array_join(names, "; ")).alias("nations"), F.countDistinct("s_suppkey").alias("suppliers"))


@query("""SELECT n_name AS name_de, NULL::VARCHAR AS name_fr, 'nation' AS type, n_nationkey::VARCHAR AS identifier, 'nation ' || n_name AS embed_input, length(n_name) > 8 AS flagged FROM nation
UNION ALL SELECT r_name, lower(r_name), 'region', r_regionkey::VARCHAR, 'region ' || r_name, length(r_name) > 8 FROM region""")
def gazetteer_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name_de"), F.lit("nation").alias("type"), F.col("n_nationkey").cast("string").alias("identifier"))
    r = table(spark, sf_dir, "region").select(F.col("r_name").alias("name_de"), F.lower("r_name").alias("name_fr"), F.lit("region").alias("type"), F.col("r_regionkey").cast("string").alias("identifier"))
    every = n.unionByName(r, allowMissingColumns=True)
    return every.select("name_de", "name_fr", "type", "identifier", readers.embedding_input(F.col("type"), F.col("name_de")).alias("embed_input"), (F.length("name_de") > 8).alias("flagged"))


_LIVES = ["1857-1927", "um 1850", "1850/51-1900", "18501-", "", "1900", "?-1912"]


@query(f"""WITH v AS (SELECT unnest([{", ".join(f"'{x}'" for x in _LIVES)}]) AS life), p AS (SELECT life, split_part(life, '-', 1) AS b, CASE WHEN contains(life, '-') THEN substr(life, strpos(life, '-') + 1) ELSE '' END AS d FROM v)
SELECT life, substr(regexp_extract(b, '([0-9]+)', 1), 1, 4) AS birth, substr(regexp_extract(d, '([0-9]+)', 1), 1, 4) AS death, CASE WHEN contains(b, '/') THEN 'uncertain' ELSE '' END AS birth_flag, CASE WHEN contains(d, '/') THEN 'uncertain' ELSE '' END AS death_flag FROM p""")
def bio_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(x,) for x in _LIVES], "life string").withColumn("p", F.split("life", "-", 2))
    b, d = F.col("p")[0], F.coalesce(F.get("p", F.lit(1)), F.lit(""))
    flag = lambda c: F.when(F.contains(c, F.lit("/")), "uncertain").otherwise("")
    return rows.select("life", X.year(b).alias("birth"), X.year(d).alias("death"), flag(b).alias("birth_flag"), flag(d).alias("death_flag"))


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading, regexp_extract(html, '<a href="([^"]*)"', 1) AS first_link,
((length(html) - length(replace(html, '<a href=', ''))) / 8)::INT AS n_links, regexp_extract(url, '/([0-9]+)', 1) AS number FROM pages""")
def html_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = readers.html_parts(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", p["title"].alias("title"), p["heading"].alias("heading"), p["first_link"].alias("first_link"), p["n_links"].alias("n_links"), F.regexp_extract("url", "/([0-9]+)", 1).alias("number"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN NULL ELSE role END AS name, CASE WHEN turn % 4 IN (2, 3) THEN NULL ELSE 'urn:' || conv_id END AS url, turn % 4 NOT IN (2, 3) AS kept FROM conversations""")
def llm_json_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as models give them: talk around the object, curly quotes, trailing commas, Python's constants, or none."""
    kind = F.col("turn") % 4
    url = F.when(kind == 2, "None").otherwise(F.concat(F.lit("“urn:"), "conv_id", F.lit("”")))
    answer = F.when(kind == 3, "no object here } {").otherwise(F.concat(F.lit("Sure: {“people”: [{“name”: “"), "role", F.lit("”, “url”: "), url, F.lit(",},]} that {is} all")))
    parsed = F.from_json(X.clean_json(X.balanced_object(answer)), "people array<struct<name:string,url:string>>")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", parsed.alias("p"))
    kept = F.filter("p.people", lambda x: x["url"].isNotNull() & (x["url"] != ""))
    return rows.select("conv_id", "turn", F.get("p.people", F.lit(0))["name"].alias("name"), F.get("p.people", F.lit(0))["url"].alias("url"), F.coalesce(F.size(kept) > 0, F.lit(False)).alias("kept"))


@query("""SELECT o_orderkey, year(o_orderdate)::INT AS year, strftime(o_orderdate, '%m') AS month, strftime(o_orderdate, '%Y/%m/%Y-%m-%d.txt') AS path FROM orders WHERE year(o_orderdate) BETWEEN 1993 AND 1997""")
def date_path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "dd.MM.yyyy")
    date = F.try_to_date(day, "dd.MM.yyyy")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.year(date).alias("year"), F.lpad(F.month(date).cast("string"), 2, "0").alias("month"), F.date_format(date, "yyyy/MM/yyyy-MM-dd'.txt'").alias("path"))
    return rows.filter(F.col("year").between(1993, 1997))


@query(r"""WITH m AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(regexp_replace(coalesce(text, ''), '([.!?\n])[ ,]', '\1' || chr(1), 'g'), '[ ,]([A-ZÀ-Þ][\p{L}\p{N}_-]+( [A-ZÀ-Þ][\p{L}\p{N}_-]+)*)', 1))) AS text FROM documents)
SELECT doc_id, text, CASE WHEN contains(text, ' ') THEN 'PER' ELSE 'LOC' END AS label FROM m""")
def ner_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names found in each document by the default recogniser, with their kind."""
    return linking.mentions(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", models.capitalised_spans)


@query(f"""WITH t AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS i, len(w) AS n FROM (SELECT doc_id, {_TOKENS.format('text')} AS w FROM documents)),
h AS (SELECT doc_id, i, n, ('0x' || substr(md5(lower(t)), 1, 2))::INT % 32 AS dim, CASE WHEN ('0x' || substr(md5(lower(t)), 3, 2))::INT % 2 = 1 THEN 1.0 ELSE -1.0 END AS x FROM t),
p AS (SELECT doc_id, i // 256 AS k, dim, x FROM h UNION ALL SELECT doc_id, (i + 1) // 256, dim, x / 2 FROM h WHERE i + 1 < n UNION ALL SELECT doc_id, (i - 1) // 256, dim, x / 2 FROM h WHERE i > 0),
c AS (SELECT doc_id, i // 256 AS k, count(*) AS size FROM h GROUP BY doc_id, k)
SELECT doc_id, k::INT AS chunk_order, dim::INT AS dim, round(sum(x) / any_value(size), 6)::DOUBLE AS x FROM p JOIN c USING (doc_id, k) GROUP BY doc_id, k, dim HAVING sum(x) != 0""")
def late_chunk_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 256 tokens with the mean of their part of the document's token matrix, whose rows hold some of their
    neighbours'; dimensions that aren't zero."""
    rows = ingest.late_chunks(table(spark, sf_dir, "documents"), 256, models.token_matrix)
    return rows.select("doc_id", "chunk_order", F.posexplode("vector").alias("dim", "x")).filter("x != 0").withColumn("x", F.round("x", 6))


@query("""WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')) AS w FROM benchmark), h AS (SELECT item_id, md5('retrieval.query:' || w) AS h FROM w),
s AS (SELECT item_id, ('0x' || substr(h, 1, 2))::INT % 32 AS dim, sum(CASE WHEN ('0x' || substr(h, 3, 2))::INT % 2 = 1 THEN 1.0 ELSE -1.0 END)::DOUBLE AS x FROM h GROUP BY item_id, dim)
SELECT item_id, dim::INT AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY item_id)), 6) AS x FROM s WHERE x != 0""")
def task_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries' vectors from the default model for a task; dimensions that aren't zero."""
    rows = ingest.embedded(table(spark, sf_dir, "benchmark"), "text", "v", models.hash_embedder(32, "retrieval.query"))
    return rows.select("item_id", F.posexplode("v").alias("dim", "x")).filter("x != 0").withColumn("x", F.round("x", 6))


_VOTES = ", ".join(f"len(list_intersect(w, [{', '.join(repr(x) for x in v)}])) AS {k}" for k, v in sorted(models.STOP_WORDS.items()))


@query(rf"""SELECT doc_id, lang, CASE WHEN greatest(de, en, es, fr, it) = 0 THEN 'other' {" ".join(f"WHEN {k} = greatest(de, en, es, fr, it) THEN '{k}'" for k in sorted(models.STOP_WORDS))} END AS voted
FROM (SELECT doc_id, lang, {_VOTES} FROM (SELECT doc_id, lang, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+')) AS w FROM documents))""".replace("\\\\", "\\"))
def language_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vote of frequent words for each document's language."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", X.language_vote(F.col("text"), models.STOP_WORDS).alias("voted"))


def _base(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, or else in the warehouse; executors share both."""
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def _streamed(flow: DataFrame, name: str) -> DataFrame:
    """What the stream writes until its source is read; a file sink, so that no row passes through the driver."""
    base = _base(flow.sparkSession, name)
    flow.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return flow.sparkSession.read.schema(flow.schema).parquet(f"{base}/rows")


def _source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from pyspark.sql.types import StructType

    schema: StructType = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@query("SELECT user_id, ts, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type")
def stream_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.streaming import flows

    rows = _source(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return _streamed(flows.transitions(rows, "user_id", ["ts", "event_id"], "event_type"), "stream_transitions").select("user_id", "ts", "event_type")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.streaming import flows

    rows = _source(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    # all rows come in one batch, so each pair of keys is kept once; which of its rows that is isn't told
    return _streamed(flows.deduplicated(rows, ["user_id", "event_type"], "ts"), "stream_dedup").select("user_id", "event_type")


@query("SELECT event_id AS doc_id, event_type FROM events")
def stream_ingest_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and ledger in the warehouse."""
    from folioscope.streaming import flows

    base = _base(spark, "ingest")
    rows = _source(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "event_type")
    flows.ingest(rows, f"{base}/rows", f"{base}/ledger").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.parquet(f"{base}/ledger").select("doc_id")
    return spark.read.parquet(f"{base}/rows").join(done, "doc_id", "left_semi").select("doc_id", "event_type")
