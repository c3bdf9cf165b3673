"""Benchmark decontamination with a distributed positional inverted index.

Words are maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A window is ten consecutive
words of a benchmark item (an item of fewer, but not none, is one window). All stages are DataFrame operations:

1. Terms of the windows are counted over all documents. A window's terms are put in order from the rarest.
2. The index stores the postings (term, document, position) of each window's two rarest terms, and a row a document with its
   number of words, in one scan.
3. Phrases: a window's lists are intersected from the rarest on, offsets adjusted: (document, position - offset) must be the
   same in all. What the first two lists leave tells the documents and stretches in which the lists of all other terms
   are read and intersected in the same way.
4. Proximity: items of which some window's two rarest terms, of those that any document has, are within ten words of each
   other, in any order. This finds windows with altered words, too; exact matches of two words or more are among them.

Only terms, windows and candidates are broadcast, and only below a measured size; beyond it Spark joins by shuffle. A term
found in very many documents is an anchor only of windows that have no rarer one, and its postings stay where they are
read: the windows come to them.

Defined cases: null texts have no words and no windows. Benchmark items that repeat an id are one item of several texts; a
null item_id counts as the string "null". Rows of documents that repeat an id are judged each. A null doc_id is returned
as null. Without documents or items the result is empty, or free of hits. drop_contaminated passes other columns through,
whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm._spark import broadcast_if_small, cut, is_small, shielded, text_key
from folioscope.llm._words import NO_ID

WINDOW = 10
#: What lies between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What names a row of documents.
ROW = ["doc_id", "ka", "kb"]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), BETWEEN), "")


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(wid, terms, items): the distinct windows and the ids of the items that have each, as strings."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    each = rows.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))).alias("i"))
    found = each.groupBy(F.slice("w", F.col("i"), window).alias("terms")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    return cut(found.withColumn("wid", F.monotonically_increasing_id()))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, ka, kb and text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), *text_key("text"), "text")


def anchored(docs: DataFrame, test: DataFrame) -> DataFrame:
    """test with lists (n, term, offset), rarest first, of the terms that any document has, and whole: all have."""
    vocabulary = broadcast_if_small(cut(test.select(F.explode("terms").alias("term")).distinct()))
    counts = docs.select(F.explode(words(F.col("text"))).alias("term")).join(vocabulary, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    each = test.select("wid", F.posexplode("terms").alias("offset", "term")).join(broadcast_if_small(cut(counts)), "term")
    lists = each.groupBy(F.col("wid").alias("w")).agg(F.array_sort(F.collect_list(F.struct("n", "term", "offset"))).alias("lists"))
    return test.join(lists, test["wid"] == lists["w"]).select("wid", "terms", "items", "lists", (F.size("lists") == F.size("terms")).alias("whole"))


def index(docs: DataFrame, test: DataFrame) -> DataFrame:
    """(doc_id, ka, kb, term, pos, n_words): the postings of the windows' two rarest terms; and a row of each document with
    term "" and its number of words."""
    terms = cut(test.select(F.explode(F.slice("lists", 1, 2)).alias("a")).select("a.term").distinct())
    rows = keyed(docs).select(*ROW, words(F.col("text")).alias("w"))
    n_words = F.size("w").cast("long")
    if is_small(terms):
        marked = terms.unionByName(terms.sparkSession.range(1).select(F.lit("").alias("term")))
        each = rows.select(*ROW, n_words.alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), "w")).alias("pos", "term"))
        found = each.join(F.broadcast(marked), "term")
        return found.select(*ROW, "term", (F.col("pos") - 1).alias("pos"), F.when(F.col("pos") == 0, F.col("n_words")).alias("n_words"))
    # a row a document would be one key of that join
    found = rows.select(*ROW, F.posexplode("w").alias("pos", "term")).join(terms, "term").select(*ROW, "term", "pos", F.lit(None).cast("long").alias("n_words"))
    return found.unionByName(rows.select(*ROW, F.lit("").alias("term"), F.lit(-1).alias("pos"), n_words.alias("n_words")))


def _same(a: dict[str, Column], postings: DataFrame) -> tuple[DataFrame, Column]:
    """Postings under other names, and where they are at the row, term and position given."""
    other = postings.select(*(F.col(c).alias(f"_{c}") for c in (*ROW, "term", "pos")))
    test = F.lit(True)
    for c in (*ROW, "term", "pos"):
        test = test & (a.get(c, F.col(c)) == F.col(f"_{c}"))
    return other, test


def phrase_matches(docs: DataFrame, postings: DataFrame, test: DataFrame) -> DataFrame:
    """(doc_id, ka, kb, wid, start, n_terms): where the windows occur exactly, each once."""
    whole = test.filter("whole").select("wid", F.size("terms").alias("n_terms"), F.col("lists")[0].alias("a"), F.get("lists", F.lit(1)).alias("b"))
    small = broadcast_if_small(whole.select("wid", "n_terms", "b", F.col("a.term").alias("term"), F.col("a.offset").alias("at")))
    first = postings.join(small, "term").withColumn("start", F.col("pos") - F.col("at")).filter("start >= 0").select(*ROW, "wid", "n_terms", "b", "start")
    two = first.filter("n_terms > 1").select(*ROW, "wid", "n_terms", "start", F.col("b.term").alias("term"), (F.col("start") + F.col("b.offset")).alias("pos"))
    both = two.join(*_same({}, postings), "left_semi")
    kept = cut(first.filter("n_terms = 1").unionByName(both, allowMissingColumns=True).select(*ROW, "wid", "n_terms", "start").distinct())
    more = kept.filter("n_terms > 2")
    rest = broadcast_if_small(test.filter("whole AND size(lists) > 2").select(F.col("wid").alias("w"), F.expr("slice(lists, 3, size(lists) - 2)").alias("rest")))
    asked = more.join(rest, F.col("wid") == F.col("w")).select(*ROW, "wid", "n_terms", "start", F.explode("rest").alias("r"))
    asked = asked.select(*ROW, "wid", "n_terms", "start", F.col("r.term").alias("term"), (F.col("start") + F.col("r.offset")).alias("pos"))
    agreed = asked.join(*_same({}, lists_between(docs, more)), "left_semi").groupBy(*ROW, "wid", "n_terms", "start").agg(F.count(F.lit(1)).alias("c")).filter("c = n_terms - 2")
    return kept.filter("n_terms <= 2").unionByName(agreed.drop("c"))


def lists_between(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The postings of all terms of the documents in found, from the first start there to the last window's end."""
    where = found.groupBy(*(F.col(c).alias(f"_{c}") for c in ROW)).agg(F.min("start").alias("lo"), F.max(F.col("start") + F.col("n_terms")).alias("hi"))
    where = broadcast_if_small(cut(where))
    same = (F.col("doc_id") == F.col("_doc_id")) & (F.col("ka") == F.col("_ka")) & (F.col("kb") == F.col("_kb"))
    rows = keyed(docs).join(where, same)
    part = F.slice(words(F.col("text")), F.col("lo") + 1, F.col("hi") - F.col("lo"))
    return rows.select(*ROW, "lo", F.posexplode(part).alias("p", "term")).select(*ROW, "term", (F.col("lo") + F.col("p")).alias("pos"))


def proximity_matches(postings: DataFrame, test: DataFrame, slop: int = WINDOW) -> DataFrame:
    """(doc_id, ka, kb, wid): windows whose two rarest terms are within slop words of each other, in any order. Positions are
    put in cells of slop words, so that only neighbours meet."""
    pairs = test.filter(F.size("lists") > 1).select("wid", F.col("lists")[0]["term"].alias("term"), F.col("lists")[1]["term"].alias("other"))
    cell = lambda p: F.floor(p / slop)
    near = F.explode(F.array(*(cell(F.col("pos")) + i for i in (-1, 0, 1)))).alias("cell")
    first = postings.join(broadcast_if_small(pairs), "term").select(*ROW, "pos", "wid", "other", near)
    second = postings.filter("pos >= 0").select(*(F.col(c).alias(f"_{c}") for c in (*ROW, "term", "pos")), cell(F.col("pos")).alias("_cell"))
    same = (F.col("other") == F.col("_term")) & (F.col("cell") == F.col("_cell"))
    for c in ROW:
        same = same & (F.col(c) == F.col(f"_{c}"))
    met = (F.abs(F.col("pos") - F.col("_pos")) <= slop) & (F.col("pos") != F.col("_pos"))
    return first.join(second, same & met, "left_semi").select(*ROW, "wid").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, ka, kb, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items of each row of docs."""
    test = cut(anchored(docs, windows(benchmark, window)))
    postings = cut(index(docs, test))
    found = cut(phrase_matches(docs, postings, test))
    near = proximity_matches(postings, test, window)
    items = broadcast_if_small(test.select(F.col("wid").alias("w"), "items"))
    covered = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n_terms") - 1)).alias("p")
    hit = found.select(*ROW, covered).distinct().groupBy(*ROW).agg(F.count(F.lit(1)).alias("n_hit"))
    of = lambda rows, to: rows.join(items, F.col("wid") == F.col("w")).select(*ROW, F.explode("items").alias("item")).groupBy(*ROW).agg(F.array_sort(F.collect_set("item")).alias(to))
    told = cut(hit.join(of(found, "ids"), ROW).join(of(near, "near"), ROW, "full")).select(*(F.col(c).alias(f"_{c}") for c in ROW), "n_hit", "ids", "near")
    rows = postings.filter("pos < 0").select(*ROW, "n_words")
    same = F.lit(True)
    for c in ROW:
        same = same & (F.col(c) == F.col(f"_{c}"))
    both = rows.join(broadcast_if_small(told), same, "left")
    none = F.array().cast("array<string>")
    ids, close = F.coalesce("ids", none), F.coalesce("near", none)
    return both.select(*ROW, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), F.size(close).cast("long").alias("n_near_items"))


@shielded
def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without those that have a window of the benchmark; all columns stay."""
    test = cut(anchored(docs, windows(benchmark, window)))
    found = phrase_matches(docs, cut(index(docs, test)), test)
    bad = broadcast_if_small(cut(found.select(*(F.col(c).alias(f"__{c}") for c in ROW)).distinct()))
    ka, kb = text_key("text")
    return docs.join(bad, (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == bad["__doc_id"]) & (ka == bad["__ka"]) & (kb == bad["__kb"]), "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, benchmark).drop("ka", "kb").withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7_SQL = f"""
WITH b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
t AS MATERIALIZED (SELECT item, least(len(w), 10) AS k, w[i:i + 9] AS v, array_to_string(w[i:i + 9], ' ') AS x FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS x FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM t))),
m AS MATERIALIZED (SELECT doc_id, s.k, i, item FROM s JOIN t USING (k, x)),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
j AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM m GROUP BY doc_id),
tok AS MATERIALIZED (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS p FROM d),
cnt AS (SELECT term, count(*) AS n FROM tok GROUP BY term),
l AS (SELECT x, list({{'n': n, 'term': term, 'o': o}} ORDER BY n, term, o) AS a FROM (SELECT DISTINCT x, unnest(v) AS term, unnest(range(len(v))) AS o FROM t) JOIN cnt USING (term) GROUP BY x HAVING count(*) > 1),
ab AS MATERIALIZED (SELECT DISTINCT item, a[1].term AS t1, a[2].term AS t2 FROM l JOIN t USING (x)),
pos AS MATERIALIZED (SELECT * FROM tok WHERE term IN (SELECT t1 FROM ab UNION SELECT t2 FROM ab)),
pr AS (SELECT DISTINCT f.doc_id, t1, t2 FROM (SELECT DISTINCT t1, t2 FROM ab) JOIN pos f ON f.term = t1 JOIN pos g ON g.term = t2 AND g.doc_id = f.doc_id AND abs(f.p - g.p) <= 10 AND f.p != g.p),
ni AS (SELECT doc_id, count(DISTINCT item) AS n FROM pr JOIN ab USING (t1, t2) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(j.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, h.n IS NOT NULL AS contaminated, coalesce(ni.n, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN j USING (doc_id) LEFT JOIN ni USING (doc_id)
"""
