"""Substring deduplication: Rabin-Karp hashes of every 50-word window, counted in Spark.

The rolling hash of a window comes from two running sums, so hashing costs the same for every window length. A first
aggregation leaves only windows that can be repeated (see repeats.py, where the defined cases stand too); their hashes
are grouped for the least document id, joined back, and the later ones merge into maximal removal intervals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import repeats as R
from folioscope.llm._spark import shielded


def removal_intervals(docs: DataFrame, window: int = R.WINDOW) -> DataFrame:
    """(doc_id, ka, kb, begins, ends): for each document with any, the word ranges to remove."""
    many, _ = R.repeated_minimisers(docs, window)
    return R.intervals(R.later_windows(R.windows(docs, R.wanted_by(many), window)), window)


@shielded
def dedup_substrings(docs: DataFrame, window: int = R.WINDOW) -> DataFrame:
    """docs without the words that repeat an earlier document's; all columns stay."""
    return R.remove(docs, removal_intervals(docs, window)).drop("__removed")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return R.digests(docs, removal_intervals(docs))


#: Each window's words as one string; equal windows of a smaller document remove what they cover.
OP3_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS t FROM s),
f AS (SELECT t, min(doc_id) AS a FROM g GROUP BY t),
r AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT g.doc_id, unnest(range(i, i + 50)) AS p FROM g JOIN f USING (t) WHERE g.doc_id > f.a) GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept FROM (SELECT d.doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) u
      WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(gone) AS p FROM r) q WHERE q.doc_id = u.doc_id AND q.p = u.p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""
