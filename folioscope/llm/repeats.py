"""What both exact-substring operators share: minimisers, the windows they stand for, and cutting removed words.

Words are maximal runs of other bytes than x20 and x09 to x0D. A window is WINDOW consecutive words of one document. A
word is removed if a window over it has a word sequence that also starts in a document with a smaller doc_id; windows
are judged on the input.

Every window is stood for by its minimiser: of the GRAM-word grams in it the one of least hash, the first such. Equal
windows have equal minimisers, so a window whose minimiser occurs in one document only can't be repeated elsewhere and
is left out of the shuffle. The minimisers of several documents go to all tasks as a bit filter of bounded size; what
passes it by chance costs a row and changes no result.

Defined cases: null texts have no words. Rows with a null doc_id count as one document that follows all others. Rows
that repeat a doc_id are one document for the comparison of ids, and each is cut by its own text. Columns other than
doc_id and text are passed through whatever their names (remove gives `__removed` beside them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm._spark import blooms, bloom_words, broadcast_if_small, cut, in_bloom, small_batches, text_key
from folioscope.llm._words import NO_ID, Words, buffers, find_words, gram_hashes, ids, leftmost_min, slices, word_hashes

WINDOW = 50
GRAM = 8
#: A minimiser with more occurrences is compared window by window through a Spark aggregation, never in one task: a bound on what
#: a task sorts at once, of about 100 MB.
HOT = 1 << 16


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and 128 bits of hashes of the text, which with doc_id name a row."""
    return small_batches(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text", *text_key("text"))


def occurrences(w: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser occurrences: hash, word at which it starts, first and last window start that it stands for."""
    h = word_hashes(w)
    g = gram_hashes(h, gram)
    starts = np.flatnonzero(np.arange(len(h)) + window <= w.row_end)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    at = leftmost_min(g, window - gram + 1)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (np.diff(starts) != 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(starts)) - 1
    return g[at[head]], at[head], starts[head], starts[tail]


def minimisers(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(m, doc_id): the minimisers of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            w = find_words(*buffers(part.column(1)))
            m, at, _, _ = occurrences(w, window, gram)
            doc = ids(part)[w.row[at]]
            yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(doc)], ["m", "doc_id"])

    return keyed(docs).mapInArrow(run, "m long, doc_id long")


def repeated_minimisers(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> tuple[np.ndarray, np.ndarray]:
    """Filters of the minimisers found in two documents or more, and of those with more than hot occurrences."""
    seen = minimisers(docs, window, gram).groupBy("m").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count(F.lit(1)).alias("n"))
    words = bloom_words(4 * docs.count())
    found = blooms(seen.filter("a < b"), "m", words, many=F.lit(True), hot=F.col("n") > hot)
    return found["many"], found["hot"]


def windows(docs: DataFrame, wanted: Callable[[np.ndarray], np.ndarray], window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(h, doc_id, ka, kb, at): hash and first word of each window whose minimiser is wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            w = find_words(*buffers(part.column(1)))
            m, _, a, b = occurrences(w, window, gram)
            keep = wanted(m)
            a, n = a[keep], (b - a + 1)[keep]
            s = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
            row = w.row[s]
            h = gram_hashes(word_hashes(w), window)[s] if len(s) else np.zeros(0, np.uint64)
            cols = [h.view(np.int64), ids(part)[row], part.column(2).to_numpy()[row], part.column(3).to_numpy()[row], (s - w.first[row]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h", "doc_id", "ka", "kb", "at"])

    return keyed(docs).mapInArrow(run, "h long, doc_id long, ka long, kb long, at int")


def later_windows(found: DataFrame) -> DataFrame:
    """(doc_id, ka, kb, at) of the windows that also start in a document of smaller id. Counted in Spark: a hash's rows are
    combined before the shuffle. The counts are cut, since Spark splits a frequent hash's rows in the join only where both
    sides come straight from a shuffle."""
    first = cut(found.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("h", "a"))
    return found.join(first, "h").filter("doc_id > a").select("doc_id", "ka", "kb", "at")


def intervals(starts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, ka, kb, begins, ends): maximal word ranges under the windows that start at the words listed (at: a word or
    an array). Rows that repeat a document list the same words, so a set of them is no longer than the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begins, ends = [], []
            for x in batch.column(3):
                at = np.unique(x.values.to_numpy())
                gap = np.flatnonzero(np.diff(at) > window)
                begins.append(at[np.append(0, gap + 1)])
                ends.append(at[np.append(gap, len(at) - 1)] + window)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(begins, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], ["doc_id", "ka", "kb", "begins", "ends"])

    listed = F.collect_set("at")
    if dict(starts.dtypes)["at"].startswith("array"):
        listed = F.flatten(listed)
    return starts.groupBy("doc_id", "ka", "kb").agg(listed.alias("at")).mapInArrow(run, "doc_id long, ka long, kb long, begins array<int>, ends array<int>")


def with_intervals(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """docs, each with the ranges to remove from it (null: none)."""
    ranges = broadcast_if_small(cut(ranges)).select(F.col("doc_id").alias("__id"), F.col("ka").alias("__ka"), F.col("kb").alias("__kb"), F.col("begins").alias("__begins"), F.col("ends").alias("__ends"))
    ka, kb = text_key("text")
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == ranges["__id"]) & (ka == ranges["__ka"]) & (kb == ranges["__kb"])
    return docs.join(ranges, same, "left").drop("__id", "__ka", "__kb")


def kept_words(text: str | None, begins: list[int] | None, ends: list[int] | None) -> tuple[int, list[bytes]]:
    """The number of words and those left."""
    words = text.encode().split() if text else []
    if not begins:
        return len(words), words
    left, at = [], 0
    for a, b in zip(begins, ends, strict=True):
        left += words[at:a]
        at = b
    return len(words), left + words[at:]


def digests(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, sha = [], [], []
            for text, a, b in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                n, left = kept_words(text.as_py(), a.as_py(), b.as_py())
                total.append(n)
                removed.append(n - len(left))
                sha.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return with_intervals(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ranges).select("doc_id", "text", "__begins", "__ends").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """docs with the removed words cut out of text, the words left joined by one space; a text that loses no word is
    returned as it is. All columns stay, and n_chars, if there, follows the text; __removed tells the words removed."""
    found = with_intervals(docs, ranges).withColumn("__removed", F.lit(0).cast("long"))
    names = found.columns
    text, begins, ends, count = (names.index(x) for x in ("text", "__begins", "__ends", "__removed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for t, a, b in zip(batch.column(text), batch.column(begins), batch.column(ends), strict=True):
                if not a.is_valid:
                    texts.append(t.as_py())
                    removed.append(0)
                    continue
                n, left = kept_words(t.as_py(), a.as_py(), b.as_py())
                texts.append(b" ".join(left).decode())
                removed.append(n - len(left))
            cols = batch.columns
            cols[text], cols[count] = pa.array(texts, pa.string()), pa.array(removed, pa.int64())
            yield pa.RecordBatch.from_arrays(cols, names)

    done = found.mapInArrow(run, found.schema).drop("__begins", "__ends")
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return done


def wanted_by(many: np.ndarray, hot: np.ndarray | None = None, is_hot: bool = False) -> Callable[[np.ndarray], np.ndarray]:
    """A test of minimisers by the filters: those in many; with hot, those of them that are in hot too, or aren't."""

    def test(m: np.ndarray) -> np.ndarray:
        keep = in_bloom(many, m)
        return keep if hot is None else keep & (in_bloom(hot, m) == is_hot)

    return test
