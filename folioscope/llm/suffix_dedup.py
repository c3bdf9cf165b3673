"""Suffix-array deduplication over sparse suffixes.

Only the suffixes that start at content-selected minimiser positions are kept, about one word in 22. Those that share
their minimiser with another document are sorted, neighbours are compared for their longest common prefix (the extension
to the right), and contexts to the left are compared word by word. A window of 50 words is repeated by a smaller
document exactly if some suffix of that document lies in the same run of the sorted order (every neighbour's common
prefix reaches the window's end) and agrees to the left back to the window's start. Since equal windows have the same
minimiser at the same place, this finds every repeated window: the result is the one defined in repeats.py.

The suffixes of a minimiser with more than repeats.HOT occurrences don't meet in one task. What a run of the sorted order
and an equal left context tell together is the sequence of a window's words; for these minimisers Spark groups the windows by
a hash of that sequence, in as many tasks as it likes, instead of sorting them in one. The result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import repeats as R
from folioscope.llm._spark import shielded
from folioscope.llm._words import buffers, find_words, ids, mix, slices, word_hashes

U = np.uint64
#: Suffix rows that a task sorts at once, besides the rest of a minimiser's group.
ROWS = 8192


def sparse_suffixes(docs: DataFrame, wanted, window: int = R.WINDOW, gram: int = R.GRAM) -> DataFrame:
    """(m, doc_id, ka, kb, start, left, span, words): each wanted minimiser occurrence with the words of all windows that
    it stands for, from word start of the document; left of them before the suffix; span window starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            w = find_words(*buffers(part.column(1)))
            m, at, a, b = R.occurrences(w, window, gram)
            keep = wanted(m)
            m, at, a, b = m[keep], at[keep], a[keep], b[keep]
            row = w.row[a] if len(a) else a
            raw = w.data.tobytes()
            words = [raw[x:y] for x, y in zip(w.starts[a].tolist(), w.ends[b + window - 1].tolist(), strict=True)]
            cols = [m.view(np.int64), ids(part)[row], part.column(2).to_numpy()[row], part.column(3).to_numpy()[row], (a - w.first[row]).astype(np.int32), (at - a).astype(np.int32), (b - a + 1).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), pa.array(words, pa.binary())], ["m", "doc_id", "ka", "kb", "start", "left", "span", "words"])

    return R.keyed(docs).mapInArrow(run, "m long, doc_id long, ka long, kb long, start int, left int, span int, words binary")


def later_starts(rows: pa.Table, window: int, gram: int) -> list[np.ndarray]:
    """Of each suffix row, the window starts (as document words) that repeat a smaller document's window. rows holds
    whole groups of minimisers."""
    n = rows.num_rows
    m, doc = rows["m"].to_numpy().view(np.uint64), rows["doc_id"].to_numpy()
    left, span, start = (rows[c].to_numpy().astype(np.int64) for c in ("left", "span", "start"))
    w = find_words(*buffers(rows["words"].combine_chunks()))
    h, first, end = word_hashes(w), w.first[:-1], w.first[1:]
    at = first + left
    cols = at[:, None] + np.arange(window)
    right = np.where(cols < end[:, None], h[np.minimum(cols, len(h) - 1)], U(0))
    key = np.empty((n, window + 1), ">u8")
    key[:, 0], key[:, 1:] = m, right
    order = np.argsort(key.view(f"V{8 * (window + 1)}").ravel(), kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    common = np.where(same.all(1), window, np.argmin(same, 1) - 1)  # words; -1: other minimisers
    doc, left, span, at, first = doc[order], left[order], span[order], at[order], first[order]
    before = np.zeros(n, np.uint64)
    found_row, found_at = [], []
    for o in range(window - gram + 1):
        if o:
            p = at - o
            with np.errstate(over="ignore"):
                before = mix(before * U(0x9E3779B97F4A7C15) + np.where(p >= first, h[np.maximum(p, 0)], U(0)))
        ok = np.flatnonzero((o <= left) & (o > left - span))
        if len(ok) < 2:
            continue
        run = np.zeros(n, np.uint64)
        run[1:] = np.cumsum(common < window - o)
        same_left = mix(run * U(0xD1342543DE82EF95) + before)[ok]
        by = np.lexsort((doc[ok], same_left))
        k, d = same_left[by], doc[ok][by]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        later = d > d[np.flatnonzero(new)][np.cumsum(new) - 1]
        hit = ok[by[later]]
        found_row.append(order[hit])
        found_at.append(left[hit] - o)
    row = np.concatenate(found_row) if found_row else np.zeros(0, np.int64)
    at = (np.concatenate(found_at) if found_at else np.zeros(0, np.int64)) + start[row]
    by = np.argsort(row, kind="stable")
    return np.split(at[by], np.searchsorted(row[by], np.arange(1, n)))


def compare_neighbours(suffixes: DataFrame, window: int = R.WINDOW, gram: int = R.GRAM) -> DataFrame:
    """(doc_id, ka, kb, at array<int>): the repeated windows of each suffix row that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(t: pa.Table) -> pa.RecordBatch:
            at = later_starts(t, window, gram)
            keep = np.flatnonzero([len(x) > 0 for x in at])
            return pa.RecordBatch.from_arrays([*(pa.array(t[c].to_numpy()[keep]) for c in ("doc_id", "ka", "kb")), pa.array([at[i].astype(np.int32) for i in keep], pa.list_(pa.int32()))], ["doc_id", "ka", "kb", "at"])

        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows >= ROWS:
                m = held["m"].to_numpy()
                whole = int(np.searchsorted(m, m[-1]))
                if whole:
                    yield judged(held.slice(0, whole))
                    held = held.slice(whole)
        if held is not None and held.num_rows:
            yield judged(held)

    return suffixes.repartition("m").sortWithinPartitions("m").mapInArrow(run, "doc_id long, ka long, kb long, at array<int>")


def removal_intervals(docs: DataFrame, window: int = R.WINDOW, hot: int = R.HOT) -> DataFrame:
    """(doc_id, ka, kb, begins, ends): for each document with any, the word ranges to remove."""
    many, frequent = R.repeated_minimisers(docs, window, hot=hot)
    found = compare_neighbours(sparse_suffixes(docs, R.wanted_by(many, frequent), window), window)
    if frequent.any():
        other = R.later_windows(R.windows(docs, R.wanted_by(many, frequent, True), window))
        found = found.unionByName(other.withColumn("at", F.array("at")))
    return R.intervals(found, window)


@shielded
def dedup_suffixes(docs: DataFrame, window: int = R.WINDOW) -> DataFrame:
    """docs without the words that repeat an earlier document's; all columns stay. Documents with no word left go."""
    out = R.remove(docs, removal_intervals(docs, window))
    return out.filter("__removed = 0 OR text != ''").drop("__removed")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return R.digests(docs, removal_intervals(docs))
