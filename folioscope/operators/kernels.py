"""What searches do with a batch of rows, in numpy and Arrow. Pairs of queries and rows are compared in blocks, so that memory
doesn't grow with the queries or with a batch; of each task only the best of each query, or pairs that were asked for, leave."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs of rows and queries whose words are weighed at once: 8 MB of doubles.
CELLS = 1 << 20
#: Pairs of vectors that are compared at once: 1 MB of doubles, and some ten of these are held; larger blocks aren't faster.
PAIRS = 1 << 17


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves go away from zero, as in SQL; numpy's own rounding takes them to the even side."""
    y = x * 10.0**digits
    whole = np.trunc(y)
    with np.errstate(invalid="ignore"):  # infinities stay
        return np.copysign((np.abs(whole) + (np.abs(y - whole) >= 0.5)) / 10.0**digits, y)


def matrix(column: pa.Array, n: int) -> np.ndarray:
    """The vectors of a column without nulls as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def squares(v: np.ndarray) -> np.ndarray:
    return (v * v).sum(1)


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """(queries, rows): cosines of six digits; 0 if a vector has no length."""
    length = np.sqrt(np.outer(squares(q), squares(v)))
    return rounded(np.divide(q @ v.T, length, out=np.zeros_like(length), where=length > 0), 6)


def millionths(cos: np.ndarray) -> np.ndarray:
    """The certainty of cosines of six digits, in millionths, halves up."""
    return np.floor((np.round(5e6 * (1 + cos)) + 5) / 10)


def blocks(n_queries: int, n_rows: int) -> Iterator[tuple[slice, slice]]:
    """Slices of queries and of rows with PAIRS pairs at most."""
    width = max(1, min(n_rows, 2048))
    for r in range(0, n_rows, width):
        height = max(1, PAIRS // width)
        for s in range(0, n_queries, height):
            yield slice(s, min(s + height, n_queries)), slice(r, min(r + width, n_rows))


def best_cells(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest cells of each row that aren't minus infinity; ties go to the first column."""
    n = scores.shape[1]
    if k < n:
        which, at = np.nonzero((scores >= np.partition(scores, n - k, axis=1)[:, n - k, None]) & (scores > -np.inf))
    else:
        which, at = np.nonzero(scores > -np.inf)
    order = np.lexsort((at, -scores[which, at], which))
    which, at = which[order], at[order]
    keep = places(which) < k
    return which[keep], at[keep]


def places(groups: np.ndarray) -> np.ndarray:
    """The place of each element in its run of equal ones."""
    if not len(groups):
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    return np.arange(len(groups)) - np.repeat(starts, np.diff(np.append(starts, len(groups))))


class Best:
    """The k best rows of each query that a task has seen: columns __q (the query's number), those of names, of which the first is
    the key that ties go by, and score."""

    def __init__(self, k: int, n_queries: int) -> None:
        self.k, self.most, self.size, self.kept = k, max(1 << 16, 4 * k * n_queries), 0, []

    def add(self, which: np.ndarray, taken: pa.RecordBatch, score: np.ndarray) -> None:
        if len(which):
            self.kept.append(pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), *taken.columns, pa.array(score)], ["__q", *taken.schema.names, "__score"]))
            self.size += len(which)
        if self.size > self.most:
            self.reduce()

    def reduce(self) -> None:
        t = pa.Table.from_batches(self.kept).combine_chunks()
        t = t.take(pc.sort_indices(t, [("__q", "ascending"), ("__score", "descending"), (t.schema.names[1], "ascending")]))
        t = t.filter(pa.array(places(t["__q"].to_numpy()) < self.k)).combine_chunks()
        self.kept, self.size = t.to_batches(), t.num_rows

    def rows(self, qid: pa.Array, score: str) -> Iterator[pa.RecordBatch]:
        if self.kept:
            self.reduce()
        for b in self.kept:
            for i in range(0, b.num_rows, 1 << 16):
                s = b.slice(i, 1 << 16)
                yield pa.RecordBatch.from_arrays([qid.take(s.column(0)), *s.columns[1:]], ["qid", *s.schema.names[1:-1], score])


def ordered(batch: pa.RecordBatch, key: str) -> pa.RecordBatch:
    """A batch by key, so that ties go to the least."""
    return batch.take(pc.sort_indices(batch, [(key, "ascending")]))


class Words(NamedTuple):
    """The terms of a set of queries: terms, and the queries of each from start[i] up to start[i + 1] in asked."""

    qid: pa.Array
    terms: pa.Array
    start: np.ndarray
    asked: np.ndarray


def words_of(qid: pa.Array, terms: list[list[str]]) -> Words:
    """terms: for each of qid."""
    of: dict[str, list[int]] = {}
    for i, each in enumerate(terms):
        for term in dict.fromkeys(each or []):
            of.setdefault(term, []).append(i)
    names = sorted(of)
    counts = np.array([len(of[t]) for t in names], np.int64)
    return Words(qid, pa.array(names, pa.string()), np.concatenate(([0], np.cumsum(counts))).astype(np.int64), np.array([i for t in names for i in of[t]], np.int64))


def counted(column: pa.Array, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of lists of terms: each row's length; and row, number of the term and how often, for the terms in words."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().dictionary_encode()
    number = pc.fill_null(pc.index_in(flat.dictionary, value_set=words.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = number[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)[ids >= 0]
    cells, tf = np.unique(row * max(len(words.terms), 1) + ids[ids >= 0], return_counts=True)
    return lengths, cells // max(len(words.terms), 1), cells % max(len(words.terms), 1), tf


def keyword_scores(n: int, row: np.ndarray, term: np.ndarray, weight: np.ndarray, words: Words) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, (rows, queries)) for stretches of n rows: sums of the weights of the terms that a row and a query share, of six
    digits; minus infinity without one. row is in order."""
    q = len(words.qid)
    meets = np.diff(words.start)[term]
    upto = np.concatenate(([0], np.cumsum(meets)))
    first = np.searchsorted(row, np.arange(n + 1))
    at = 0
    while at < n and q:  # as many rows as have CELLS pairs with queries, and of terms with queries, or one
        to = at + 1
        while to < n and upto[first[to + 1]] - upto[first[at]] <= CELLS and (to + 1 - at) * q <= CELLS:
            to += 1
        a, b = first[at], first[to]
        m = meets[a:b]
        inside = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        cell = np.repeat((row[a:b] - at) * q, m) + words.asked[np.repeat(words.start[term[a:b]], m) + inside]
        sums = np.bincount(cell, np.repeat(weight[a:b], m), (to - at) * q)
        yield at, to, np.where(sums > 0, rounded(sums, 6), -np.inf).reshape(to - at, q)
        at = to


def postings(column: pa.Array, words: Words) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Of a column of lists of terms: each row's length, and lists of the numbers of its terms in words and of how often each is."""
    lengths, row, term, tf = counted(column, words)
    offsets = pa.array(np.searchsorted(row, np.arange(len(lengths) + 1)), pa.int32())
    listed = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32()))
    return pa.array(lengths, pa.int32()), listed(term), listed(tf)


class Bm25(NamedTuple):
    """What weighs a posting: the terms' idf, and the parameters."""

    idf: np.ndarray
    avgdl: float
    k1: float
    b: float

    def weights(self, n: pa.Array, ids: pa.Array, tfs: pa.Array, lens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, number of the term and weight of each posting; lens, where it isn't null, has the lengths of the texts of a row that
        stands for several."""
        count = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(count)), count)
        term, tf = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (ids, tfs))
        length = n.to_numpy(zero_copy_only=False).astype(np.float64)[row]
        several = lens.is_valid().to_numpy(zero_copy_only=False)[row]
        length[several] = lens.flatten().to_numpy(zero_copy_only=False)
        return row, term, self.idf[term] * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / self.avgdl))
