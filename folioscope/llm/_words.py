"""Words, lines and rolling hashes of whole Arrow text columns as flat numpy arrays.

Nothing here loops over words in Python: a slice of a text column is one byte array, and words, windows and
minimisers are found with vector operations. Hashes are 64-bit polynomials modulo 2**64 over mixed bytes, finished
by a bijective mixer, so equal word sequences always get equal hashes and a chance collision of two given sequences
has odds of about 2**-64. All tables come from arithmetic, so that driver and executors always agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes and rows handled at once; a longer single text is handled alone.
SLICE_BYTES, SLICE_ROWS = (1 << 20) - 1, 2048
U = np.uint64
NO_ID = np.iinfo(np.int64).max

#: ASCII white space: x20 and x09 to x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(30))
        x = x * U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U(27))
        x = x * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
LOWER_BYTE = BYTE[_LOWER]

_BASES = {"byte": 0x5851F42D4C957F2D, "word": 0xD1342543DE82EF95}
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse modulo 2**64."""
    have = _powers.get(kind)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        made = []
        for b in (_BASES[kind], pow(_BASES[kind], -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        have = (made[0], made[1])
        if size <= 1 << 22:
            _powers[kind] = have
    return have[0][:n], have[1][:n]


class Words(NamedTuple):
    """Words of the rows of a slice; word bounds are byte positions in data, of which offsets bound the rows."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # of each row and past the last: number of words before it

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    @property
    def row_end(self) -> np.ndarray:
        """Of each word, the number of the first word after its row."""
        return np.repeat(self.first[1:], self.counts)


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row bounds in them; a null is an empty text."""
    if text.null_count:
        text = pc.fill_null(text, "")
    kind = np.int64 if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type) else np.int32
    bufs = text.buffers()
    off = np.frombuffer(bufs[1], kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Row ranges of the batches with SLICE_BYTES of text at most, or one row; SLICE_ROWS at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = buffers(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = min(max(at + 1, int(np.searchsorted(off, off[at] + SLICE_BYTES, "right")) - 1), at + SLICE_ROWS)
            yield batch.slice(at, to - at)
            at = to


def find_words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes that are no gap, within rows."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, np.zeros(len(offsets), np.int64))
    tok = ~gap[data]
    head, tail = tok.copy(), tok.copy()
    head[1:] &= ~tok[:-1]
    tail[:-1] &= ~tok[1:]
    full = np.flatnonzero(np.diff(offsets))
    at = offsets[full]
    head[at] = tok[at]
    at = offsets[full + 1] - 1
    tail[at] = tok[at]
    starts = np.flatnonzero(head)
    return Words(data, offsets, starts, np.flatnonzero(tail) + 1, np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """Of byte spans, from one running sum over all bytes."""
    power, inverse = powers("byte", len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * power[:-1], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(w: Words, lower: bool = False) -> np.ndarray:
    return span_hashes(w.data, w.starts, w.ends, LOWER_BYTE if lower else BYTE)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hashes of every k consecutive words, rows disregarded: entry i covers words i to i + k - 1."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    power, inverse = powers("word", len(h) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * power[:-1], out=sums[1:])
        return mix((sums[k:] - sums[:-k]) * inverse[: len(h) - k + 1] + U(k))


def sequence_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of word ranges of any length."""
    power, inverse = powers("word", len(h) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * power[:-1], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def gram_starts(w: Words, k: int) -> np.ndarray:
    """Words at which k consecutive words of one row start."""
    return np.flatnonzero(np.arange(len(w.starts)) + k <= w.row_end)


def leftmost_min(v: np.ndarray, width: int) -> np.ndarray:
    """Of every width consecutive entries, where the smallest is (the first such)."""
    at = np.arange(len(v))
    have = 1
    while have * 2 <= width:
        a, b = at[:-have], at[have:]
        at = np.where(v[a] <= v[b], a, b)
        have *= 2
    if rest := width - have:
        a, b = at[:-rest], at[rest:]
        at = np.where(v[a] <= v[b], a, b)
    return at


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the entries between the bounds."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def ids(batch: pa.RecordBatch, name: str = "doc_id") -> np.ndarray:
    """A null id becomes the largest number: such rows are taken as one document after all others."""
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.int64())
    return np.asarray(pc.fill_null(col, NO_ID).to_numpy(zero_copy_only=False), np.int64)


def text_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """32 bits of each whole text: tells apart the texts of repeated ids."""
    return (span_hashes(data, offsets[:-1], offsets[1:]) >> U(32)).astype(np.uint32).view(np.int32)
