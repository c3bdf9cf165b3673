"""Language identification as inference of a mixture.

Each language is a smoothed distribution of byte trigrams (A-Z lower-cased, other ASCII than letters a gap), counted over
all training rows. A document's words are draws from a mixture of languages: expectation-maximisation estimates its
proportions from the words' trigram likelihoods, and the set of languages is the one of greatest likelihood less a
penalty of half the logarithm of the word count for each further language. Sets are nested: the languages of largest
proportion, up to all; a document is done when no larger set can gain, as even a likelihood of one wouldn't pay the penalty.

Training uses text and lang of rows whose crc32(doc_id as text) mod 4 is not 2. Defined cases: rows with a null doc_id
aren't held out and aren't trained on; null or letterless texts are `und` with score 0; without any training row every
text is. Ties go to the language that sorts first. Repeated rows count, and are judged, each. Columns named as those that
with_languages adds are replaced, others stay. A single text of any length is handled whole. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm._spark import small_batches
from folioscope.llm._words import U, buffers, find_words, slices

#: Hash buckets of trigrams, and what is added to each count.
BUCKETS, SMOOTH = 1 << 16, 0.5
#: Rounds of estimation for all languages and for each smaller set.
ROUNDS, FEWER = 10, 5

GAP = np.ones(256, bool)
GAP[97:123] = GAP[65:91] = False
GAP[128:] = False
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += U(32)
_FOLD[GAP] = U(32)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bucket of the three bytes around each byte; before and after a text is a gap."""
    b = _FOLD[data]
    x = b << U(8)
    x[1:] |= b[:-1] << U(16)
    x[:1] |= U(32 << 16)
    x[:-1] |= b[1:]
    x[-1:] |= U(32)
    full = np.diff(offsets) > 0
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    x[heads] = x[heads] & U(0xFFFF) | U(32 << 16)
    x[tails] = x[tails] & U(0xFFFF00) | U(32)
    with np.errstate(over="ignore"):
        return ((x * U(0x9E3779B97F4A7C15)) >> U(48)).astype(np.int64)


def held_out(by: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % by == remainder, F.lit(False))


def fit(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (language, bucket) from rows of text and lang. Counts are added up in Spark; what
    reaches the driver has BUCKETS numbers a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for part in slices(batches):
            data, off = buffers(part.column(0))
            if not len(data):
                continue
            tri = trigrams(data, off)
            names, which = np.unique(np.asarray(part.column(1).to_pylist(), object).astype(str), return_inverse=True)
            row = np.repeat(which, np.diff(off))
            use = ~GAP[data]
            for i, name in enumerate(names):
                n = np.bincount(tri[use & (row == i)], minlength=BUCKETS)
                seen[str(name)] = seen.get(str(name), 0) + n
        for name, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], ["lang", "at", "n"])

    counts = small_batches(rows).select("text", "lang").mapInArrow(run, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts["lang"].to_pylist()))
    table = np.zeros((len(langs), BUCKETS))
    index = {x: i for i, x in enumerate(langs)}
    table[[index[x] for x in counts["lang"].to_pylist()], counts["at"].to_numpy()] = counts["n"].to_numpy()
    table += SMOOTH
    return langs, np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def _estimate(like: np.ndarray, row: np.ndarray, heads: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each row after some rounds, and the log likelihood of each word under them."""
    n = np.diff(np.append(heads, len(row)))[:, None].astype(np.float32)
    for _ in range(rounds):
        r = like * share[row]
        r /= r.sum(1, keepdims=True)
        share = np.add.reduceat(r, heads, axis=0) / n
    return share, np.log(np.maximum((like * share[row]).sum(1), 1e-30))


def proportions(data: np.ndarray, offsets: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """(rows, languages): shares of the chosen languages; zeros for rows without words."""
    k = len(logs)
    out = np.zeros((len(offsets) - 1, k), np.float32)
    w = find_words(data, offsets, GAP)
    rows = np.flatnonzero(w.counts)
    if not len(rows) or not k:
        return out
    row = np.repeat(np.arange(len(rows)), w.counts[rows])
    heads = w.first[rows]
    tri = trigrams(data, offsets)
    ll = np.empty((len(w.starts), k), np.float32)
    for i in range(k):
        sums = np.append(0.0, np.cumsum(logs[i][tri], dtype=np.float64))
        ll[:, i] = sums[w.ends] - sums[w.starts]
    top = ll.max(1, keepdims=True)
    like = np.exp(np.maximum(ll - top, -40))
    one = np.add.reduceat(ll.astype(np.float64), heads, axis=0)
    best = one.argmax(1)
    rest = np.add.reduceat(top[:, 0].astype(np.float64), heads)
    chosen = np.zeros((len(rows), k), np.float32)
    chosen[np.arange(len(rows)), best] = 1
    score = one[np.arange(len(rows)), best]
    penalty = 0.5 * np.log(np.maximum(w.counts[rows], 2))
    if k > 1:
        full, _ = _estimate(like, row, heads, np.full((len(rows), k), 1 / k, np.float32), ROUNDS)
        order = np.argsort(-full, 1, kind="stable")
        for size in range(2, k + 1):
            # a word's likelihood is one at most here, so rest less the penalties bounds what this and larger sets can reach
            open_ = np.flatnonzero(rest - (size - 1) * penalty > score)
            if not len(open_):
                break
            n = w.counts[rows][open_]
            starts = np.append(0, np.cumsum(n)[:-1])
            inner = np.repeat(np.arange(len(open_)), n)
            some = like[np.repeat(heads[open_] - starts, n) + np.arange(len(inner))]
            share = np.zeros((len(open_), k), np.float32)
            at = order[open_, :size]
            np.put_along_axis(share, at, np.maximum(np.take_along_axis(full[open_], at, 1), 1e-4), 1)
            share /= share.sum(1, keepdims=True)
            floor = some if size == k else np.maximum(some, 1e-30)
            share, logp = _estimate(floor, inner, starts, share, FEWER)
            now = np.add.reduceat(logp.astype(np.float64), starts) + rest[open_] - (size - 1) * penalty[open_]
            better = now > score[open_]
            chosen[open_[better]] = share[better]
            score[open_[better]] = now[better]
    out[rows] = chosen
    return out


def with_languages(docs: DataFrame, langs: list[str], logs: np.ndarray) -> DataFrame:
    """docs with __lang, __score (its share) and __langs (all languages found, by share); all columns stay."""
    docs = docs.drop("__lang", "__score", "__langs")
    shared = docs.sparkSession.sparkContext.broadcast(logs)
    names = docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "__lang string, __score double, __langs string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            text = part.column(names.index("text"))
            data, off = buffers(text)
            share = proportions(data, off, shared.value)
            ascii_letters = np.append(0, np.cumsum(~GAP[data] & (data < 128)))
            letters = ascii_letters[off[1:]] > ascii_letters[off[:-1]]
            for i in np.flatnonzero(~letters & (share.max(1, initial=0) > 0)):
                letters[i] = any(map(str.isalpha, text[i].as_py()))
            share[~letters] = 0
            best = share.argmax(1) if len(langs) else np.zeros(len(text), int)
            known = share.max(1, initial=0) > 0
            order = np.argsort(-share, 1, kind="stable")
            lang = [langs[b] if k else "und" for b, k in zip(best, known, strict=True)]
            every = [",".join(langs[j] for j in o if s[j] > 0) for o, s in zip(order, share, strict=True)]
            score = share[np.arange(len(lang)), best] if len(langs) else np.zeros(len(lang))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(np.clip(score.astype(np.float64), 0, 1)), pa.array(every, pa.string())], [*names, "__lang", "__score", "__langs"])

    return small_batches(docs).mapInArrow(run, schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = held_out(4, 2)
    langs, logs = fit(docs.filter(~out & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    return with_languages(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), langs, logs).select("doc_id", out.alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), F.col("__langs").alias("languages"))
