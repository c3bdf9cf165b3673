"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded before matching: compatibility forms, case, homoglyphs of other scripts, zero-width characters, and the
digits and signs that stand for letters (l, i and 1 become one character); everything that is no letter becomes a gap.
The lexicon holds starts of words and whole words, each with the log odds of a toxic label among the training texts that
have it. Patterns are chosen greedily, the one that explains most toxic texts not yet explained first. Exception phrases
are a hit's word with the word before or after it that training texts show to be harmless; a hit inside one doesn't
count. The sum of weights, normalised by the logarithm of the text's length, becomes a score by a logistic fit.

Labels are learned from rows whose crc32(doc_id as text) mod 3 is not 1, from TRAINING different labelled texts of each
class at most (those of least crc32 of the id; a classifier's fit may take a bounded sample). Texts that are equal when
folded are one. Every text is scored whole.

Defined cases: null and empty texts have no hit and get the score of no hit; null labels aren't learned from; a doc_id
with several labels is toxic if any says so; without labels of both classes the lexicon is empty and scores are 0.
Rows without id are scored and not learned from; rows that repeat an id are learned from, and scored, each. A column named
__score is replaced, others stay. An empty table gives none.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm._spark import broadcast_if_small, cut, small_batches
from folioscope.llm.language_id import held_out

#: Labelled texts of each class that the lexicon is learned from, at most.
TRAINING = 4000
#: Least toxic texts and least share of toxic texts (as counted) of a pattern.
SUPPORT, PRECISION = 3, 0.9
#: Least likelihood ratio (twice its logarithm) of a pattern's toxic and clean texts against the classes' shares: odds of
#: about 1 in 10,000 by chance. It depends on the balance of the classes, not on their size.
EVIDENCE = 15.1
#: Patterns that a toxic text may have before it counts as explained.
DEMAND = 6
#: Lengths of word starts that can be patterns.
STARTS = range(3, 9)

# Letters of other scripts that look like a Latin one, signs and digits read as letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r", "п": "n",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "η": "n", "ω": "w", "σ": "o",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ȷ": "j", "ʟ": "l", "ɩ": "i", "ƅ": "b", "օ": "o", "ս": "u", "ո": "n", "հ": "h", "ց": "g", "ք": "p",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i"}
_TRAILING = re.compile(r"[!|$@]+(?=\s|$)")
ZERO_WIDTH = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


class _Fold(dict):
    """Single characters to their folded form; filled as characters turn up."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        low = HOMOGLYPHS.get(ch.lower(), ch.lower())
        low = DIGITS.get(low, low)
        self[code] = out = "" if ch in ZERO_WIDTH else low if all(map(str.isalpha, low)) else " "
        return out


_fold = _Fold()


def folded(text: str) -> str:
    """A sign that reads as a letter is one only inside or before a word: a trailing run of them is a gap."""
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return f" {_TRAILING.sub(' ', text).translate(_fold)} "


def word_patterns(word: str) -> list[str]:
    return [f" {word[:n]}" for n in STARTS if len(word) >= n] + [f" {word} "]


def pattern_counts(rows: DataFrame) -> DataFrame:
    """(pattern, toxic, clean): texts that have it, from rows of text and toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic: Counter[str] = Counter()
        clean: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(toxic | clean)
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], ["pattern", "toxic", "clean"])
            toxic.clear()
            clean.clear()
            return out

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {p for w in set(folded(text or "").split()) for p in word_patterns(w)}
                (toxic if label else clean).update(found)
                if len(toxic) + len(clean) > 500_000:
                    yield flush()
        yield flush()

    return rows.select("text", "toxic").mapInArrow(run, "pattern string, toxic long, clean long").groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def automaton(patterns: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, p in enumerate(patterns):
        found.add_word(p, (i, len(p)))
    if patterns:
        found.make_automaton()
    return found


def around(text: str, start: int) -> tuple[str, str, str]:
    """The word before, the word that starts there and the word after it, however wide the gaps; none is empty text."""
    end = text.index(" ", start)
    last = start - 1
    while last >= 0 and text[last] == " ":
        last -= 1
    first = end
    while first < len(text) and text[first] == " ":
        first += 1
    return text[text.rfind(" ", 0, last + 1) + 1 : last + 1], text[start:end], text[first : text.find(" ", first)] if first < len(text) else ""


def hits(machine, text: str, exceptions: set[str]) -> list[tuple[int, int]]:
    """(pattern, start of the word) of each hit in a folded text that is in no exception phrase; of hits in one word, the
    longest pattern's."""
    best: dict[int, tuple[int, int]] = {}
    for end, (i, n) in machine.iter(text):
        start = end - n + 2
        if n > best.get(start, (0, 0))[0]:
            best[start] = (n, i)
    out = []
    for start, (_, i) in best.items():
        if exceptions:
            before, word, after = around(text, start)
            if word in exceptions or f"{before} {word}" in exceptions or f"{word} {after}" in exceptions:
                continue
        out.append((i, start))
    return out


def density(weights: np.ndarray, found: list[tuple[int, int]], words: int) -> float:
    """The sum of the weights of the hits, normalised by length."""
    return float(sum(weights[i] for i, _ in found)) / (1.0 + math.log1p(words))


class Model:
    """Patterns, their weights, exception phrases, and the logistic curve of the normalised sum."""

    def __init__(self, patterns: list[str], weights: list[float], exceptions: set[str], slope: float, middle: float) -> None:
        self.patterns, self.weights, self.slope, self.middle = patterns, np.array(weights), slope, middle
        self.exceptions = {folded(x).strip() for x in exceptions}

    def scores(self, texts: list[str | None]) -> list[float]:
        if not self.patterns:
            return [0.0] * len(texts)
        machine = automaton(self.patterns)
        return [self.score(machine, t) for t in texts]

    def score(self, machine, text: str | None) -> float:
        f = folded(text or "")
        x = density(self.weights, hits(machine, f, self.exceptions), f.count(" "))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.slope * (x - self.middle)))))


def text_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text): key is a hash of the folded text, gaps taken as one, so that copies have one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [hashlib.blake2b(" ".join(folded(t or "").split()).encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), batch.column(1)], ["doc_id", "key", "text"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, key binary, text string")


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAINING) -> DataFrame:
    """(text, toxic) of the labelled texts learned from; of texts of a class that are equal when folded one, since copies
    prove nothing. Copies are dropped before the limit."""
    usable = cut(labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(3, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")))
    order = F.struct(F.crc32(F.col("doc_id").cast("string")), "doc_id")
    keys = text_keys(docs).select("doc_id", "key").join(broadcast_if_small(usable), "doc_id")
    firsts = cut(keys.groupBy("toxic", "key").agg(F.min(order).alias("first")).select("toxic", "key", "first", F.col("first.doc_id").alias("doc_id")))
    some = cut(firsts.filter("toxic = 1").orderBy("first").limit(most).unionByName(firsts.filter("toxic = 0").orderBy("first").limit(most)).select("doc_id", "key", "toxic"))
    found = docs.join(F.broadcast(some.select(F.col("doc_id").alias("__id"))), F.col("doc_id").cast("long") == F.col("__id"), "left_semi")
    texts = text_keys(found).join(F.broadcast(some), ["doc_id", "key"])
    return cut(texts.groupBy("toxic", "key").agg(F.min("text").alias("text")).select("text", F.col("toxic").cast("boolean").alias("toxic")))


def fit(rows: DataFrame) -> Model:
    """A model from rows of text and toxic, of which there are few (see TRAINING). Counting is done in Spark."""
    sizes = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("toxic"), 1))).head()
    counted = pattern_counts(rows).filter((F.col("toxic") >= SUPPORT) & (F.col("toxic") >= PRECISION * (F.col("toxic") + F.col("clean"))) & (evidence(sizes[1] / max(1, sizes[0])) >= EVIDENCE))
    table = counted.orderBy(F.desc("toxic"), F.desc(F.length("pattern")), "pattern").toArrow()
    candidates = table["pattern"].to_pylist()
    clean = dict(zip(candidates, table["clean"].to_pylist(), strict=True))
    toxic = dict(zip(candidates, table["toxic"].to_pylist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set(candidates)
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                words = set(folded(text or "").split())
                found.append(sorted({p for w in words for p in word_patterns(w)} & known))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.string()))], ["toxic", "found"])

    having = rows.filter("toxic").select("text", "toxic").mapInArrow(run, "toxic boolean, found array<string>").toArrow()["found"].to_pylist()
    chosen = _cover([frozenset(x) for x in having], clean)
    weights = [math.log((toxic[p] + 0.5) / (clean[p] + 0.5)) for p in chosen]
    exceptions = _exceptions(rows, chosen)
    return _calibrated(rows, chosen, weights, exceptions)


def evidence(share: float) -> Column:
    """Twice the logarithm of the likelihood ratio of a pattern's counts against the share of toxic texts among all."""

    def part(n: Column, expected: float) -> Column:
        return F.when(n > 0, n * F.log(n / ((F.col("toxic") + F.col("clean")) * F.lit(max(expected, 1e-12))))).otherwise(0.0)

    return 2 * (part(F.col("toxic"), share) + part(F.col("clean"), 1 - share))


def _cover(texts: list[frozenset[str]], clean: dict[str, int]) -> list[str]:
    """Patterns chosen greedily by the texts that still need one, each of which takes DEMAND; of equals the one with fewer
    clean texts, then the longer. What a pattern finds isn't counted again for a start or continuation of it. A pattern
    must add to SUPPORT texts, or to one that has none yet, so that no text with a candidate is left without."""
    where: dict[str, set[int]] = defaultdict(set)
    for i, ps in enumerate(texts):
        for p in ps:
            where[p].add(i)
    left = [DEMAND] * len(texts)
    words: dict[str, list[str]] = defaultdict(list)
    for p in where:
        words[p.strip()].append(p)
    sorted_words = sorted(words)
    rank = {p: i for i, p in enumerate(sorted(where, key=lambda p: (len(p), p), reverse=True))}
    # gains only fall, so the first entry that is still right is the best
    entry = lambda p: (5 * clean[p] - len(where[p]), -len(where[p]), rank[p], p)
    heap = [entry(p) for p in where]
    heapq.heapify(heap)
    chosen: list[str] = []
    while heap:
        was = heapq.heappop(heap)
        best = was[-1]
        if was != entry(best):
            heapq.heappush(heap, entry(best))
            continue
        new = any(left[i] == DEMAND for i in where[best])
        if not new and len(where[best]) < SUPPORT:
            continue
        gained = where.pop(best)
        chosen.append(best)
        word = best.strip()
        alike = [word[:n] for n in range(1, len(word))]
        for w in sorted_words[bisect.bisect_left(sorted_words, word) :]:
            if not w.startswith(word):
                break
            alike.append(w)
        for q in [q for w in alike for q in words.get(w, ()) if q in where]:
            where[q] -= gained
        for i in gained:
            left[i] -= 1
            if not left[i]:
                for p in texts[i]:
                    if p in where:
                        where[p].discard(i)
    return chosen


def _exceptions(rows: DataFrame, patterns: list[str]) -> set[str]:
    """Words with hits, and pairs of such a word and its neighbour, found in clean texts and in none that is toxic: three a
    hit in the bounded sample at most."""
    if not patterns:
        return set()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(patterns)
        for batch in batches:
            phrases, toxic = [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = folded(text or "")
                for _, start in hits(machine, f, set()):
                    before, word, after = around(f, start)
                    for p in {word, *([f"{before} {word}"] if before else []), *([f"{word} {after}"] if after else [])}:
                        phrases.append(p)
                        toxic.append(label)
            yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.string()), pa.array(toxic, pa.bool_())], ["phrase", "toxic"])

    seen = rows.select("text", "toxic").mapInArrow(run, "phrase string, toxic boolean").groupBy("phrase").agg(F.max("toxic").alias("toxic"))
    return set(seen.filter("NOT toxic").select("phrase").toArrow()["phrase"].to_pylist())


def _calibrated(rows: DataFrame, patterns: list[str], weights: list[float], exceptions: set[str]) -> Model:
    """The logistic curve by Newton steps on the training texts' normalised sums, with a slight ridge."""
    model = Model(patterns, weights, exceptions, 1.0, 0.0)
    if not patterns:
        return model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(patterns)
        for batch in batches:
            folds = [folded(t or "") for t in batch.column(0).to_pylist()]
            x = [density(model.weights, hits(machine, f, exceptions), f.count(" ")) for f in folds]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column(1)], ["x", "toxic"])

    t = rows.select("text", "toxic").mapInArrow(run, "x double, toxic boolean").toArrow()
    x, y = t["x"].to_numpy(), t["toxic"].to_numpy(zero_copy_only=False).astype(float)
    design, beta = np.stack([np.ones(len(x)), x], 1), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2), design.T @ (y - p) - 1e-2 * beta)
        beta += step
        if abs(step).max() < 1e-6:
            break
    model.slope = max(float(beta[1]), 1e-6)
    model.middle = -float(beta[0]) / model.slope
    return model


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """docs with __score; all columns stay."""
    docs = docs.drop("__score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "__score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        machine = automaton(m.patterns) if m.patterns else None
        for batch in batches:
            texts = batch.column(names.index("text"))
            found = [m.score(machine, texts[i].as_py()) if machine else 0.0 for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*names, "__score"])

    return small_batches(docs).mapInArrow(run, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(training_rows(docs, labels))
    scored = with_scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.7).cast("int").alias("predicted"))
