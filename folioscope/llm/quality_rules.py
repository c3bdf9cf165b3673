"""Quality rules with adaptive thresholds.

Base rules are the same for all documents. The others compare a document's measures with those usual in its language and
source. Each measure goes into a DDSketch, a quantile sketch whose buckets grow by 2 %, so that merging sketches is adding
counts, in any order, with one result. Spark adds the counts by (lang, source, measure, bucket), a few hundred rows a group
however large the group; the sketches of a language and of all documents are merged from those of the groups. Documents
are filtered by joining the thresholds.

A group's fences are its quartiles, moved outwards by SPREAD times their distance. Where the quartiles coincide, the distance
is the least step that the measure can take in a document of the group's median size (one symbol, one line), read from
sketches of the sizes. Fences can't be wider than CEILING times those of the language, so that a source of junk doesn't
justify itself. A group with fewer than FEW documents is judged by its language, and a language with fewer by all. The sketches
take all documents that pass the base rules.

Defined cases: a null text has no words and fails the base rules. Null lang or source are groups of their own. Repeated
rows are judged, and counted, each. A value at its fence is kept. Columns with other names are passed through by keep_good,
whatever they are. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm._spark import broadcast_if_small, cut, shielded, small_batches
from folioscope.llm._words import buffers, find_words, gram_hashes, gram_starts, mix, row_sums, slices, span_hashes, word_hashes

U = np.uint64
MIN_WORDS = 10
#: Words in repeated five-word windows, in hundredths of all, that are still fine.
MAX_REPEATED = 20
GRAM = 5
GROWTH = 1.02
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def measured(text: pa.Array) -> dict[str, np.ndarray]:
    """Counts of each text."""
    data, off = buffers(text)
    w = find_words(data, off)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    marks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(SYMBOLS[data], out=marks[1:])
    # lines: split at x0A within rows; those with a word are compared within their row
    newline = np.zeros(256, bool)
    newline[10] = True
    lines = find_words(data, off, newline)
    has = np.searchsorted(w.starts, lines.ends) > np.searchsorted(w.starts, lines.starts)
    row = lines.row[has]
    dup = np.zeros(len(off) - 1, np.int64)
    if len(row):
        dup = np.bincount(row, minlength=len(dup)) - _in_row_unique(span_hashes(data, lines.starts[has], lines.ends[has]), row, len(dup))
    full = gram_starts(w, GRAM)
    covered = np.zeros(len(w.starts) + GRAM, np.int64)
    if len(full):
        key = _in_row(gram_hashes(word_hashes(w), GRAM)[full], w.row[full])
        by = np.argsort(key)
        same = key[by][1:] == key[by][:-1]
        many = np.zeros(len(key), bool)
        many[by[1:][same]] = True
        many[by[:-1][same]] = True
        covered[full[many]] += 1
        covered[full[many] + GRAM] -= 1
    inside = np.cumsum(covered)[: len(w.starts)] > 0
    return {
        "n_words": w.counts,
        "word_chars": row_sums(chars[w.ends] - chars[w.starts], w.first),
        "n_symbols": marks[off[1:]] - marks[off[:-1]],
        "n_dup_lines": dup,
        "n_repeat_words": row_sums(inside, w.first),
        "n_lines": np.bincount(row, minlength=len(dup)),
    }


def _in_row(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h + (row.astype(np.uint64) + U(1)) * U(0x9E3779B97F4A7C15))


def _in_row_unique(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Distinct hashes of each row."""
    by = np.lexsort((h, row))
    h, row = h[by], row[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return np.bincount(row[new], minlength=rows)


def with_counts(docs: DataFrame) -> DataFrame:
    """docs and the counts, each named with two underscores in front; all columns stay."""
    names = docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"__{c} long" for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = measured(part.column(names.index("text")))
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(np.asarray(found[c], np.int64)) for c in COUNTS)], [*names, *(f"__{c}" for c in COUNTS)])

    return small_batches(docs).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("__n_words") < MIN_WORDS) | (100 * F.col("__n_repeat_words") > MAX_REPEATED * F.col("__n_words"))


def bucket(part: Column, whole: Column) -> Column:
    """The DDSketch bucket of part / whole in parts per million; -1 for nothing."""
    ppm = (part * 1_000_000 / F.greatest(whole, F.lit(1))).cast("long")
    return F.when(ppm < 1, F.lit(-1)).otherwise(F.ceil(F.log(ppm.cast("double")) / F.lit(float(np.log(GROWTH)))).cast("int"))


def _steps(factor: float) -> int:
    return round(float(np.log(factor) / np.log(GROWTH)))


#: Quartile distances by which a fence lies outside the quartiles; documents that a group needs for fences of its own; how
#: much wider than its language's they can be.
SPREAD, FEW, CEILING = 5, 50, 4
#: Measure: numerator, denominator (in parts per million), and the size that decides the least step of the measure (None: a
#: fiftieth of the median, the width of a bucket).
MEASURES: dict[str, tuple[str, str, str | None]] = {
    "symbols": ("n_symbols", "word_chars", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines", "n_lines"),
    "word_length": ("word_chars", "n_words", None),
}
#: Measures that can be too small, too.
BOTH_SIDES = ("word_length",)


def ppm(part: Column, whole: Column) -> Column:
    return F.floor(part * 1_000_000 / F.greatest(whole, F.lit(1))).cast("long")


def bucket(value: Column) -> Column:
    """The DDSketch bucket of a number; -1 for nothing."""
    return F.when(value < 1, F.lit(-1)).otherwise(F.ceil(F.log(value.cast("double")) / F.lit(float(np.log(GROWTH)))).cast("int"))


def _values() -> dict[str, Column]:
    """What the sketches take of a document: the measures, and the sizes."""
    found = {m: ppm(F.col(f"__{a}"), F.col(f"__{b}")) for m, (a, b, _) in MEASURES.items()}
    return found | {size: F.col(f"__{size}") for _, _, size in MEASURES.values() if size}


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, m, b, n): the sketch of each measure over the documents of a group that pass the base rules."""
    each = F.array(*(F.struct(F.lit(m).alias("m"), bucket(v).alias("b")) for m, v in _values().items()))
    rows = counted.filter(~base_failed()).select("lang", "source", F.explode(each).alias("e"))
    return rows.groupBy("lang", "source", "e.m", "e.b").agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame, by: list[str], mark: str) -> DataFrame:
    """(by, mark_n, and of each measure mark_lo_m and mark_hi_m) of merged sketches."""
    group = Window.partitionBy(*by, "m")
    merged = sketch.groupBy(*by, "m", "b").agg(F.sum("n").alias("n"))
    upto = merged.withColumn("c", F.sum("n").over(group.orderBy("b"))).withColumn("all", F.sum("n").over(group))
    value = F.when(F.col("b") < 0, F.lit(0)).otherwise(F.floor(F.pow(F.lit(GROWTH), F.col("b")))).cast("long")
    q = lambda m, k: F.min(F.when((F.col("m") == m) & (4 * F.col("c") >= k * F.col("all")), value))
    names = [*MEASURES, *(size for _, _, size in MEASURES.values() if size)]
    wide = upto.groupBy(*by).agg(F.max("all").alias(f"{mark}_n"), *(q(m, k).alias(f"{m}_{k}") for m in names for k in (1, 2, 3)))
    out = []
    for m, (_, _, size) in MEASURES.items():
        step = F.floor(F.lit(1_000_000) / F.greatest(F.col(f"{size}_2"), F.lit(1))) if size else F.floor(F.col(f"{m}_2") / 50)
        apart = SPREAD * F.greatest(F.col(f"{m}_3") - F.col(f"{m}_1"), step.cast("long"))
        out += [(F.col(f"{m}_1") - apart).alias(f"{mark}_lo_{m}"), (F.col(f"{m}_3") + apart).alias(f"{mark}_hi_{m}")]
    return wide.select(*by, f"{mark}_n", *out)


def thresholds(counted: DataFrame) -> DataFrame:
    """(__lang, __source, and of each measure __lo_m and __hi_m) of each group."""
    sketch = cut(sketches(counted))
    own, lang, every = fences(sketch, ["lang", "source"], "g"), fences(sketch, ["lang"], "l"), fences(sketch, [], "a")
    lang = lang.withColumnRenamed("lang", "__l")
    both = own.join(lang, own["lang"].eqNullSafe(lang["__l"])).join(F.broadcast(every))
    out = []
    for m in MEASURES:
        for side in ("lo", "hi"):
            above = F.when(F.col("l_n") >= FEW, F.col(f"l_{side}_{m}")).otherwise(F.col(f"a_{side}_{m}"))
            mine = F.when(F.col("g_n") >= FEW, F.col(f"g_{side}_{m}")).otherwise(above)
            out.append((F.least(mine, CEILING * above) if side == "hi" else F.greatest(mine, F.floor(above / CEILING))).alias(f"__{side}_{m}"))
    return both.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *out)


def verdicts(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """counted (lang, source, counts) with __base_failed and __kept."""
    limits = broadcast_if_small(cut(limits))
    joined = counted.join(limits, counted["lang"].eqNullSafe(limits["__lang"]) & counted["source"].eqNullSafe(limits["__source"]), "left").drop("__lang", "__source")
    odd, values = F.lit(False), _values()
    for m in MEASURES:
        odd = odd | (values[m] > F.col(f"__hi_{m}"))
        if m in BOTH_SIDES:
            odd = odd | (values[m] < F.col(f"__lo_{m}"))
    failed = base_failed()
    return joined.withColumn("__base_failed", failed).withColumn("__kept", ~failed & ~F.coalesce(odd, F.lit(False)))


def judged(docs: DataFrame) -> DataFrame:
    """docs, the counts, __base_failed and __kept."""
    return verdicts(with_counts(docs), thresholds(with_counts(docs.select("text", "lang", "source"))))


@shielded
def keep_good(docs: DataFrame) -> DataFrame:
    """docs that the rules keep; all columns stay."""
    return judged(docs).filter("__kept").select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    counted = cut(with_counts(docs).drop("text"))
    return verdicts(counted, thresholds(counted)).select("doc_id", *(F.col(f"__{c}").alias(c) for c in COUNTS[:5]), F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


def _sql_ppm(m: str) -> str:
    part, whole, _ = MEASURES[m]
    return f"floor({part} * 1000000 / greatest({whole}, 1))::BIGINT"


def _sql_bucket(value: str) -> str:
    return f"CASE WHEN {value} < 1 THEN -1 ELSE ceil(ln({value}) / ln({GROWTH}))::INT END"


def _sql_fences(name: str, by: str) -> str:
    """The fences of the sketches merged by some columns."""
    keys = by + ", " if by else ""
    part = f"PARTITION BY {keys}m"
    sizes = [size for _, _, size in MEASURES.values() if size]
    quartiles = ", ".join(f"min(CASE WHEN m = '{m}' AND 4 * c >= {k} * n THEN CASE WHEN b < 0 THEN 0 ELSE floor(pow({GROWTH}, b)) END END)::BIGINT AS {m}_{k}" for m in (*MEASURES, *sizes) for k in (1, 2, 3))
    out = []
    for m, (_, _, size) in MEASURES.items():
        step = f"floor(1000000 / greatest({size}_2, 1))::BIGINT" if size else f"floor({m}_2 / 50)::BIGINT"
        out += [f"{m}_{q} {sign} {SPREAD} * greatest({m}_3 - {m}_1, {step}) AS {side}_{m}" for q, sign, side in ((1, "-", "lo"), (3, "+", "hi"))]
    return f"""{name}_c AS (SELECT {keys}m, b, sum(sum(n)) OVER ({part} ORDER BY b) AS c, sum(sum(n)) OVER ({part}) AS n FROM v GROUP BY {keys}m, b),
{name} AS MATERIALIZED (SELECT {keys}n, {", ".join(out)} FROM (SELECT {keys}max(n) AS n, {quartiles} FROM {name}_c {"GROUP BY " + by if by else ""}))"""


def _sql_limits() -> str:
    out = []
    for m in MEASURES:
        for side in ("lo", "hi"):
            above = f"CASE WHEN l.n >= {FEW} THEN l.{side}_{m} ELSE a.{side}_{m} END"
            mine = f"CASE WHEN g.n >= {FEW} THEN g.{side}_{m} ELSE {above} END"
            out.append((f"least({mine}, {CEILING} * ({above}))" if side == "hi" else f"greatest({mine}, floor(({above}) / {CEILING}))") + f" AS {side}_{m}")
    return f"SELECT g.lang, g.source, {', '.join(out)} FROM g JOIN l ON g.lang IS NOT DISTINCT FROM l.lang, a"


_ODD = " OR ".join(f"{_sql_ppm(m)} > hi_{m}" + (f" OR {_sql_ppm(m)} < lo_{m}" if m in BOTH_SIDES else "") for m in MEASURES)
_TAKEN = {**{m: _sql_ppm(m) for m in MEASURES}, **{size: size for _, _, size in MEASURES.values() if size}}

OP2_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
g5 AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS k FROM g5) WHERE k > 1) GROUP BY doc_id),
k AS (SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines FROM d LEFT JOIN r USING (doc_id)),
c AS MATERIALIZED (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM k),
v AS MATERIALIZED (SELECT lang, source, m, b, count(*) AS n FROM ({" UNION ALL ".join(f"SELECT lang, source, '{m}' AS m, {_sql_bucket(x)} AS b FROM c WHERE NOT base_failed" for m, x in _TAKEN.items())}) GROUP BY lang, source, m, b),
{_sql_fences("g", "lang, source")},
{_sql_fences("l", "lang")},
{_sql_fences("a", "")},
f AS MATERIALIZED ({_sql_limits()})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce({_ODD}, false) AS kept
FROM c LEFT JOIN f ON c.lang IS NOT DISTINCT FROM f.lang AND c.source IS NOT DISTINCT FROM f.source
"""
