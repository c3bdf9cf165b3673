"""Searches whose pairs stay in their task: rounding, formats, blocks, postings, against plain loops."""

from __future__ import annotations

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.functions import vector as V
from folioscope.operators import kernels as K
from folioscope.operators import search


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def corpus(seed: int, n: int = 60):
    """Texts with odd rows: null, empty, a key twice with texts of one length, a row without key."""
    rng = random.Random(seed)
    text = lambda: " ".join(rng.choices("abcdefgh", k=rng.randint(1, 12)))
    docs = [(i, text()) for i in range(n)] + [(n, None), (n + 1, ""), (3, "a b a c"), (3, "c a a d"), (None, "a b"), (None, "b b")]
    return docs, [(i, text()) for i in range(9)] + [(9, None), (10, "nothing")]


def plain_bm25(docs, asked):
    groups: dict = {}
    for key, t in docs:
        w = (t or "").split()
        for term in w:
            groups[(key, len(w), term)] = groups.get((key, len(w), term), 0) + 1
    total, avgdl = len(docs), sum(len((t or "").split()) for _, t in docs) / len(docs)
    out: dict = {}
    for q, t in asked:
        for term in set((t or "").split()):
            df = sum(g[2] == term for g in groups)
            for (key, length, x), tf in groups.items():
                if x == term:
                    out[(q, key)] = out.get((q, key), 0) + math.log(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avgdl))
    return {x: round(s, 6) for x, s in out.items()}


def frames(spark, docs, asked):
    return spark.createDataFrame(docs, "id int, t string").repartition(4), spark.createDataFrame(asked, "qid int, query string")


def test_bm25_of_pairs(spark):
    """F1: only the pairs asked for are scored, and statistics are those of all documents."""
    docs, asked = corpus(1)
    d, q = frames(spark, docs, asked)
    want = plain_bm25(docs, asked)
    pairs = [(i, j, t) for i in range(5) for j, t in docs[3:12]]
    p = spark.createDataFrame(pairs, "qid int, id int, t string")
    got = {(r["qid"], r["id"]): r["bm25"] for r in search.bm25(q, d, "id", "t", pairs=p).collect()}
    assert got == pytest.approx({x: s for x, s in want.items() if x in {(i, j) for i, j, _ in pairs}}, abs=2e-6)
    single = [(i, t) for i, t in docs if i is not None and i != 3]
    found = search.bm25(q, frames(spark, single, asked)[0], "id", "t", pairs=p.filter("id != 3"), repeats=False)
    want = plain_bm25(single, asked)
    assert {(r["qid"], r["id"]): r["bm25"] for r in found.collect()} == pytest.approx({x: s for x, s in want.items() if x in {(i, j) for i, j, _ in pairs}}, abs=2e-6)


def test_scores_are_rounded_as_sql_does(spark):
    """F1: the product of 0.79485 and 10,000 is below the half."""
    values = [0.79485, 0.00005, 0.12345, -0.79485, 0.0, 0.99995]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").select("i", search.rounded(F.col("x"), 4).alias("x"))
    assert [r["x"] for r in sorted(rows.collect())] == [float(K.rounded(np.array(x), 4)) for x in values]
    assert float(K.rounded(np.array(0.79485), 4)) == 0.7948


def test_three_digits_as_c_prints_them(spark):
    """halves go by the exact binary value."""
    values = [i * 0.0005 for i in range(2001)] + [None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").select("i", search.fixed(F.col("x")).alias("s"))
    assert [r["s"] for r in sorted(rows.collect())] == [None if x is None else f"{x:.3f}" for x in values]
    asked = spark.createDataFrame([(1, "a", "a", [1.0, 0.0])], "qid int, query string, like string, qvec array<double>")
    docs = spark.createDataFrame([(1, "a", [0.825, math.sqrt(1 - 0.825**2)]), (2, "a", None)], "id int, t string, vector array<double>")
    found = search.page(asked, docs, "id", "t").collect()
    assert [(r["certainty"], r["score"], r["explain"]) for r in found] == [(0.9125, f"{0.9125:.3f}", f"distance {1 - 0.825:.3f}, certainty {0.9125:.3f}")]


def test_halves_go_away_from_zero(spark):
    """cosines as SQL rounds them: 1/128 has seven digits."""
    assert K.rounded(np.array([0.0078125, -0.0078125, 0.0234375, 0.1, -np.inf]), 6).tolist() == [0.007813, -0.007813, 0.023438, 0.1, -np.inf]
    asked = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0, 0.0])], "qid int, qvec array<double>")
    rows = spark.createDataFrame([(1, [1.0, 127.0, 15.0, 5.0, 2.0])], "id int, vector array<double>")
    assert search.near_vector_topk(asked, rows, "id").head()["cos"] == 0.007813
    assert search.paired(asked, rows.withColumn("qid", F.lit(0))).head()["cos"] == 0.007813


def test_results_page_halves(spark):
    """as test_three_digits_as_c_prints_them, in the page."""
    hits = spark.createDataFrame([(1, "a", 0.9125, 1), (1, "b", 0.0045, 2)], "qid int, id string, certainty double, rank int")
    assert search.results_page(hits, "qid", "id").head()["html"] == f"<ol><li>a ({0.9125:.3f})</li><li>b ({0.0045:.3f})</li></ol>"


def test_hybrid_against_a_plain_loop(spark):
    """every pair fused in a loop; no pair is joined or shuffled."""
    docs, asked = corpus(2)
    docs = [x for x in docs if x[0] is not None]
    rng = random.Random(5)
    vec = lambda: [float(rng.randint(0, 3)) for _ in range(4)]
    rows, queries = [(i, t, vec()) for i, t in docs], [(i, t, vec()) for i, t in asked]
    d, q = spark.createDataFrame(rows, "id int, t string, vector array<double>").repartition(3), spark.createDataFrame(queries, "qid int, query string, qvec array<double>")
    single = d.dropDuplicates(["id"])
    assert "Join" not in plan(search.hybrid_topk(q, single, "id", "t"))
    words, want = plain_bm25(docs, asked), set()
    for i, _, a in queries:
        cos = [K.cosines(np.array([a]), np.array([v]))[0, 0] for _, _, v in rows]
        keyword = [s for (j, _), s in words.items() if j == i]
        each = []
        for (key, _, _), c in zip(rows, cos, strict=True):
            x = (c - min(cos)) / (max(cos) - min(cos)) if max(cos) > min(cos) else 1.0
            s = words.get((i, key))
            y = 0.0 if s is None else (s - min(keyword)) / (max(keyword) - min(keyword)) if max(keyword) > min(keyword) else 1.0
            each.append((-float(K.rounded(np.array(0.25 * x + 0.75 * y), 4)), key))
        want |= {(i, key, -s, n + 1) for n, (s, key) in enumerate(sorted(each)[:3])}
    assert {(r["qid"], r["id"], r["score"], r["rank"]) for r in search.hybrid_topk(q, d, "id", "t").collect()} == want


def test_blocks_and_best_cells():
    """F6, F8: no block has more than CELLS pairs, and blocks cover all; the best of a block are those of a full sort."""
    for n, m in ((1, 1), (6150, 10000), (3, 100000), (2000000, 1), (0, 5), (5, 0)):
        found = list(K.blocks(n, m))
        assert all((s.stop - s.start) * (r.stop - r.start) <= K.CELLS for s, r in found)
        assert sum((s.stop - s.start) * (r.stop - r.start) for s, r in found) == n * m
    scores = np.random.default_rng(1).integers(0, 4, (50, 30)).astype(float)
    scores[:3] = -np.inf
    for k in (1, 3, 29, 30, 99):
        which, at = K.best_cells(scores, k)
        want = [(i, j) for i in range(50) for j in np.argsort(-scores[i], kind="stable")[:k] if scores[i, j] > -np.inf]
        assert list(zip(which, at, strict=True)) == want


class Stated:
    """Stands for rows: gives the function that near_in_blocks would run on their batches."""

    columns, dtypes = ["id", "vector"], [("qid", "bigint"), ("id", "bigint"), ("vector", "array<double>")]

    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):
        return run


def peak_of_a_task(monkeypatch, n: int, sizes: list[int], k: int | None, least: float = 0.0, same: bool = False) -> tuple[float, int]:
    """MB that numpy holds at most in a task that meets n queries with batches of those sizes, and the rows that leave it. same:
    all vectors are one."""
    rng = np.random.default_rng(0)
    vectors = lambda m: np.ones((m, 64)) if same else rng.standard_normal((m, 64))
    asked = (pa.array(range(n), pa.int64()), vectors(n))
    monkeypatch.setattr(search, "stated", lambda queries: asked)
    flat = [vectors(m).reshape(-1) for m in sizes]
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(m)), pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * 64, pa.int32()), pa.array(v))], ["id", "vector"]) for m, v in zip(sizes, flat, strict=True)]
    run = search.near_in_blocks(Stated(), Stated(), "id", k, least)
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in run(iter(batches)))
        return tracemalloc.get_traced_memory()[1] / 1e6, rows
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("same", [False, True])
def test_a_task_of_wanted_pairs_stays_small(monkeypatch, same):
    """neither more queries nor larger batches make a task of near_vector_certainty hold more, even if all pairs are wanted."""
    small, _ = peak_of_a_task(monkeypatch, 1000, [1000], None, 0.7, same)
    large, rows = peak_of_a_task(monkeypatch, 2000, [3000, 10000], None, 0.7, same)
    assert (rows == 26_000_000) if same else (rows > 0)
    assert small < 32 and large < 32


def test_a_task_of_nearest_rows_stays_small(monkeypatch):
    """F8: the same for near_vector_topk; k rows a query leave a task, also of equal ones."""
    for same in (False, True):
        small, _ = peak_of_a_task(monkeypatch, 1000, [1000], 3, same=same)
        large, rows = peak_of_a_task(monkeypatch, 6156, [3000, 10000], 3, same=same)
        assert rows == 3 * 6156 and small < 32 and large < 32


def test_layered_meets_only_its_parents(spark):
    """the two levels, compared in blocks; no pair of a child and a query is a row of a join."""
    rng = random.Random(4)
    vector = lambda: [rng.random() for _ in range(4)]
    asked = spark.createDataFrame([(i, vector()) for i in range(7)], "qid int, qvec array<double>")
    parents = spark.createDataFrame([(i, vector()) for i in range(6)], "label int, vector array<double>")
    rows = spark.createDataFrame([(i, None if i % 11 == 0 else i % 6, None if i % 13 == 0 else vector()) for i in range(90)], "id int, label int, vector array<double>").repartition(4)
    found = search.layered(asked, parents, rows, "label", "id", 2, 3)
    assert "Join" not in plan(found)
    best = search.near_vector_topk(asked, parents, "label", 2).select("qid", "label")
    near = search.near_vectors(asked, rows.filter("vector IS NOT NULL"), "id").join(best, ["qid", "label"])
    want = search.top(near, ["qid"], [F.desc("cos"), F.col("id")], 3)
    pick = lambda df: sorted(map(tuple, df.select("qid", "label", "id", "cos", "certainty", "rank").collect()))
    assert pick(found) == pick(want)


@pytest.mark.parametrize("seed", range(2))
def test_bm25_topk_shuffles_the_best_only(spark, seed):
    """against a plain loop; documents of one key count as one, and no pair is joined."""
    docs, asked = corpus(seed)
    single = [x for x in docs if x[0] not in (3, None)]
    for some in (docs, single):
        d, q = frames(spark, some, asked)
        found = search.bm25_topk(q, d, "id", "t", 4)
        if some is single:
            assert "Join" not in plan(found)
        got = {(r["qid"], r["rank"]): r["bm25"] for r in found.collect()}
        each: dict = {}
        for (i, _), s in plain_bm25(some, asked).items():
            each.setdefault(i, []).append(float(K.rounded(np.array(s), 4)))
        assert got == pytest.approx({(i, n + 1): s for i, x in each.items() for n, s in enumerate(sorted(x, reverse=True)[:4])}, abs=2e-4)


def test_report_without_pairs(spark, monkeypatch):
    """counted in the task; the same as from pairs."""
    rng = random.Random(6)
    vector = lambda: [rng.gauss(0, 1) for _ in range(3)]
    asked = spark.createDataFrame([(i, vector()) for i in range(6)] + [(6, [0.0, 0.0, 0.0])], "qid int, qvec array<double>")
    rows = spark.createDataFrame([(i, vector()) for i in range(80)], "id int, vector array<double>").repartition(3)
    pick = lambda: sorted(map(tuple, search.certainty_report(asked, rows, "id", 0.6).select("qid", "n", "best", "least").collect()))
    small = pick()
    monkeypatch.setattr(search, "fits", lambda df, limit=0: False)
    assert pick() == small and len(small) == 6


def test_buckets_of_hashed_terms(spark):
    """the sixteen buckets are counted from one string, without sixteen passes of calls; as md5 tells them."""
    import hashlib

    texts = [["a", "b", "a", "ü", ""], [], None, ["a", None]]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t array<string>").select("i", V.hashed(F.col("t")).alias("v"), V.hashed(F.col("t"), 7).alias("w"))
    assert plan(rows).count("filter(") <= 1
    got = {r["i"]: r for r in rows.collect()}
    for i, x in enumerate(texts):
        for size, name in ((16, "v"), (7, "w")):
            at = [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % size for t in x or [] if t is not None]
            if x is not None:
                assert got[i][name] == [float(at.count(b)) for b in range(size)]


def test_words_of_no_query():
    words = K.words_of(pa.array([], pa.int32()), [])
    assert list(K.keyword_scores(3, *(np.zeros(0, np.int64),) * 2, np.zeros(0), words)) == []
