"""Boundary cases of ingest, linking, streams and the small operators around them."""

from __future__ import annotations

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators import ingest, linking, monitoring, search
from folioscope.session import Settings
from folioscope.sources import readers, sinks
from folioscope.streaming import flows


def test_transitions_with_nulls(spark):
    """Only a change counts: null before the first value, then null, null, a, a, null."""
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, None, "a", "a", None, "b"])], "k int, i int, v string")
    assert [r["i"] for r in monitoring.transitions(rows, ["k"], ["i"], "v").orderBy("i").collect()] == [2, 4, 5]


def test_nearest_against_all_pairs(spark):
    r = random.Random(2)
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    left = [("u", at(r.randrange(4000)), i) for i in range(3000)]
    right = [("u", at(r.randrange(4000)), i) for i in range(3000)]
    make = lambda rows, c: spark.createDataFrame(rows, f"u string, ts timestamp, {c} bigint")
    began = time.time()
    got = {x["l"]: (x["r"], x["micros"]) for x in monitoring.nearest(make(left, "l"), make(right, "r"), "u", "ts", "l", "r").collect()}
    assert time.time() - began < 8  # a frame that grows, not one that is taken anew for each row
    for _, t, i in left[:200]:
        far, _, best = min((abs((t - s).total_seconds()), s, j) for _, s, j in right)
        assert got[i] == (best, int(far * 1e6))


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_ingest_reads_its_ledger(spark, tmp_path):
    """A key that comes again in a later file isn't written again."""
    schema = "doc_id long, x string"
    for batch in ([(1, "a"), (2, "b")], [(2, "again"), (3, "c")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        rows = stream(spark, f"{tmp_path}/in", schema)
        flows.ingest(rows, f"{tmp_path}/rows", f"{tmp_path}/ledger").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/rows").collect()
    assert sorted((r["doc_id"], r["x"]) for r in got) == [(1, "a"), (2, "b"), (3, "c")]


def test_log_tail(spark, tmp_path):
    """Transitions over files that arrive one after the other, the last document carried along."""
    line = "2024-01-01 10:00:{:02d},000 INFO: Stored triples for chunk {}/0"
    for name, lines in (("a", [(1, 7), (2, 7), (3, 8)]), ("b", [(4, 8), (5, 9)])):
        (tmp_path / "logs").mkdir(exist_ok=True)
        (tmp_path / "logs" / f"{name}.log").write_text("\n".join(line.format(*x) for x in lines))
        time.sleep(1.1)
    rows = spark.readStream.option("maxFilesPerTrigger", 1).text(f"{tmp_path}/logs").withColumn("source", F.lit("log"))
    flow = flows.log_transitions(rows).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c")
    flow.trigger(availableNow=True).start().awaitTermination()
    assert [r["root"] for r in spark.read.parquet(f"{tmp_path}/out").orderBy("ts").collect()] == ["7", "8", "9"]


def test_stop_between_batches(spark):
    query = spark.readStream.format("rate").option("rowsPerSecond", 5).load().writeStream.format("noop").start()
    flows.stop_when(query, lambda: query.lastProgress is not None, 0.2)
    assert not query.isActive and query.exception() is None


def plain_chunks(sentences: list[str], limit: int, threshold: float) -> list[list[str]]:
    """Greedy chunks and merged singles by hand; vectors count md5 buckets."""
    import hashlib

    def vector(s: str) -> list[int]:
        v = [0] * 16
        for w in s.split():
            v[int(hashlib.md5(w.lower().encode()).hexdigest()[:8], 16) % 16] += 1
        return v

    def cosine(a: list[int], b: list[int]) -> float:
        return sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5

    out: list[list[str]] = []
    for s in sentences:
        size = sum(len(x.split()) for x in out[-1]) if out else 0
        if not out or size + len(s.split()) > limit or round(cosine(vector(out[-1][-1]), vector(s)), 6) < threshold:
            out.append([])
        out[-1].append(s)
    merged: list[list[str]] = []
    for chunk in out:
        if merged and len(chunk) == 1 and sum(len(x.split()) for x in merged[-1]) + len(chunk[0].split()) <= limit:
            merged[-1] += chunk
        else:
            merged.append(chunk)
    return merged


def test_ingest_against_plain_python(spark):
    r = random.Random(1)
    sentence = lambda: " ".join(r.choice(["Alpha", "beta", "gamma", "delta", "eps"]) for _ in range(r.randrange(1, 9))) + "."
    texts = {str(i): " ".join(sentence() for _ in range(12)) for i in range(30)} | {"e": "", "n": None, "b": " \n"}
    docs = spark.createDataFrame([(k, v, "de") for k, v in texts.items()], "doc_id string, text string, lang string")
    settings = Settings(token_limit=1000, overlap=10, chunk_limit=14, similarity=0.6)
    got = ingest.chunks(docs, settings=settings).orderBy("doc_id", "chunk_order").collect()
    for k, text in texts.items():
        want = plain_chunks([s + "." for s in (text or "").strip().rstrip(".").split(". ")] if (text or "").strip() else [], 14, 0.6)
        mine = [x for x in got if x["doc_id"] == k]
        assert [x["content"] for x in mine] == [" ".join(c) for c in want]
        assert [x["chunk_order"] for x in mine] == list(range(len(want)))
        assert all(sum(x["sums"]) == x["stop"] - x["start"] for x in mine)
    parts = ingest.process(docs, "urn:g", settings)
    assert parts["triples"].count() == 3 * parts["chunks"].count() and set(parts["chunks"].columns) >= {"chunk_id", "vector"}
    long = spark.createDataFrame([("x", " ".join(f"w{i}." for i in range(50)))], "doc_id string, text string")
    windows = ingest.chunks(long, settings=Settings(token_limit=20, overlap=5, chunk_limit=8, similarity=0.0)).collect()
    assert {x["window"] for x in windows} == {0, 1, 2} and [x["chunk_order"] for x in sorted(windows, key=lambda x: x["chunk_order"])] == list(range(len(windows)))
    assert ingest.identified(spark.createDataFrame([(None,), ("a",)], "doc_id string")).filter("doc_id IS NULL").count() == 0


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('so {"people": [{"name": "A", "url": "u"}, {"name": "B", "url": ""}, {"name": None}]} there', [{"name": "A", "url": "u"}]),
        ("{“people”: [{“url”: “u”,},]}", [{"url": "u"}]),
        ("nothing", None), (None, None), ("} {\"people\": []}", None), ('{"people": []}', []), ('{"people": [', None),
        ('{"people": [}', ValueError), ('{"people": [x]}', ValueError), ("{}", ValueError), ('{"people": 3}', ValueError),
    ],
)
def test_parsed_answer(raw, want):
    if want is ValueError:
        with pytest.raises(ValueError):  # noqa: PT011
            linking.parsed_answer(raw)
    else:
        assert linking.parsed_answer(raw) == want


def test_people_and_organisations(spark, tmp_path):
    (tmp_path / "Person.csv").write_text("id,lemma,complement,b,d,url,bu,du,desc,author,translator\n7,Meier,Anna,1850,1900,u,x,,d,a,t\nx,Muster,,,,,,,,,\n8,Kurz,K\n")
    rows = readers.persons(spark, f"{tmp_path}/Person.csv").orderBy("lemma").collect()
    assert [(r["name"], r["identifier"], r["birth_uncertainty"], r["death_uncertainty"], r["author"]) for r in rows] == [("K Kurz", 8, False, False, ""), ("Anna Meier", 7, True, False, "a"), (" Muster", None, False, False, "")]
    (tmp_path / "Amt.csv").write_text("url,de,fr\nu1,Amt,Office\n")
    assert [tuple(r) for r in readers.organizations(spark, f"{tmp_path}/Amt.csv").collect()] == [("Amt", "Office", "Amt", "u1")]


def test_years_are_pruned(spark, tmp_path):
    spark.range(40).select("id", (F.col("id") + 1900).alias("year"), F.lit(1).alias("month")).write.partitionBy("year", "month").parquet(f"{tmp_path}/y")
    found = readers.years(spark, f"{tmp_path}/y", 1910, 1912)
    assert found.count() == 3 and "PartitionFilters: [isnotnull(year" in found._jdf.queryExecution().toString()


def test_metrics_are_observed(spark):
    df, seen = sinks.observed(spark.range(10), rows=F.count(F.lit(1)), total=F.sum("id"))
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 10, "total": 45}


def test_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).head()["x"]
    assert one(X.outer_object(F.lit("a {b} c {d} e"))) == "{b} c {d}" and one(X.outer_object(F.lit("} {"))) is None
    assert one(X.between(F.lit("abcdef"), F.lit(1), F.lit(3))) == "bc" and one(X.between(F.lit("abc"), F.lit(2), F.lit(1))) == ""
    assert one(readers.padded(F.lit(None).cast("array<string>"), 2)) == ["", ""]


def test_nearest_in_blocks(spark):
    """Ties, null and zero vectors, small batches and no query."""
    rows = spark.createDataFrame([(i, None if i == 5 else [0.0, 0.0] if i == 6 else [1.0, float(i % 3)]) for i in range(30)], "id long, vector array<double>").repartition(5)
    asked = spark.createDataFrame([("q", [1.0, 0.0]), ("z", [0.0, 0.0])], "qid string, qvec array<double>")
    got = {(r["qid"], r["rank"]): r["id"] for r in search.near_vector_topk(asked, rows, "id", 3).collect()}
    assert got == {("q", 1): 0, ("q", 2): 3, ("q", 3): 9, ("z", 1): 0, ("z", 2): 1, ("z", 3): 2}
    assert search.near_vector_topk(asked.limit(0), rows, "id", 3).count() == 0
    every = search.near_vectors(asked, rows, "id").filter("certainty >= 0.75").select("qid", "id", "cos", "certainty")
    some = search.near_vectors(asked, rows, "id", least=0.75).select("qid", "id", "cos", "certainty")
    assert sorted(map(tuple, every.filter("id != 5").collect())) == sorted(map(tuple, some.collect()))
    blank = spark.createDataFrame([("a", " "), ("b", None), ("c", "x")], "qid string, query string")
    assert [r["qid"] for r in search.asked(blank).collect()] == ["c"]
