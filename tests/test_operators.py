"""Boundary cases of the operators."""

from __future__ import annotations

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from folioscope import schema
from folioscope.functions import models, register
from folioscope.functions import text as X
from folioscope.operators import chunking, graph, linking, maintenance, monitoring, search
from folioscope.sources import readers, sinks


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).head()["x"]


@pytest.mark.parametrize(("n", "want"), [(0, []), (1, [(0, 1)]), (511, [(0, 511)]), (512, [(0, 512)]), (513, [(0, 512), (256, 513)]), (768, [(0, 512), (256, 768)]), (769, [(0, 512), (256, 768), (512, 769)])])
def test_windows(spark, n, want):
    rows = chunking.token_windows(spark.createDataFrame([(n,)], "n int"), "n", 512).orderBy("k").collect()
    assert [(r["start"], r["stop"]) for r in rows] == want


def test_windows_need_a_step(spark):
    with pytest.raises(ValueError, match="exceed"):
        chunking.token_windows(spark.range(1), "id", 256)


@pytest.mark.parametrize(
    ("items", "want"),
    [
        ([(40, None), (24, 0.89), (1, 0.99)], [0, 0, 1]),  # the sum exactly at the limit stays
        ([(10, None), (10, 0.89), (10, 0.8899)], [0, 0, 1]),  # a similarity exactly at the bound stays
        ([(100, None), (5, 0.99)], [0, 1]),  # a sentence beyond the limit stands alone
        ([(1, None)], [0]),
        ([(1, None), (1, 0.0)], [0, 1]),  # a zero vector breaks
    ],
)
def test_greedy(spark, items, want):
    df = spark.createDataFrame([("d", i, n, s) for i, (n, s) in enumerate(items)], "key string, i int, n bigint, sim double")
    got = chunking.greedy_chunks(df, "key", "i", "n", "sim", 64, 0.89).orderBy("i").collect()
    assert [r["chunk"] for r in got] == want


@pytest.mark.parametrize(
    ("sizes", "want"),
    [([1, 2], [0, 1]), ([2, 1, 1, 2], [0, 0, 0, 1]), ([1, 1], [0, 0])],
)
def test_merge(spark, sizes, want):
    chunks = [(c, 10) for c, size in enumerate(sizes) for _ in range(size)]
    df = spark.createDataFrame([("d", i, n, c) for i, (c, n) in enumerate(chunks)], "key string, i int, n bigint, chunk int")
    got = chunking.merged_chunks(df, "key", "n", 100).collect()
    of = {c: r["merged"] for r in got for c in range(len(sizes)) if r["first_chunk"] <= c}
    assert [of[c] for c in range(len(sizes))] == want


@pytest.mark.parametrize(("a", "b", "want"), [("abc", "abc", 100), ("", "", 100), ("", "x", 0), ("kitten", "sitting", 62), (None, "x", 0)])
def test_ratio(spark, a, b, want):
    assert one(spark, X.ratio(F.col("a"), F.col("b")), a=a, b=b) == want


def test_token_sort(spark):
    assert one(spark, X.token_sort_ratio(F.col("a"), F.col("b")), a="Meier, Hans", b="hans MEIER!") == 100
    assert one(spark, X.sorted_tokens(F.col("a")), a="Zürich") == "zrich"


@pytest.mark.parametrize(("text", "want"), [('x {"a": {"b": 1}} {y}', '{"a": {"b": 1}}'), ("no", None), ("} {a}", None), ("{a", None), ("", None)])
def test_balanced(spark, text, want):
    assert one(spark, X.balanced_object(F.col("t")), t=text) == want


@pytest.mark.parametrize(("text", "want"), [("1857-1927", "1857"), ("um 1850", "1850"), ("18501-", "1850"), ("", ""), (None, "")])
def test_year(spark, text, want):
    assert one(spark, X.year(F.col("t")), t=text) == want


def test_sentences(spark):
    assert one(spark, X.sentences(F.col("t")), t="Ja. Nein!  Wie?\nGut") == ["Ja.", "Nein!", "Wie?", "Gut"]
    assert one(spark, X.sentences(F.col("t")), t="") == []


def test_reduce_mentions(spark):
    df = spark.createDataFrame([("Anna Meier",), ("Meier",), (" Meier ",), ("Huber",)], "name string")
    assert sorted(r["name"] for r in linking.reduce_mentions(df, "name").collect()) == ["Anna Meier", "Huber"]


def plain_ratio(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j, prev=row, x=x: max(prev[j], left, prev[j - 1] + 1 if b[j - 1] == x else 0), initial=0))
    return round(200 * row[-1] / (len(a) + len(b)))


@pytest.mark.parametrize("least", [60, 85, 100])
def test_alike_words_against_all_pairs(spark, least):
    rng = random.Random(7)
    words = {"".join(rng.choices("abc", k=rng.randint(1, 12))) for _ in range(150)} | {"abcdefghijk", "abcdefghijkxxxx", "Zoë", "zoé"}
    left, right = sorted(words)[::2] + ["abcdefghijk", "ABCA"], sorted(words)[1::2] + ["abcdefghijkxxxx", "abca"]
    a, b = (spark.createDataFrame([(w,) for w in x], f"{c} string").distinct() for x, c in ((left, "a"), (right, "b")))
    got = {(r["a"], r["b"]) for r in linking.alike(a, b, least).collect()}
    assert got == {(x, y) for x in left for y in right if plain_ratio(x.lower(), y.lower()) >= least}


def test_alike_words_of_no_words(spark):
    none = spark.createDataFrame([], "a string")
    assert linking.alike(none, none.withColumnRenamed("a", "b"), 85).count() == 0
    assert linking.reduce_mentions(spark.createDataFrame([(None,), ("",), ("Meier",)], "name string"), "name").collect() == [("Meier",)]


def test_searches_do_not_depend_on_what_is_broadcast(spark, monkeypatch):
    rng = random.Random(3)
    vector = lambda: [rng.random() for _ in range(4)]
    asked = spark.createDataFrame([(i, vector()) for i in range(5)], "qid int, qvec array<double>")
    parents = spark.createDataFrame([(i, vector()) for i in range(4)], "label int, vector array<double>")
    rows = spark.createDataFrame([(i, i % 4, vector()) for i in range(40)], "id int, label int, vector array<double>")
    docs = spark.createDataFrame([(1, "a b c a"), (2, "c d"), (3, None), (4, "")], "id int, t string")
    words = spark.createDataFrame([(0, "a c"), (1, "d x"), (2, None)], "qid int, query string")

    def found():
        near, two = search.near_vector_topk(asked, rows, "id"), search.layered(asked, parents, rows, "label", "id", 2, 3)
        key = search.bm25(words, docs, "id", "t")
        fused = search.fuse(search.near_vectors(asked, rows, "id").select("qid", "id", "cos"), key, "id", queries=asked)
        return [sorted(map(tuple, df.select("qid", "id", c).collect())) for df, c in ((near, "rank"), (two, "rank"), (key, "bm25"), (fused, "score"))]

    small = found()
    monkeypatch.setattr(search, "fits", lambda df, limit=0: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert found() == small
        assert {(q, i) for q, i, _ in small[2]} == {(0, 1), (0, 2), (1, 2)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sizes(spark):
    from folioscope.operators.sizes import fits

    df = spark.createDataFrame([("x" * 1000, 1), (None, None)], "t string, n long")
    assert fits(df, 2000) and not fits(df, 1000) and fits(df.limit(0), 0)


@pytest.mark.parametrize(
    ("birth", "death", "want"),
    [(None, None, True), ("x", "y", True), (None, "1924.0", True), (None, "1903", False), ("1903", None, True), ("1904", None, True), ("1905", None, False)],
)
def test_alive(spark, birth, death, want):
    df = spark.createDataFrame([(birth, death, dt.date(1924, 1, 1))], "birth string, death string, d date")
    assert df.filter(linking.alive("birth", "death", F.col("d"))).count() == want


def test_search_ties_and_limits(spark):
    rows = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0])], "id int, vector array<double>")
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "qid int, qvec array<double>")
    got = search.near_vector_topk(asked, rows, "id", 9).orderBy("rank").collect()
    assert [(r["id"], r["cos"]) for r in got] == [(1, 1.0), (3, 1.0), (2, 0.0)]


def test_fuse_of_equal_scores(spark):
    v = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.5)], "qid int, id int, cos double")
    k = spark.createDataFrame([(0, 2, 3.0), (0, 3, 1.0)], "qid int, id int, bm25 double")
    got = {r["id"]: r["score"] for r in search.fuse(v, k, "id").collect()}
    assert got == {1: 0.25, 2: 1.0, 3: 0.0}


def test_keyword_has_no_patterns(spark):
    df = spark.createDataFrame([("100% sure",), ("100 sure",)], "t string")
    assert [r["t"] for r in search.keyword(df, "t", "0% S").collect()] == ["100% sure"]


def test_nearest_takes_the_earlier_of_equals(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    left = spark.createDataFrame([("u", at(10), 1), ("v", at(1), 2)], "u string, ts timestamp, l bigint")
    right = spark.createDataFrame([("u", at(5), 7), ("u", at(15), 8)], "u string, ts timestamp, r bigint")
    got = monitoring.nearest(left, right, "u", "ts", "l", "r").collect()
    assert [(r["l"], r["r"], r["micros"]) for r in got] == [(1, 7, 5_000_000)]


def test_log_lines(spark):
    lines = ["2024-01-01 10:00:00,123 INFO: Stored triples for chunk 12/3", "2024-01-01 10:00:00,123 INFO: Stored triples for chunk ab/3", "junk"]
    got = monitoring.parsed(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r["root"] for r in got] == ["12"]


def test_triples_survive_a_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("7", 0, 'He said "no"\nand left /{x}', "en")], "doc_id string, chunk_order int, content string, lang string")
    made = graph.chunk_triples(df, "urn:g")
    made.select(F.expr("*")).count()
    lines = graph.n_quads(made).select(F.regexp_replace("value", r" <urn:g> \.$", " .").alias("value"))
    lines.coalesce(1).write.text(str(tmp_path / "g"))
    name = next((tmp_path / "g").glob("part-*.txt"))
    name.rename(tmp_path / "minutes.nt")
    back = readers.n_triples(spark, str(tmp_path / "minutes.nt")).collect()
    assert {r["graph"] for r in back} == {"minutes"} and len(back) == 3
    assert [r["lang"] for r in back if r["lang"]] == ["en"]


def test_files(spark, tmp_path):
    day = spark.createDataFrame([(dt.date(1917, 9, 3), "12", "E 1"), (dt.date(1917, 9, 3), "13", "E 2")], "date date, doc_id string, signature string")
    sinks.manifest(day, str(tmp_path / "m"))
    got = readers.manifest(spark, str(tmp_path / "m" / "*" / "*.txt")).collect()
    assert [(r["date"], r["doc_id"], r["signature"]) for r in got] == [(dt.date(1917, 9, 3), "13", "E 2")]
    folder = tmp_path / "t" / "1917" / "9"
    folder.mkdir(parents=True)
    (folder / "1917-9-3.txt").write_text("a\nb", encoding="utf-8")
    texts = readers.whole_texts(spark, str(tmp_path / "t" / "*" / "*" / "*.txt")).collect()
    assert [(r["text"], r["year"], r["month"], r["date"]) for r in texts] == [("a\nb", "1917", "09", "1917-9-3")]
    found, lost = maintenance.split_missing(day, spark.createDataFrame([("12",)], "doc_id string"), "doc_id")
    assert (found.count(), lost.count()) == (1, 1)
    sinks.rejects(lost, str(tmp_path / "dead"))
    assert spark.read.text(str(tmp_path / "dead")).head()["value"] == "03.09.1917 13 E 2"
    (tmp_path / "Kanton.csv").write_text('graph,sub,identifier,name_de,name_fr,name_it\ng,urn:1,ZH,"Zürich, Stadt",Zurich,Zurigo\n', encoding="utf-8")
    place = readers.gazetteer(spark, str(tmp_path / "Kanton.csv"), "canton").head()
    assert (place["name_de"], place["identifier"], place["url"], place["type"]) == ("Zürich, Stadt", "ZH", "urn:1", "Kanton")


def test_html_tables(spark):
    html = "<table><tr><th>h</th></tr><tr><td>1</td><td>a</td><td><a href='x'>b</a></td></tr><tr><td>2</td></tr></table>"
    assert one(spark, readers.table_rows(F.col("h")), h=html) == [["1", "a", "b"]]


def test_fetch_tells_errors(spark):
    def get(url):
        if url == "bad":
            raise OSError("gone")
        return 200, url.upper()

    got = readers.fetched(spark.createDataFrame([("a",), ("bad",)], "url string"), get).orderBy("url").collect()
    assert [(r["status"], r["body"], r["error"]) for r in got] == [(200, "A", None), (0, None, "gone")]


def test_collections(spark):
    table = "folio_places"
    schema.drop(spark, table)
    schema.create(spark, "places", table)
    schema.create(spark, "places", table)
    schema.insert(spark.createDataFrame([("x", "Bern")], "url string, name_de string"), "places", table)
    assert spark.table(table).select("name_de", "url", "type").head() == ("Bern", "x", None)
    schema.drop(spark, table)


def test_registered_functions(spark):
    register.register(spark)
    assert spark.sql("SELECT round(vector_cosine(array(1d, 0d), array(1d, 1d)), 3) AS x").head()["x"] == 0.707
    assert spark.sql("SELECT vector_mean(v) AS m FROM VALUES (array(1d, 3d)), (array(3d, 5d)) AS t(v)").head()["m"] == [2.0, 4.0]
    assert spark.sql("SELECT * FROM token_windows('a b c d e', 3, 1)").count() == 2


def test_default_models(spark):
    import pandas as pd

    votes = spark.createDataFrame([("der die und",), ("zzz",), (None,), ("la",)], "t string").select(X.language_vote(F.col("t"), models.STOP_WORDS).alias("x"))
    assert [r["x"] for r in votes.collect()] == ["de", "other", "other", "es"]
    assert models.capitalised_spans(pd.Series(["We met Anna Meier in Bern."])).iloc[0] == [{"text": "Anna Meier", "label": "PER"}, {"text": "Bern", "label": "LOC"}]
    assert models.overlap_judge([{"url": "u", "description": "federal judge"}, {"url": "", "description": "judge"}], "the judge") == [{"url": "u", "description": "federal judge"}]


def test_plausible(spark):
    rows = [
        (1, "PER", "u1", "judge"), (1, "PER", "u2", None), (1, "PER", None, "judge"), (1, "ORG", "o", None),
        (2, "LOC", "p", None), (3, "PER", "u1", "fails"), (3, "LOC", "p", None), (4, "PER", "u1", "none"), (4, "ORG", "o", None),
        (5, "PER", "u9", "judge"), (None, "LOC", "p", None), (1, "ORG", "o", None),
    ]
    found = spark.createDataFrame(rows, "part long, kind string, url string, description string")
    texts = spark.createDataFrame([(1, "the judge"), (1, "the judge"), (2, None), (3, "t"), (4, "t")], "part long, text string")

    def judge(people, text):
        told = {p["description"] for p in people}
        if "fails" in told:
            raise ValueError("no object")
        return None if "none" in told else models.overlap_judge(people, text)

    got = linking.plausible(found, texts, judge)
    assert got.columns == found.columns
    assert sorted((r["part"], r["kind"], r["url"]) for r in got.collect()) == [(1, "ORG", "o"), (1, "ORG", "o"), (1, "PER", "u1"), (2, "LOC", "p")]
    # a judge that answers in time is heard
    calls = []

    def late(people, text):
        calls.append(1)
        if len(calls) < 4:
            raise ValueError("not yet")
        return people

    one = found.filter("part = 5").coalesce(1)
    assert [r["url"] for r in linking.plausible(one, texts, late).collect()] == ["u9"]
    assert linking.plausible(one, texts, late, calls=1).count() == 0
    assert linking.plausible(found.limit(0), texts, judge).count() == 0


def test_mentions_by_language(spark):
    rows = [(1, " Ann Lee ", "de"), (2, "x", "fr"), (3, "y", None), (4, None, "en"), (5, "z", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def says(name, label="PER"):
        return lambda texts: texts.map(lambda t: [{"text": f" {name} ", "label": label}] * 2 if t else [])

    got = linking.mentions(docs, "doc_id", "text", "lang", says("other", "LOC"), {"de": says("german"), "fr": says("french", "MISC")})
    assert sorted(map(tuple, got.collect())) == [(1, "german", "PER"), (3, "other", "LOC"), (5, "german", "PER")]
    assert linking.mentions(docs.limit(0), "doc_id", "text", "lang", says("a")).count() == 0
