"""Readers against what writers wrote, on awkward values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators import chunking, ingest
from folioscope.session import Settings
from folioscope.sources import readers, sinks

AWKWARD = ["", "\\", '\\"', 'a\\nb"\n\r\\\\', "\\\\\\", "x" * 200_000 + '"\\', "\\u0020 <é>", "{}|^`\t"]


@pytest.mark.parametrize("there,back", [(X.literal, lambda c: X.unescaped(F.substring(c, 2, F.length(c) - 2))), (X.iri, lambda c: X.iri_text(F.substring(c, 2, F.length(c) - 2)))])
def test_escapes_are_undone(spark, there, back):
    rows = spark.createDataFrame([(x,) for x in AWKWARD], "x string")
    assert [r["y"] for r in rows.select(back(there(F.col("x"))).alias("y")).collect()] == AWKWARD


def test_quads_keep_awkward_texts(spark, tmp_path):
    rows = [("urn:g h", f"urn:{i}", "urn:p", x, "en") for i, x in enumerate(AWKWARD)] + [("urn:g h", "urn:s", "urn:p", "urn:<o>", None)]
    sinks.quads(spark.createDataFrame(rows, "graph string, subject string, predicate string, object string, lang string"), str(tmp_path / "q"))
    got = readers.n_triples(spark, str(tmp_path / "q")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == sorted(rows, key=lambda r: r[1])


def test_patient_asks_a_bounded_number_of_times():
    asked = []

    def get(url):
        asked.append(url)
        return (503, None) if len(asked) < 3 or url == "never" else (200, "x")

    assert readers.patient(get, 3, 0)("a") == (200, "x") and len(asked) == 3
    asked.clear()
    assert readers.patient(get, 4, 0)("never") == (503, None) and len(asked) == 4


def test_gazetteer_by_header_and_by_position(spark, tmp_path):
    (tmp_path / "Nation.csv").write_text("identifier,country,name_fr,name_de,name_it,validFrom,wikidata\nCH,urn:1,Suisse,Schweiz,Svizzera,1848,Q39\n", encoding="utf-8")
    (tmp_path / "Gemeinde.csv").write_text("a,b,c\nurn:2,261,Bern\n", encoding="utf-8")
    got = readers.gazetteer(spark, str(tmp_path / "Nation.csv"), "nation").head()
    assert (got["name_de"], got["identifier"], got["valid_from"], got["url"], got["type"]) == ("Schweiz", "CH", "1848", "urn:1", "Nation")
    got = readers.gazetteer(spark, str(tmp_path / "Gemeinde.csv"), "municipality").head()
    assert (got["name_it"], got["identifier"], got["url"]) == ("Bern", "261", "urn:2")


def test_scrapers_on_pages_without_what_they_look_for(spark):
    rows = spark.createDataFrame([("",), (None,), ("<div class='results'></div>",), ("<div class='results'><table><tr><th>a</th></tr></table></div>",)], "h string")
    got = rows.select(readers.linked_rows(F.col("h"), "results").alias("r"), readers.labelled(F.col("h"), "x", "y").alias("l")).collect()
    assert [r["r"] or [] for r in got] == [[]] * 4 and [r["l"] for r in got] == [""] * 4


@pytest.mark.parametrize("distances,want", [([], [(0, 0)]), ([0.5], [(0, 1)]), ([0.1, 0.9, 0.1], [(0, 1), (2, 3)]), ([0.3, 0.3, 0.3], [(0, 3)])])
def test_semantic_spans(spark, distances, want):
    rows = spark.createDataFrame([(distances,)], "d array<double>")
    assert [tuple(x) for x in rows.select(chunking.semantic_spans(F.col("d")).alias("x")).head()["x"]] == want


def test_semantic_chunks_of_no_text(spark):
    rows = spark.createDataFrame([(None,), ("",), ("  ",), ("One.",)], "t string")
    assert [len(r["x"] or []) for r in rows.select(ingest.semantic_chunks(F.col("t")).alias("x")).collect()] == [0, 0, 0, 1]


def test_settings_come_from_the_environment(spark, monkeypatch):
    docs = spark.createDataFrame([("1", "One two. Three four. Five six.")], "doc_id string, text string")
    monkeypatch.setenv("FOLIOSCOPE_CHUNK_LIMIT", "2")
    monkeypatch.setenv("FOLIOSCOPE_SIMILARITY", "-1")
    assert Settings.from_environment().chunk_limit == 2 and Settings.from_environment().similarity == -1.0
    assert ingest.chunks(docs).count() == 3
    monkeypatch.setenv("FOLIOSCOPE_CHUNK_LIMIT", "4")
    assert [r["content"] for r in ingest.chunks(docs).orderBy("chunk_order").collect()] == ["One two. Three four.", "Five six."]
