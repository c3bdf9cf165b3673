"""Readers. Paths go to Spark only, so any store that it knows can hold them."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as X


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, year, month, date) of text files named .../{year}/{month}/{yyyy-mm-dd}.txt."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    date = F.regexp_extract("path", r"([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})\.txt$", 1)
    return rows.withColumn("year", F.regexp_extract("path", r"/([0-9]{4})/[0-9]{1,2}/[^/]+$", 1)).withColumn("month", F.lpad(F.regexp_extract("path", r"/([0-9]{1,2})/[^/]+$", 1), 2, "0")).withColumn("date", date)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(date, doc_id, signature) of JSON maps from dd.mm.yyyy to [number, signature]."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("day", "v"))
    return rows.select(F.to_date("day", "dd.MM.yyyy").alias("date"), F.col("v")[0].alias("doc_id"), F.col("v")[1].alias("signature"))


def log_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).text(path)


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with header; without schema, types are inferred."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


# Columns of the gazetteer files, in the order of each file, and the ones that each collection takes.
PLACES = {
    "canton": ("graph, sub, identifier, name_de, name_fr, name_it", {"name_de": "name_de", "name_fr": "name_fr", "name_it": "name_it", "identifier": "identifier", "url": "sub"}),
    "district": ("graph, sub, identifier, name", {"name_de": "name", "identifier": "identifier", "url": "sub"}),
    "municipality": ("url, identifier, name", {"name_de": "name", "name_fr": "name", "name_it": "name", "identifier": "identifier", "url": "url"}),
    "nation": ("country, identifier, name_de, name_fr, name_it, validFrom, wikidata", {"name_de": "name_de", "name_fr": "name_fr", "name_it": "name_it", "valid_from": "validFrom", "identifier": "identifier", "url": "country"}),
}


def persons(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of people, by position: number, lemma, complement, years of birth and death, url, marks of uncertainty, description,
    author, translator; shorter rows are filled up with empty texts. The name is complement and lemma."""
    columns = "identifier, lemma, complement, birthyear, deathyear, url, birth_mark, death_mark, description, author, translator"
    rows = csv(spark, path, ", ".join(f"{c.strip()} string" for c in columns.split(",")))
    rows = rows.select(*(F.coalesce(c, F.lit("")).alias(c) for c in rows.columns))
    name = F.concat_ws(" ", "complement", "lemma")
    return rows.select(name.alias("name"), "complement", "lemma", "description", "birthyear", "deathyear", F.expr("try_cast(identifier AS int)").alias("identifier"), "url", (F.col("birth_mark") != "").alias("birth_uncertainty"), (F.col("death_mark") != "").alias("death_uncertainty"), "author", "translator")


def organizations(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of organisations, by position: url, German name, French name; type is the file's stem."""
    rows = csv(spark, path, "url string, name_de string, name_fr string")
    return rows.select("name_de", "name_fr", F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1).alias("type"), "url")


def padded(row: Column, size: int = 8) -> Column:
    """A row's cells, filled up with empty texts."""
    cells = F.coalesce(row, F.array().cast("array<string>"))
    return F.concat(cells, F.array_repeat(F.lit(""), F.greatest(F.lit(size) - F.size(cells), F.lit(0))))


def years(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Rows of a dataset in folders year=/month=; other years' folders aren't read."""
    return spark.read.parquet(path).filter(F.col("year").between(first, last))


def gazetteer(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A places file in the places schema, by the names in its header, or by position if it has others; type is the file's
    stem."""
    columns, taken = PLACES[kind]
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if not set(taken.values()) <= set(rows.columns):
        rows = csv(spark, path, ", ".join(f"{c.strip()} string" for c in columns.split(",")))
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)
    return rows.select(*(F.col(v).alias(k) for k, v in taken.items()), stem.alias("type"))


def embedding_input(kind: Column, name: Column) -> Column:
    return F.concat_ws(" ", kind, name)


def n_triples(spark: SparkSession, path: str) -> DataFrame:
    """(graph, subject, predicate, object, lang) of N-Quads, N-Triples or one-line Turtle files; where a line tells no graph, it is
    the file's stem. Literals of any length: the pattern is possessive, so that matching needs no stack."""
    line = r'^<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]++|\\.)*+)"(?:@([A-Za-z-]+)|\^\^<[^>]*>)?)\s*(?:<([^>]*)>)?\s*\.'
    rows = spark.read.text(path).filter(F.col("value").rlike(line))
    part = lambda i: F.nullif(F.regexp_extract("value", line, i), F.lit(""))
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.(?:ttl|nt)$", 1)
    obj = F.coalesce(X.iri_text(part(3)), X.unescaped(F.regexp_extract("value", line, 4)))
    return rows.select(F.coalesce(X.iri_text(part(6)), stem).alias("graph"), X.iri_text(part(1)).alias("subject"), X.iri_text(part(2)).alias("predicate"), obj.alias("object"), part(5).alias("lang"))


def html_parts(html: Column) -> dict[str, Column]:
    """Title, first link, number of links, meta description and first heading of a page."""
    return {
        "title": F.regexp_extract(html, r"<title>([^<]*)</title>", 1),
        "heading": F.regexp_extract(html, r"<h1>([^<]*)</h1>", 1),
        "description": F.regexp_extract(html, r'<meta name="description" content="([^"]*)"', 1),
        "first_link": F.regexp_extract(html, r'<a href="([^"]*)"', 1),
        "n_links": F.regexp_count(html, F.lit("<a href=")),
    }


def table_rows(html: Column) -> Column:
    """Rows of the first table but its header, each an array of cell texts; rows with fewer than three cells are left out."""
    rows = F.split(F.regexp_extract(html, r"(?s)<table[^>]*>(.*?)</table>", 1), "</tr>")
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", ""))))
    return F.filter(cells, lambda c: F.size(c) >= 3)


def linked_rows(html: Column, box: str, number: str = r"/(\d+)\.json") -> Column:
    """Rows of the table in the first element of a class, but its header: structs of the first cell's date, the number that the
    second cell's link holds, and the third cell's signature. Rows without such a link or with fewer cells are left out."""
    table = F.regexp_extract(html, rf"""(?s)class=["'](?:[^"']*\s)?{box}(?:\s[^"']*)?["'].*?<table[^>]*>(.*?)</table>""", 1)
    rows = F.regexp_extract_all(table, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    plain = lambda cell: F.trim(F.regexp_replace(cell, "<[^>]*>", ""))

    def described(row: Column) -> Column:
        cells = F.regexp_extract_all(row, F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1))
        link = F.regexp_extract(F.get(cells, F.lit(1)), r"""<a\s[^>]*href=["']([^"']*)["']""", 1)
        return F.struct(plain(F.get(cells, F.lit(0))).alias("date"), F.regexp_extract(link, number, 1).alias("number"), plain(F.get(cells, F.lit(2))).alias("signature"))

    found = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), described)
    return F.filter(found, lambda r: (r["number"] != "") & r["signature"].isNotNull())


def labelled(html: Column, box: str, label: str) -> Column:
    """The text that follows the last span of a class with this label; empty if there is none."""
    span = rf"""(?s)<span[^>]*class=["'](?:[^"']*\s)?{box}(?:\s[^"']*)?["'][^>]*>\s*{label}\s*</span>([^<]*)"""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(span), F.lit(1))
    return F.trim(F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("")))


def patient(get: Callable[[str], tuple[int, str | None]], tries: int, wait: float = 3.0) -> Callable[[str], tuple[int, str | None]]:
    """get, asked again while it answers 503, so many times at most; any other answer stands."""

    def ask(url: str) -> tuple[int, str | None]:
        for i in range(tries):
            status, body = get(url)
            if status != 503:
                break
            if i + 1 < tries:
                time.sleep(wait)
        return status, body

    return ask


def fetched(urls: DataFrame, get, url: str = "url") -> DataFrame:
    """urls with status and body, by a function from a url to both; bounded retries are the function's. Failures have the
    status 0 and an error text for the dead letters."""

    def run(batches):
        for pdf in batches:
            found = []
            for u in pdf[url]:
                try:
                    found.append((*get(u), None))
                except Exception as e:  # noqa: BLE001  the row tells it
                    found.append((0, None, str(e)))
            yield pdf.assign(status=[x[0] for x in found], body=[x[1] for x in found], error=[x[2] for x in found])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema), "status int, body string, error string"])
    return urls.mapInPandas(run, schema)
