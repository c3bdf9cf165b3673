"""Queries that go through files, tables and pages: what a reader gives of what a writer wrote, each beside its SQL. The files
lie in a new folder beside the checkpoints, or else in the warehouse."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import schema
from folioscope.functions import text as X
from folioscope.operators import ingest, maintenance, monitoring, search
from folioscope.plans.lifecycle import _LOWER, page_search
from folioscope.plans.queries import _HASHED, _TOKENS, SQL, _base, query, table
from folioscope.sources import readers, sinks


@query("""SELECT strftime(d, '%Y-%m-%d') AS date, max(k) AS doc_id, arg_max(s, k) AS signature
FROM (SELECT o_orderdate::DATE AS d, o_orderkey::VARCHAR AS k, 'E "' || o_custkey || '"' AS s FROM orders) GROUP BY d""")
def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests, a file a month; of a date's rows the one of greatest id stands."""
    base = _base(spark, "manifests")
    signature = F.concat(F.lit('E "'), F.col("o_custkey").cast("string"), F.lit('"'))
    sinks.manifest(table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").cast("string").alias("doc_id"), signature.alias("signature")), base)
    return readers.manifest(spark, f"{base}/*/*.txt").withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("""SELECT c_custkey, c_name, c_mktsegment || ', "' || c_custkey || '"' || chr(10) || 'line' AS remark, c_acctbal FROM customer""")
def csv_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV written and appended to, read with inferred types."""
    base, key = _base(spark, "csv"), F.col("c_custkey")
    remark = F.concat("c_mktsegment", F.lit(', "'), key.cast("string"), F.lit('"\nline'))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", remark.alias("remark"), "c_acctbal")
    sinks.csv(rows.filter(key % 2 == 0), base)
    sinks.csv(rows.filter(key % 2 == 1), base, "append")
    return readers.csv(spark, base).withColumn("c_custkey", key.cast("long"))


@query("""SELECT c_name AS name_de, lower(c_name) AS name_fr, upper(c_name) AS name_it, c_nationkey::VARCHAR AS identifier, 'urn:' || c_custkey AS url FROM customer""")
def csv_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gazetteer file, read by the names in its header, which come in another order than the reader lists them."""
    base = _base(spark, "places")
    rows = table(spark, sf_dir, "customer").select(F.lower("c_name").alias("name_fr"), F.upper("c_name").alias("name_it"), F.col("c_name").alias("name_de"), F.concat(F.lit("urn:"), "c_custkey").alias("sub"), F.lit("g").alias("graph"), F.col("c_nationkey").alias("identifier"))
    sinks.csv(rows, base)
    return readers.gazetteer(spark, base, "canton").drop("type")


@query("""SELECT trim(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'von' END || ' ' || c_name) AS name, c_custkey::INT AS identifier, 'urn:' || c_custkey AS url, c_custkey % 2 = 0 AS birth_uncertainty, false AS death_uncertainty, c_mktsegment AS description FROM customer""")
def csv_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People by position: names composed, marks turned into booleans, missing cells empty."""
    base, key = _base(spark, "persons"), F.col("c_custkey")
    mark = F.when(key % 2 == 0, "?")
    cells = [key, F.col("c_name"), F.when(key % 3 != 0, "von"), F.lit("1850"), F.lit(None).cast("string"), F.concat(F.lit("urn:"), key), mark, F.lit(None).cast("string"), F.col("c_mktsegment"), F.lit("a"), F.lit("t")]
    sinks.csv(table(spark, sf_dir, "customer").select(*(c.alias(f"c{i}") for i, c in enumerate(cells))), base)
    return readers.persons(spark, base).select(F.trim("name").alias("name"), "identifier", "url", "birth_uncertainty", "death_uncertainty", "description")


@query("""SELECT c_name AS name_de, lower(c_name) AS name_fr, 'part' AS type, 'urn:' || c_custkey AS url FROM customer""")
def csv_organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisations by position; the type is the file's stem, which Spark's writer begins with `part`."""
    base = _base(spark, "organizations")
    sinks.csv(table(spark, sf_dir, "customer").select(F.concat(F.lit("urn:"), "c_custkey").alias("a"), F.col("c_name").alias("b"), F.lower("c_name").alias("c")), base)
    return readers.organizations(spark, base).withColumn("type", F.substring("type", 1, 4))


@query("""SELECT 'urn:g' || doc_id % 3 AS graph, 'urn:doc:' || coalesce(source, '') || ' ' || doc_id AS subject, 'urn:text' AS predicate, md5(text) AS object_md5, lang FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL
UNION ALL SELECT 'urn:g' || doc_id % 3, 'urn:doc:' || coalesce(source, '') || ' ' || doc_id, 'urn:next', md5('urn:<doc>{' || (doc_id + 1) || '}'), NULL FROM documents""")
def quad_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples written as quads and read again: texts with quotes and line ends, IRIs with characters that they can't hold."""
    base, d = _base(spark, "quads"), F.col("doc_id")
    said = F.struct(F.lit("urn:text").alias("predicate"), F.col("text").alias("object"), F.col("lang").alias("lang"))
    after = F.struct(F.lit("urn:next").alias("predicate"), F.concat(F.lit("urn:<doc>{"), d + 1, F.lit("}")).alias("object"), F.lit(None).cast("string").alias("lang"))
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("urn:g"), d % 3).alias("graph"), F.concat(F.lit("urn:doc:"), F.coalesce("source", F.lit("")), F.lit(" "), d).alias("subject"), F.explode(F.array(said, after)).alias("x")).select("graph", "subject", "x.*")
    sinks.quads(rows.filter("predicate != 'urn:text' OR (object IS NOT NULL AND lang IS NOT NULL)"), base)
    return readers.n_triples(spark, base).select("graph", "subject", "predicate", F.md5("object").alias("object_md5"), "lang")


@query("""SELECT 'g' || r_regionkey AS graph, r_name AS object FROM region WHERE r_regionkey != 0 UNION ALL SELECT 'g0', 'new' UNION ALL SELECT 'g9', 'new'""")
def graph_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs uploaded, one of them again: it is replaced as a whole, the others stay."""
    base = _base(spark, "graphs")
    rows = table(spark, sf_dir, "region").select(F.concat(F.lit("g"), "r_regionkey").alias("graph"), F.col("r_name").alias("object"))
    sinks.graph(rows, base)
    sinks.graph(spark.range(2).select(F.when(F.col("id") == 0, "g0").otherwise("g9").alias("graph"), F.lit("new").alias("object")), base)
    return spark.read.parquet(base).select("graph", "object")


@query(f"""SELECT doc_id::VARCHAR AS doc_id, lang AS language, md5(text) AS content_md5, array_to_string(list_transform({_HASHED.format(_LOWER.format(_TOKENS.format('text')))}, lambda x: x::INT::VARCHAR), ',') AS vector FROM documents WHERE doc_id % 3 != 0""")
def collection_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection created unless it is there, filled with vectors, and rows deleted by id; its table is dropped at last."""
    name, base = f"upkeep_{uuid.uuid4().hex}", _base(spark, "upkeep")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").alias("language"), F.col("text").alias("content"), ingest.token_sums(X.tokens(F.col("text"))).alias("vector"))
    schema.create(spark, "chunks", name)
    schema.create(spark, "chunks", name)
    schema.insert(docs, "chunks", name)
    gone = table(spark, sf_dir, "documents").filter("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("doc_id"))
    sinks.objects(maintenance.without(spark.table(name), gone, "doc_id"), base)
    schema.drop(spark, name)
    return spark.read.parquet(base).select("doc_id", "language", F.md5("content").alias("content_md5"), F.array_join(F.transform("vector", lambda x: x.cast("int").cast("string")), ",").alias("vector"))


@query("SELECT event_id, event_type FROM events WHERE event_id % 4 NOT IN (0, 1)")
def ledger_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to do after two runs that wrote their keys to the ledger, the second some of them again."""
    base, rows = _base(spark, "ledger"), table(spark, sf_dir, "events").select("event_id", "event_type")
    sinks.ledger(rows.filter("event_id % 4 = 0"), "event_id", base)
    sinks.ledger(rows.filter("event_id % 4 IN (0, 1)"), "event_id", base)
    return maintenance.pending(rows, spark.read.parquet(base), "event_id")


@query(r"""SELECT strptime(strftime(ts, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS ts, user_id::VARCHAR AS root FROM events WHERE event_type NOT IN ('view', 'error')""")
def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log files, line by line: requests and lines that tell no stored chunk don't count."""
    base, kind = _base(spark, "logs"), F.col("event_type")
    said = F.when(kind == "error", "failed").otherwise(F.concat(F.when(kind == "view", "HTTP Request: ").otherwise(""), F.lit("Stored triples for chunk "), "user_id", F.lit("/"), "event_id"))
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(",000 INFO: "), said)
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(base)
    return monitoring.parsed(readers.log_lines(spark, base)).select(F.col("ts").cast("timestamp_ntz").alias("ts"), "root")


@query("SELECT o_orderkey, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month FROM orders WHERE year(o_orderdate) BETWEEN 1993 AND 1995")
def year_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in folders of years and months; other years' folders aren't read."""
    base = _base(spark, "years")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    rows.repartition("year", "month").write.partitionBy("year", "month").parquet(base)
    return readers.years(spark, base, 1993, 1995).select("o_orderkey", "year", "month")


@query("""SELECT conv_id, turn, lpad((turn % 28 + 1)::VARCHAR, 2, '0') || '.01.1917' AS date, conv_id::VARCHAR AS number, 'E ' || role AS signature FROM conversations WHERE turn % 4 < 2""")
def scraped_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a result table: the header, rows without link, and tables outside the box are left out."""
    kind = F.col("turn") % 4
    date = F.concat(F.lpad((F.col("turn") % 28 + 1).cast("string"), 2, "0"), F.lit(".01.1917"))
    link = F.when(kind == 2, "none").otherwise(F.concat(F.lit('<a class="x" href="/file/'), "conv_id", F.lit('.json">open</a>')))
    cells = F.when(kind == 3, F.concat(F.lit("<td>"), date, F.lit("</td>"))).otherwise(F.concat(F.lit("<td> "), date, F.lit("\n</td><td>"), link, F.lit("</td><td>E <b>"), "role", F.lit("</b></td>")))
    html = F.concat(F.lit('<table><tr><td>1</td><td>2</td></tr></table><div class="results wide">\n<table border="0"><tr><th>date</th></tr><tr>'), cells, F.lit("</tr></table></div>"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(readers.linked_rows(html, "results")).alias("x"))
    return rows.select("conv_id", "turn", F.regexp_replace("x.date", r"\s", "").alias("date"), "x.number", "x.signature")


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '' ELSE role END AS author, CASE WHEN turn % 2 = 0 THEN '' ELSE 'n' || conv_id END AS translator, 'about ' || role AS description FROM conversations""")
def scraped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts beside labels, and the description in a page's head."""
    turn = F.col("turn")
    span = lambda label, text: F.concat(F.lit(f'<span class="who function">{label}:</span> '), text, F.lit("<br>"))
    html = F.concat(F.lit('<meta name="description" content="about '), "role", F.lit('">'), F.when(turn % 3 != 0, span("Author", F.col("role"))).otherwise("<span>Author:</span> x"), F.when(turn % 2 == 1, span("Translator", F.concat(F.lit("n"), "conv_id"))).otherwise(""))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", html.alias("html"))
    page = F.col("html")
    return rows.select("conv_id", "turn", readers.labelled(page, "function", "Author:").alias("author"), readers.labelled(page, "function", "Translator:").alias("translator"), readers.html_parts(page)["description"].alias("description"))


def _scripted():
    """A source of pages: every fifth answers at the third try only, every seventh never, every eleventh breaks."""
    seen: dict[str, int] = {}

    def get(url: str) -> tuple[int, str | None]:
        number = int(url.rsplit("/", 1)[-1])
        seen[url] = seen.get(url, 0) + 1
        if number % 11 == 0:
            raise OSError("gone")
        if number % 7 == 0 or (number % 5 == 0 and seen[url] < 3):
            return 503, None
        return (404, None) if number % 13 == 0 else (200, f"page {number}")

    return get


@query("""SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 0 WHEN page_id % 7 = 0 THEN 503 WHEN page_id % 13 = 0 THEN 404 ELSE 200 END AS status, CASE WHEN page_id % 11 != 0 AND page_id % 7 != 0 AND page_id % 13 != 0 THEN 'page ' || page_id END AS body, CASE WHEN page_id % 11 = 0 THEN 'gone' END AS error FROM pages""")
def fetch_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downloads: three tries while the answer is 503, other answers stand, an error is told in its row."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("urn:/"), "page_id").alias("url"))
    return readers.fetched(rows, readers.patient(_scripted(), 3, 0)).drop("url")


@query("SELECT count(*) AS n, sum(n_chars)::BIGINT AS chars, count(*) FILTER (text IS NULL) AS empty FROM documents")
def observed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums of a job, gathered while it runs."""
    rows, seen = sinks.observed(table(spark, sf_dir, "documents"), n=F.count(F.lit(1)), chars=F.sum("n_chars"), empty=F.count_if(F.col("text").isNull()))
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["n"], seen.get["chars"], seen.get["empty"])], "n long, chars long, empty long")


@query(f"""WITH se AS (SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\n\\r\\f]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x != '') AS l FROM documents)),
sv AS MATERIALIZED (SELECT doc_id, i, s, {_HASHED.format(_LOWER.format('w'))} AS v FROM (SELECT *, {_TOKENS.format('s')} AS w FROM se)),
r AS MATERIALIZED (SELECT doc_id, i, s, CASE WHEN i > 0 THEN round(1 - CASE WHEN list_sum(v) > 0 AND list_sum(lag(v) OVER o) > 0 THEN list_cosine_similarity(lag(v) OVER o, v) ELSE 0 END, 6) END AS distance FROM sv WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT *, CASE WHEN distance > round(quantile_cont(distance, 0.95) OVER (PARTITION BY doc_id), 9) THEN 1 ELSE 0 END AS begins FROM r),
c AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS chunk FROM b)
SELECT doc_id, chunk::INT AS chunk_order, count(*)::INT AS n_sentences, md5(string_agg(s, ' ' ORDER BY i)) AS content_md5 FROM c GROUP BY doc_id, chunk""")
def semantic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that end where the distance of neighbouring sentences exceeds the document's 95th percentile, in the document's row."""
    each = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(ingest.semantic_chunks(F.col("text"))).alias("chunk_order", "x"))
    return each.select("doc_id", "chunk_order", "x.n_sentences", F.md5("x.content").alias("content_md5"))


@query(f"""WITH hits AS ({SQL['page_search']}) SELECT qid, '<ol>' || string_agg('<li>' || doc_id || ' (' || score || ')</li>', '' ORDER BY rank) || '</ol>' AS html FROM hits GROUP BY qid""")
def results_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.results_page(page_search(spark, sf_dir), "qid", "doc_id")
