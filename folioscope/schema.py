"""Fixed schemas of the collections, and a registry that creates, describes and drops them as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_VECTOR = "vector array<float>"
COLLECTIONS: dict[str, str] = {
    "chunks": f"content string, language string, chunk_id string, doc_id string, chunk_order int, {_VECTOR}",
    "documents": f"doc_id string, language string, file_name string, token_length int, {_VECTOR}",
    "persons": "name string, complement string, lemma string, description string, birthyear string, deathyear string, identifier int, url string, "
    f"birth_uncertainty boolean, death_uncertainty boolean, author string, translator string, roles array<string>, {_VECTOR}",
    "places": f"name_de string, name_fr string, name_it string, type string, valid_from string, identifier string, url string, {_VECTOR}",
    "organizations": f"name_de string, name_fr string, name_it string, type string, valid_from string, url string, {_VECTOR}",
    "triples": "graph string, subject string, predicate string, object string, object_kind string, lang string",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(COLLECTIONS[name])


def create(spark: SparkSession, name: str, table: str | None = None) -> None:
    """Create a collection's table unless it exists; triples are partitioned by graph."""
    by = " PARTITIONED BY (graph)" if name == "triples" else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table or name} ({COLLECTIONS[name]}) USING parquet{by}")


def drop(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def insert(df: DataFrame, name: str, table: str | None = None) -> None:
    """Append rows; missing columns are null, and column order doesn't matter."""
    from pyspark.sql import functions as F

    fields = schema(name).fields
    order = sorted(fields, key=lambda f: f.name == "graph") if name == "triples" else fields
    df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in order)).write.insertInto(table or name)


def describe(spark: SparkSession, table: str) -> list[tuple[str, str]]:
    return spark.table(table).dtypes
