"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from folioscope.operators.graph import n_quads


def objects(df: DataFrame, path: str, mode: str = "append") -> None:
    """Rows with vectors, in bulk."""
    df.write.mode(mode).parquet(path)


def graph(triples: DataFrame, path: str) -> None:
    """Triples by graph, each replaced as a whole."""
    triples.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("graph").parquet(path)


def quads(triples: DataFrame, path: str) -> None:
    n_quads(triples).write.mode("overwrite").text(path)


def observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """df, and its metrics (aggregates, such as counts and sums), which are there once an action on it has ended."""
    seen = Observation()
    return df.observe(seen, *(c.alias(k) for k, c in metrics.items())), seen


def csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """With one header a file; appending adds files, which readers.csv reads as one table."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def manifest(rows: DataFrame, path: str) -> None:
    """One JSON map from dd.mm.yyyy to [number, signature] for each month; of one date the last row stands."""
    day = rows.groupBy(F.date_format("date", "yyyy-MM").alias("month"), F.date_format("date", "dd.MM.yyyy").alias("day")).agg(F.max_by(F.array("doc_id", "signature"), "doc_id").alias("v"))
    maps = day.groupBy("month").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("day", "v"))))).alias("value"))
    maps.write.mode("overwrite").partitionBy("month").text(path)


def rejects(df: DataFrame, path: str) -> None:
    """Dead letters: date, id and signature, a line each."""
    df.select(F.concat_ws(" ", F.date_format("date", "dd.MM.yyyy"), F.col("doc_id").cast("string"), "signature").alias("value")).write.mode("append").text(path)


def ledger(df: DataFrame, key: str, path: str) -> None:
    df.select(key).distinct().write.mode("append").parquet(path)
