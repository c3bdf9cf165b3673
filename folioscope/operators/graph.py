"""Triples: building, pattern matching, writing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as X

TYPE = "rdf:type"


def chunk_triples(chunks: DataFrame, graph: str, base: str = "urn:doc:") -> DataFrame:
    """Three triples of each chunk (doc_id, chunk_order, content, lang): its document, its type, its scrubbed text with a
    language."""
    doc = F.concat(F.lit(base), F.col("doc_id").cast("string"))
    part = F.concat(doc, F.lit("/"), F.col("chunk_order").cast("string"))
    none = F.lit(None).cast("string")
    made = F.array(
        F.struct(doc.alias("subject"), F.lit("rico:hasOrHadPart").alias("predicate"), part.alias("object"), none.alias("lang")),
        F.struct(part.alias("subject"), F.lit(TYPE).alias("predicate"), F.lit("rico:RecordPart").alias("object"), none.alias("lang")),
        F.struct(part.alias("subject"), F.lit("rico:textualValue").alias("predicate"), X.scrub(F.col("content")).alias("object"), F.col("lang").alias("lang")),
    )
    return chunks.select(F.lit(graph).alias("graph"), F.explode(made).alias("t")).select("graph", "t.*")


def of_type(triples: DataFrame, kind: str) -> DataFrame:
    """All triples of the subjects that have the type."""
    typed = triples.filter((F.col("predicate") == TYPE) & (F.col("object") == kind)).select("subject").distinct()
    return triples.join(typed, "subject", "left_semi")


def copy(triples: DataFrame, graph: str) -> DataFrame:
    """All triples of a named graph."""
    return triples.filter(F.col("graph") == graph)


def hop(triples: DataFrame, starts: DataFrame, start: str, predicate: str, to: str, optional: bool = False, lang: str | None = None) -> DataFrame:
    """starts with to, the objects that the predicate leads to, of a language if one is given; optional keeps rows without
    any."""
    edges = triples.filter((F.col("predicate") == predicate) & (F.lit(True) if lang is None else F.col("lang") == lang)).select(F.col("subject").alias(start), F.col("object").alias(to))
    return starts.join(edges, start, "left" if optional else "inner")


def n_quads(triples: DataFrame) -> DataFrame:
    """One text column: the triples as lines; objects with a language are literals."""
    obj = F.when(F.col("lang").isNotNull(), F.concat(X.literal(F.col("object")), F.lit("@"), F.col("lang"))).otherwise(X.iri(F.col("object")))
    line = F.concat_ws(" ", X.iri(F.col("subject")), X.iri(F.col("predicate")), obj, X.iri(F.col("graph")), F.lit("."))
    return triples.select(line.alias("value"))
