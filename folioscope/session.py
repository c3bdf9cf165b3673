"""Session factory and settings."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Limits and thresholds of the document pipeline; each can be set by an environment variable FOLIOSCOPE_<NAME>."""

    token_limit: int = 8192
    overlap: int = 256
    chunk_limit: int = 512
    similarity: float = 0.89
    alpha: float = 0.25
    top_k: int = 3
    certainty: float = 0.7
    entity_top_k: int = 8
    entity_score: float = 0.85
    fuzzy: int = 85
    lifespan_days: int = 7300

    @classmethod
    def from_environment(cls) -> Settings:
        found = {f.name: os.environ.get(f"FOLIOSCOPE_{f.name.upper()}") for f in fields(cls)}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{k: kinds[k](v) for k, v in found.items() if v is not None})


def session(app: str = "folioscope", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
