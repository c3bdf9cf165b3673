"""Upkeep: duplicates, ledgers, rejects, last writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row of each key, the first by order. Combined before the shuffle, so a frequent key costs no more than others."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*")


def last_write(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def pending(work: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """What the ledger doesn't name."""
    return work.join(ledger.select(key).distinct(), key, "left_anti")


def split_missing(manifest: DataFrame, files: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The manifest's rows with their file, and those without, for the dead letters."""
    return manifest.join(files, key), manifest.join(files.select(key), key, "left_anti")


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Deletion by id, as a rewrite."""
    return df.join(ids.select(key).distinct(), key, "left_anti")
