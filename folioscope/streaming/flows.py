"""Structured Streaming versions of the batch services."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioscope.operators import monitoring


def ingest(source: DataFrame, target: str, ledger: str, key: str = "doc_id"):
    """A writer that appends the rows whose keys the ledger doesn't name and, after them, their keys. Keys of earlier batches
    are left out; a replayed batch replaces its own folders, so nothing is written twice. Rows without key are written."""
    kind = dict(source.dtypes)[key]

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = spark.read.schema(f"{key} {kind}, batch long").option("pathGlobFilter", "*.parquet").parquet(ledger) if _exists(spark, ledger) else spark.createDataFrame([], f"{key} {kind}, batch long")
        earlier = done.filter(F.col("batch") < number).select(F.col(key).alias("__done")).distinct()
        fresh = batch.join(earlier, F.col(key) == F.col("__done"), "left_anti")
        fresh.write.mode("overwrite").parquet(f"{target}/batch={number}")
        fresh.select(key).distinct().write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    return source.writeStream.foreachBatch(write)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def stop_when(query: StreamingQuery, asked: Callable[[], bool], every: float = 1.0) -> None:
    """Stops a stream between two batches once asked to; returns when it has ended."""
    while query.isActive and not query.awaitTermination(every):
        if asked():
            while query.isActive and query.status["isTriggerActive"]:
                query.awaitTermination(every)
            query.stop()


def transitions(source: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """(by, order, value) where a source's value changes, before the first there is null; the last value of each source is the
    state. Rows of one micro-batch are put in order by all of order, which should be unique; a batch is bounded by the
    source's options (maxFilesPerTrigger and the like)."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        now = [None if pd.isna(x) else x for x in rows[value]]
        before = [state.get[0] if state.exists else None, *now[:-1]]
        state.update((now[-1],))
        yield rows[[a != b for a, b in zip(before, now, strict=True)]][columns]

    kinds, columns = dict(source.dtypes), list(dict.fromkeys((by, *order, value)))
    out = ", ".join(f"{c} {kinds[c]}" for c in columns)
    return source.groupBy(by).applyInPandasWithState(run, out, f"last {kinds[value]}", "append", GroupStateTimeout.NoTimeout)


def log_transitions(lines: DataFrame, source: str = "source") -> DataFrame:
    """(source, ts, root) where the document that a log names changes: a tail of text lines (value, and the source that
    they come from)."""
    return transitions(monitoring.parsed(lines).select(source, "ts", "root"), source, ["ts", "root"], "root")


def deduplicated(source: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """The first of rows with equal keys that come within the time of each other."""
    return source.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
