"""Session helpers of the operators: fixed-size filters, size-checked broadcasts, cut lineage."""

from __future__ import annotations

import math
import re
import tempfile
from collections.abc import Callable
from functools import wraps

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or that which the session has set; one of our own only where none is set and all
    runs in one process, as in tests. A cluster without one is an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        have = sc._jsc.sc().getCheckpointDir()
        if have.isEmpty() and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = have.get() if have.isDefined() else tempfile.mkdtemp(prefix="folioscope-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df with its rows written to the cluster's shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def cut_small(df: DataFrame, rows: int = 1 << 18) -> DataFrame:
    """cut, then in as many partitions as its rows need: a small result makes no hundreds of files in each later step."""
    done = cut(df)
    return done.coalesce(max(1, done.count() // rows))


def text_key(text: str) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a text, ka and kb: with doc_id they name a row, so that rows without id or of one id
    aren't taken for each other."""
    return F.xxhash64(F.col(text)).alias("ka"), F.xxhash64(F.lit(1), F.col(text)).alias("kb")


def delete_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder of intermediate rows, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shielded(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator that gives its first table's columns back: those with names kept for use inside (two underscores in front)
    get others meanwhile."""

    @wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        names, other = docs.columns, {}
        for c in names:
            if c.startswith("__"):
                to = f"kept{c}"
                while to in names or to in other.values():
                    to += "_"
                other[c] = to
        out = operator(docs.withColumnsRenamed(other) if other else docs, *args, **kwargs)
        return out.withColumnsRenamed({v: k for k, v in other.items()}) if other else out

    return run


#: Rows that go to a Python worker at once, so that its memory doesn't depend on how long texts are in the mean.
BATCH_ROWS = 1024


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches have BATCH_ROWS rows at most."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def is_small(df: DataFrame, limit_bytes: int = 32 << 20) -> bool:
    """Whether df's values, measured, are within the limit. This reads df, so it should be cheap or cut."""
    size: Column = F.lit(0)
    for field in df.schema:
        width = F.length(F.to_json(F.struct(F.col(f"`{field.name}`")))) if field.dataType.typeName() in ("array", "string", "binary", "struct", "map") else F.lit(8)
        size = size + F.coalesce(width, F.lit(0))
    return (df.agg(F.sum(size.cast("long"))).head()[0] or 0) <= limit_bytes


def broadcast_if_small(df: DataFrame, limit_bytes: int = 32 << 20) -> DataFrame:
    """df, marked for broadcast if it is small; Spark chooses the join otherwise."""
    return F.broadcast(df) if is_small(df, limit_bytes) else df


def bloom_words(rows: int) -> int:
    """64-bit words of a filter for about so many keys: a power of two, of 2**22 (32 MB) at most. A full filter only lets
    more rows through; what it guards stays exact."""
    return min(1 << 22, max(1 << 12, 1 << math.ceil(math.log2(max(1, rows)))))


def blooms(df: DataFrame, column: str, words: int, **when: Column) -> dict[str, np.ndarray]:
    """For each condition, a filter of the well-mixed 64-bit keys of the rows that meet it; one word of four bits a key.
    What reaches the driver is bounded by words, whatever the number of keys."""
    h = F.col(column)
    mask = F.lit(0).cast("long")
    for shift in (34, 40, 46, 52):
        mask = mask.bitwiseOR(_shift_one(h, shift))
    found = [F.bit_or(F.when(c, mask).otherwise(F.lit(0).cast("long"))).alias(k) for k, c in when.items()]
    rows = df.groupBy(h.bitwiseAND(F.lit(words - 1).cast("long")).alias("at")).agg(*found).toArrow()
    out = {}
    for k in when:
        bits = np.zeros(words, np.int64)
        bits[rows["at"].to_numpy()] = rows[k].to_numpy()
        out[k] = bits.view(np.uint64)
    return out


def _shift_one(h: Column, shift: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int"))


def in_bloom(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    word = bits[(h & U(len(bits) - 1)).astype(np.int64)]
    ok = np.ones(len(h), bool)
    for shift in (34, 40, 46, 52):
        ok &= ((word >> ((h >> U(shift)) & U(63))) & U(1)).astype(bool)
    return ok
