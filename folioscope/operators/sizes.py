"""What may be broadcast: data whose size is measured, not guessed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of values that may go to every executor.
BROADCAST_BYTES = 32 << 20


def fits(df: DataFrame, limit_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the values of df take limit_bytes at most. This reads df, so it should be cheap, such as a stated set of
    queries."""
    size = F.lit(0)
    for field in df.schema:
        col = F.col(f"`{field.name}`")
        wide = field.dataType.typeName() in ("array", "string", "binary", "struct", "map")
        size = size + (F.coalesce(F.length(F.to_json(F.struct(col))), F.lit(0)) if wide else F.lit(8))
    return (df.agg(F.sum(size.cast("long"))).head()[0] or 0) <= limit_bytes


def broadcast_if(small: bool, df: DataFrame) -> DataFrame:
    """df marked for broadcast, or as it is: Spark then chooses the join by what it measures."""
    return F.broadcast(df) if small else df
