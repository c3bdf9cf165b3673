"""SQL names of the scalar functions, a vector-mean aggregate and a chunker table function. All but the aggregate are SQL
functions, which the optimizer sees through."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_DOT = "aggregate(zip_with({0}, {1}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
_SQUARES = f"({_DOT.format('a', 'a')} * {_DOT.format('b', 'b')})"
_WORDS = r"array_remove(split(coalesce(text, ''), '[ \t\n\r\f]+'), '')"


def register(spark: SparkSession) -> None:
    """After this, SQL can call vector_cosine(a, b), vector_mean(v) and token_windows(text, limit, overlap). A limit that doesn't
    exceed the overlap is an error."""

    @F.pandas_udf("array<double>")
    def vector_mean(v: pd.Series) -> list[float]:
        return np.stack(v.to_numpy()).astype(float).mean(0).tolist()

    spark.udf.register("vector_mean", vector_mean)
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION vector_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE
      RETURN CASE WHEN {_SQUARES} > 0 THEN {_DOT.format('a', 'b')} / sqrt({_SQUARES}) ELSE 0D END""")
    words = _WORDS.replace("\\", "\\\\")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION token_windows(text STRING, size INT, overlap INT) RETURNS TABLE (k INT, start INT, stop INT, content STRING)
      RETURN SELECT k, k * (size - overlap), least(k * (size - overlap) + size, n), array_join(slice(w, k * (size - overlap) + 1, size), ' ')
      FROM (SELECT w, n, explode(sequence(0, greatest(0, CAST(ceil((n - size) / IF(size > overlap, size - overlap, raise_error('the limit must exceed the overlap'))) AS INT)))) AS k
        FROM (SELECT {words} AS w, size({words}) AS n) WHERE n > 0)""")
