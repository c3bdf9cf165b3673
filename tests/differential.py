"""Runs queries and their SQL side by side: python tests/differential.py [folder] [name...]."""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def compare(got, want) -> str:
    """Empty if both frames hold the same rows."""
    import pandas as pd

    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} against {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    text = lambda df: df[sorted(df.columns)].apply(lambda c: c.map(lambda v: "" if v is None or (not isinstance(v, (list, str)) and pd.isna(v)) else f"{v:.6f}" if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else str(v)))
    norm = lambda df: sorted(map(tuple, text(df).to_numpy().tolist()))
    a, b = norm(got), norm(want)
    if a == b:
        return ""
    a = sorted(tuple(x.removesuffix(".000000") for x in r) for r in a)
    b = sorted(tuple(x.removesuffix(".000000") for x in r) for r in b)
    return "" if a == b else f"rows differ, such as {next(x for x in a if x not in set(b))} and {next(x for x in b if x not in set(a))}"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


if __name__ == "__main__":
    import __spark_entry__ as e
    from folioscope.session import session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    sql, con, bad = e.oracle_sql(), connect(folder), []
    for name, f in e.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        t = time.time()
        try:
            got = f(spark, folder).toPandas()
            s = time.time() - t
            want = con.sql(sql[name]).df() if name in sql else got
            why = compare(got, want) if name in sql else ""
            kinds = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got if str(got[c].dtype) != str(want[c].dtype)}
        except Exception:
            kinds, why, got, s = {}, traceback.format_exc()[-700:], [], time.time() - t
        print(f"{'ok' if not why else 'BAD':4}{name:28}{len(got):8} rows {s:6.1f} s {'' if name in sql else 'no sql'} {why[:700]} {kinds or ''}", flush=True)
        if why:
            bad.append(name)
    print("bad:", *bad)
