"""Compare a Spark result with DuckDB's: rows as multisets of normalised values, columns by name."""

from __future__ import annotations

import math
import os
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def norm(x):
    if x is None:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, Decimal):
        x = int(x) if x == x.to_integral_value() else float(x)
    if isinstance(x, float):
        if math.isnan(x):
            return None
        return round(x, 6) if x != int(x) else int(x)
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(map(norm, x))
    if hasattr(x, "asDict"):
        return tuple(map(norm, x))
    return x


def same(spark_df, con, sql: str) -> str:
    """Empty if both give the same rows, else what differs."""
    cols = sorted(spark_df.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in spark_df.collect())
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} and {sorted(rel.columns)}"
    at = [rel.columns.index(c) for c in cols]
    want = Counter(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
    if got == want:
        return "" if got else "no rows"
    return f"rows {sum(got.values())} and {sum(want.values())}; only Spark {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}"
