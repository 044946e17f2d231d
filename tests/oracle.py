"""Strict comparison of a Spark result with its DuckDB reference."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "item") and not hasattr(v, "__len__"):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return 0.0 if v == 0 else v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if type(v).__name__ in ("NaTType", "NAType"):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows(pdf):
    cols = sorted(pdf.columns)
    out = [tuple(_norm(v) for v in r) for r in pdf[cols].astype(object).itertuples(index=False, name=None)]
    return cols, sorted(out, key=repr)


def compare(spark_pdf, duck_pdf) -> str | None:
    """None on equality, else a short reason."""
    for c in set(spark_pdf.columns) & set(duck_pdf.columns):
        # pandas shows a nullable integer column of Spark as floats
        if str(duck_pdf[c].dtype).startswith("Int") and str(spark_pdf[c].dtype) == "float64":
            spark_pdf = spark_pdf.assign(**{c: spark_pdf[c].astype("Int64")})
    sc, sr = rows(spark_pdf)
    dc, dr = rows(duck_pdf)
    if sc != dc:
        return f"columns {sc} != {dc}"
    if len(sr) != len(dr):
        return f"row count {len(sr)} != {len(dr)}"
    for a, b in zip(sr, dr):
        if a != b or any(type(x) is not type(y) for x, y in zip(a, b)):
            n = sum(x != y for x, y in zip(sr, dr))
            return f"{n} rows differ, first {a} != {b}"
    return None
