"""Side-by-side check of a registered Spark query against its DuckDB SQL oracle."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if v is pd.NA:  # a null in a column of whole numbers; Spark's side holds NaN there
        return "nan"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def canon(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = [tuple(_norm(v) for v in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark_df, sql: str, con) -> dict:
    a = spark_df.toPandas()
    b = con.sql(sql).df()
    out = {"spark_rows": len(a), "sql_rows": len(b),
           "same_columns": sorted(a.columns) == sorted(b.columns)}
    if out["same_columns"]:
        ca, cb = canon(a), canon(b)
        out["match"] = ca == cb
        if not out["match"]:
            diff = [(x, y) for x, y in zip(ca, cb) if x != y][:3]
            out["diff"] = diff
    else:
        out["match"] = False
        out["columns"] = (sorted(a.columns), sorted(b.columns))
    return out
