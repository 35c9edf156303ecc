"""Run registered queries next to their DuckDB oracles."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(os.listdir(sf_dir)):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def _rows(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    out = []
    for row in pdf[cols].astype(object).itertuples(index=False):
        out.append(tuple("∅" if v is None or v is pd.NA or v != v else str(v) for v in row))
    return cols, sorted(out)


def _kind(dtype: str) -> str:
    return {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}.get(
        dtype, dtype
    )


def compare(spark, con, name, fn, sql, sf_dir):
    """List of differences, empty when equal."""
    df = fn(spark, sf_dir)
    got_types = {n: _kind(t) for n, t in df.dtypes}
    rel = con.sql(sql)
    want_types = dict(zip(rel.columns, map(str, rel.types)))
    problems = []
    if got_types != want_types:
        problems.append(f"schema {got_types} != {want_types}")
    table = rel.to_arrow_table()
    cols_a, a = _rows(df.toArrow().to_pandas(types_mapper=pd.ArrowDtype))
    cols_b, b = _rows(table.to_pandas(types_mapper=pd.ArrowDtype))
    if cols_a != cols_b:
        problems.append(f"columns {cols_a} != {cols_b}")
    elif a != b:
        sa, sb = set(a), set(b)
        problems.append(
            f"rows {len(a)} vs {len(b)}; only spark {sorted(sa - sb)[:3]}; only duckdb {sorted(sb - sa)[:3]}"
        )
    elif not a:
        problems.append("no rows")
    return problems
