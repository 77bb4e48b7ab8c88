"""Comparing a Spark result with its SQL equivalent in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        if (path := Path(folder) / f"{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _value(x):
    if x is None or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(map(_value, x))
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)):
        return round(float(x), 6)
    return str(x)


def rows(table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return sorted((tuple(map(_value, r)) for r in zip(*columns)), key=repr)


def compare(df, con, sql: str | None) -> str | None:
    """What differs, or None."""
    mine = df.toArrow()
    if sql is None:
        return None
    found = con.execute(sql).to_arrow_table()
    if sorted(mine.column_names) != sorted(found.column_names):
        return f"columns {sorted(mine.column_names)} and {sorted(found.column_names)}"
    a, b = rows(mine), rows(found)
    if a == b:
        return None
    x = next(((p, q) for p, q in zip(a, b) if p != q), (len(a), len(b)))
    return f"{len(a)} and {len(b)} rows; first difference {str(x)[:600]}"
