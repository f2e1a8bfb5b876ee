"""Runs a registered query and its SQL twin and compares the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob.glob(os.path.join(sf_dir, "*.parquet"))):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return round(value, 6) + 0.0
    if isinstance(value, list):
        return tuple(_cell(v) for v in value)
    if hasattr(value, "as_tuple"):
        return round(float(value), 6)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def kind(dtype: str) -> str:
    names = {
        "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
        "boolean": "BOOLEAN", "float": "FLOAT", "array<string>": "VARCHAR[]",
        "array<bigint>": "BIGINT[]", "timestamp_ntz": "TIMESTAMP",
    }
    return names.get(dtype, dtype)


def compare(df, con, sql: str) -> list[str]:
    """Differences, an empty list if there are none."""
    problems = []
    result = con.sql(sql)
    names, types = result.columns, [str(t) for t in result.types]
    rows = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    theirs = dict(zip(names, types))
    for name, dtype in df.dtypes:
        if kind(dtype) != theirs[name]:
            problems.append(f"type of {name}: {dtype} against {theirs[name]}")
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    other = _rows(list(names), rows)
    if len(mine) != len(other):
        problems.append(f"{len(mine)} rows against {len(other)}")
    if mine != other:
        left = [r for r in mine if r not in other][:2]
        right = [r for r in other if r not in mine][:2]
        problems.append(f"rows differ: {str(left)[:400]} against {str(right)[:400]}")
    return problems
