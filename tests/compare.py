"""Run a query in Spark and its check in DuckDB and compare all rows."""

from __future__ import annotations

import math
import os

import duckdb

from flowspark.sources.driver_tables import TABLES

# DuckDB type names by Spark type name, where the two differ.
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(value):
    if value is None:
        return (0, "")
    if isinstance(value, float) and value == 0:
        return (1, "0.0")
    return (1, repr(value))


def _ordered(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: [_key(v) for v in r])


def differences(df, con, sql: str) -> list[str]:
    """Human-readable differences; empty if columns, types and all values agree."""
    spark_rows, columns = [tuple(r) for r in df.collect()], df.columns
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    kinds = {d[0]: str(d[1]) for d in found.description}
    rows = found.fetchall()
    out = []
    if sorted(names) != sorted(columns):
        return [f"columns {sorted(columns)} != {sorted(names)}"]
    for name, kind in df.dtypes:
        if TYPES.get(kind) and TYPES[kind] != kinds[name]:
            out.append(f"type of {name}: {kind} != {kinds[name]}")
    if len(rows) != len(spark_rows):
        out.append(f"rows {len(spark_rows)} != {len(rows)}")
    left, right = _ordered(spark_rows, columns), _ordered(rows, names)
    wrong = [(a, b) for a, b in zip(left, right) if a != b and not _same(a, b)]
    if wrong:
        out.append(f"{len(wrong)} rows differ, first: {wrong[0]}")
    return out


def _same(a, b) -> bool:
    return all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y)) for x, y in zip(a, b))
