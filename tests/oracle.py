"""Comparison of a query with its SQL."""

import math
import os

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{name}')")
    return con


def _plain(v):
    if v is None or str(v) in ("NaT", "<NA>") or (isinstance(v, float) and math.isnan(v)):
        return None
    kind = type(v).__name__
    if "bool" in kind:
        return bool(v)
    if "int" in kind or "float" in kind or kind == "Decimal":
        return round(float(v), 6)
    return str(v)


def rows(frame, columns) -> list[tuple]:
    return sorted((tuple(map(_plain, r)) for r in frame[columns].astype(object).values.tolist()), key=repr)


def assert_same(found, expected) -> None:
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    assert rows(found, columns) == rows(expected, columns)
