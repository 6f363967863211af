"""Compares a Spark result with a DuckDB result, regardless of row order."""

from __future__ import annotations

import duckdb

from outcomelens.oracles import ORACLES
from outcomelens.plans.testbed import SCHEMAS
from outcomelens.registry import QUERIES


def connect(folder: str, replaced: dict[str, str] | None = None) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in SCHEMAS:
        path = (replaced or {}).get(name, f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def check(spark, folder: str, name: str, con: duckdb.DuckDBPyConnection) -> int:
    """Asserts equal columns and rows; returns the number of rows."""
    got = QUERIES[name](spark, folder)
    want = con.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    ours = sorted((tuple(row[c] for c in columns) for row in got.collect()), key=repr)
    theirs = sorted((tuple(row[i] for i in place) for row in want.fetchall()), key=repr)
    assert ours == theirs
    return len(ours)
