"""Run a registered query and its SQL on the same tables and compare the values."""

from __future__ import annotations

import math
import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        if os.path.exists(path):
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def _rows(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: tuple(map(repr, r)))


KINDS = {
    "tinyint": "int", "smallint": "int", "int": "int", "integer": "int", "bigint": "int", "hugeint": "huge",
    "double": "double", "float": "float", "string": "text", "varchar": "text", "boolean": "boolean",
}


def compare(spark, connection, name: str, sf_dir: str, inspect=None) -> str | None:
    """None when both agree, else what differs; ``inspect`` sees the DataFrame first."""
    from tallyrow.catalog import REGISTRY

    item = REGISTRY[name]
    df = item.run(spark, sf_dir)
    if inspect:
        inspect(df)
    got = [tuple(r) for r in df.collect()]
    if item.sql is None:
        return None if got else "no rows"
    result = connection.execute(item.sql)
    names = [d[0] for d in result.description]
    types = {d[0]: KINDS.get(str(d[1]).lower(), str(d[1])) for d in result.description}
    want = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    ours = {n: KINDS.get(t, t) for n, t in df.dtypes}
    off = {n: (ours[n], types[n]) for n in names if ours[n] != types[n]}
    if off:
        return f"types (ours, SQL) {off}"
    a, b = _rows(df.columns, got), _rows(names, want)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    if not a:
        return "both are empty"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, {sorted(names)}, first {bad[:2]}" if bad else None
