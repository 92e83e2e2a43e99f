"""Spark rows against DuckDB rows."""

from __future__ import annotations

import decimal

import duckdb

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return "nan" if v != v else float(v)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr(tuple(plain(r[i]) for i in order)) for r in rows))


def duck(sql: str, folder: str | None = None, **tables):
    """Rows and columns of a query over the folder's tables, or over given Arrow tables."""
    con = duckdb.connect()
    for name in NAMES if folder else ():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    for name, table in tables.items():
        con.register(name, table)
    found = con.execute(sql)
    return found.fetchall(), [d[0] for d in found.description]


def assert_same(df, sql: str, folder: str | None = None, **tables) -> None:
    rows, columns = duck(sql, folder, **tables)
    assert sorted(df.columns) == sorted(columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(rows, columns)
