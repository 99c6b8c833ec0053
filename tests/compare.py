"""Rows of a DataFrame and of DuckDB SQL over the same Parquet tables, in a form that can be compared."""

from __future__ import annotations

import datetime
import decimal
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, Row


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if v != v else round(float(v), 8) + 0.0
    if isinstance(v, (Row, dict)):
        return tuple(sorted((k, plain(x)) for k, x in (v.asDict() if isinstance(v, Row) else v).items()))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def spark_rows(df: DataFrame) -> list[str]:
    names = sorted(df.columns)
    return sorted(repr(tuple(map(plain, r))) for r in df.select(*names).collect())


def duck_rows(sql: str, sf_dir: str) -> tuple[list[str], list[str]]:
    """Column names in order, rows."""
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}{'/*.parquet' if f.is_dir() else ''}')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    at = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())


def assert_same(df: DataFrame, sql: str, sf_dir: str) -> None:
    names, rows = duck_rows(sql, sf_dir)
    assert sorted(df.columns) == names
    assert spark_rows(df) == rows
