"""Exact comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str, files: str = "") -> duckdb.DuckDBPyConnection:
    """A database with a view per table; ``files`` is the pattern of part files, if any."""
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet" + (f"/{files}" if files else "")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def _canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = [tuple(_cell(r[i]) for i in order) for r in rows]
    body.sort(key=lambda r: tuple((c is None, str(type(c)), c if c is not None else 0) for c in r))
    return [columns[i] for i in order], body


_SPARK = {"bigint": "int64", "int": "int32", "double": "double", "string": "text", "date": "date", "boolean": "bool"}
_DUCK = {"BIGINT": "int64", "INTEGER": "int32", "DOUBLE": "double", "VARCHAR": "text", "DATE": "date", "BOOLEAN": "bool"}


def difference(df, con, sql: str) -> str | None:
    """A description of the first difference, or None when the results agree."""
    cur = con.execute(sql)
    want_types = {d[0]: _DUCK.get(str(d[1]), str(d[1])) for d in cur.description}
    want_cols, want = _canon([d[0] for d in cur.description], cur.fetchall())
    have_types = {f.name: _SPARK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    have_cols, have = _canon(df.columns, [tuple(r) for r in df.collect()])
    if have_cols != want_cols:
        return f"columns {have_cols} != {want_cols}"
    if have_types != want_types:
        return f"types {[(k, v, want_types[k]) for k, v in have_types.items() if v != want_types[k]]}"
    if len(have) != len(want):
        return f"{len(have)} rows != {len(want)} rows"
    bad = [(h, w) for h, w in zip(have, want) if h != w]
    if bad:
        return f"{len(bad)} of {len(have)} rows differ in {have_cols}: {bad[:2]}"
    return None
