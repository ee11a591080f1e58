"""Compare a job with its SQL on the same tables, as multisets of rows."""

from __future__ import annotations

import datetime as dt
from collections import Counter
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return ("f", round(value, 9))
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _rows(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


_KINDS = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date", "BOOLEAN": "boolean",
          "TIMESTAMP": "timestamp_ntz"}


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between a DataFrame and a query result; empty when they agree."""
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    theirs = _rows(columns, result.fetchall())
    out = []
    if sorted(columns) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(columns)}"]
    for name, kind in df.dtypes:
        if _KINDS.get(kinds[name], kinds[name]) != kind:
            out.append(f"type of {name}: {kind} against {kinds[name]}")
    ours = _rows(df.columns, df.collect())
    only_ours, only_theirs = ours - theirs, theirs - ours
    if only_ours or only_theirs:
        out.append(f"{sum(only_ours.values())} rows only in Spark, {sum(only_theirs.values())} only in SQL "
                   f"(of {sum(ours.values())} and {sum(theirs.values())})")
        out += [f"spark {r}" for r in sorted(map(str, only_ours))[:3]]
        out += [f"sql   {r}" for r in sorted(map(str, only_theirs))[:3]]
    return out
