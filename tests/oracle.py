"""Compare registered queries with their SQL, value by value."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(frame, connection, sql: str) -> str | None:
    """None when equal, else a short account of the difference."""
    ours = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    result = connection.execute(sql)
    theirs = _rows([d[0] for d in result.description], result.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} / {theirs[0]}"
    if ours[1] != theirs[1]:
        return (
            f"{sum(ours[1].values())} / {sum(theirs[1].values())} rows;"
            f" only here {list((ours[1] - theirs[1]).items())[:2]};"
            f" only there {list((theirs[1] - ours[1]).items())[:2]}"
        )
    return None
