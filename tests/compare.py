"""Equality of results as sets of rows with named columns."""

from __future__ import annotations

import math
from collections import Counter
from typing import Any


def plain(value: Any) -> Any:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows_of(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def assert_same(frame, con, sql: str) -> None:
    """The Spark frame has the columns and rows that the SQL gives in DuckDB."""
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(frame.columns) == sorted(names)
    ours, theirs = rows_of(frame.columns, frame.collect()), rows_of(names, got.fetchall())
    assert ours == theirs, f"only here: {list((ours - theirs).items())[:3]}; only in SQL: {list((theirs - ours).items())[:3]}"
