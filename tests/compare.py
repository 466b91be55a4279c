"""Comparing rows of two engines without regard to order."""

from __future__ import annotations

import math


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return value


def table(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def close(a, b, tolerance: float = 1e-6) -> bool:
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(close(x, y, tolerance) for x, y in zip(a, b, strict=True))
    if isinstance(a, bool) or isinstance(b, bool) or a is None or b is None or isinstance(a, str):
        return a == b
    return abs(a - b) <= tolerance * max(1.0, abs(a), abs(b))


def assert_same(df, result) -> None:
    """A Spark DataFrame against an executed DuckDB query."""
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    mine, other = table(df.columns, df.collect()), table(names, result.fetchall())
    assert len(mine) == len(other)
    wrong = [(a, b) for a, b in zip(mine, other, strict=True) if not close(a, b)]
    assert not wrong, wrong[:3]
