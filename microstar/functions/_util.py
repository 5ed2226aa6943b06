from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, functions as F


def col(c) -> Column:
    """Accept a column name or a Column."""
    return F.col(c) if isinstance(c, str) else c


def as_code(c) -> Column:
    """Codes are compared as trimmed strings: ANSI mode rejects 'A' = 0."""
    return F.trim(col(c).cast("string"))


def map_literal(mapping: dict) -> Column:
    """A literal map column; built once per distinct mapping (Column
    expressions are immutable and reusable across DataFrames)."""
    return _map_literal(tuple(mapping.items()))


@lru_cache(maxsize=1024)
def _map_literal(items: tuple) -> Column:
    flat = []
    for k, v in items:
        flat += [F.lit(k), F.lit(v)]
    return F.create_map(*flat)
