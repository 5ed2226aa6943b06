"""Reshaping: multi-measure unpivot (N1, F3) and distinct-count crosstab."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unpivot_groups(df: DataFrame, keys: list[str], groups: dict[str, list[str]],
                   label_col: str, value_cols: list[str],
                   not_null: str | None = None) -> DataFrame:
    """Turn each group of columns into one row.

    ``groups`` maps a label (e.g. the knowledge area 'CH') to the columns
    that fill ``value_cols`` for it.  Keys repeat on every output row.  With
    ``not_null`` rows whose value in that output column is null are
    dropped (F3).  A single ``stack`` generator: no shuffle.
    """
    n = len(groups)
    parts = []
    for lab, cols in groups.items():
        if len(cols) != len(value_cols):
            raise ValueError(f"group {lab!r} has {len(cols)} columns, expected {len(value_cols)}")
        lit = "'" + lab.replace("'", "''") + "'"
        parts.append(", ".join([lit] + [_q(c) for c in cols]))
    stack = f"stack({n}, {', '.join(parts)}) as ({', '.join(_q(c) for c in [label_col] + value_cols)})"
    out = df.selectExpr(*[_q(k) for k in keys], stack)
    if not_null:
        out = out.where(F.col(not_null).isNotNull())
    return out


def crosstab_distinct(df: DataFrame, rows: list[str], pivot_col: str, pivot_values: list,
                      distinct_col: str, names: dict | None = None) -> DataFrame:
    """COUNT(DISTINCT distinct_col) by ``rows`` with one column per pivot value (A4).

    Two aggregation steps instead of one multi-distinct aggregate: first
    de-duplicate (rows, pivot, value) -- a shuffle keyed by the full tuple,
    so a hot row key is still spread over many tasks -- then count with
    partial (map-side) aggregation and pivot on a fixed value list (no
    extra job to discover values).
    """
    dedup = df.select(*rows, pivot_col, distinct_col).where(F.col(distinct_col).isNotNull()).distinct()
    out = dedup.groupBy(*rows).pivot(pivot_col, pivot_values).count()
    names = names or {}
    return out.select(*rows, *[F.coalesce(F.col(str(v)), F.lit(0)).alias(names.get(v, str(v)))
                               for v in pivot_values])
