"""Filters and conditional routing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


def filter_eq(df: DataFrame, column: str, value) -> DataFrame:
    """Equality filter (F1); pushed into the Parquet scan by Catalyst."""
    return df.where(F.col(column) == F.lit(value))


def filter_ne(df: DataFrame, column: str, value) -> DataFrame:
    """Inequality filter (F4).  Null keys are dropped (SQL three-valued logic)."""
    return df.where(F.col(column) != F.lit(value))


@dataclass
class Target:
    """One routing target: an optional predicate and its output columns.

    ``columns`` items are names or (source, target) pairs.  ``computed`` says
    that the predicate reads derived columns (see ``where_computed``)."""
    columns: list
    predicate: Column | None = None
    computed: bool = False


def where_computed(df: DataFrame, predicate: Column) -> DataFrame:
    """Filter on derived columns, evaluated where it stands.

    The condition becomes a column that ``inline`` makes, which no optimizer
    rule looks through.  A plain filter would be pushed below the projections
    that derive its columns: a condition over thirty renamed flags then is
    carried through each rename in two versions, 2**30 in all.
    """
    return df.select("*", F.inline(F.array(F.struct(predicate.alias("_routed"))))).where("_routed").drop("_routed")


def project_target(df: DataFrame, t: Target) -> DataFrame:
    out = df if t.predicate is None else where_computed(df, t.predicate) if t.computed else df.where(t.predicate)
    cols = []
    for c in t.columns:
        src, dst = (c, c) if isinstance(c, str) else c
        cols.append(F.col(src).alias(dst))
    return out.select(cols)


def route(df: DataFrame, targets: dict[str, Target]) -> dict[str, DataFrame]:
    """Send every row of ``df`` to every target whose predicate holds (F2).

    Copy semantics: a row may reach several targets.  Each result is a lazy
    plan over the same source, so each target reads only its own columns
    (column pruning reaches the scan).  No cache is taken: at scale the
    derived base is wider than the sum of what the targets read.
    """
    return {name: project_target(df, t) for name, t in targets.items()}
