"""Projections, renames, defaults."""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, functions as F


def select_rename(df: DataFrame, mapping) -> DataFrame:
    """Keep and rename the listed columns in the given order, drop the rest.

    ``mapping`` is a list of (source, target) pairs or a dict.  All renames
    happen in one ``select``, so permutations such as Q001<->Q002 are
    simultaneous (P2); chained ``withColumnRenamed`` calls would collide.
    """
    pairs = tuple(mapping.items()) if isinstance(mapping, dict) else tuple(map(tuple, mapping))
    return df.select(list(_renamed(pairs)))


@lru_cache(maxsize=256)
def _renamed(pairs: tuple) -> tuple:
    # Column expressions are immutable: build each projection list once
    return tuple(F.col(src).alias(dst) for src, dst in pairs)


def permute_columns(df: DataFrame, swaps: dict[str, str]) -> DataFrame:
    """Rename ``a -> b`` for every pair of ``swaps`` at once, keep other columns."""
    return df.select([F.col(c).alias(swaps.get(c, c)) for c in df.columns])


def harmonise(df: DataFrame, target: list[str], defaults: dict | None = None,
              types: dict | None = None) -> DataFrame:
    """Project onto ``target``; columns absent from ``df`` become constants (P5).

    ``defaults[col]`` is the constant (None = null string, '0' for absent
    flags); ``types[col]`` casts it so every yearly frame has one schema.
    """
    defaults, types = defaults or {}, types or {}
    key = (tuple(target), frozenset(df.columns), tuple(sorted(defaults.items(), key=lambda kv: kv[0])),
           tuple(sorted(types.items())))
    return df.select(list(_harmonised(key)))


@lru_cache(maxsize=256)
def _harmonised(key: tuple) -> tuple:
    target, have, defaults, types = key
    defaults, types = dict(defaults), dict(types)
    cols = []
    for c in target:
        if c in have:
            e = F.col(c)
        else:
            e = F.lit(defaults.get(c)).cast(types.get(c, "string"))
        cols.append(e.alias(c))
    return tuple(cols)


def union_years(frames: list[DataFrame], target: list[str] | None = None,
                defaults: dict | None = None, types: dict | None = None) -> DataFrame:
    """UNION ALL of yearly frames after harmonising each onto one schema."""
    if target is not None:
        frames = [harmonise(f, target, defaults, types) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=target is None), frames)


def null_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Replace nulls by a per-column default (P6); types are kept."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType))
                           for c, v in defaults.items()})


def null_to_empty(df: DataFrame, cols: list[str]) -> DataFrame:
    """Null -> '' on string columns."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in cols})


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop columns."""
    return df.drop(*cols)


def with_derived(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add many derived columns in one projection (never a withColumn loop)."""
    return df.withColumns(columns)


def recode(df: DataFrame, rules: dict, mode: str = "map") -> DataFrame:
    """Recode several columns at once (X2), in one projection.

    ``rules`` maps a column to a rule list (``Rule``) or to a composed map;
    ``mode='map'`` (default) does one lookup per column, ``mode='sequential'``
    applies the rule chain as whole-word, case-insensitive regex replaces
    (rule lists only).
    """
    from microstar.functions.recode import recode_map, recode_sequential
    if mode not in ("map", "sequential"):
        raise ValueError(f"unknown recode mode {mode!r}")
    if mode == "sequential" and any(isinstance(r, dict) for r in rules.values()):
        raise ValueError("sequential mode needs rule lists, not composed maps")
    fn = recode_map if mode == "map" else recode_sequential
    return df.withColumns({c: fn(c, r) for c, r in rules.items()})
