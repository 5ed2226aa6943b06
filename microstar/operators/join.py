"""Joins of the star (J1-J6) with size-checked broadcast of small sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Dimensions at or below this many rows are broadcast (a municipality list
# has ~5,600 rows; a data dictionary a few thousand).
BROADCAST_MAX_ROWS = 200_000


# ... and whose measured size stays under this.
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def estimated_row_bytes(df: DataFrame) -> int:
    """Row width guessed from the schema alone, for planning: 8 bytes per
    number/date/time, 64 per string or binary, 1 per boolean.  Real texts can
    be far longer; ``bounded_broadcast`` measures them."""
    total = 0
    for f in df.schema.fields:
        t = f.dataType.typeName()
        total += 1 if t == "boolean" else 64 if t in ("string", "binary") else 8
    return max(total, 1)


def row_bytes(df: DataFrame) -> Column:
    """Size of a row as it would be broadcast: the real length of strings and
    binaries, 8 bytes for anything else, 16 per row and column of overhead."""
    sizes = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) if f.dataType.typeName() in ("string", "binary")
             else F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`"))))
             if f.dataType.typeName() in ("array", "map", "struct", "variant") else F.lit(8)
             for f in df.schema.fields]
    total = F.lit(16 * (len(sizes) + 1)).cast("long")
    for size in sizes:
        total = total + size
    return total


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                      max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast ``df`` only if it has at most ``max_rows`` rows that measure
    at most ``max_bytes``.

    The check reads at most ``max_rows + 1`` rows (a LIMIT job) and sums
    their real sizes, so it is cheap whatever the table's size.  Above the
    bounds the frame is returned as is and the planner (AQE) picks a shuffle
    join.  The bound changes the join's strategy, never its result.
    """
    n, size = (df.select(row_bytes(df).alias("b")).limit(max_rows + 1)
               .agg(F.count(F.lit(1)), F.coalesce(F.sum("b"), F.lit(0))).first())
    return F.broadcast(df) if n <= max_rows and size <= max_bytes else df


def star_join(base: DataFrame, steps: list[tuple[DataFrame, Column, str]],
              select: list | None = None) -> DataFrame:
    """Chain of joins starting from ``base``; each step is (frame, condition, how).

    Inner steps may carry extra right-side predicates in the condition
    (J1); Catalyst pushes them below the join.
    """
    out = base
    for right, cond, how in steps:
        out = out.join(right, cond, how)
    return out.select(*select) if select else out
