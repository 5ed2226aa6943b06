"""Table profile as Spark jobs (A7): summary, histogram, correlations, top values.

Every function returns a long, small DataFrame; the table itself never
leaves the cluster (the reference pulled it into a driver-side frame).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window, functions as F


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _stack_one_row(row_df: DataFrame, entries: list[tuple[str, str, str]], names: tuple) -> DataFrame:
    """Unpivot a one-row aggregate: entries are (key1, key2, column-of-row_df)."""
    parts = [f"'{a}', '{b}', CAST({_q(c)} AS DOUBLE)" for a, b, c in entries]
    return row_df.selectExpr(f"stack({len(entries)}, {', '.join(parts)}) as ({', '.join(names)})")


def profile_summary(df: DataFrame, numeric: list[str], other: list[str] | None = None,
                    exact_distinct: bool = True, digits: int = 6,
                    quantiles: tuple[float, ...] = ()) -> DataFrame:
    """(column_name, metric, value) with count, nulls, distinct for every
    column and min, max, mean, stddev for numeric ones.

    Two aggregations: the moments in one plain aggregate, the exact distinct
    counts in a second one.  Kept apart, the multi-distinct rewrite expands
    rows that carry only the distinct columns rather than every moment's
    inputs (about twice as fast here, for one more columnar scan).
    ``exact_distinct=False`` uses HyperLogLog++ (``approx_count_distinct``)
    inside the first aggregate instead -- one pass, no per-value shuffle --
    the setting for very large tables.  ``quantiles`` adds approximate
    percentiles of the numeric columns (``percentile_approx``: one pass,
    bounded memory per task), as metrics ``p25``, ``p50``, ...
    """
    other = other or []
    cols = numeric + other
    aggs, entries = [], []
    for i, c in enumerate(cols):
        col = F.col(c)
        metrics = [("count", F.count(col)), ("nulls", F.sum(F.when(col.isNull(), 1).otherwise(0)))]
        if not exact_distinct:
            metrics.append(("distinct", F.approx_count_distinct(col)))
        if c in numeric:
            metrics += [("min", F.min(col)), ("max", F.max(col)), ("mean", F.avg(col)),
                        ("stddev", F.stddev_samp(col))]
            metrics += [(f"p{round(q * 100)}", F.percentile_approx(col, q)) for q in quantiles]
        for m, e in metrics:
            alias = f"m{i}_{m}"
            aggs.append(e.alias(alias))
            entries.append((c, m, alias))
    long = _stack_one_row(df.agg(*aggs), entries, ("column_name", "metric", "value"))
    if exact_distinct:
        dist = df.agg(*[F.countDistinct(c).alias(f"d{i}") for i, c in enumerate(cols)])
        long = long.unionByName(_stack_one_row(dist, [(c, "distinct", f"d{i}") for i, c in enumerate(cols)],
                                               ("column_name", "metric", "value")))
    # + 0.0 turns a -0.0 extreme into 0.0: engines differ in which zero min/max return
    return long.withColumn("value", F.round("value", digits) + F.lit(0.0))


def profile_histogram(df: DataFrame, column: str, bins: int = 10, digits: int = 6) -> DataFrame:
    """Equal-width histogram over [min, max] of one numeric column.

    Two jobs: one aggregate for the bounds (two numbers reach the driver),
    one grouped count of the bucket index.  The maximum falls in the last
    bucket.  Output: column_name, bucket, lo, hi, n_rows.
    """
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    if lo is None:
        return df.sparkSession.createDataFrame(
            [], "column_name string, bucket int, lo double, hi double, n_rows bigint")
    lo, hi = float(lo), float(hi)
    width = (hi - lo) / bins if hi > lo else 1.0
    v = F.col(column).cast("double")
    b = F.least(F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(column).isNotNull()).groupBy(b.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n_rows"))
    return counts.select(
        F.lit(column).alias("column_name"), "bucket",
        F.round(F.lit(lo) + F.col("bucket") * F.lit(width), digits).alias("lo"),
        F.round(F.lit(lo) + (F.col("bucket") + 1) * F.lit(width), digits).alias("hi"),
        "n_rows")


def profile_histograms(df: DataFrame, columns: list[str], bins: int = 10, digits: int = 6) -> DataFrame:
    """Equal-width histograms of many numeric columns in two scans.

    One aggregate returns every column's bounds (2 numbers per column reach
    the driver); one stacked (column, bucket) grouped count with partial
    aggregation returns every bucket.  Same output as ``profile_histogram``.
    """
    row = df.agg(*[F.min(c).alias(f"lo{i}") for i, c in enumerate(columns)],
                 *[F.max(c).alias(f"hi{i}") for i, c in enumerate(columns)]).first()
    parts, meta = [], []
    for i, c in enumerate(columns):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        if lo is None:
            continue
        lo, hi = float(lo), float(hi)
        width = (hi - lo) / bins if hi > lo else 1.0
        v = F.col(c).cast("double")
        b = F.when(v.isNotNull(), F.least(F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int"))
        parts.append(F.struct(F.lit(c).alias("column_name"), b.alias("bucket")))
        meta.append((c, lo, width))
    if not parts:
        return df.sparkSession.createDataFrame(
            [], "column_name string, bucket int, lo double, hi double, n_rows bigint")
    cells = df.select(F.explode(F.array(*parts)).alias("x")).select("x.column_name", "x.bucket")
    counts = cells.where(F.col("bucket").isNotNull()).groupBy("column_name", "bucket").agg(
        F.count(F.lit(1)).alias("n_rows"))
    lo_of = F.create_map(*[e for c, lo, _ in meta for e in (F.lit(c), F.lit(lo))])
    width_of = F.create_map(*[e for c, _, w in meta for e in (F.lit(c), F.lit(w))])
    lo_c, w_c = lo_of[F.col("column_name")], width_of[F.col("column_name")]
    return counts.select("column_name", "bucket",
                         F.round(lo_c + F.col("bucket") * w_c, digits).alias("lo"),
                         F.round(lo_c + (F.col("bucket") + 1) * w_c, digits).alias("hi"), "n_rows")


def profile_corr(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Pearson correlation of every pair (col_a < col_b in list order); one job."""
    pairs = list(combinations(columns, 2))
    aggs = [F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]
    long = _stack_one_row(df.agg(*aggs), [(a, b, f"c{i}") for i, (a, b) in enumerate(pairs)],
                          ("col_a", "col_b", "corr"))
    return long.withColumn("corr", F.round("corr", digits))


def profile_topk(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """The k most frequent values of each column (ties by value), with rank.

    Values of all columns are stacked as strings and counted in one grouped
    aggregation (map-side partial counts absorb hot values); the rank is a
    window per column over the already-counted (column, value) rows.
    """
    parts = ", ".join(f"'{c}', CAST({_q(c)} AS STRING)" for c in columns)
    stacked = df.selectExpr(f"stack({len(columns)}, {parts}) as (column_name, value)")
    counts = stacked.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n_rows"))
    w = Window.partitionBy("column_name").orderBy(F.col("n_rows").desc(), F.col("value").asc_nulls_last())
    return (counts.withColumn("rank", F.row_number().over(w))
                  .where(F.col("rank") <= k))
