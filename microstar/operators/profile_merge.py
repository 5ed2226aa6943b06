"""Profiles of editions that are kept and merged, exact quantiles, heavy values (A7); crosstabs by bitmaps (A4).

A stored profile holds one row per edition and column: counts, moments and a
HyperLogLog sketch of the values.  A new edition adds its rows; a profile of
any set of editions is an aggregate of stored rows, and no edition is read
again.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from microstar.operators.profile import _q, profile_topk

#: Sketches of 2**12 registers: a standard error of 1.04 / sqrt(4096), 1.6 %; three of them bound 99.7 % of estimates.
LOG_REGISTERS = 12
DISTINCT_ERROR = 3 * 1.04 / math.sqrt(1 << LOG_REGISTERS)


def edition_profile(df: DataFrame, edition: str, numeric: list[str], other: list[str] = ()) -> DataFrame:
    """One row per edition and column: ``edition, column_name, n_rows, n_nulls, lo, hi, total, squares, sketch``.

    One scan: values are stacked and reduced by a partial aggregate, so an
    edition or value that holds most of the rows costs one row a task.
    """
    columns = [*numeric, *other]
    cells = ", ".join(f"'{c}', CAST({_q(c)} AS STRING), {f'CAST({_q(c)} AS DOUBLE)' if c in numeric else 'CAST(NULL AS DOUBLE)'}" for c in columns)
    stacked = df.select(F.col(edition).alias("edition"), *columns).selectExpr("edition", f"stack({len(columns)}, {cells}) AS (column_name, value, number)")
    number = F.col("number")
    return stacked.groupBy("edition", "column_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("value").isNull()).alias("n_nulls"), F.min(number).alias("lo"), F.max(number).alias("hi"),
        F.sum(number).alias("total"), F.sum(number * number).alias("squares"), F.hll_sketch_agg("value", F.lit(LOG_REGISTERS)).alias("sketch"))


def merged_profile(stored: DataFrame) -> DataFrame:
    """``column_name, n_rows, n_nulls, distinct, lo, hi, mean`` of all stored editions given.

    ``distinct`` is an estimate within ``DISTINCT_ERROR`` of the truth (three
    standard errors), and exact but for rounding while a column has few
    values; merging adds no error.
    """
    union = stored.groupBy("column_name").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_nulls").alias("n_nulls"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.sum("total") / F.sum(F.when(F.col("total").isNotNull(), F.col("n_rows") - F.col("n_nulls")))).alias("mean"))
    return union.select("column_name", "n_rows", "n_nulls", "distinct", F.col("lo") + F.lit(0.0), F.col("hi") + F.lit(0.0), "mean").toDF(
        "column_name", "n_rows", "n_nulls", "distinct", "lo", "hi", "mean")


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float], buckets: int = 1024) -> DataFrame:
    """``column_name, share, value``: the smallest value that at least ``share`` of a column's values do not exceed.

    Exact without a sort: a pass counts the values of each wanted quantile's
    interval in equal buckets and takes the bucket that holds its rank, with
    that bucket's own least and largest value, as the next interval.  It ends
    when these are equal.  A pass is one partial aggregate of at most
    ``buckets`` rows a quantile, read column by column, and a few passes do for
    any number of rows.
    Nulls, NaN and infinite values do not count; a column without values has null quantiles.
    """
    spark = df.sparkSession
    values = {c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")) for c in columns}
    first = df.agg(*[f(values[c]).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    done, open_ = [], []
    for i, c in enumerate(columns):
        n, lo, hi = (first[f"{x}{i}"] for x in ("n", "lo", "hi"))
        for share in map(float, shares):
            if not n:
                done.append((c, share, None))
            else:
                open_.append({"column": c, "share": share, "rank": max(1, math.ceil(share * n)), "lo": lo, "hi": hi})
    while open_:
        done += [(t["column"], t["share"], t["lo"] + 0.0) for t in open_ if t["lo"] == t["hi"]]
        open_ = [t for t in open_ if t["lo"] != t["hi"]]
        if not open_:
            break
        ranges: dict[str, list] = {}
        for t in open_:
            own = ranges.setdefault(t["column"], [])
            if (t["lo"], t["hi"]) not in own:
                own.append((t["lo"], t["hi"]))
        found: dict[tuple, list] = {}
        for row in reduce(DataFrame.union, [range_counts(df, c, values[c], r, buckets) for c, r in ranges.items()]).collect():
            found.setdefault((row["column_name"], *ranges[row["column_name"]][row["cell"] // buckets]), []).append(row)
        for t in open_:
            for row in sorted(found[t["column"], t["lo"], t["hi"]], key=lambda r: r["cell"]):
                if t["rank"] <= row["n"]:
                    # the next pass looks at the same values again: those of this bucket
                    t["lo"], t["hi"] = row["lo"], row["hi"]
                    break
                t["rank"] -= row["n"]
    return spark.createDataFrame(done, "column_name string, share double, value double")


def range_counts(df: DataFrame, name: str, value: Column, ranges: list[tuple[float, float]], buckets: int) -> DataFrame:
    """``column_name, cell, n, lo, hi``: a column's values in ``buckets`` equal parts of each range, counted.

    Shares that look at the same range share its counts.  Ranges are disjoint
    (the smallest and largest value of different buckets; a larger value is
    never in a lower bucket), so a row counts once; ``cell`` is the place of
    the range times ``buckets`` plus the bucket.  Only this column is read.
    """
    inside = [value.between(F.lit(lo), F.lit(hi)) for lo, hi in ranges]
    cells = []
    for i, (lo, hi) in enumerate(ranges):
        width = hi / buckets - lo / buckets
        place = F.floor((value - F.lit(lo)) / F.lit(width)) if width > 0 else F.when(value == lo, 0).otherwise(1)
        cells.append(F.when(inside[i], F.least(place, F.lit(buckets - 1)).cast("int") + i * buckets))
    return (df.where(reduce(Column.__or__, inside)).select(F.coalesce(*cells).alias("cell"), value.alias("value"))
            .groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
            .select(F.lit(name).alias("column_name"), "cell", "n", "lo", "hi"))


#: Counters of a frequent-item sketch, and the share of all rows by which its counts may be off (3.5 over its counters).
TRACKED = 8192
SKETCH_ERROR = 3.5 / TRACKED


def heavy_values(df: DataFrame, columns: list[str], k: int = 5, candidates: int = 256) -> DataFrame:
    """``column_name, value, n_rows, rank`` of the k most frequent values of each column (ties by value), exactly.

    A first pass keeps a frequent-item sketch a column, a second one counts
    the sketch's candidates exactly; what is shuffled are sketches and a few
    counts a task, not values.  A column is settled if its k-th count is
    above what any other value can have; other columns (no value stands out)
    are counted in full by ``profile_topk``.
    """
    spark, k2 = df.sparkSession, max(candidates, 4 * k)
    shown = [F.concat(F.lit("v"), F.col(c).cast("string")) for c in columns]
    shown = [F.coalesce(s, F.lit("null")) for s in shown]
    named = df.select(*[s.alias(f"v{i}") for i, s in enumerate(shown)])
    first = named.agg(F.count(F.lit(1)).alias("n"), *[F.expr(f"approx_top_k(v{i}, {k2}, {TRACKED})").alias(f"t{i}") for i in range(len(columns))]).first()
    listed = [(i, r["item"]) for i in range(len(columns)) for r in first[f"t{i}"] or []]
    if not listed:
        return profile_topk(df, columns, k)
    # at most candidates x columns rows
    wanted = spark.createDataFrame(listed, "column_index int, item string")
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("column_index"), F.col(f"v{i}").alias("item")) for i in range(len(columns))]))
    counted = (named.select(cells.alias("x")).select("x.*").join(F.broadcast(wanted), ["column_index", "item"])
               .groupBy("column_index", "item").agg(F.count(F.lit(1)).alias("n_rows")).collect())
    rows, open_ = [], []
    for i, c in enumerate(columns):
        top = first[f"t{i}"] or []
        own = sorted(((r["n_rows"], r["item"]) for r in counted if r["column_index"] == i),
                     key=lambda x: (-x[0], x[1] == "null", x[1]))[:k]
        all_seen = sum(r["count"] for r in top) == first["n"]  # nothing was purged: the counts are whole
        missed = (top[-1]["count"] if len(top) == k2 else 0) + SKETCH_ERROR * first["n"]
        if all_seen or (len(own) == k and own[-1][0] > missed):
            rows += [(c, None if item == "null" else item[1:], n, rank + 1) for rank, (n, item) in enumerate(own)]
        else:
            open_.append(c)
    settled = spark.createDataFrame(rows, "column_name string, value string, n_rows long, rank int")
    return settled.unionByName(profile_topk(df, open_, k)) if open_ else settled


def edition_bitmaps(df: DataFrame, edition: str, rows: list[str], pivot: str, number: str) -> DataFrame:
    """Stored form of a distinct count by rows, pivot value and edition: bitmaps of the numbers seen.

    ``number`` is a whole number of 0 or more; 32,768 of them share a bitmap.
    """
    return (df.where(F.col(number).isNotNull()).groupBy(F.col(edition).alias("edition"), *rows, pivot, F.bitmap_bucket_number(number).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits")))


def merged_crosstab(stored: DataFrame, rows: list[str], pivot: str, pivot_values: list, names: dict) -> DataFrame:
    """COUNT(DISTINCT number) by ``rows`` with a column per pivot value, over all stored editions given; exact (A4)."""
    cells = stored.groupBy(*rows, pivot, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    table = cells.groupBy(*rows).pivot(pivot, pivot_values).agg(F.sum(F.bitmap_count("bits")))
    return table.select(*rows, *[F.coalesce(F.col(str(v)), F.lit(0)).alias(names[v]) for v in pivot_values])
