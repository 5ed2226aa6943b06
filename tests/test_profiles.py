"""Stored profiles, exact quantiles, heavy values, bitmaps, bucketed joins and split quoted text."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from microstar.operators import profile_merge as P
from microstar.operators.profile import profile_topk
from microstar.operators.quality import check_unique
from microstar.plans import catalog
from microstar.sources import quoted
from microstar.sources.bucketed import buckets_for, read_bucketed, write_star_bucketed
from microstar.sources.delimited import read_star_csv, write_delimited
from tests.conftest import SF_SMALL


def test_merged_distinct_counts_stay_within_the_stated_error(spark):
    rows = spark.range(60_000).select((F.col("id") % 5).alias("e"), (F.col("id") * 7 % 40_000).alias("v"), F.lit(None).cast("string").alias("s"))
    stored = P.edition_profile(rows, "e", ["v"], ["s"])
    got = {r.column_name: r for r in P.merged_profile(stored).collect()}
    assert abs(got["v"].distinct - 40_000) <= P.DISTINCT_ERROR * 40_000
    assert (got["v"].n_rows, got["v"].n_nulls, got["v"].lo, got["v"].hi) == (60_000, 0, 0.0, 39_999.0)
    assert (got["s"].n_nulls, got["s"].distinct, got["s"].mean) == (60_000, 0, None)
    part = {r.column_name: r for r in P.merged_profile(stored.where("edition < 2")).collect()}
    assert part["v"].n_rows == 24_000


@pytest.mark.parametrize("buckets", [2, 7, 1024])
def test_quantiles_equal_sorted_ranks(spark, buckets):
    draw = random.Random(buckets)
    values = [draw.choice([0.0, -1.5, draw.gauss(0, 1), draw.lognormvariate(0, 20), None, float("nan"), float("inf")]) for _ in range(700)]
    frame = spark.createDataFrame([(v, i % 3, None) for i, v in enumerate(values)], "a double, b int, c double")
    shares = [0, 0.1, 0.5, 0.999, 1]
    got = {(r.column_name, r.share): r.value for r in P.exact_quantiles(frame, ["a", "b", "c"], shares, buckets).collect()}
    held = sorted(v for v in values if v is not None and abs(v) < float("inf"))
    for share in shares:
        at = max(1, -int(-share * len(held) // 1)) - 1
        assert got["a", share] == held[at], (share, at)
        assert got["c", share] is None
    assert got["b", 0.5] == 1.0


def test_heavy_values_equal_full_counts(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("x"), F.col("id") % 900)).alias("a"),
        F.col("id").alias("b"), (F.col("id") % 2).cast("boolean").alias("c"), F.lit("null").alias("d"))
    columns = ["a", "b", "c", "d"]  # b: no value stands out, counted in full
    got = sorted(map(tuple, P.heavy_values(rows, columns, 3, candidates=16).collect()), key=str)
    assert got == sorted(map(tuple, profile_topk(rows, columns, 3).collect()), key=str)
    assert P.heavy_values(rows.where("b < 0"), columns, 3).count() == 0


def test_heavy_values_shuffle_no_values(spark):
    found = catalog.QUERIES["profile_topk"](spark, SF_SMALL)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_merged_crosstab_counts_each_number_once(spark):
    rows = [("a", 1, 5, "m1"), ("a", 1, 5, "m2"), ("a", 1, 40_000, "m2"), ("a", 2, 0, "m1"), ("b", 2, None, "m1"), ("b", 2, 32_768, "m3")]
    stored = P.edition_bitmaps(spark.createDataFrame(rows, "r string, p int, n long, e string"), "e", ["r"], "p", "n")
    got = lambda frame: sorted(map(tuple, P.merged_crosstab(frame, ["r"], "p", [1, 2], {1: "p1", 2: "p2"}).collect()))
    assert got(stored) == [("a", 2, 1), ("b", 0, 1)]
    assert got(stored.where("edition = 'm1'")) == [("a", 1, 1)]


def test_bucketed_star_joins_and_checks_without_exchange(spark):
    orders, lines = catalog.T(spark, SF_SMALL, "orders"), catalog.T(spark, SF_SMALL, "lineitem")
    names = write_star_bucketed({"o": orders, "l": lines}, {"o": "o_orderkey", "l": "l_orderkey"}, lines.count())
    o, ln = read_bucketed(spark, names["o"]), read_bucketed(spark, names["l"])
    joined = o.join(ln.hint("merge"), o.o_orderkey == ln.l_orderkey)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert "Exchange" not in check_unique(o, ["o_orderkey"])._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == orders.join(lines, orders.o_orderkey == lines.l_orderkey).count() and check_unique(o, ["o_orderkey"]).count() == 0
    assert buckets_for(1) == 8 and buckets_for(100_000_000) == 32


TEXTS = ["plain", 'say "hi"', "line\nbreak", "\n", '"', "a\tb", "\r\n", " padded ", "é ü", "", None, "x" * 500 + "\n\n" + '""' * 40, "end\r"]


@pytest.mark.parametrize("encoding", ["UTF-8", "ISO-8859-1"])
def test_one_quoted_file_is_read_by_many_tasks(spark, tmp_path, encoding):
    draw = random.Random(3)
    rows = [(i, draw.choice(TEXTS), draw.choice(TEXTS[:9])) for i in range(3000)]
    frame = spark.createDataFrame(rows, "id long, a string, b string")
    path = str(tmp_path / "q")
    write_delimited(frame.coalesce(1), path, sep="\t", encoding=encoding)
    whole = spark.read.format("csv").schema(frame.schema).options(
        header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, nullValue="", sep="\t",
        encoding=encoding, multiLine=True).load(path)
    want = Counter(map(tuple, whole.collect()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("700", "5000", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            got = read_star_csv(spark, path, encoding=encoding, schema=frame.schema, multiline=True)
            assert Counter(map(tuple, got.collect())) == want, size
            splits = quoted.split_states(quoted._lines(spark, path)).count()
            assert splits > 20 if size != before else splits >= 1
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sum(want.values()) == 3000


def test_quantile_passes_share_ranges_and_make_no_row_a_share(spark):
    """Shares in the same range are counted once; a pass reads rows as they are, without one copy a share."""
    from microstar.operators.profile_merge import exact_quantiles, range_counts
    frame = spark.range(10_000).select(F.when(F.col("id") % 97 != 0, (F.col("id") * 7919 % 10_000) / 8).alias("x"))
    counts = range_counts(frame, "x", F.col("x"), [(0.0, 100.0), (1000.0, 1100.0)], 16)
    assert "Generate" not in counts._jdf.queryExecution().executedPlan().toString()
    values = sorted(r[0] for r in frame.where("x IS NOT NULL").collect())
    rows = counts.collect()
    assert sum(r["n"] for r in rows) == sum(v <= 100 or 1000 <= v <= 1100 for v in values)
    assert {r["cell"] // 16 for r in rows} == {0, 1} and len(rows) <= 32
    shares = [0.0, 0.001, 0.25, 0.2501, 0.5, 0.5, 0.99, 1.0]
    found = sorted((r["share"], r["value"]) for r in exact_quantiles(frame, ["x"], shares, buckets=8).collect())
    assert found == [(p, values[max(1, math.ceil(p * len(values))) - 1]) for p in shares]
