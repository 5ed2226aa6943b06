"""Published loads, keys against stored keys, and planner-safe checks."""

import time

import pytest
from pyspark.sql import functions as F

from microstar.operators import keys
from microstar.operators.quality import REJECT_COL, FieldSpec, enforce_schema, split_rejects
from microstar.operators.route import where_computed
from microstar.plans import catalog, exam
from microstar.sources.publication import Publication
from tests.conftest import SF_SMALL


def checked(spark, rows):
    return spark.createDataFrame(rows, f"k string, v int, year string, {REJECT_COL} string")


def held(pub, table="t", **more):
    return sorted(tuple(r) for r in pub.read(table, **more).collect())


def test_a_load_counts_only_once_it_is_published(spark, tmp_path):
    pub = Publication(spark, str(tmp_path / "p"))
    with pytest.raises(LookupError):
        pub.read("t")
    first = pub.stage(checked(spark, [("a", 1, "1", None), ("b", 2, "2", None), ("x", 0, "2", "bad")]), "t", "year")
    assert pub.editions("t") == []
    pub.publish([(first, ["1", "2"])])
    assert held(pub) == [("a", 1, "1"), ("b", 2, "2")] and held(pub, status="rejected") == [("x", 0, "2", "bad")]
    opened = pub.read("t")
    second = pub.stage(checked(spark, [("c", 3, "2", None), (None, 4, "2", None)]), "t", "year")
    assert held(pub) == [("a", 1, "1"), ("b", 2, "2")]  # staged, not published
    pub.publish([(second, ["2"])])
    assert held(pub, editions=["2"], status="rejected") == []
    assert sorted(map(str, (r.k for r in pub.read("t", ["2"]).collect()))) == ["None", "c"]
    assert sorted(tuple(r) for r in opened.collect()) == [("a", 1, "1"), ("b", 2, "2")]  # an older reader keeps its state
    third = pub.stage(checked(spark, [("d", 5, "1", None)]), "t", "year")
    pub.publish([(third, ["1"])], append=True)
    assert held(pub, editions=["1"]) == [("a", 1, "1"), ("d", 5, "1")]
    none = pub.stage(checked(spark, []), "t", "year")
    pub.publish([(none, ["1", "2"])])
    assert held(pub) == []
    assert len(pub.vacuum()) == 3 and held(pub) == []


def test_a_broken_manifest_is_passed_over(spark, tmp_path):
    pub = Publication(spark, str(tmp_path / "p"))
    pub.publish([(pub.stage(checked(spark, [("a", 1, "1", None)]), "t"), ["all"])])
    (tmp_path / "p" / "_manifest" / "000000002.json").write_text('{"tables": {"t": {}')
    assert held(pub) == [("a", 1, "1")]
    assert pub.publish([(pub.stage(checked(spark, [("b", 2, "1", None)]), "t"), ["all"])]) == 3
    assert held(pub) == [("b", 2, "1")]
    assert pub._create(f"{pub.root}/_manifest/000000003.json", "x") is False  # a number is used once


def test_key_filters_hold_every_key_and_few_others(spark):
    own = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    buckets = keys.buckets_for(20_000)
    stored = keys.key_filter(own, ["k"], buckets)
    assert stored.count() == buckets
    assert keys.maybe_in(own, ["k"], stored, buckets).count() == 20_000
    other = spark.range(20_000, 60_000).select(F.col("id").cast("string").alias("k"))
    assert keys.maybe_in(other, ["k"], stored, buckets).count() < 0.03 * 40_000
    both = keys.stored_keys(spark.createDataFrame([("5",), ("x",)], "k string"), ["k"], own)
    assert [r.k for r in both.collect()] == ["5"]


def test_stored_keys_are_not_shuffled(spark, tmp_path):
    spark.range(50_000).select(F.col("id").cast("string").alias("k")).write.parquet(str(tmp_path / "s"))
    hits = keys.stored_keys(spark.createDataFrame([("5",), ("6",)], "k string"), ["k"], spark.read.parquet(str(tmp_path / "s")))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("BroadcastHashJoin"):]
    assert "LeftSemi" in below and "Exchange hashpartitioning" not in below.split("FileScan")[0]


def test_checks_stay_one_predicate_below_renames(spark):
    """A hundred checked, renamed columns under another filter plan in seconds."""
    n = 100
    frame = spark.range(50).select(*[(F.col("id") + i).cast("string").alias(f"c{i}") for i in range(n)])
    t0 = time.perf_counter()
    good, bad = split_rejects(enforce_schema(frame, [FieldSpec(f"c{i}", "int", 2) for i in range(n)]))
    renamed = good.select(*[F.col(f"c{i}").alias(f"d{i}") for i in range(n)])
    any_set = F.col("d0") > 40
    for i in range(1, 40):
        any_set = any_set | (F.col(f"d{i}") > 70)
    routed = where_computed(renamed.withColumns({f"d{i}": F.col(f"d{i}") * 2 for i in range(n)}), any_set)
    assert routed.count() == 1 and good.count() == 1
    assert bad.first()[REJECT_COL] == "c99: longer than 2"
    assert time.perf_counter() - t0 < 60


@pytest.mark.parametrize("table", ["DIM_RECURSO_DIFERENCIADO", "DIM_RSP_PRV"])
def test_exam_tables_plan_in_seconds(spark, table):
    star = catalog._exam_star(spark, SF_SMALL, table)
    good, _ = split_rejects(star)
    t0 = time.perf_counter()
    good._jdf.queryExecution().executedPlan()
    assert time.perf_counter() - t0 < 10


def test_first_reason_of_no_checks_is_null(spark):
    assert enforce_schema(spark.range(1), [FieldSpec("id", "string")]).first()[REJECT_COL] is None


def test_loads_of_editions_keep_one_row_a_key(spark, tmp_path):
    """K5: the outcome does not depend on how editions are batched, but for which comes first."""
    from tests import exam_fixtures as X
    raw = {y: X.write_raw(str(tmp_path), y, [X.base_row(y, "000000000007"), X.base_row(y, f"{y}00000001")]) for y in (2018, 2019)}
    out = str(tmp_path / "lake")
    for y in (2018, 2019):
        exam.load_editions(spark, {y: raw[y]}, out, tables=["DIM_LOCAL_PROVA"])
    rows = exam.read_star_table(spark, f"{out}/curated", "DIM_LOCAL_PROVA").select("NUM_INS", "ANO_ENEM").collect()
    assert sorted(map(tuple, rows)) == [("000000000007", "2018"), ("201800000001", "2018"), ("201900000001", "2019")]
    again = exam.load_editions(spark, {2018: raw[2018]}, out, tables=["DIM_LOCAL_PROVA"])  # a rerun does not meet itself
    rows = exam.read_star_table(spark, f"{out}/curated", "DIM_LOCAL_PROVA").select("NUM_INS", "ANO_ENEM").collect()
    assert sorted(map(tuple, rows))[0] == ("000000000007", "2018") and len(rows) == 3 and "DIM_LOCAL_PROVA" in again


def test_checked_columns_nobody_reads_are_not_made(spark):
    """The reason alone goes through the generator; a column that is only checked is not carried on."""
    frame = spark.range(20).select(*[F.concat(F.lit(f"{i}-"), F.col("id").cast("string")).alias(f"c{i}") for i in range(5)])
    good, bad = split_rejects(enforce_schema(frame, [FieldSpec(f"c{i}", "string", 3 if i else 9) for i in range(5)]))
    plan = good.select("c0")._jdf.queryExecution().optimizedPlan().toString()
    generate = next(line for line in plan.splitlines() if "Generate" in line)
    assert "c1#" not in generate and "_checked" in generate
    assert good.count() == 10 and {r[REJECT_COL] for r in bad.collect()} == {"c1: longer than 3"}


def test_staging_sorts_no_rows_by_status(spark, tmp_path):
    """Rows keep their order within the files of a status; more editions than open files are stored whole."""
    from microstar.sources import publication as P
    pub = P.Publication(spark, str(tmp_path))
    n = 3 * P.OPEN_FILES
    rows = (spark.range(0, 40 * n, 1, 2).select(F.col("id"), (F.col("id") % n).cast("string").alias("e"),
                                                F.when(F.col("id") % 7 == 0, "bad").alias(REJECT_COL)))
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    staged = pub.stage(rows, "t", "e")
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    found = sorted([(r["id"], r["e"], None) for r in pub.rows(staged).collect()]
                   + [(r["id"], r["e"], r[REJECT_COL]) for r in pub.rows(staged, P.REJECTED).collect()])
    assert found == sorted(tuple(r) for r in rows.collect())
