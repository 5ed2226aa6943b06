"""One key holding a third of the rows: results stay exact, work is split."""

from pyspark.sql import functions as F

from microstar.operators.quality import check_unique, sort_with_tiebreak, surrogate_key
from microstar.operators.reshape import crosstab_distinct
from microstar.operators.profile import profile_topk

N = 30_000


def skewed(spark):
    # key 0 holds a third of the rows
    return spark.range(N).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"),
                                 (F.col("id") % 7).alias("grp"))


def test_hot_sort_key_is_split_across_range_partitions(spark):
    df = skewed(spark).repartition(8)
    # small test data: keep AQE from merging the sorted partitions back into one
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = (sort_with_tiebreak(df, ["k"]).groupBy(F.spark_partition_id().alias("p")).count()
                 .agg(F.max("count")).first()[0])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert parts < N / 3 * 0.75                   # the hot key alone would be N/3 in one task
    keys = surrogate_key(df, ["k"], name="sk").agg(F.min("sk"), F.max("sk"), F.countDistinct("sk")).first()
    assert tuple(keys) == (1, N, N)


def test_grouped_operators_exact_under_skew(spark):
    df = skewed(spark)
    dup = {r["k"]: r["n_rows"] for r in check_unique(df, ["k"]).collect()}
    assert dup == {0: N // 3}
    ct = {r["grp"]: r for r in crosstab_distinct(df.withColumn("piv", F.col("id") % 2), ["grp"], "piv", [0, 1], "k")
          .collect()}
    brute = {(g, p): len({(i if i % 3 else 0) for i in range(N) if i % 7 == g and i % 2 == p})
             for g in range(7) for p in (0, 1)}
    assert all(ct[g][str(p)] == brute[(g, p)] for g in range(7) for p in (0, 1))
    top = profile_topk(df.select(F.col("k").cast("string").alias("k")), ["k"], k=1).first()
    assert (top["value"], top["n_rows"]) == ("0", N // 3)


def test_aqe_splits_a_skewed_join_partition(spark):
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
            "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        fact = skewed(spark).repartition(8)
        dim = spark.range(N).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
        j = fact.join(dim, "k", "inner")
        assert len(j.collect()) == N               # exact
        final = j._jdf.queryExecution().executedPlan().toString()   # the adaptive plan after running
        assert "isSkewJoin=true" in final or "skew=true" in final
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
