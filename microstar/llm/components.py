"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from microstar.llm.common import written



def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the links (a, b); component is the smallest node reachable.

    Each round sends every node's larger neighbours, then its smaller ones,
    to the smallest node beside it.  The edges stay at most as many as the
    links, the rounds grow with the logarithm of the longest path, and a hub
    is only ever grouped by its smallest neighbour (a partial aggregate).
    Each round's edges are a written table, so lost executors cost one round.
    """
    spark = links.sparkSession
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()
    edges = written(edges, "links")
    before = None
    for _ in range(most_rounds):
        # larger neighbours of a node go to the smallest of its neighbours and itself
        both = edges.union(edges.select(F.col("low").alias("high"), F.col("high").alias("low"))).toDF("node", "other")
        least = both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("least"))
        large = (both.where("other > node").join(least, "node")
                 .select(F.col("other").alias("high"), F.col("least").alias("low")).where("high <> low").distinct())
        # smaller neighbours of a node, and itself, go to the smallest of them
        least = large.groupBy("high").agg(F.min("low").alias("least"))
        small = (large.join(least, "high").select(F.col("low").alias("high"), F.col("least").alias("low"))
                 .where("high <> low").union(least.toDF("high", "low")).distinct())
        edges = written(small, "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return (edges.groupBy("high").agg(F.min("low").alias("component")).withColumnRenamed("high", "node")
            .union(edges.select("low", "low").distinct()))
