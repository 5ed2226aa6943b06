"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Targets: the sources share the total size by weight; a target never passes
``max_repeats`` times its source's size, and what is cut off is shared again
by weight among the others until none is above.

Sampling: within a source every document expects ``target / source_size``
copies.  Documents are put in a fixed order, their expected copies are
prefix-summed, one offset in [0, 1) drawn for the source is added, and a
document is emitted once for each integer its interval crosses.

The order is (size class, hash class, size, hash, id), so every size class
is hit evenly and the words taken come near the target.  Its prefix sums are
taken in three levels - over the size classes of a source, over the at most
4096 hash classes of a size class, and inside a hash class - so no window
holds a whole source however large its share of the rows is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from microstar.llm import common
from microstar.session import checkpoint_root

_BEFORE = (W.unboundedPreceding, -1)


def targets(sources: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """``target`` for each row (source, source_size); one row per source.

    Sources are weighed by code-point order (null last), the weights
    repeating.  Sorted by cap per unit of weight, the sources that reach
    their cap are a prefix: a source belongs to it when its cap is at most
    what its weight would bring from what the earlier caps leave.  Running
    sums over the sources' totals (one small row each) give all of it.
    """
    null_last = F.col("source").isNull().cast("int")
    place = F.row_number().over(W.orderBy(null_last, "source")) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]),
                          (place % len(weights)).cast("int") + 1)
    rows = sources.select("source", "source_size", weight.alias("weight"),
                          (F.col("source_size") * max_repeats).alias("cap"))
    before = W.orderBy(F.col("cap") / F.col("weight"), null_last, "source").rowsBetween(*_BEFORE)
    rows = (rows.select("*", F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
                        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"))
            .select("*", (F.sum("source_size").over(W.partitionBy()) - F.col("cap_before")).alias("size_left"),
                    (F.sum("weight").over(W.partitionBy()) - F.col("weight_before")).alias("weight_left"))
            .withColumn("capped", F.col("cap") * F.col("weight_left") <= F.col("size_left") * F.col("weight")))
    first_free = F.max(F.when(~F.col("capped"), F.struct("weight_left", "size_left"))).over(W.partitionBy())
    rows = rows.withColumn("free", first_free)
    return rows.select(
        "source", "source_size",
        F.when(F.col("capped"), F.col("cap").cast("double"))
        .otherwise((F.col("free.size_left") * F.col("weight")).cast("double") / F.col("free.weight_left"))
        .alias("target"))


def _size_class(size: Column) -> Column:
    """Number of digits and the two leading ones: classes at most a tenth wide, in size order."""
    digits = size.cast("string")
    return F.concat(F.lpad(F.length(digits).cast("string"), 2, "0"), F.rpad(F.substring(digits, 1, 2), 2, "0"))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
           weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3, seed: str = "mix") -> DataFrame:
    """Copies of every document: ``doc_id, source, size, source_size, target, copies, taken``.

    One row per input row.  Size is the number of words (null text: 0);
    documents of no size take part and cost nothing.  A null source is a
    source of its own.  The result depends on the rows alone, so reruns
    agree; of rows equal in id, source and size it is open which one gets an
    odd copy.  Null ids sort first.  Other columns are not read.  An empty
    table gives an empty result.
    """
    checkpoint_root(docs.sparkSession)
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = (docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                        common.n_words(F.col(text_col)).alias("size"))
            .select("*", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"),
                    _size_class(F.col("size")).alias("size_class"),
                    F.md5(F.concat(F.lit(f"{seed}:"), ident)).alias("hash"))
            .withColumn("hash_class", F.substring("hash", 1, 3))
            .checkpoint())  # the texts are read once
    cells = rows.groupBy("key", "size_class", "hash_class").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"), F.first("source").alias("source"))
    classes = cells.groupBy("key", "size_class").agg(
        F.sum("n").alias("n"), F.sum("words").alias("words"), F.first("source").alias("source"))
    sources = classes.groupBy("key").agg(F.sum("words").alias("source_size"), F.first("source").alias("source"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), "key")), 1, 12), 16, 10).cast("double") / 16.0 ** 12
    plan = (targets(sources.select("source", "source_size"), weights, max_repeats)
            .withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
            .select("key", "source_size", "target",
                    F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("each"),
                    offset.alias("offset")))
    earlier_classes = classes.select("key", "size_class", F.coalesce(
        F.sum("n").over(W.partitionBy("key").orderBy("size_class").rowsBetween(*_BEFORE)), F.lit(0)).alias("before_class"))
    earlier = (cells.select("key", "size_class", "hash_class", F.coalesce(
        F.sum("n").over(W.partitionBy("key", "size_class").orderBy("hash_class").rowsBetween(*_BEFORE)),
        F.lit(0)).alias("before_cell"))
        .join(earlier_classes, ["key", "size_class"]).join(plan, "key"))
    in_cell = W.partitionBy("key", "size_class", "hash_class").orderBy("size", "hash", "doc_id")
    place = F.col("before_class") + F.col("before_cell") + F.col("in_cell")
    crossed = lambda end: F.floor(F.col("each") * end + F.col("offset"))
    return (rows.withColumn("in_cell", F.row_number().over(in_cell))
            .join(earlier, ["key", "size_class", "hash_class"])
            .withColumn("copies", (crossed(place) - crossed(place - 1)).cast("long"))
            .select("doc_id", "source", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3, seed: str = "mix") -> DataFrame:
    """The mixed corpus: every row of ``docs``, all columns, once for each of its copies.

    ``docs`` needs ids that tell its rows apart; rows with a null id, and
    rows that share one, count as documents of the mix by their id's copies.
    """
    taken = (copies(docs, id_col, text_col, source_col, weights, max_repeats, seed)
             .groupBy("doc_id").agg(F.max("copies").alias("mix_copies__")).withColumnRenamed("doc_id", "mix_id__"))
    joined = docs.join(taken, docs[id_col].eqNullSafe(taken["mix_id__"]))
    repeated = F.explode(F.array_repeat(F.lit(1), F.col("mix_copies__").cast("int"))).alias("mix_one__")
    return joined.select(*[docs[c] for c in docs.columns], repeated).drop("mix_one__")


#: DuckDB SQL for the rows of ``copies(documents)`` without ``source`` and ``copies``.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
r AS (
  SELECT *, coalesce('=' || source, '') AS key,
         lpad(CAST(length(CAST(size AS VARCHAR)) AS VARCHAR), 2, '0') || rpad(left(CAST(size AS VARCHAR), 2), 2, '0') AS size_class,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hash
  FROM d),
s AS (SELECT key, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY key),
w AS (
  SELECT *, CAST(1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS BIGINT) AS weight,
         3 * source_size AS cap FROM s),
b AS (
  SELECT *, CAST(coalesce(sum(cap) OVER o, 0) AS BIGINT) AS cap_before, CAST(coalesce(sum(weight) OVER o, 0) AS BIGINT) AS weight_before
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) - cap_before AS size_left,
         CAST(sum(weight) OVER () AS BIGINT) - weight_before AS weight_left FROM b),
f AS (SELECT weight_left AS free_weight, size_left AS free_size FROM l
      WHERE NOT cap * weight_left <= size_left * weight ORDER BY weight_left DESC LIMIT 1),
p AS (
  SELECT l.key, l.source_size,
         CASE WHEN cap * weight_left <= size_left * weight THEN CAST(cap AS DOUBLE)
              ELSE CAST(free_size * weight AS DOUBLE) / free_weight END AS target,
         CAST(CAST('0x' || substr(md5('mix/' || l.key), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 AS u
  FROM l LEFT JOIN f ON true),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY size_class, substr(hash, 1, 3), size, hash, doc_id) AS i FROM r),
e AS (SELECT n.*, p.source_size, p.target, p.u,
             CASE WHEN p.source_size > 0 THEN p.target / p.source_size ELSE 0.0 END AS each FROM n JOIN p ON n.key = p.key)
SELECT doc_id, size, source_size, target,
       CAST(floor(each * i + u) - floor(each * (i - 1) + u) AS BIGINT) * size AS taken
FROM e
"""
