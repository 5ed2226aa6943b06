"""Near duplicates by bottom-k sketches of word shingles.

1. One hash function maps every shingle of a text to a number; the set's
   smallest ``sketch`` numbers are its sketch.  Texts with equal sets are one
   class from here on (found by a 128-bit digest of the set), so copies cost
   one row, and the class is named after its smallest id.
2. Inverted lists of the retained values: two sets as alike as asked share
   at least ``o`` of their retained values (a bound missed by a pair on the
   threshold itself once in about a million), so they share a value among
   the ``size - o + 1`` rarest ones of each.  Only these few values of a
   class are listed; values that occur once are never listed.
3. In every list each class is paired with the list's most ordinary member.
   Pairs are filtered by set sizes, then by the Jaccard estimate from the
   union's sketch, and confirmed by the exact Jaccard of the full sets.
4. Only lists whose members are still in different components go on.  In
   short ones all remaining pairs are tried.  The classes in long ones (many
   copies with small changes) are listed anew by the rarest shingles of
   their full sets, which is an exact filter; a pair is met at its first
   common shingle and tried unless what follows there, or the estimate,
   already rules it out.
5. Components of the links are the result.

Lists are joined, never collected; only links between components not yet
joined are looked for, so a group of copies needs about one pair a member.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from microstar.llm import common, hashing
from microstar.llm.common import written
from microstar.llm.components import components

_U = np.uint64


@dataclass(frozen=True)
class Likeness:
    """What counts as near duplicate, and the sketches that find it."""

    words: int = 5              # of a shingle
    percent: int = 85           # least Jaccard similarity, in percent
    listed: int = 64            # retained values with inverted lists
    sketch: int = 256           # retained values for estimates
    deviations: float = 5.0     # standard deviations an estimate may fall short
    short_list: int = 64        # lists up to this length are tried out in full

    @property
    def least(self) -> float:
        return self.percent / 100

    def shared(self, k: int) -> int:
        """Retained values, of ``k``, that two sets as alike as asked share at least."""
        return max(1, math.ceil(self.least * k - self.deviations * math.sqrt(k * self.least * (1 - self.least))))

    def shared_by(self, n: int) -> int:
        """Retained values that a set of ``n``, all of them listed, shares with one as alike as asked at least.

        A larger partner may not fit its sketch; at worst all that it drops
        are shared values.
        """
        whole, largest = -(-n * self.percent // 100), n * 100 // self.percent
        cut = [-(-(n + m) * self.percent // (100 + self.percent)) - (m - self.listed)
               for m in range(self.listed + 1, largest + 1)]
        return min(whole, max(min(cut), self.shared(self.listed))) if cut else whole


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and the bounds of each text's part.

    A text with fewer words than a shingle has its whole word sequence as the
    one shingle; a text without words has none.
    """
    found = hashing.words(texts, lower=True)
    starts, owner = hashing.window_starts(found.bounds, words)
    hashes = hashing.windows(found.hashes, words, starts)
    ends = np.searchsorted(owner, np.arange(len(found.bounds)))
    counts = np.diff(found.bounds)
    parts = []
    for i in range(len(counts)):
        if counts[i] >= words:
            parts.append(np.unique(hashes[ends[i]:ends[i + 1]]))
        elif counts[i]:
            whole = found.hashes[found.bounds[i]:found.bounds[i + 1]]
            parts.append(hashing.windows(whole, len(whole), np.zeros(1, np.int64), seed=100 + len(whole)))
        else:
            parts.append(np.empty(0, np.uint64))
    bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), bounds


def _digests(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set: sums of mixed hashes, mixed with the size."""
    out = []
    for seed in (11, 13):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashing.mix(values ^ hashing.seeds(1, seed)[0]))))
        out.append(hashing.mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _lists(values: np.ndarray, bounds: np.ndarray, most: int | None = None) -> pa.ListArray:
    """The sets, or their ``most`` smallest hashes, as lists of signed numbers in hash order."""
    if most is not None:
        counts = np.minimum(np.diff(bounds), most)
        ends = np.concatenate(([0], np.cumsum(counts)))
        owner = np.repeat(np.arange(len(counts)), counts)
        values, bounds = values[np.arange(ends[-1]) - ends[owner] + bounds[owner]], ends
    # the order of unsigned hashes is kept by moving the sign bit
    signed = (values ^ _U(1 << 63)).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(signed, pa.int64()))


def sketched(docs: DataFrame, like: Likeness) -> DataFrame:
    """(doc_id, d1, d2, n_shingles, sketch) of every row; ``sketch`` holds the listed values."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text", 1 << 20):
                values, bounds = shingle_sets(batch.column(1), like.words)
                d1, d2 = _digests(values, bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(d1), pa.array(d2), pa.array(np.diff(bounds)),
                     _lists(values, bounds, like.listed)], ["doc_id", "d1", "d2", "n_shingles", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, d1 long, d2 long, n_shingles long, sketch array<long>")


def full_sets(docs: DataFrame, like: Likeness) -> DataFrame:
    """(node, n, sketch, shingles) of the given rows; ``sketch`` holds the values for estimates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text", 1 << 20):
                values, bounds = shingle_sets(batch.column(1), like.words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.diff(bounds)), _lists(values, bounds, like.sketch),
                     _lists(values, bounds)], ["node", "n", "sketch", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "node long, n long, sketch array<long>, shingles array<long>")


def _sizes_allow(n: Column, m: Column, like: Likeness) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * like.percent


def _estimate_allows(a: Column, b: Column, n: Column, m: Column, k: int, like: Likeness) -> Column:
    """Whether the Jaccard estimate from the union's sketch comes near enough.

    Up to the smaller of the two largest retained values both sketches are
    complete, so their union there is a sketch of the union.  Sets that lie
    whole in their sketches are compared exactly.
    """
    top = F.lit((1 << 63) - 1)
    last = lambda x, size: F.when(size > k, F.element_at(x, -1)).otherwise(top)
    bound = F.least(last(a, n), last(b, m))
    within = lambda x: F.when(F.element_at(x, -1) <= bound, F.size(x)).otherwise(
        F.size(F.filter(x, lambda v: v <= bound)))
    shared, both = F.size(F.array_intersect(a, b)), within(a) + within(b)
    slack = F.when(bound == top, 0.0).otherwise(
        like.deviations * math.sqrt(like.least * (1 - like.least)) / F.sqrt(F.lit(float(k))))
    # shared / (both - shared) >= least - slack
    return shared * (1 + like.least - slack) >= both * (like.least - slack) - 1e-9


def confirmed(pairs: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) whose full sets are as alike as asked, after the size and sketch filters."""
    side = lambda cols, x: sets.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in cols])
    near = (pairs.join(side(["n", "sketch"], "a"), "a").join(side(["n", "sketch"], "b"), "b")
            .where(_sizes_allow(F.col("n_a"), F.col("n_b"), like))
            .where(_estimate_allows(F.col("sketch_a"), F.col("sketch_b"), F.col("n_a"), F.col("n_b"), like.sketch, like))
            .select("a", "b").distinct())
    near = written(near, "near-pairs")
    shared = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return (near.join(side(["n", "shingles"], "a"), "a").join(side(["n", "shingles"], "b"), "b")
            .where(shared * 100 >= (F.col("n_a") + F.col("n_b") - shared) * like.percent).select("a", "b"))


def _rarest(found: DataFrame, size: Column, keep: Column) -> DataFrame:
    """(node, n, size, own, place, rare, value): the ``keep`` rarest values of each node, one a row.

    ``found`` has (node, size, value, seen) for the values seen twice or more;
    the others of a node's ``size`` values are unique, come first and are not
    listed; ``own`` is their number.  ``place`` counts the values before one
    in the common order (rarest first), ``rare`` holds all listed ones of the
    node in that order.
    """
    per = found.groupBy("node").agg(F.first("size").alias("size"), F.first("n").alias("n"),
                                    F.sort_array(F.collect_list(F.struct("seen", "value"))).alias("values"))
    per = per.withColumn("own", size - F.size("values")).withColumn("left", (keep - F.col("own")).cast("int"))
    rare = F.transform(F.slice("values", F.lit(1), F.greatest(F.col("left"), F.lit(0))), lambda v: v["value"])
    return (per.where("left > 0").withColumn("rare", rare)
            .select("node", "n", "size", "own", "rare", F.posexplode("rare").alias("at", "value"))
            .withColumn("place", F.col("own") + F.col("at")).drop("at"))


def _counted(rows: DataFrame) -> DataFrame:
    """(node, size, n, value, seen) for the values that more than one row has."""
    seen = rows.groupBy("value").agg(F.count(F.lit(1)).alias("seen")).where("seen > 1")
    return rows.join(seen, "value")


def _star_pairs(lists: DataFrame) -> DataFrame:
    """Each member of a list with the member that has the fewest values of its own."""
    head = (lists.groupBy("value").agg(F.min(F.struct((F.col("own") / F.col("size")).alias("share"), "node")).alias("h"),
                                       F.count(F.lit(1)).alias("members"))
            .where("members > 1").select("value", F.col("h.node").alias("head")))
    return (lists.join(head, "value").where("node <> head")
            .select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct())


def links(docs: DataFrame, classes: DataFrame, like: Likeness) -> DataFrame:
    """Links (a, b) between classes; together they connect what all links connect.

    ``classes`` has (node, n, sketch), ``docs`` the text of every node.
    """
    spark = docs.sparkSession
    size = F.size("sketch")
    rows = classes.select("node", "n", size.alias("size"), F.explode("sketch").alias("value"))
    by_size = F.array(*[F.lit(like.shared_by(n)) for n in range(1, like.listed + 1)])
    need = F.when(F.col("n") > F.col("size"), F.lit(like.shared(like.listed))).otherwise(F.element_at(by_size, F.col("size")))
    listed = written(_rarest(_counted(rows), F.col("size"), F.col("size") - need + 1).drop("rare"), "lists")
    many = listed.groupBy("value").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    nodes = listed.join(many, "value").select("node").distinct()
    sets = written(full_sets(docs.join(nodes, docs["doc_id"] == nodes["node"]).select("doc_id", "text"), like), "sets")

    star = written(confirmed(_star_pairs(listed), sets, like), "star-links")
    joined = written(components(star), "star-components")
    where = lambda frame: (frame.join(joined, "node", "left")
                           .withColumn("component", F.coalesce("component", "node")))
    open_lists = (where(listed).groupBy("value")
                  .agg(F.count(F.lit(1)).alias("members"), F.min("component").alias("low"),
                       F.max("component").alias("high")).where("low <> high").select("value", "members"))
    rest = written(where(listed).join(open_lists, "value"), "open-lists")

    # short lists: every pair that is still in two components
    short = rest.where(F.col("members") <= like.short_list)
    left = short.select("value", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("component").alias("c_a"))
    right = short.select("value", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("c_b"))
    tries = (left.join(right, "value").where("a < b AND c_a <> c_b")
             .where(_sizes_allow(F.col("n_a"), F.col("n_b"), like)).select("a", "b").distinct())

    # long lists: the classes in them are listed by the rarest shingles of their full sets
    long_nodes = rest.where(F.col("members") > like.short_list).select("node", "component").distinct()
    crowd = (sets.join(long_nodes, "node")
             .select("node", "n", F.col("n").alias("size"), F.explode("shingles").alias("value")))
    full_need = F.ceil(F.col("n") * like.percent / F.lit(100))
    relisted = _rarest(_counted(crowd), F.col("size"), F.col("size") - full_need + 1)
    relisted = written(where(relisted), "relisted")
    around = sets.select("node", "sketch").join(relisted.select("node").distinct(), "node")
    carried = relisted.join(around, "node")
    # comparing is far more work than the rows are bytes, so the partitions are not to be merged
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = lambda x: carried.select("value", *[F.col(c).alias(f"{c}_{x}") for c in
                                              ("node", "n", "place", "component", "rare", "sketch")]).repartition(parts, "value")
    # two sets share at most what follows their first common value in the common order
    most = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    possible = most * (100 + like.percent) >= (F.col("n_a") + F.col("n_b")) * like.percent
    first_common = F.element_at(F.array_intersect("rare_a", "rare_b"), 1) == F.col("value")
    crowded = (one("a").join(one("b"), "value")
               .where((F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b"))
                      & possible & _sizes_allow(F.col("n_a"), F.col("n_b"), like) & first_common
                      & _estimate_allows(F.col("sketch_a"), F.col("sketch_b"), F.col("n_a"), F.col("n_b"), like.sketch, like))
               .select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    return star.union(confirmed(tries.union(crowded).distinct(), sets, like))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    like: Likeness = Likeness()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Texts without words, and null texts, have an empty set, are linked with
    nothing and are kept.  Rows that share an id are one document of the
    graph.  Rows without an id belong to the component of their class, have
    a null ``component_id`` if nothing in it has an id, and are not kept.
    Ids are integers; other columns are not read.  An empty table gives an
    empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(sketched(docs, like), "sketched")
    filled = rows.where("n_shingles > 0")
    classes = written(filled.where("doc_id IS NOT NULL").groupBy("d1", "d2").agg(
        F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "classes")
    found = components(links(docs, classes.select("node", "n", "sketch"), like))
    named = (classes.select("d1", "d2", "node").join(found, "node", "left")
             .select("d1", "d2", F.coalesce("component", "node").alias("class_component")))
    labelled = rows.select("doc_id", "d1", "d2", "n_shingles").join(named, ["d1", "d2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("class_component")).otherwise(F.col("doc_id"))
    return (labelled.withColumn("component_id", component)
            .select("doc_id", "n_shingles", "component_id",
                    F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", like: Likeness = Likeness()) -> DataFrame:
    """Rows of ``docs``, all columns, without the near duplicates of a document with a smaller id.

    Of rows that share an id all stay or all go.  Rows without an id stay.
    """
    gone = (near_duplicates(docs, id_col, text_col, like).where("doc_id IS NOT NULL AND NOT kept")
            .select(F.col("doc_id").alias("gone__")).distinct())
    return docs.join(gone, docs[id_col] == gone["gone__"], "left_anti")
