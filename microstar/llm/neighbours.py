"""Approximate nearest neighbours by inner product: NN-descent graph, greedy graph search.

Building: equal vectors become one node.  Random hyperplanes deal the nodes
into blocks a few times over; the best partners inside a block start each
node's list of ``degree`` neighbours, and ``links`` of its entries are nodes
dealt by hash, so that neighbours of neighbours leave the block.  Then, round
by round, Spark joins the neighbours (both directions) of every node around
which a list entry is new with their vectors, and each such neighbourhood
proposes its members to each other: neighbours of neighbours become
neighbours when they are nearer than what a list holds.  Members that have
met there in an earlier round are not compared again.  Rounds go on until
hardly any list entry changes.

Searching: a query keeps a beam of the nearest nodes seen and starts from its
own node and that node's random links; no node is an entry for all queries.
Each hop sends it to the neighbourhoods of its nearest nodes not yet visited,
until all of the beam is visited.  Distances on the way use vectors rounded to 8 bits;
the scores returned are computed in double precision on the vectors given.

All state is in tables keyed by node or query; nothing is held by one task
but a block (bounded) or a neighbourhood (at most twice the degree).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from microstar.llm.common import written


@dataclass(frozen=True)
class Graph:
    """Parameters of the graph and its search."""

    degree: int = 32      # neighbours in a node's list
    links: int = 4        # of them at the start: nodes dealt by hash; a query starts from them, too
    block: int = 1000     # nodes of a starting block, about
    deals: int = 4        # times the nodes are dealt into blocks
    settled: float = 0.01 # share of list entries that change in the last round
    beam: int = 32        # nodes a query keeps for each doubling of the nodes
    visits: int = 64      # neighbourhoods a query visits in one hop
    rescored: int = 64    # nodes of the beam that are scored exactly (answers at least)


_VECTOR = "node long, code binary, scale float"
_LIST = "node long, ids array<long>, scores array<float>, fresh array<boolean>"
PROPOSED = 1 << 20  # proposals that a task holds before it merges them, about


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part, as arrays of doubles.

    Left out are null ids, null and empty vectors, those with null or
    non-finite components, zero vectors, and those whose length is not the
    most frequent one (the smaller of equally frequent ones).
    """
    x = F.col("vector")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    rows = (table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
            .where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0))
            .where(F.forall(x, finite) & F.exists(x, lambda v: v != 0)))
    usual = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (usual["n"] if usual else 0))


def nodes_of(rows: DataFrame) -> DataFrame:
    """(node, vector): equal vectors once, under their smallest id."""
    return rows.groupBy("vector").agg(F.min("vec_id").alias("node")).select("node", "vector")


def coded(nodes: DataFrame) -> DataFrame:
    """(node, code, scale): vectors rounded to 8 bits, each with its own scale."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                scale = np.maximum(np.abs(x).max(axis=1), np.finfo(np.float64).tiny) / 127
                code = np.rint(x / scale[:, None]).astype(np.int8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([c.tobytes() for c in code], pa.binary()),
                     pa.array(scale.astype(np.float32))], ["node", "code", "scale"])

    return nodes.select("node", "vector").mapInArrow(run, _VECTOR)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _codes(column: pa.Array) -> np.ndarray:
    """Rows of 8-bit codes as floats; products and sums of them are exact in single precision."""
    return _bytes(column).reshape(len(column), -1).astype(np.float32)


def _bytes(column: pa.Array) -> np.ndarray:
    """All bytes of a binary column without nulls, one value after the other."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.int8)[ends[0]:ends[-1]]


def _products(codes: np.ndarray, scales: np.ndarray, own: np.ndarray | None = None,
              own_scales: np.ndarray | None = None) -> np.ndarray:
    own, own_scales = (codes, scales) if own is None else (own, own_scales)
    return (own @ codes.T) * own_scales[:, None] * scales[None, :]


def whole_groups(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.Table]:
    """Tables that hold whole groups, from batches sorted by the ``key`` column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1], side="left"))  # where the batch's last group begins
        if cut or held and held[-1].column(key)[-1].as_py() != keys[-1]:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _by_key(frame: DataFrame, key: str, run: Callable, schema: str) -> DataFrame:
    return frame.repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(run, schema)


def _best(owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, keep: int, *flags: np.ndarray):
    """The ``keep`` best different ids of each owner: (owner, id, score, flags) sorted by owner, score, id.

    Of the same id of an owner one entry stays, flagged if any of them was.
    """
    order = np.lexsort((ids, owner))
    owner, ids, scores = owner[order], ids[order], scores[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (np.diff(owner) != 0) | (np.diff(ids) != 0)
    first = np.flatnonzero(new)
    flags = tuple(np.logical_or.reduceat(f[order], first) if len(first) else f[order] for f in flags)
    owner, ids, scores = owner[first], ids[first], scores[first]
    order = np.lexsort((ids, -scores, owner))
    owner, ids, scores, flags = owner[order], ids[order], scores[order], tuple(f[order] for f in flags)
    begins = np.searchsorted(owner, owner, side="left")
    top = np.arange(len(owner)) - begins < keep
    return owner[top], ids[top], scores[top], tuple(f[top] for f in flags)


def _flat(table: pa.Table, owner: int, lists: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
    table = table.combine_chunks()
    columns = [table.column(i).combine_chunks() for i in range(table.num_columns)]
    lengths = columns[lists[0]].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    own = np.repeat(columns[owner].to_numpy(zero_copy_only=False), lengths)
    return own, [columns[i].flatten().to_numpy(zero_copy_only=False) for i in lists]


def _list_batch(owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, fresh: np.ndarray) -> pa.RecordBatch:
    keys, starts = np.unique(owner, return_index=True)
    ends = pa.array(np.append(starts, len(owner)), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(keys), pa.ListArray.from_arrays(ends, pa.array(ids)),
         pa.ListArray.from_arrays(ends, pa.array(scores.astype(np.float32))),
         pa.ListArray.from_arrays(ends, pa.array(fresh))], ["node", "ids", "scores", "fresh"])


def merged(lists: DataFrame, keep: int) -> DataFrame:
    """One list for each node: the best ``keep`` of all its lists; fresh are entries that are so in all of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            owner, (ids, scores, fresh) = _flat(table, 0, [1, 2, 3])
            owner, ids, scores, (known,) = _best(owner, ids, scores, keep, ~fresh.astype(bool))
            if len(owner):
                yield _list_batch(owner, ids, scores, ~known)

    return _by_key(lists, "node", run, _LIST)


def starting_lists(vectors: DataFrame, count: int, graph: Graph, seed: int = 5) -> DataFrame:
    """Lists from brute force inside blocks of about ``block`` nodes, dealt by random hyperplanes.

    A block that comes out too large (many vectors in one direction) is
    split by a hash of the node, so no task ever holds more than a few
    thousand vectors.  The lists leave room for the random links.
    """
    keep = max(1, graph.degree - graph.links)
    bits = max(0, int(np.ceil(np.log2(max(count, 1) / graph.block))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _codes(batch.column(1))
            for t in range(graph.deals):
                planes = np.random.default_rng((seed, t)).normal(size=(x.shape[1], bits)).astype(np.float32)
                side = ((x @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64))) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(side * graph.deals + t), *batch.columns], ["block", "node", "code", "scale"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            blocks = table.column("cell").to_numpy()
            ends = [*np.flatnonzero(np.diff(blocks)) + 1, len(blocks)]
            start = 0
            for end in ends:
                part = table.slice(start, end - start).combine_chunks()
                start = end
                nodes = part.column("node").to_numpy()
                if len(nodes) < 2:
                    continue
                scores = _products(_codes(part.column("code").combine_chunks()),
                                   part.column("scale").to_numpy())
                np.fill_diagonal(scores, -np.inf)
                k = min(keep, len(nodes) - 1)
                best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                lists = np.take_along_axis(scores, best, axis=1)
                offsets = pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes), pa.ListArray.from_arrays(offsets, pa.array(nodes[best].ravel())),
                     pa.ListArray.from_arrays(offsets, pa.array(lists.ravel().astype(np.float32))),
                     pa.ListArray.from_arrays(offsets, pa.array(np.ones(lists.size, dtype=bool)))],
                    ["node", "ids", "scores", "fresh"])

    dealt = vectors.mapInArrow(deal, f"block long, {_VECTOR}")
    sizes = dealt.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / F.lit(2 * graph.block)).alias("parts"))
    cells = (dealt.join(sizes, "block")
             .withColumn("cell", F.xxhash64("block", F.pmod(F.xxhash64("node", "block"), F.col("parts"))))
             .select("cell", "node", "code", "scale"))
    return merged(_by_key(cells, "cell", search, _LIST), keep)


def random_links(vectors: DataFrame, count: int, graph: Graph) -> DataFrame:
    """Lists of up to ``links`` nodes: in each of as many deals by hash, the node that follows in the cell."""
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            table = table.combine_chunks()
            cell, nodes, scale = (table.column(name).to_numpy() for name in ("cell", "node", "scale"))
            begins = np.flatnonzero(np.append(True, np.diff(cell) != 0))
            follower = np.arange(1, len(cell) + 1)
            follower[np.append(begins[1:], len(cell)) - 1] = begins
            code = _codes(table.column("code").combine_chunks())
            score = np.einsum("ij,ij->i", code, code[follower]) * scale * scale[follower]
            at = np.flatnonzero(follower != np.arange(len(cell)))
            at = at[np.argsort(nodes[at], kind="stable")]
            if len(at):
                owner, ids, scores, _ = _best(nodes[at], nodes[follower[at]], score[at], graph.links)
                yield _list_batch(owner, ids, scores, np.ones(len(owner), dtype=bool))

    cells = max(1, -(-count // graph.block))
    dealt = vectors.withColumn("deal", F.explode(F.sequence(F.lit(1), F.lit(graph.links)))).withColumn(
        "order", F.xxhash64("node", "deal"))
    rows = dealt.select((F.pmod("order", F.lit(cells)) * graph.links + F.col("deal")).alias("cell"), "order", "node", "code", "scale")
    found = rows.repartition(F.col("cell")).sortWithinPartitions("cell", "order").mapInArrow(link, _LIST)
    return merged(found, graph.links)


def neighbourhoods(lists: DataFrame, graph: Graph, fresh_only: bool = False) -> DataFrame:
    """(node, other, fresh): each node's neighbours in both directions, once each.

    Of the nodes that list a node, the ``degree`` nearest count, so a node
    that very many list has no larger neighbourhood than others.  With
    ``fresh_only`` the neighbourhoods without a fresh entry are left out.
    """
    edges = lists.select("node", F.explode(F.arrays_zip("ids", "scores", "fresh")).alias("e")).select(
        "node", F.col("e.ids").alias("other"), F.col("e.scores").alias("score"), F.col("e.fresh").alias("fresh"))
    rank = F.row_number().over(W.partitionBy("node").orderBy(F.desc("score"), "other"))
    back = (edges.select(F.col("other").alias("node"), F.col("node").alias("other"), "score", "fresh")
            .withColumn("rank", rank).where(F.col("rank") <= graph.degree))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            if not table.num_rows:
                continue
            node, other, fresh = (c.to_numpy() for c in table.columns)
            order = np.lexsort((other, node))
            node, other, fresh = node[order], other[order], fresh[order].astype(bool)
            first = np.flatnonzero(np.append(True, (np.diff(node) != 0) | (np.diff(other) != 0)))
            node, other, fresh = node[first], other[first], np.logical_or.reduceat(fresh, first)
            if fresh_only:
                begins = np.flatnonzero(np.append(True, np.diff(node) != 0))
                some = np.repeat(np.logical_or.reduceat(fresh, begins), np.diff(np.append(begins, len(node))))
                node, other, fresh = node[some], other[some], fresh[some]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(other), pa.array(fresh)], ["node", "other", "fresh"])

    columns = ["node", "other", "fresh"]
    return _by_key(edges.select(columns).union(back.select(columns)), "node", once, "node long, other long, fresh boolean")


def _groups(keys: np.ndarray) -> list[tuple[int, int]]:
    ends = [*(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)] if len(keys) else []
    return list(zip([0, *ends], ends))


def around(lists: DataFrame, vectors: DataFrame, graph: Graph) -> DataFrame:
    """(node, ids, codes, scales): each node's neighbourhood, its members' values as bytes, one after the other."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            if not table.num_rows:
                continue
            table = table.combine_chunks()
            node, other, scale = (table.column(name).to_numpy() for name in ("node", "other", "scale"))
            code = _bytes(table.column("code").combine_chunks()).reshape(len(node), -1)
            groups = _groups(node)
            packed = [pa.array([x[a:b].tobytes() for a, b in groups], pa.binary()) for x in (other, code, scale)]
            yield pa.RecordBatch.from_arrays([pa.array(node[[a for a, _ in groups]]), *packed],
                                             ["node", "ids", "codes", "scales"])

    members = (neighbourhoods(lists, graph).select("node", "other").join(vectors.withColumnRenamed("node", "other"), "other")
               .select("node", "other", "code", "scale"))
    return _by_key(members, "node", pack, "node long, ids binary, codes binary, scales binary")


def descended(lists: DataFrame, vectors: DataFrame, graph: Graph) -> DataFrame:
    """Lists after one round: every neighbourhood proposes its members to each other."""
    def proposed(found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        owner, other, value = (np.concatenate(x) for x in zip(*found))
        owner, other, value, _ = _best(owner, other, value, graph.degree)
        if len(owner):
            yield _list_batch(owner, other, value, np.ones(len(owner), dtype=bool))

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for table in whole_groups(batches):
            if not table.num_rows:
                continue
            table = table.combine_chunks()
            node, ids, scales, worst, fresh = (
                table.column(name).to_numpy() for name in ("node", "other", "scale", "worst", "fresh"))
            codes, fresh = _codes(table.column("code").combine_chunks()), fresh.astype(bool)
            for a, b in _groups(node):
                if b - a < 2:
                    continue
                scores = _products(codes[a:b], scales[a:b])
                np.fill_diagonal(scores, -np.inf)
                # members that are both known here met in an earlier round
                better = (scores > worst[a:b, None]) & (fresh[a:b, None] | fresh[None, a:b])
                row, column = np.nonzero(better)
                found.append((ids[a:b][row], ids[a:b][column], scores[row, column]))
                held += len(row)
                if held > PROPOSED:
                    yield from proposed(found)
                    found, held = [], 0
        if found:
            yield from proposed(found)

    worst = lists.select(F.col("node").alias("other"), F.when(
        F.size("scores") >= graph.degree, F.array_min("scores")).otherwise(F.lit(float("-inf"))).cast("float").alias("worst"))
    own = vectors.withColumnRenamed("node", "other").join(worst, "other")
    members = neighbourhoods(lists, graph, fresh_only=True).join(own, "other").select(
        "node", "other", "code", "scale", "worst", "fresh")
    proposals = _by_key(members, "node", propose, _LIST)
    known = lists.withColumn("fresh", F.transform("fresh", lambda _: F.lit(False)))
    return merged(known.union(proposals), graph.degree)


def build(vectors: DataFrame, links: DataFrame, count: int, graph: Graph = Graph()) -> DataFrame:
    """The neighbour lists (node, ids, scores) of all vectors, as a written table."""
    lists = written(merged(starting_lists(vectors, count, graph).union(links), graph.degree), "ann-lists")
    while True:  # lists only ever improve, so this ends
        lists = written(descended(lists, vectors, graph), "ann-lists")
        changed = lists.agg(F.sum(F.size(F.filter("fresh", lambda x: x))) / F.sum(F.size("ids"))).first()[0]
        if not changed or changed < graph.settled:
            return lists


_STATE = "query long, code binary, scale float, ids array<long>, scores array<float>, seen array<boolean>, next array<long>"


def search(queries: DataFrame, entries: DataFrame, around: DataFrame, beam: int, visits_a_hop: int) -> DataFrame:
    """(query, ids, scores): the ``beam`` best nodes of every query after greedy search.

    ``queries`` has (query, code, scale), ``entries`` (query, node) the nodes
    to start from, ``around`` the packed neighbourhoods.
    """
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries at a neighbourhood: score its members, report those that may enter the beam."""
        for batch in batches:
            if not batch.num_rows:
                continue
            own = _codes(batch.column(1))
            own_scale, least = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            sizes = pc.binary_length(batch.column(4)).to_numpy(zero_copy_only=False) // 8
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            ids, scales = _bytes(batch.column(4)).view(np.int64), _bytes(batch.column(6)).view(np.float32)
            codes = _bytes(batch.column(5)).reshape(len(ids), -1)
            out_ids, out_scores, lengths = [], [], []
            for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
                value = (codes[a:b].astype(np.float32) @ own[i]) * own_scale[i] * scales[a:b]
                good = value > least[i]
                out_ids.append(ids[a:b][good])
                out_scores.append(value[good])
                lengths.append(int(good.sum()))
            ends = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(out_ids))),
                 pa.ListArray.from_arrays(ends, pa.array(np.concatenate(out_scores).astype(np.float32)))],
                ["query", "ids", "scores"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The beam of each query from its last one and the reports, and the nodes it visits next: the best not yet seen."""
        for table in whole_groups(batches):
            table = table.combine_chunks()
            owner, (ids, scores, seen) = _flat(table, 0, [3, 4, 5])
            owner, ids, scores, (seen,) = _best(owner, ids, scores, beam, seen.astype(bool))
            keys = table.column("query").to_numpy()
            has = np.asarray(table.column("code").is_valid())
            mine = dict(zip(keys[has].tolist(), np.flatnonzero(has).tolist()))
            found, starts = np.unique(owner, return_index=True)
            new = np.cumsum(~seen)
            new -= np.repeat(new[starts] - ~seen[starts], np.diff(np.append(starts, len(owner))))
            coming = ~seen & (new <= visits_a_hop)
            next_ends = pa.array(np.append(0, np.cumsum(coming))[np.append(starts, len(owner))], pa.int32())
            at = pa.array([mine[k] for k in found.tolist()], pa.int64())
            ends = pa.array(np.append(starts, len(owner)), pa.int32())
            take = lambda name: table.column(name).take(at).combine_chunks()
            if len(found):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found), take("code"), take("scale"), pa.ListArray.from_arrays(ends, pa.array(ids)),
                     pa.ListArray.from_arrays(ends, pa.array(scores)), pa.ListArray.from_arrays(ends, pa.array(seen | coming)),
                     pa.ListArray.from_arrays(next_ends, pa.array(ids[coming]))],
                    ["query", "code", "scale", "ids", "scores", "seen", "next"])

    least = F.when(F.size("scores") >= beam, F.array_min("scores")).otherwise(F.lit(float("-inf"))).cast("float")
    state = None
    while True:  # a node that left a beam never returns, so this ends
        if state is None:  # the entry nodes are visited; no beam yet
            visits = queries.join(entries, "query").select("query", "code", "scale",
                                                            F.lit(float("-inf")).cast("float").alias("least"), "node")
            last = queries.select("query", "code", "scale", F.lit(None).cast("array<long>").alias("ids"),
                                  F.lit(None).cast("array<float>").alias("scores"),
                                  F.lit(None).cast("array<boolean>").alias("seen"))
        else:
            visits = state.select("query", "code", "scale", least.alias("least"), F.explode("next").alias("node"))
            last = state.drop("next")
        reports = visits.join(around, "node").select("query", "code", "scale", "least", "ids", "codes", "scales").mapInArrow(
            step, "query long, ids array<long>, scores array<float>")
        reports = reports.select("query", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("float").alias("scale"),
                                 "ids", "scores", F.transform("ids", lambda _: F.lit(False)).alias("seen"))
        state = written(_by_key(last.union(reports), "query", gather, _STATE), "ann-beams")
        if not state.where(F.size("next") > 0).limit(1).count():
            return state.select("query", "ids", "scores")


def inner_product(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision, first component first."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def nearest(table: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding",
            answers: int = 20, graph: Graph = Graph()) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest other rows of every query row.

    ``is_query`` is a condition on ``vec_id``.  Nearest first, ties to the
    smaller id; fewer rows if there are fewer candidates.  Invalid vectors
    (see ``valid_vectors``) take no part on either side.  Copies of a vector
    are one node of the graph and are all candidates: the ``answers + 1``
    smallest ids of a node are enough, as one may be the query.  Rows that
    share an id count once for each of their vectors.  Other columns are not
    read.  An empty table gives an empty result.
    """
    rows = written(valid_vectors(table, id_col, vector_col), "ann-rows")
    nodes = written(nodes_of(rows), "ann-nodes")
    vectors = written(coded(nodes), "ann-codes")
    count = vectors.count()
    links = written(random_links(vectors, count, graph), "ann-links")
    near = written(around(build(vectors, links, count, graph), vectors, graph), "ann-around")

    asked = written(rows.where(is_query).select("vec_id", "vector").distinct()
                    .join(nodes, "vector").select("vec_id", "node", "vector"), "ann-queries")
    start = asked.select("node").distinct()  # equal queries search once
    entries = start.select(F.col("node").alias("query"), "node").union(
        links.join(start, "node").select("node", F.explode("ids")))
    beams = search(vectors.withColumnRenamed("node", "query").join(start.withColumnRenamed("node", "query"), "query"),
                   entries, near, graph.beam * max(1, count).bit_length(), graph.visits)

    member = F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))
    members = (rows.select("vec_id", "vector").distinct().withColumn("n", member).where(F.col("n") <= answers + 1)
               .join(nodes, "vector").select(F.col("node").alias("found"), "vec_id", "vector"))
    found = (beams.select(F.col("query").alias("node"), F.explode(F.slice("ids", 1, max(graph.rescored, answers))).alias("found"))
             .union(start.select("node", F.col("node").alias("found"))).distinct())
    scored = (asked.select(F.col("vec_id").alias("query_id"), "node", F.col("vector").alias("own")).join(found, "node")
              .join(members, "found").where("vec_id <> query_id")
              .select("query_id", "vec_id", inner_product(F.col("own"), F.col("vector")).alias("score")))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (scored.withColumn("rank", rank).where(F.col("rank") <= answers)
            .select("query_id", "rank", "vec_id", "score"))
