"""Vector compression: parts of vectors become indexes into learned codebooks.

The codebooks are refined by the exact nearest-entry rule, without looking at
every part.  Each slice of vectors gets, for each part position, a metric
tree by the anchors hierarchy: some anchors share out the points, each new
one taking what is nearer to it from the others; the anchors' balls are then
merged upwards, the pair with the smallest common ball first, and split
further downwards in the same way while they hold many points.  A ball keeps
its sum, count, centre and radius.

An assignment walks the balls from the top with lists of candidate entries:
a ball inherits its parent's list and drops each entry that is farther than
another one for every place in the ball.  A ball with one entry left is
wholly owned: its sum and count go to the entry, or its points get the code,
without a look at the points.  What is left at the leaves is settled point by
point in whole numbers, so results equal a full search.

The trees are a written table with one row a slice.  A round reads it once
and sends one row per part and entry from each task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from microstar.llm.common import written

#: Vectors of a slice, and points of a ball that is not split further.
SLICE, LEAF = 4096, 64


# ------------------------------------------------------------- trees ----

class Tree(NamedTuple):
    """Balls over the points of one part position, parents before children.

    ``order`` lists the points so that each ball holds the run
    ``first:first + count``; ``parent`` is -1 for the top.
    """

    order: np.ndarray
    parent: np.ndarray
    depth: np.ndarray
    first: np.ndarray
    count: np.ndarray
    leaf: np.ndarray
    sums: np.ndarray
    radius: np.ndarray


def _anchors(points: np.ndarray, n: int) -> list[np.ndarray]:
    """Share points out among up to ``n`` anchors; each list of indexes belongs to one anchor.

    The next anchor is the point farthest from its own.  Points within half
    the distance of the two anchors from theirs cannot change hands, so only
    the others are measured.
    """
    places = [0]
    owner = np.zeros(len(points), dtype=np.int64)
    far = np.sqrt(((points - points[0]) ** 2).sum(1))
    while len(places) < n:
        new = int(far.argmax())
        if far[new] == 0:
            break
        apart = np.sqrt(((points[places] - points[new]) ** 2).sum(1))
        open_ = np.flatnonzero(far >= apart[owner] * 0.499)
        distance = np.sqrt(((points[open_] - points[new]) ** 2).sum(1))
        taken = distance < far[open_]
        owner[open_[taken]] = len(places)
        far[open_[taken]] = distance[taken]
        places.append(new)
    order = np.argsort(owner, kind="stable")
    return np.split(order, np.cumsum(np.bincount(owner, minlength=len(places)))[:-1])


class _Ball:
    __slots__ = ("at", "centre", "radius", "children")

    def __init__(self, points: np.ndarray, at: np.ndarray, children: tuple = ()):
        self.at, self.children = at, children
        held = points[at]
        self.centre = held.mean(0)
        self.radius = float(np.sqrt(((held - self.centre) ** 2).sum(1).max()))


def _middle_out(points: np.ndarray, at: np.ndarray) -> _Ball:
    """The ball of these points with all balls under it."""
    whole = _Ball(points, at)
    if len(at) <= LEAF or whole.radius == 0:
        return whole
    shares = _anchors(points[at], math.ceil(math.sqrt(len(at))))
    if len(shares) < 2:
        return whole
    balls = [_middle_out(points, at[s]) for s in shares]
    # merge upwards: always the two balls with the smallest common ball
    centres = np.array([b.centre for b in balls])
    radii = np.array([b.radius for b in balls])
    common = _common(centres[:, None], centres[None], radii[:, None], radii[None])
    np.fill_diagonal(common, np.inf)
    live = len(balls)
    while live > 2:
        i, j = divmod(int(common.argmin()), len(balls))
        merged = _Ball(points, np.concatenate([balls[i].at, balls[j].at]), (balls[i], balls[j]))
        balls[i], centres[i], radii[i] = merged, merged.centre, merged.radius
        gone = ~np.isfinite(common[i])
        row = _common(centres, centres[i], radii, radii[i])
        row[gone] = np.inf
        row[[i, j]] = np.inf
        common[i], common[:, i] = row, row
        common[j], common[:, j] = np.inf, np.inf
        balls[j], live = None, live - 1
    left = tuple(b for b in balls if b is not None)
    whole.children = left
    whole.at = np.concatenate([b.at for b in left])
    return whole


def _common(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray) -> np.ndarray:
    """Radius of the smallest ball around two balls."""
    apart = np.sqrt(((a - b) ** 2).sum(-1))
    return np.maximum(np.maximum(ra, rb), (apart + ra + rb) / 2)


def tree(points: np.ndarray) -> Tree:
    """The metric tree of whole-number points (rows), one at least."""
    top = _middle_out(points.astype(np.float64), np.arange(len(points)))
    order: list[np.ndarray] = []
    rows: list[tuple] = []
    held = 0
    todo = [(top, -1, 0)]
    sums = []
    while todo:  # depth first, so that a ball's points are one run
        ball, parent, depth = todo.pop()
        me = len(rows)
        rows.append((parent, depth, held, len(ball.at), not ball.children, ball.radius))
        sums.append(points[ball.at].sum(0))
        if ball.children:
            todo += [(child, me, depth + 1) for child in ball.children]
        else:
            order.append(ball.at)
            held += len(ball.at)
    parent, depth, first, count, leaf, radius = map(np.array, zip(*rows))
    return Tree(np.concatenate(order), parent, depth, first, count, leaf, np.array(sums, dtype=np.int64), radius)


# ------------------------------------------------------- assignment ----

def candidates(balls: Tree, entries: np.ndarray) -> np.ndarray:
    """For each ball (row) the entries that may own some place in it.

    An entry goes if the whole ball lies on the other side of the plane
    between it and the entry nearest to the centre, by more than what
    rounding can amount to.  Of equal entries only the first may own.
    """
    far = entries.astype(np.float64)
    _, first = np.unique(entries, axis=0, return_index=True)
    allowed = np.zeros(len(balls.parent) + 1, dtype=bool)[:, None].repeat(len(entries), 1)
    allowed[-1, first] = True  # the list that the top inherits (its parent is -1)
    centres = balls.sums / balls.count[:, None]
    between = np.sqrt(((far[:, None] - far[None]) ** 2).sum(-1))
    for level in range(int(balls.depth.max()) + 1):
        at = np.flatnonzero(balls.depth == level)
        mine = allowed[balls.parent[at]]
        square = ((centres[at][:, None] - far[None]) ** 2).sum(-1)
        masked = np.where(mine, square, np.inf)
        best = masked.argmin(1)
        least = masked[np.arange(len(at)), best]
        reach = balls.radius[at][:, None] * (1 + 1e-9)
        slack = 1e-9 * (square + least[:, None]) + 1e-9
        beyond = square - least[:, None] - slack > 2 * between[best] * reach
        allowed[at] = mine & ~beyond
    return allowed[:-1]


def _settle(points: np.ndarray, owners: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The nearest entry of each point among its candidates (rows of ``owners``), ties to the lower index."""
    out = np.empty(len(points), dtype=np.int64)
    step = max(1, (1 << 22) // max(1, entries.size))
    for a in range(0, len(points), step):
        row, entry = np.nonzero(owners[a:a + step])
        square = ((points[a:a + step][row] - entries[entry]) ** 2).sum(1)
        starts = np.searchsorted(row, np.arange(len(points[a:a + step])))
        least = np.minimum.reduceat(square, starts)
        hit = np.where(square == least[row], entry, len(entries))
        out[a:a + step] = np.minimum.reduceat(hit, starts)
    return out


def owned(balls: Tree, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sum per entry, count per entry, code per point) of one part position.

    ``points`` are in tree order.  The highest balls with one candidate left
    give their cached sum and count; the points of other leaves are settled
    one by one.
    """
    allowed = candidates(balls, entries)
    single = allowed.sum(1) == 1
    above = np.append(single, False)[balls.parent]
    for level in range(1, int(balls.depth.max()) + 1):  # a ball under a wholly owned one is not visited
        at = np.flatnonzero(balls.depth == level)
        above[at] |= np.append(above, False)[balls.parent[at]]
    sums, counts = np.zeros_like(entries), np.zeros(len(entries), dtype=np.int64)
    codes = np.zeros(len(points), dtype=np.int64)
    whole = np.flatnonzero(single & ~above)
    entry = allowed[whole].argmax(1)
    np.add.at(sums, entry, balls.sums[whole])
    np.add.at(counts, entry, balls.count[whole])
    edge = np.zeros(len(points) + 1, dtype=np.int64)
    for ball, e in zip(whole, entry):
        codes[balls.first[ball]:balls.first[ball] + balls.count[ball]] = e
    rest = np.flatnonzero(balls.leaf & ~single & ~above)
    if len(rest):
        edge[balls.first[rest]] += 1
        edge[balls.first[rest] + balls.count[rest]] -= 1
        at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        leaf = np.repeat(rest, balls.count[rest])[np.argsort(np.repeat(balls.first[rest], balls.count[rest]), kind="stable")]
        codes[at] = _settle(points[at], allowed[leaf], entries)
        np.add.at(sums, codes[at], points[at])
        np.add.at(counts, codes[at], 1)
    return sums, counts, codes


# ------------------------------------------------------------- Spark ----

def _usable(vector: Column) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & whole


def _quantized(rows: list, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of vectors as whole numbers, padded with zeros to ``width``; see ``compress`` for very large ones."""
    out = np.zeros((len(rows), width), dtype=np.int64)
    if rows:
        dims = len(rows[0])
        limit = math.isqrt((1 << 62) // max(1, width)) // 2
        out[:, :dims] = np.clip(np.floor(np.array(rows, dtype=np.float64).reshape(len(rows), dims) * scale), -limit, limit)
    return out


_FOREST = [("n", pa.int64()), ("points", pa.list_(pa.int64())), ("vectors", pa.list_(pa.int32())),
           *((c, pa.list_(pa.int32())) for c in ("balls", "parent", "depth", "first", "count")),
           ("leaf", pa.list_(pa.bool_())), ("sums", pa.list_(pa.int64())), ("radius", pa.list_(pa.float64()))]


def forest(vectors: DataFrame, parts: int, width: int, scale: int) -> DataFrame:
    """One row per slice of (vec_id, vector, label): the ids, the labels and all parts' trees, flat."""
    id_type, label_type = (vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    each = width // parts
    schema = (f"ids array<{id_type}>, labels array<{label_type}>, n long, points array<long>, vectors array<int>, balls array<int>, "
              "parent array<int>, depth array<int>, first array<int>, count array<int>, leaf array<boolean>, sums array<long>, radius array<double>")

    def planted(slices: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(slices).combine_chunks()
        whole = _quantized(batch.column(1).to_pylist(), width, scale)
        trees = [tree(whole[:, p * each:(p + 1) * each]) for p in range(parts)]
        points = np.concatenate([whole[t.order, p * each:(p + 1) * each].ravel() for p, t in enumerate(trees)])
        flat = {c: np.concatenate([getattr(t, c).ravel() for t in trees]) for c in ("parent", "depth", "first", "count", "leaf", "sums", "radius")}
        flat |= {"n": len(whole), "points": points, "vectors": np.concatenate([t.order for t in trees]), "balls": np.array([len(t.parent) for t in trees])}
        own = [batch.column(0).to_pylist()], [batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [pa.array(own[0], pa.list_(batch.schema.field(0).type)), pa.array(own[1], pa.list_(batch.schema.field(2).type)),
             *(pa.array([flat[c] if c == "n" else flat[c].tolist()], t) for c, t in _FOREST)],
            ["ids", "labels", *(c for c, _ in _FOREST)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                room = SLICE - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == SLICE:
                    yield planted(held)
                    held = []
        if sum(b.num_rows for b in held):
            yield planted(held)

    return vectors.select("vec_id", "vector", "label").mapInArrow(run, schema)


def _trees(row: dict, parts: int, each: int) -> Iterator[tuple[Tree, np.ndarray]]:
    """The trees of a forest row, part by part, with their points."""
    n, at = row["n"], 0
    points = row["points"].reshape(parts, n, each)
    order = row["vectors"].reshape(parts, n)
    sums = row["sums"].reshape(-1, each)
    for p, size in enumerate(row["balls"]):
        run = slice(at, at + size)
        yield Tree(order[p], *(row[c][run] for c in ("parent", "depth", "first", "count", "leaf")), sums[run], row["radius"][run]), points[p]
        at += size


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        row = {}
        for name, _ in _FOREST:
            value = batch.column(batch.schema.get_field_index(name))[i]
            row[name] = value.as_py() if name == "n" else value.values.to_numpy(zero_copy_only=False)
        yield row


def _refined(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every part to its nearest entry, every used entry to the floor of its parts' mean."""
    parts, k, each = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, k, each), dtype=object), np.zeros((parts, k), dtype=np.int64)
        for batch in batches:
            for row in _rows(batch):
                for p, (balls, points) in enumerate(_trees(row, parts, each)):
                    s, c, _ = owned(balls, points, books[p])
                    sums[p] += s  # Python integers: a task's sums do not overflow
                    counts[p] += c
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry], pa.int64()),
             pa.array([[str(x) for x in sums[p, e]] for p, e in zip(part, entry)], pa.list_(pa.string()))], ["part", "entry", "n", "sums"])

    own = [c for c, _ in _FOREST]
    partial = trees.select(*own).mapInArrow(run, "part int, entry int, n long, sums array<string>")
    totals = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(each)]
    new = books.copy()
    for row in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect():  # parts x entries rows at most
        new[row["part"], row["entry"]] = [int(row[f"s{i}"]) // row["n"] for i in range(each)]
    return new


def _coded(trees: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every vector."""
    parts, _, each = books.shape
    types = {f.name: f.dataType.elementType.simpleString() for f in trees.schema.fields if f.name in ("ids", "labels")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(_rows(batch)):
                codes = np.zeros((row["n"], parts), dtype=np.uint8)
                error = np.zeros(row["n"], dtype=np.int64)
                for p, (balls, points) in enumerate(_trees(row, parts, each)):
                    code = owned(balls, points, books[p])[2]
                    codes[balls.order, p] = code
                    error[balls.order] += ((points - books[p][code]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index("ids"))[i].values, batch.column(batch.schema.get_field_index("labels"))[i].values,
                     pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return trees.mapInArrow(run, f"vec_id {types['ids']}, label {types['labels']}, code string, error long")


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256,
             vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Per vector: ``vec_id, label, code, error, label_error, codebooks_sha256``.

    Vectors that are null or hold null or non-finite components are left out.
    Components become floor(scale * x); the codebooks start as the parts of
    the vectors with the smallest ids (a null id comes last, equal ids go by
    their vectors) and are refined ``rounds`` times.  ``entries`` is 256 at
    most; with fewer vectors than that there are as many entries as vectors.
    Repeated rows are coded each on their own.  Vectors of another length
    than that with the smallest id have no code: ``code`` and ``error`` are
    null.  A length that ``parts`` does not divide is padded with zeros.
    Components so large that squared distances would leave 64 bits are taken
    as the largest that do not (above half a million for 64 dimensions).
    ``label_error`` is null if the sum leaves 64 bits.  An empty table gives
    an empty result.  Other columns are not read.
    """
    kept = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"), F.col(label).alias("label")).where(_usable(F.col("vector")))
    order = [F.col("vec_id").asc_nulls_last(), "vector"]
    first = kept.orderBy(*order).limit(1).collect()
    if not first:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                           F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    dims = len(first[0]["vector"])
    width = max(1, math.ceil(dims / parts)) * parts
    same = kept.where(F.size("vector") == dims)
    start = _quantized([r[0] for r in same.orderBy(*order).select("vector", "vec_id").limit(entries).collect()], width, scale)
    books = np.ascontiguousarray(start.reshape(len(start), parts, -1).transpose(1, 0, 2))
    trees = written(forest(same, parts, width, scale), "ball-trees")
    for _ in range(rounds):
        books = _refined(trees, books)
    text = ",".join(map(str, books[:, :, :].ravel().tolist()))
    coded = _coded(trees, books)
    other = kept.where(F.size("vector") != dims).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = written(coded.union(other), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")
    by_label = coded.groupBy(F.col("label").alias("its_label")).agg(total)
    return (coded.join(by_label, F.col("label").eqNullSafe(F.col("its_label")), "left").drop("its_label")
            .withColumn("codebooks_sha256", F.lit(hashlib.sha256(text.encode()).hexdigest())))


#: Every part against every entry; two rounds written out.
def _oracle() -> str:
    steps = ["""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
           FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT r, vec_id, label, part, list_slice(q, 4 * part + 1, 4 * part + 4) AS c FROM v, range(16) AS t(part)),
b0 AS (SELECT part, k, c FROM (SELECT part, c, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS k FROM p) WHERE k < 64)"""]
    square = " + ".join(f"(p.c[{i}] - b.c[{i}]) * (p.c[{i}] - b.c[{i}])" for i in range(1, 5))
    for n in range(3):
        steps.append(f"""
a{n} AS (SELECT r, vec_id, label, p.part, p.c, min({{'d': {square}, 'k': b.k}}) AS own
         FROM p JOIN b{n} AS b ON p.part = b.part GROUP BY ALL)""")
        if n < 2:
            mean = ", ".join(f"CAST(floor(sum(c[{i}]) / count(*)) AS BIGINT)" for i in range(1, 5))
            steps.append(f"""
m{n} AS (SELECT part, own.k AS k, [{mean}] AS c FROM a{n} GROUP BY ALL),
b{n + 1} AS (SELECT part, k, coalesce(m.c, b.c) AS c FROM b{n} AS b LEFT JOIN m{n} AS m USING (part, k))""")
    steps.append("""
code AS (SELECT r, vec_id, label, string_agg(printf('%02x', own.k), '' ORDER BY part) AS code, CAST(sum(own.d) AS BIGINT) AS error FROM a2 GROUP BY ALL),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, k)) AS codebooks_sha256 FROM b2)""")
    return ",".join(steps) + """
SELECT vec_id, label, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM code, digest
"""


ORACLE = _oracle()
