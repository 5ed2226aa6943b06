"""Schema enforcement (K4), primary-key check (K5), identity key (K6)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from microstar.session import checkpoint_root

REJECT_COL = "_reject_reason"


@dataclass(frozen=True)
class FieldSpec:
    """A typed column: Spark SQL type name, max characters, nullability."""
    name: str
    type: str = "string"
    max_len: int | None = None
    nullable: bool = True


def _checks(src: Column, f: FieldSpec) -> list[tuple[Column, str]]:
    out = []
    if not f.nullable:
        out.append((src.isNull(), f"{f.name}: null"))
    if f.type != "string":
        out.append((src.isNotNull() & src.try_cast(f.type).isNull(), f"{f.name}: not {f.type}"))
    if f.max_len is not None:
        out.append((F.char_length(src) > f.max_len, f"{f.name}: longer than {f.max_len}"))
    return out


def enforce_schema(df: DataFrame, spec: list[FieldSpec], checks: list | None = None) -> DataFrame:
    """Type and check ``df`` against ``spec`` (K4).

    Returns the spec's columns cast with ``try_cast`` plus ``_reject_reason``:
    null for a good row, otherwise the first failed check in spec order
    (``name: null`` / ``name: not int`` / ``name: longer than n``).  Casting
    never raises, so one bad row cannot fail a load; rejects are kept, not
    dropped.  ``checks`` are extra (condition, reason) pairs tested before the
    field checks (row-level rules such as a malformed line).

    The reason is made once, in a projection (compiled, unlike what a
    generator evaluates), and passes through an ``inline`` of its own: filters
    on it stay above.  Pushed below, they would repeat every check, and the
    optimizer would carry them as constraints through each rename, doubling
    their number at each.  The columns go past it, so those that nobody reads
    are not made.
    """
    conds = list(checks or [])
    cols = []
    for f in spec:
        src = F.col(f.name)
        conds += _checks(src, f)
        cols.append(src if f.type == "string" else src.try_cast(f.type).alias(f.name))
    made = df.withColumn("_checked", first_reason(conds))
    barrier = F.inline(F.array(F.struct(F.col("_checked").alias(REJECT_COL))))
    return made.select(*[F.col(f.name) for f in spec], barrier).select(*cols, REJECT_COL)


def first_reason(conds: list[tuple[Column, str]]) -> Column:
    """The text of the first condition that holds, else null.

    The conditions are one array of places and the first is its minimum, so
    "no reason" is one predicate and not a conjunct for each check.
    """
    if not conds:
        return F.lit(None).cast("string")
    places = F.array(*[F.when(cond, F.lit(i)) for i, (cond, _) in enumerate(conds)])
    return F.get(F.array(*[F.lit(text) for _, text in conds]), F.array_min(places))


def split_rejects(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows without the reason column, rejected rows with it)."""
    good = checked.where(F.col(REJECT_COL).isNull()).drop(REJECT_COL)
    bad = checked.where(F.col(REJECT_COL).isNotNull())
    return good, bad


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values occurring more than once, with their count (K5).

    A grouped count: partial aggregation runs map-side, so even a key that
    holds a third of the rows is pre-counted per task before the shuffle.
    An empty result means the key is unique.
    """
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
              .where(F.col("n_rows") > 1))


def reject_duplicates(checked: DataFrame, keys: list[str]) -> DataFrame:
    """Enforce a primary key on checked rows (K5).

    Of the good rows that share a key the one whose values have the smallest
    64-bit hash stays (the same one in every run); the others get the reason
    ``<key>: duplicate key``.  Of fully equal rows one stays.  It is found by
    a partial aggregate over keys and hashes, and only keys that repeat are
    joined back, so a key that holds a third of the rows is never gathered
    in one task.
    """
    label = f"{', '.join(keys)}: duplicate key"
    good = F.col(REJECT_COL).isNull()
    rows = checked.withColumn("_row", F.monotonically_increasing_id())
    values = [c for c in checked.columns if c != REJECT_COL]
    first = (rows.where(good).select(*keys, F.struct(F.xxhash64(*values), "_row").alias("_place")).groupBy(*keys)
             .agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
             .where("_n > 1").select(*keys, F.col("_first._row").alias("_keep")))
    marked = rows.join(first, keys, "left")
    late = good & F.col("_keep").isNotNull() & (F.col("_row") != F.col("_keep"))
    return marked.select(*values, F.when(late, F.lit(label)).otherwise(F.col(REJECT_COL)).alias(REJECT_COL))


def sort_with_tiebreak(df: DataFrame, order_by: list) -> DataFrame:
    """Global sort on ``order_by`` plus a unique input row id, so that the
    range partitioner can cut inside a run of equal keys (a hot key does not
    land in one task)."""
    return (df.withColumn("_tie", F.monotonically_increasing_id())
              .orderBy(*order_by, "_tie").drop("_tie"))


def surrogate_key(df: DataFrame, order_by: list | None, name: str = "SK", start: int = 1) -> DataFrame:
    """Dense 1, 2, 3 ... key following ``order_by`` (K6, an IDENTITY column).

    Without ``order_by`` the key follows the order in which rows arrive, as
    an IDENTITY column does, and nothing is sorted.

    Distributed: a global sort (range-partitioned, no single-task window),
    ``monotonically_increasing_id`` inside each sorted partition, one small
    count per partition and a running offset over those counts (one row
    per partition, a size bounded by the partition count).  The tagged
    rows are checkpointed to the shared checkpoint folder first so that the
    count pass and the numbering pass see the same rows and ids even if a
    task is re-run.  A unique row id breaks ties in the sort, so even a sort
    key shared by a third of the rows is split across range partitions.
    ``order_by`` should be unique for a deterministic key.
    """
    checkpoint_root(df.sparkSession)
    tagged = (sort_with_tiebreak(df, order_by) if order_by else df).withColumn("_mid", F.monotonically_increasing_id())
    tagged = tagged.checkpoint(eager=True)
    pid = F.shiftrightunsigned(F.col("_mid"), 33)
    counts = tagged.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    out = tagged.join(F.broadcast(offsets), pid == F.col("_pid"), "inner")
    key = F.col("_off") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)) + F.lit(start)
    return out.select(*[F.col(c) for c in df.columns], key.alias(name))
