"""Exam microdata pipeline: raw text -> RAW -> CLEANED -> CURATED star.

Every step is a row-local DataFrame expression, so a yearly edition flows
from its text files to the star tables without a shuffle; the only
shuffles are the answers table's identity key (a global sort) and the
optional primary-key checks.  Years are processed as separate frames (each
edition has its own layout, recodes and label variants) and combined with
``unionByName``; every table is partitioned by ``ANO_ENEM`` so that a rerun
of one year overwrites only that year.

Stage order follows the reference: fold accents -> null defaults -> rename
(CLEANED); state filter -> constants -> recode -> derive -> route/project
(CURATED).  Derivations run after the recode, so every label sees the
standardised code.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from microstar.functions import (any_flag, any_flag_int, attendance_code, attendance_label,
                                 day_attendance, label, recode_map, row_mean, strip_accents, yes_no)
from microstar.functions.labels import NO, YES
from microstar.operators.project import harmonise, null_defaults, select_rename
from microstar.operators.keys import buckets_for, key_filter, maybe_in, stored_keys
from microstar.operators.quality import FieldSpec, REJECT_COL, check_unique, enforce_schema, reject_duplicates, surrogate_key
from microstar.operators.reshape import unpivot_groups
from microstar.operators.route import Target, filter_eq, route, where_computed
from microstar.session import checkpoint_root
from microstar.sources.delimited import DEFAULT_ENCODING, read_delimited
from microstar.sources.publication import GOOD, REJECTED, Publication, Staged
from microstar.spec import labels as L
from microstar.spec import star as S
from microstar.spec.layouts import ACCENT_FOLDED, LAYOUTS, NULL_DEFAULTS, SEPARATOR
from microstar.spec.recodes import recodes_for
from microstar.spec.renames import rename_list

YEARS = (2015, 2016, 2017, 2018, 2019)
DEFAULT_STATE = "RR"


# ---------------------------------------------------------------- RAW ----

OVERFLOW = "_EXTRA_FIELDS"
MALFORMED = "malformed line: more or fewer fields than the layout"


def read_raw(spark: SparkSession, path, year: int, encoding: str = DEFAULT_ENCODING,
             flag_overflow: bool = True) -> DataFrame:
    """The edition's delimited file(s), bound by position to its layout.

    The ``_EXTRA_FIELDS`` column holds lines with more or fewer fields than
    the layout, for ``check_raw``; without ``flag_overflow`` they are read as
    far as they fit."""
    return read_delimited(spark, path, LAYOUTS[year], sep=SEPARATOR[year], encoding=encoding,
                          malformed_column=OVERFLOW if flag_overflow else None)


def check_raw(raw: DataFrame, year: int) -> DataFrame:
    """RAW layer typing (K4): every column a string within its VARCHAR width;
    ``_reject_reason`` names the malformed line, the row of another edition,
    or the first column that is too long.  The sentinel column is not kept."""
    from microstar.spec.widths import raw_width
    checks = [(F.col(OVERFLOW).isNotNull(), MALFORMED)] if OVERFLOW in raw.columns else []
    checks.append((~F.col("NU_ANO").eqNullSafe(str(year)), f"NU_ANO: not {year}"))
    spec = [FieldSpec(c, "string", raw_width(year, c)) for c in raw.columns if c != OVERFLOW]
    return enforce_schema(raw, spec, checks)


def check_cleaned(cleaned: DataFrame, year: int) -> DataFrame:
    """CLEANED layer typing (K4): renamed columns keep their raw width; the
    two '-1' defaults are two characters wide."""
    from microstar.spec.widths import cleaned_widths
    w = cleaned_widths(year)
    return enforce_schema(cleaned, [FieldSpec(c, "string", w[c]) for c in cleaned.columns])


# ------------------------------------------------------------ CLEANED ----

def clean(raw: DataFrame, year: int, fixes: bool = False) -> DataFrame:
    """RAW -> CLEANED: accent-folded name copies (X1), null defaults (P6),
    one simultaneous rename/permute/drop select (P1, P2).  All strings.
    Lines that were read as malformed are left out; ``check_raw`` keeps them
    as rejects."""
    if OVERFLOW in raw.columns:
        raw = raw.where(F.col(OVERFLOW).isNull())
    folded = raw.withColumns({f"{c}_ORG": strip_accents(c) for c in ACCENT_FOLDED if c in raw.columns})
    defaulted = null_defaults(folded, {c: v for c, v in NULL_DEFAULTS.items() if c in folded.columns})
    return select_rename(defaulted, rename_list(year, fixes))


# ------------------------------------------------------------ CURATED ----

@lru_cache(maxsize=1)
def curated_input_columns() -> tuple[str, ...]:
    """Union of the cleaned columns of all editions plus the constant-only
    questions and flags: the harmonised width every edition is brought to."""
    cols: dict[str, None] = {}
    for y in YEARS:
        for _, dst in rename_list(y):
            cols[dst] = None
    for table in S.STAR_COLUMNS.values():
        for c in table:
            src = c if isinstance(c, str) else c[0]
            if src.startswith("Q") or src in S.FLAG_DEFAULTS:
                cols[src] = None
    return tuple(cols)


def _code(c: str) -> Column:
    return F.trim(F.col(c).cast("string"))


def derivations(year: int, fixes: bool = False) -> dict[str, Column]:
    """All derived columns of one edition (X3-X12), as one dict for a single
    projection.  Built once per (edition, fixes): Column expressions are
    immutable and reusable across DataFrames."""
    return dict(_derivations(year, fixes))


@lru_cache(maxsize=16)
def _derivations(year: int, fixes: bool) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for target, source, map_name in L.CODE_LABELS:
        mapping = L.LABELS[map_name]
        if target == "DSC_EST_CVL" and year in (2016, 2017):
            mapping = L.CIVIL_STATUS_NO_ZERO
        out[target] = label(source, mapping)
    for target, source in L.YES_NO_LABELS:
        out[target] = yes_no(source)
    q048, q044 = L.DSC_Q048
    out["DSC_Q048"] = (yes_no(q048) if fixes else
                       F.when(_code(q048) == "0", F.lit(NO)).when(_code(q044) == "1", F.lit(YES))
                        .otherwise(F.lit("")))
    code = attendance_code(S.PRESENCE_FLAGS)
    out["COD_TPO_PSC"] = code
    out["DSC_TPO_PSC"] = attendance_label(code)
    out["FL_PSC"] = any_flag(S.PRESENCE_FLAGS)
    out["FL_PSC_DIA_1"] = day_attendance("ANO_ENEM", "FL_PSC_CIE_NAT", "FL_PSC_LNG_COD", S.DAY_RULE_CUTOVER)
    out["FL_PSC_DIA_2"] = day_attendance("ANO_ENEM", "FL_PSC_LNG_COD", "FL_PSC_CIE_NAT", S.DAY_RULE_CUTOVER)
    out["FL_AMP"] = any_flag_int(S.LARGE_PRINT_FLAGS)
    out["FL_CDC_ESP"] = any_flag(S.SPECIAL_CONDITION_FLAGS)
    out["FL_PRV_DTD_TRAT"] = any_flag_int(S.lying_down_flags(year))
    out["FL_RCS_DIF"] = any_flag(S.resource_flags(year))
    out["NOT_MED"] = row_mean(S.GRADES)
    return out


def derived_columns_for(tables) -> set[str]:
    """Derived columns that the given star tables and their routing use."""
    every = set(_derivations(2019, False))
    need: set[str] = set()
    for name in tables:
        if name == "DIM_RSP_PRV":
            need.add(S.ROUTES[name][0])
            continue
        for c in S.STAR_COLUMNS[name]:
            src = c if isinstance(c, str) else c[0]
            if src in every:
                need.add(src)
        if S.ROUTES[name] and S.ROUTES[name][0] in every:
            need.add(S.ROUTES[name][0])
    return need


@lru_cache(maxsize=16)
def _recode_columns(year: int) -> dict[str, Column]:
    return {c: recode_map(c, m) for c, m in recodes_for(year).items()}


def curate_year(cleaned: DataFrame, year: int, state: str | None = DEFAULT_STATE,
                fixes: bool = False, outputs: set[str] | None = None) -> DataFrame:
    """CLEANED edition -> derived curated base.

    The state filter is the first operator, so on a Parquet CLEANED layer it
    is pushed into the scan.  ``outputs`` limits the derivations to the
    named columns (``derived_columns_for(tables)``): the plan then carries
    only what the target tables need.
    """
    df = filter_eq(cleaned, "UF_PRV", state) if state else cleaned
    df = harmonise(df, list(curated_input_columns()), defaults=S.FLAG_DEFAULTS)
    df = df.withColumns({c: e for c, e in _recode_columns(year).items() if c in df.columns})
    derived = derivations(year, fixes)
    if outputs is not None:
        derived = {k: v for k, v in derived.items() if k in outputs}
    return df.withColumns(derived)


def curate(cleaned_by_year: dict[int, DataFrame], state: str | None = DEFAULT_STATE,
           fixes: bool = False, tables=None) -> DataFrame:
    """All editions in one plan: per-year derivation, then UNION ALL.

    With ``tables`` only the derivations those star tables use are built."""
    outputs = derived_columns_for(tables) if tables else None
    frames = [curate_year(df, y, state, fixes, outputs) for y, df in sorted(cleaned_by_year.items())]
    return reduce(lambda a, b: a.unionByName(b), frames)


def _predicate(rule) -> Column | None:
    if rule is None:
        return None
    col, value = rule
    return F.col(col).isNotNull() if value == "NOT NULL" else (F.col(col) == F.lit(value))


def star_targets() -> dict[str, Target]:
    derived = set(_derivations(2019, False))
    return {name: Target(cols, _predicate(rule := S.ROUTES[name]), computed=bool(rule) and rule[0] in derived)
            for name, cols in S.STAR_COLUMNS.items()}


def _spec_for(columns: list[str]) -> list[FieldSpec]:
    out = []
    for c in columns:
        t, n = S.column_type(c)
        out.append(FieldSpec(c, t, n, nullable=c != "NUM_INS"))
    return out


def typed(df: DataFrame) -> DataFrame:
    """Cast to the curated types with reject reasons (K4)."""
    return enforce_schema(df, _spec_for(df.columns))


def build_star(base: DataFrame, answers_key: bool = True,
               tables: list[str] | None = None, key_start: int = 1) -> dict[str, DataFrame]:
    """Route the derived base into the star.

    Returns typed tables (``_reject_reason`` column included; use
    ``split_rejects``).  Each table is its own lazy plan over ``base``;
    ``tables`` restricts the output to the named ones; ``key_start`` is the
    first answers identity value (1 for a full load).
    """
    wanted = set(tables) if tables else set(S.STAR_COLUMNS) | {"DIM_RSP_PRV"}
    star = route(base, {k: v for k, v in star_targets().items() if k in wanted})
    if "DIM_RSP_PRV" not in wanted:
        return {name: typed(df) for name, df in star.items()}
    answers = unpivot_groups(where_computed(base, _predicate(S.ROUTES["DIM_RSP_PRV"])), ["NUM_INS", "ANO_ENEM"],
                             S.ANSWER_GROUPS, "AREA_CCN_ITEM", ["RSP_INS", "COD_PRV"], not_null="RSP_INS")
    if answers_key:
        answers = surrogate_key(answers, ["ANO_ENEM", "NUM_INS", "AREA_CCN_ITEM"], name="DIM_RSP_PRV_PK",
                                start=key_start)
    else:
        answers = answers.withColumn("DIM_RSP_PRV_PK", F.lit(None).cast("bigint"))
    star["DIM_RSP_PRV"] = answers.select(*S.ANSWER_COLUMNS, "ANO_ENEM")
    return {name: typed(df) for name, df in star.items()}


def load_star(star: dict[str, DataFrame], out_dir: str, years=None) -> dict[str, str]:
    """Load star tables and publish them together (K1); returns each table's new folder.

    The primary key NUM_INS of every dimension and of the fact is enforced
    within the load and against the editions that stay (K5).  With ``years``
    exactly those editions of the given tables are replaced, also by nothing,
    and rows of other editions are rejected; without, the editions present in
    the rows.  Each table is written once, good and rejected rows apart, and
    written again only if keys repeat; until all are written, readers see the
    former editions.
    """
    return stage_star(star, out_dir, years).publish()


def stage_star(star: dict[str, DataFrame], out_dir: str, years=None) -> StagedStar:
    """The first half of ``load_star``: everything is written, nothing counts yet."""
    spark = next(iter(star.values())).sparkSession
    pub = Publication(spark, out_dir)
    loads = []
    for name, checked in star.items():
        if years is not None:
            stray = F.col(REJECT_COL).isNull() & ~F.col("ANO_ENEM").isin([str(y) for y in years])
            checked = checked.withColumn(REJECT_COL, F.when(stray, F.lit("ANO_ENEM: not a loaded edition"))
                                         .otherwise(F.col(REJECT_COL)))
        staged = pub.stage(checked, name, "ANO_ENEM")
        editions = [str(y) for y in years] if years is not None else sorted(
            r[0] for r in pub.rows(staged).select("ANO_ENEM").distinct().collect())  # one row an edition
        if name != "DIM_RSP_PRV":
            staged = enforce_key(pub, staged, ["NUM_INS"], editions)
        loads.append((staged, editions))
    return StagedStar(pub, loads)


@dataclass(frozen=True)
class StagedStar:
    """Written star tables that do not count until ``publish``."""
    publication: Publication
    loads: list

    def publish(self) -> dict[str, str]:
        self.publication.publish(self.loads)
        return {staged.table: staged.folder for staged, _ in self.loads}


def enforce_key(pub: Publication, staged: Staged, keys: list[str], editions) -> Staged:
    """A staged load whose good rows have keys that neither repeat nor are stored in other editions.

    Only key columns are read: repeats by a grouped count, stored keys by the
    key filters of the other loads and a look at the few hits.  Without any
    the load stays as it is; else it is written again with the late rows
    rejected.  The filter of its own keys is written beside it.
    """
    good = pub.rows(staged).select(*keys)
    others = [(s, of) for s, of in ((s, [e for e in of if e not in set(map(str, editions))]) for s, of in pub.loads(staged.table)) if of]
    known = None
    for other, of in others:
        held = pub.spark.read.parquet(f"{other.folder}/_keys")
        hits = maybe_in(good, keys, held, held.agg(F.max("buckets")).first()[0])
        found = stored_keys(hits, keys, pub.rows(other, editions=of))
        known = found if known is None else known.union(found)
    if known is not None:
        checkpoint_root(pub.spark)
        known = known.distinct().checkpoint()
    stored = known is not None and known.limit(1).count() > 0
    if stored or check_unique(good, keys).limit(1).count():
        rows = pub.rows(staged).withColumn(REJECT_COL, F.lit(None).cast("string")).unionByName(pub.rows(staged, REJECTED))
        if stored:
            late = rows.join(known.withColumn("_stored", F.lit(True)), keys, "left")
            reason = F.when(F.col(REJECT_COL).isNull() & F.col("_stored"), F.lit(f"{', '.join(keys)}: duplicate key of another edition"))
            rows = late.select(*[c for c in rows.columns if c != REJECT_COL], F.coalesce(reason, F.col(REJECT_COL)).alias(REJECT_COL))
        staged = pub.stage(reject_duplicates(rows, keys), staged.table, staged.edition_column)
        good = pub.rows(staged).select(*keys)
    buckets = buckets_for(good.count())
    key_filter(good, keys, buckets).withColumn("buckets", F.lit(buckets)).write.parquet(f"{staged.folder}/_keys")
    return staged


def read_star_table(spark: SparkSession, curated_dir: str, name: str, editions=None) -> DataFrame:
    """The published rows of a star table, with its declared types."""
    return Publication(spark, curated_dir).read(name, editions)


def read_star_rejects(spark: SparkSession, curated_dir: str, editions=None) -> DataFrame:
    """Rejected rows of all published star loads: ``table_name, NUM_INS, ANO_ENEM, _reject_reason``."""
    pub = Publication(spark, curated_dir)
    parts = [pub.read(name, editions, REJECTED).select(F.lit(name).alias("table_name"), "NUM_INS", "ANO_ENEM", REJECT_COL)
             for name in sorted(pub.state()[1])]
    return reduce(lambda a, b: a.unionByName(b), parts)


def read_layer_edition(spark: SparkSession, out_dir: str, layer: str, year: int, status: str = GOOD) -> DataFrame:
    """The published rows of one edition of the RAW or CLEANED layer (``layer``: raw or cleaned), or its rejects."""
    return Publication(spark, f"{out_dir}/{layer}").read(str(year), status=status)


def next_answer_key(spark: SparkSession, curated_dir: str, years) -> int:
    """First identity value for reloading ``years``: one past the largest key
    kept in the other editions of the published answers (1 if there are
    none).  Like an IDENTITY column, keys stay unique across partial reloads."""
    pub = Publication(spark, curated_dir)
    kept = [e for e in pub.editions("DIM_RSP_PRV") if e not in {str(y) for y in years}]
    top = pub.read("DIM_RSP_PRV", kept).agg(F.max("DIM_RSP_PRV_PK")).first()[0] if kept else None
    return 1 if top is None else int(top) + 1


def _load_layer(spark: SparkSession, checked: DataFrame, layer_dir: str, year: int) -> DataFrame:
    """Write and publish one edition of a layer; its good rows as read back.

    Every edition is a table of its own: its columns are its layout's.
    """
    pub = Publication(spark, layer_dir)
    staged = pub.stage(checked, str(year))
    pub.publish([(staged, ["all"])])
    return pub.rows(staged)


def load_editions(spark: SparkSession, raw_paths: dict[int, str], out_dir: str,
                  state: str | None = DEFAULT_STATE, fixes: bool = False,
                  tables: list[str] | None = None) -> dict[str, str]:
    """Text files per year -> RAW, CLEANED (parquet, by year) -> CURATED star.

    Each layer load is typed against its table definition: malformed lines,
    rows of another edition and rows with a value wider than the column are
    kept as rejects with the reason (the reference's database would have
    failed the whole insert).  Each layer is written once and published when
    it is whole; the star tables are published together.  Exactly the named
    editions are replaced, also when they come out empty.  ``tables`` loads
    only the named star tables (deriving only what they need); the others
    keep their current content.
    """
    return stage_editions(spark, raw_paths, out_dir, state, fixes, tables).publish()


def stage_editions(spark: SparkSession, raw_paths: dict[int, str], out_dir: str,
                   state: str | None = DEFAULT_STATE, fixes: bool = False, tables: list[str] | None = None) -> StagedStar:
    """``load_editions`` up to the point where the new star would count."""
    cleaned = {}
    for year, path in sorted(raw_paths.items()):
        raw = _load_layer(spark, check_raw(read_raw(spark, path, year), year), f"{out_dir}/raw", year)
        cleaned[year] = _load_layer(spark, check_cleaned(clean(raw, year, fixes), year), f"{out_dir}/cleaned", year)
    curated_dir = f"{out_dir}/curated"
    start = 1 if tables and "DIM_RSP_PRV" not in tables else next_answer_key(spark, curated_dir, raw_paths)
    base = curate(cleaned, state, fixes, tables=tables)
    return stage_star(build_star(base, key_start=start, tables=tables), curated_dir, years=sorted(raw_paths))
