"""Query catalog: every operator of the engine run on the driver's tables.

Each entry is a function ``(spark, sf_dir) -> DataFrame`` plus, where the
operator is expressible in SQL, the equivalent DuckDB SQL over the same
tables (the correctness oracle).  The exam data itself is not among the
driver's tables, so each entry maps the exam operator onto a table of the
same shape (codes, flags, grades, keys).  Stand-in inputs are plain
projections of the tables; the operator under test is always the library's
own code in ``microstar.functions`` / ``operators`` / ``sources``.

All entries read whole tables: no sampling, no id subsets, no row caps
(``profile_topk`` keeps k rows per column because top-k is the feature).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from microstar.functions import (any_flag, any_flag_int, attendance_code, attendance_label,
                                 comma_decimal, day_attendance, evaluation_columns, label, recode_map,
                                 recode_sequential, row_mean, strip_accents, yes_no)
from microstar.functions.recode import Rule
from microstar.operators.join import bounded_broadcast, star_join
from microstar.operators.ml import LinearModel, fit_linear_svr, fit_ols, hash_split, score_linear
from microstar.operators.profile import profile_corr, profile_histogram, profile_summary
from microstar.operators.profile_merge import heavy_values
from microstar.operators.project import (drop_columns, null_defaults, null_to_empty, permute_columns,
                                         select_rename, union_years)
from microstar.operators.quality import FieldSpec, check_unique, enforce_schema, surrogate_key
from microstar.operators.reshape import crosstab_distinct, unpivot_groups
from microstar.operators.route import Target, filter_eq, filter_ne, route
from microstar.session import scratch_path
from microstar.sources.delimited import read_delimited, read_star_csv, write_delimited
from microstar.sources.layers import append_load, overwrite_load, read_layer, read_table
from microstar.spec.labels import LABELS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def T(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, sf, name)


# --------------------------------------------------------------------------
# The star join (flagship)
# --------------------------------------------------------------------------

@register("star_join", """
SELECT a.*, b.c_name, b.c_mktsegment, f.n_name, g.r_name,
       c.l_linenumber, c.l_quantity, c.l_extendedprice
FROM orders a
JOIN customer b ON a.o_custkey = b.c_custkey AND b.c_mktsegment = 'BUILDING'
JOIN lineitem c ON a.o_orderkey = c.l_orderkey
LEFT JOIN nation f ON b.c_nationkey = f.n_nationkey
LEFT JOIN region g ON f.n_regionkey = g.r_regionkey
""")
def q_star_join(spark, sf):
    """Inner join with a right-side predicate in the condition, inner join,
    left join to a small dimension and a left join through its bridge key
    to a second one; select ``a.*`` plus named columns."""
    a = T(spark, sf, "orders").alias("a")
    b = T(spark, sf, "customer").alias("b")
    c = T(spark, sf, "lineitem").alias("c")
    f = bounded_broadcast(T(spark, sf, "nation")).alias("f")
    g = bounded_broadcast(T(spark, sf, "region")).alias("g")
    return star_join(a, [
        (b, (F.col("a.o_custkey") == F.col("b.c_custkey")) & (F.col("b.c_mktsegment") == "BUILDING"), "inner"),
        (c, F.col("a.o_orderkey") == F.col("c.l_orderkey"), "inner"),
        (f, F.col("b.c_nationkey") == F.col("f.n_nationkey"), "left"),
        (g, F.col("f.n_regionkey") == F.col("g.r_regionkey"), "left"),
    ], select=["a.*", "b.c_name", "b.c_mktsegment", "f.n_name", "g.r_name",
               "c.l_linenumber", "c.l_quantity", "c.l_extendedprice"])


# --------------------------------------------------------------------------
# Scans and filters
# --------------------------------------------------------------------------

@register("table_scan", "SELECT * FROM supplier")
def q_table_scan(spark, sf):
    """Full table scan."""
    return T(spark, sf, "supplier")


@register("filter_eq", "SELECT * FROM orders WHERE o_orderstatus = 'F'")
def q_filter_eq(spark, sf):
    """Equality filter pushed into the Parquet scan (F1)."""
    return filter_eq(T(spark, sf, "orders"), "o_orderstatus", "F")


@register("filter_ne", "SELECT * FROM orders WHERE o_orderstatus <> 'F'")
def q_filter_ne(spark, sf):
    """Inequality filter; null keys drop out."""
    return filter_ne(T(spark, sf, "orders"), "o_orderstatus", "F")


# --------------------------------------------------------------------------
# Delimited text
# --------------------------------------------------------------------------

CUSTOMER_LAYOUT = ["COD_CLI", "NOM_CLI", "COD_NAC", "SALDO", "SEGMENTO"]


@register("csv_positional_scan", """
SELECT CAST(c_custkey AS VARCHAR) AS COD_CLI,
       c_name AS NOM_CLI,
       CAST(c_nationkey AS VARCHAR) AS COD_NAC,
       CAST(c_acctbal AS VARCHAR) AS SALDO,
       CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN NULL ELSE c_mktsegment END AS SEGMENTO
FROM customer
""")
def q_csv_positional_scan(spark, sf):
    """Stage customer as ';'-separated text (header names differ from the
    layout, cells padded, '-' and empty cells), then read it back by
    position with the delimited reader."""
    cust = T(spark, sf, "customer")
    staged = cust.select(
        F.col("c_custkey").cast("string").alias("C_CUSTKEY"),
        F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")).alias("C_NAME"),
        F.col("c_nationkey").cast("string").alias("C_NATIONKEY"),
        F.col("c_acctbal").cast("string").alias("C_ACCTBAL"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("-"))
         .when(F.col("c_mktsegment") == "MACHINERY", F.lit(""))
         .otherwise(F.col("c_mktsegment")).alias("C_MKTSEGMENT"))
    path = scratch_path(spark, "csv_positional")
    write_delimited(staged, path, sep=";")
    return read_delimited(spark, path, CUSTOMER_LAYOUT, sep=";")


@register("csv_infer_scan", """
SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, CAST(c_nationkey AS INTEGER) AS c_nationkey,
       c_acctbal, c_mktsegment
FROM customer
""")
def q_csv_infer_scan(spark, sf):
    """Export customer as a tab-separated ISO-8859-1 star file and read it
    back with inferred types."""
    path = scratch_path(spark, "csv_infer")
    write_delimited(T(spark, sf, "customer"), path, sep="\t")
    return read_star_csv(spark, path, sep="\t")


# --------------------------------------------------------------------------
# Layer loads
# --------------------------------------------------------------------------

_ORDERS_BY_YEAR_SQL = "SELECT *, CAST(year(o_orderdate) AS INTEGER) AS o_year FROM orders"


@register("overwrite_load", _ORDERS_BY_YEAR_SQL)
def q_overwrite_load(spark, sf):
    """Load orders partitioned by year, then re-load the later years:
    dynamic partition overwrite replaces them without duplicates."""
    o = T(spark, sf, "orders").withColumn("o_year", F.year("o_orderdate"))
    path = scratch_path(spark, "overwrite_load")
    overwrite_load(o, path, ["o_year"])
    overwrite_load(o.where(F.col("o_year") >= 1998), path, ["o_year"])
    return read_layer(spark, path)


@register("append_years", _ORDERS_BY_YEAR_SQL)
def q_append_years(spark, sf):
    """Two yearly runs appended into one table = UNION ALL of the editions."""
    o = T(spark, sf, "orders").withColumn("o_year", F.year("o_orderdate"))
    path = scratch_path(spark, "append_years")
    append_load(o.where(F.col("o_year") < 1998), path, ["o_year"])
    append_load(o.where(F.col("o_year") >= 1998), path, ["o_year"])
    return read_layer(spark, path)


# --------------------------------------------------------------------------
# K4, K5, K6: quality
# --------------------------------------------------------------------------

PART_SPEC = [
    FieldSpec("p_partkey", "bigint", nullable=False),
    FieldSpec("p_name", "string", max_len=10),
    FieldSpec("p_brand_no", "int"),
    FieldSpec("p_type", "string", max_len=7),
    FieldSpec("p_size", "int"),
    FieldSpec("p_retailprice", "double"),
]


@register("schema_enforce", """
SELECT reject_reason, count(*) AS n_rows FROM (
  SELECT CASE
    WHEN p_partkey IS NULL THEN 'p_partkey: null'
    WHEN TRY_CAST(CAST(p_partkey AS VARCHAR) AS BIGINT) IS NULL THEN 'p_partkey: not bigint'
    WHEN length(p_name) > 10 THEN 'p_name: longer than 10'
    WHEN regexp_replace(p_brand, '^Brand#', '') IS NOT NULL
         AND TRY_CAST(regexp_replace(p_brand, '^Brand#', '') AS INTEGER) IS NULL THEN 'p_brand_no: not int'
    WHEN length(p_type) > 7 THEN 'p_type: longer than 7'
    WHEN p_size IS NOT NULL AND TRY_CAST(CAST(p_size AS VARCHAR) AS INTEGER) IS NULL THEN 'p_size: not int'
    WHEN p_retailprice IS NOT NULL AND TRY_CAST(CAST(p_retailprice AS VARCHAR) AS DOUBLE) IS NULL
         THEN 'p_retailprice: not double'
    ELSE NULL END AS reject_reason
  FROM part) t
GROUP BY reject_reason
""")
def q_schema_enforce(spark, sf):
    """Typed load of part as text: casts, length limits, reject reasons."""
    text = T(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("p_partkey"), "p_name",
        F.regexp_replace("p_brand", "^Brand#", "").alias("p_brand_no"), "p_type",
        F.col("p_size").cast("string").alias("p_size"),
        F.col("p_retailprice").cast("string").alias("p_retailprice"))
    checked = enforce_schema(text, PART_SPEC)
    return (checked.groupBy(F.col("_reject_reason").alias("reject_reason"))
                   .agg(F.count(F.lit(1)).alias("n_rows")))


@register("pk_check", """
SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
""")
def q_pk_check(spark, sf):
    """Key values held by more than one row (K5)."""
    return check_unique(T(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("surrogate_key", """
SELECT *, row_number() OVER (ORDER BY s_nationkey, s_suppkey) AS s_sk FROM supplier
""")
def q_surrogate_key(spark, sf):
    """Dense distributed identity key following (nation, supplier) (K6)."""
    return surrogate_key(T(spark, sf, "supplier"), ["s_nationkey", "s_suppkey"], name="s_sk")


# --------------------------------------------------------------------------
# projections
# --------------------------------------------------------------------------

@register("select_rename", """
SELECT c_custkey AS COD_CLI, c_name AS NOM_CLI, c_acctbal AS SALDO FROM customer
""")
def q_select_rename(spark, sf):
    """Keep, rename and reorder three columns in one select."""
    return select_rename(T(spark, sf, "customer"),
                         [("c_custkey", "COD_CLI"), ("c_name", "NOM_CLI"), ("c_acctbal", "SALDO")])


@register("column_permute", """
SELECT l_orderkey, l_suppkey AS l_partkey, l_partkey AS l_suppkey, l_linenumber, l_quantity,
       l_extendedprice, l_tax AS l_discount, l_discount AS l_tax, l_returnflag, l_linestatus, l_shipdate
FROM lineitem
""")
def q_column_permute(spark, sf):
    """Swap two pairs of column names in one select."""
    return permute_columns(T(spark, sf, "lineitem"), {
        "l_partkey": "l_suppkey", "l_suppkey": "l_partkey",
        "l_discount": "l_tax", "l_tax": "l_discount"})


@register("drop_columns", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def q_drop_columns(spark, sf):
    """Drop columns."""
    return drop_columns(T(spark, sf, "customer"), ["c_name", "c_mktsegment"])


# --------------------------------------------------------------------------
# Routing one stream into several targets
# --------------------------------------------------------------------------

def lineitem_targets() -> dict[str, Target]:
    keys = ["l_orderkey", "l_linenumber"]
    return {
        "returned": Target(keys, F.col("l_returnflag") == "R"),
        "open": Target(keys, F.col("l_linestatus") == "O"),
        "discounted": Target(keys, F.col("l_discount") > 0.05),
        "all": Target(keys),
    }


@register("route_conditional", """
SELECT 'returned' AS target, l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT 'open', l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'O'
UNION ALL SELECT 'discounted', l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0.05
UNION ALL SELECT 'all', l_orderkey, l_linenumber FROM lineitem
""")
def q_route_conditional(spark, sf):
    """Route lineitem to four targets by predicate, copy semantics (F2)."""
    routes = route(T(spark, sf, "lineitem"), lineitem_targets())
    return union_years([df.select(F.lit(n).alias("target"), "*") for n, df in routes.items()])


@register("star_dimensions", """
SELECT 'FAT_RECEITA' AS table_name, l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS measure
FROM lineitem
UNION ALL SELECT 'DIM_QUANTIDADE', l_orderkey, l_linenumber, l_quantity FROM lineitem
UNION ALL SELECT 'DIM_IMPOSTO', l_orderkey, l_linenumber, l_tax FROM lineitem WHERE l_tax > 0
""")
def q_star_dimensions(spark, sf):
    """Several projections of one derived base into star tables."""
    base = T(spark, sf, "lineitem").withColumn(
        "revenue", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    keys = ["l_orderkey", "l_linenumber"]
    star = route(base, {
        "FAT_RECEITA": Target(keys + [("revenue", "measure")]),
        "DIM_QUANTIDADE": Target(keys + [("l_quantity", "measure")]),
        "DIM_IMPOSTO": Target(keys + [("l_tax", "measure")], F.col("l_tax") > 0),
    })
    return union_years([df.select(F.lit(n).alias("table_name"), "*") for n, df in star.items()])


# --------------------------------------------------------------------------
# Harmonise editions, defaults
# --------------------------------------------------------------------------

ORDERS_TARGET = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_year"]


@register("harmonise_years", """
SELECT o_orderkey, o_custkey,
       CASE WHEN year(o_orderdate) = 1996 THEN '0' ELSE o_orderstatus END AS o_orderstatus,
       o_totalprice,
       CASE WHEN year(o_orderdate) < 1996 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
       CAST(year(o_orderdate) AS INTEGER) AS o_year
FROM orders
""")
def q_harmonise_years(spark, sf):
    """Editions with different column sets (before 1996 without priority,
    1996 without status) harmonised onto one schema and unioned."""
    o = T(spark, sf, "orders").withColumn("o_year", F.year("o_orderdate"))
    editions = [
        o.where(F.col("o_year") < 1996).drop("o_orderpriority"),
        o.where(F.col("o_year") == 1996).drop("o_orderstatus"),
        o.where(F.col("o_year") > 1996),
    ]
    return union_years(editions, ORDERS_TARGET, defaults={"o_orderstatus": "0", "o_orderpriority": None},
                       types={"o_orderstatus": "string", "o_orderpriority": "string"})


def _customer_urgent_orders(spark, sf):
    c = T(spark, sf, "customer").select("c_custkey")
    o = T(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    return c.join(o, c.c_custkey == o.o_custkey, "left")


_URGENT_JOIN = """FROM customer c LEFT JOIN orders o
  ON c.c_custkey = o.o_custkey AND o.o_orderpriority = '1-URGENT'"""


@register("null_defaults", f"""
SELECT c.c_custkey, o.o_orderkey, coalesce(o.o_totalprice, 0.0) AS o_totalprice,
       coalesce(o.o_orderstatus, '-1') AS o_orderstatus
{_URGENT_JOIN}
""")
def q_null_defaults(spark, sf):
    """Per-column defaults for the nulls of a left join."""
    j = _customer_urgent_orders(spark, sf).select("c_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    return null_defaults(j, {"o_totalprice": 0.0, "o_orderstatus": "-1"})


@register("null_to_empty", f"""
SELECT c.c_custkey, o.o_orderkey, coalesce(o.o_orderpriority, '') AS o_orderpriority
{_URGENT_JOIN}
""")
def q_null_to_empty(spark, sf):
    """Null -> '' on a string column of a left join."""
    j = _customer_urgent_orders(spark, sf).select("c_custkey", "o_orderkey", "o_orderpriority")
    return null_to_empty(j, ["o_orderpriority"])


# --------------------------------------------------------------------------
# recodes
# --------------------------------------------------------------------------

# F <-> O swap through the placeholder A, as the curated rules swap codes.
STATUS_RULES = [Rule("F", "A"), Rule("O", "F"), Rule("A", "O")]


@register("recode_map", """
SELECT o_orderkey, o_orderstatus,
       CASE upper(trim(o_orderstatus)) WHEN 'F' THEN 'O' WHEN 'O' THEN 'F' WHEN 'A' THEN 'O'
            ELSE o_orderstatus END AS status_recoded
FROM orders
""")
def q_recode_map(spark, sf):
    """Code swap F <-> O through a placeholder, as one composed map lookup."""
    o = T(spark, sf, "orders")
    return o.select("o_orderkey", "o_orderstatus",
                    recode_map("o_orderstatus", STATUS_RULES).alias("status_recoded"))


NAME_RULES = [Rule("red", "X1"), Rule("blue", "red"), Rule("X1", "blue"),
              Rule("ring", "loop"), Rule("SMALL", "tiny"), Rule("hot", "warm"), Rule("warm", "mild")]


@register("recode_sequential", """
SELECT p_partkey, p_name,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(p_name, '\\bred\\b', 'X1', 'gi'), '\\bblue\\b', 'red', 'gi'), '\\bX1\\b', 'blue', 'gi'),
  '\\bring\\b', 'loop', 'gi'), '\\bSMALL\\b', 'tiny', 'gi'), '\\bhot\\b', 'warm', 'gi'),
  '\\bwarm\\b', 'mild', 'gi') AS name_recoded
FROM part
""")
def q_recode_sequential(spark, sf):
    """Whole-word, case-insensitive replace chain on part names."""
    p = T(spark, sf, "part")
    return p.select("p_partkey", "p_name", recode_sequential("p_name", NAME_RULES).alias("name_recoded"))


# --------------------------------------------------------------------------
# labels
# --------------------------------------------------------------------------

def _case_sql(expr: str, mapping: dict, default: str = "''") -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE trim(CAST({expr} AS VARCHAR)) {whens} ELSE {default} END"


@register("label_codes", f"""
SELECT l_orderkey, l_linenumber,
       CASE trim(CAST(l_linenumber AS VARCHAR)) WHEN '0' THEN 'Anulada' WHEN '1' THEN 'Em branco' WHEN '3' THEN 'Presente'
        WHEN '4' THEN 'Cópia de texto motivador' WHEN '5' THEN 'Não atendimento ao tipo textual'
        WHEN '6' THEN 'Texto insuficiente' WHEN '7' THEN 'Fuga ao tema'
        WHEN '8' THEN 'Parte do texto desconectada com o tema proposto' ELSE '' END AS DSC_SIT_RDC,
       CASE trim(CAST(l_linenumber - 1 AS VARCHAR)) WHEN '0' THEN 'Faltou à prova' WHEN '1' THEN 'Presente na prova'
        WHEN '2' THEN 'Eliminado na prova' ELSE '' END AS DSC_PSC
FROM lineitem
""")
def q_label_codes(spark, sf):
    """Code -> label maps, '' when unmatched."""
    li = T(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     label("l_linenumber", LABELS["DSC_SIT_RDC"]).alias("DSC_SIT_RDC"),
                     label(F.col("l_linenumber") - 1, LABELS["FL_PSC_TRAT"]).alias("DSC_PSC"))


@register("label_yes_no", f"""
SELECT doc_id, quality, toxic,
       {_case_sql('quality', {'0': 'Não', '1': 'Sim'})} AS DSC_QUALITY,
       {_case_sql('toxic', {'0': 'Não', '1': 'Sim'})} AS DSC_TOXIC
FROM labels
""")
def q_label_yes_no(spark, sf):
    """0/1 -> Não/Sim, '' otherwise."""
    lab = T(spark, sf, "labels")
    return lab.select("doc_id", "quality", "toxic", yes_no("quality").alias("DSC_QUALITY"),
                      yes_no("toxic").alias("DSC_TOXIC"))


# --------------------------------------------------------------------------
# Flags and attendance
# --------------------------------------------------------------------------

@register("flag_any", """
SELECT doc_id,
  CASE WHEN trim(CAST(quality AS VARCHAR)) <> '0' OR trim(CAST(toxic AS VARCHAR)) <> '0' THEN 'Sim' ELSE 'Não' END AS FL_ANY,
  CASE WHEN trim(CAST(toxic AS VARCHAR)) <> '0' THEN 1 ELSE 0 END AS FL_TOXIC_INT
FROM labels
""")
def q_flag_any(spark, sf):
    """Any-of flag as Sim/Não and as 1/0."""
    lab = T(spark, sf, "labels")
    return lab.select("doc_id", any_flag(["quality", "toxic"]).alias("FL_ANY"),
                      any_flag_int(["toxic"]).alias("FL_TOXIC_INT"))


def _attendance_standin(spark, sf) -> DataFrame:
    """Four presence flags per lineitem row ('0' absent, '1' present,
    '2' eliminated, null unknown) and an edition year."""
    li = T(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", F.year("l_shipdate").alias("ANO"),
        F.when(F.col("l_returnflag") == "N", "0").when(F.col("l_returnflag") == "A", "1")
         .otherwise("2").alias("FL_CN"),
        F.when(F.col("l_linestatus") == "O", "0").otherwise("1").alias("FL_CH"),
        F.when(F.col("l_tax") == 0, F.lit(None).cast("string"))
         .when(F.col("l_discount") == 0, "0").otherwise("1").alias("FL_LC"),
        F.when(F.col("l_quantity") > 25, "1").otherwise("0").alias("FL_MT"))


_ATTENDANCE_SQL = """
  SELECT l_orderkey, l_linenumber, year(l_shipdate) AS ANO,
    CASE WHEN l_returnflag = 'N' THEN '0' WHEN l_returnflag = 'A' THEN '1' ELSE '2' END AS FL_CN,
    CASE WHEN l_linestatus = 'O' THEN '0' ELSE '1' END AS FL_CH,
    CASE WHEN l_tax = 0 THEN NULL WHEN l_discount = 0 THEN '0' ELSE '1' END AS FL_LC,
    CASE WHEN l_quantity > 25 THEN '1' ELSE '0' END AS FL_MT
  FROM lineitem"""

_AREAS = ["FL_CN", "FL_CH", "FL_LC", "FL_MT"]


@register("attendance_class", f"""
WITH s AS ({_ATTENDANCE_SQL}),
c AS (SELECT *,
  CASE WHEN FL_CN = '0' AND FL_CH = '0' AND FL_LC = '0' AND FL_MT = '0' THEN 0
       WHEN FL_CN <> '0' AND FL_CH <> '0' AND FL_LC <> '0' AND FL_MT <> '0' THEN 1
       ELSE 2 END AS COD_TPO_PSC FROM s)
SELECT l_orderkey, l_linenumber, COD_TPO_PSC,
  CASE COD_TPO_PSC WHEN 0 THEN 'Ausente' WHEN 1 THEN 'Presente' WHEN 2 THEN 'Parcial' END AS DSC_TPO_PSC,
  CASE WHEN FL_CN <> '0' OR FL_CH <> '0' OR FL_LC <> '0' OR FL_MT <> '0' THEN 'Sim' ELSE 'Não' END AS FL_PSC
FROM c
""")
def q_attendance_class(spark, sf):
    """Three-way attendance class and label, attended-anything flag."""
    s = _attendance_standin(spark, sf)
    s = s.withColumn("COD_TPO_PSC", attendance_code(_AREAS))
    return s.select("l_orderkey", "l_linenumber", "COD_TPO_PSC",
                    attendance_label("COD_TPO_PSC").alias("DSC_TPO_PSC"),
                    any_flag(_AREAS).alias("FL_PSC"))


ATTENDANCE_CUTOVER = 1998


@register("attendance_day", f"""
WITH s AS ({_ATTENDANCE_SQL})
SELECT l_orderkey, l_linenumber,
  CASE WHEN (ANO < {ATTENDANCE_CUTOVER} AND FL_CN <> '0') OR (ANO >= {ATTENDANCE_CUTOVER} AND FL_LC <> '0')
       THEN 'Sim' ELSE 'Não' END AS FL_PSC_DIA_1,
  CASE WHEN (ANO < {ATTENDANCE_CUTOVER} AND FL_LC <> '0') OR (ANO >= {ATTENDANCE_CUTOVER} AND FL_CN <> '0')
       THEN 'Sim' ELSE 'Não' END AS FL_PSC_DIA_2
FROM s
""")
def q_attendance_day(spark, sf):
    """Year-dependent exam-day rule."""
    s = _attendance_standin(spark, sf)
    return s.select("l_orderkey", "l_linenumber",
                    day_attendance("ANO", "FL_CN", "FL_LC", ATTENDANCE_CUTOVER).alias("FL_PSC_DIA_1"),
                    day_attendance("ANO", "FL_LC", "FL_CN", ATTENDANCE_CUTOVER).alias("FL_PSC_DIA_2"))


# --------------------------------------------------------------------------
# Numbers and codes
# --------------------------------------------------------------------------

@register("row_mean", """
SELECT l_orderkey, l_linenumber,
  (coalesce(l_quantity, 0.0) + coalesce(l_extendedprice, 0.0) + coalesce(l_discount, 0.0)
   + coalesce(l_tax, 0.0) + CAST(coalesce(l_linenumber, 0) AS DOUBLE)) / 5.0 AS NOT_MED
FROM lineitem
""")
def q_row_mean(spark, sf):
    """Row mean of five numbers after null defaults."""
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    li = null_defaults(T(spark, sf, "lineitem").select("l_orderkey", *cols),
                       {"l_quantity": 0.0, "l_extendedprice": 0.0, "l_discount": 0.0, "l_tax": 0.0,
                        "l_linenumber": 0})
    return li.select("l_orderkey", F.col("l_linenumber"), row_mean(cols).alias("NOT_MED"))


@register("substring_parts", """
WITH m AS (SELECT reverse(lpad(CAST(c_custkey AS VARCHAR), 7, '0')) AS COD_MUN_IBGE, c_name AS NOM_MUN,
                  CAST(c_nationkey AS VARCHAR) AS UF FROM customer)
SELECT COD_MUN_IBGE, substring(COD_MUN_IBGE, 1, 1) AS COD_REG_UF,
  CASE substring(COD_MUN_IBGE, 1, 1) WHEN '1' THEN 'N' WHEN '2' THEN 'NE' WHEN '3' THEN 'SE'
       WHEN '4' THEN 'S' WHEN '5' THEN 'CO' ELSE '' END AS REG_UF,
  substring(COD_MUN_IBGE, 1, 2) AS COD_UF, UF, substring(COD_MUN_IBGE, 3, 5) AS COD_MUN, NOM_MUN
FROM m WHERE COD_MUN_IBGE <> '0000000'
""")
def q_substring_parts(spark, sf):
    """Municipality dimension flow on 7-character codes: substrings,
    region label, dummy-row filter, final column order."""
    from microstar.plans.municipality import curate_municipality
    m = T(spark, sf, "customer").select(
        F.reverse(F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("COD_MUN_IBGE"),
        F.col("c_name").alias("NOM_MUN"), F.col("c_nationkey").cast("string").alias("UF"))
    return curate_municipality(m)


@register("strip_accents", """
SELECT 'documents' AS source_table, doc_id AS id, CAST(0 AS BIGINT) AS turn, strip_accents(text) AS text_folded
FROM documents
UNION ALL
SELECT 'conversations', conv_id, turn, strip_accents(text) FROM conversations
""")
def q_strip_accents(spark, sf):
    """Accent folding of whole document and conversation texts."""
    d = T(spark, sf, "documents").select(F.lit("documents").alias("source_table"),
                                         F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("turn"),
                                         strip_accents("text").alias("text_folded"))
    c = T(spark, sf, "conversations").select(F.lit("conversations").alias("source_table"),
                                             F.col("conv_id").alias("id"), "turn",
                                             strip_accents("text").alias("text_folded"))
    return d.unionByName(c)


@register("comma_decimal", """
SELECT c_custkey, replace(CAST(c_acctbal AS VARCHAR), '.', ',') AS saldo_txt, round(c_acctbal, 2) AS saldo
FROM customer
""")
def q_comma_decimal(spark, sf):
    """Comma-decimal text parsed to a double rounded to 2."""
    txt = T(spark, sf, "customer").select(
        "c_custkey", F.regexp_replace(F.col("c_acctbal").cast("string"), "\\.", ",").alias("saldo_txt"))
    return txt.withColumn("saldo", comma_decimal("saldo_txt", 2))


# --------------------------------------------------------------------------
# unpivot
# --------------------------------------------------------------------------

@register("unpivot_groups", """
SELECT l_orderkey, l_linenumber, 'Q' AS kind, q AS v1, l_discount AS v2
FROM (SELECT *, CASE WHEN l_linestatus = 'F' THEN NULL ELSE l_quantity END AS q FROM lineitem) t
WHERE q IS NOT NULL
UNION ALL
SELECT l_orderkey, l_linenumber, 'P', l_extendedprice, l_tax FROM lineitem WHERE l_extendedprice IS NOT NULL
""")
def q_unpivot_groups(spark, sf):
    """Two-measure unpivot with the not-null filter."""
    li = T(spark, sf, "lineitem").withColumn(
        "q", F.when(F.col("l_linestatus") == "F", F.lit(None).cast("double")).otherwise(F.col("l_quantity")))
    return unpivot_groups(li, ["l_orderkey", "l_linenumber"],
                          {"Q": ["q", "l_discount"], "P": ["l_extendedprice", "l_tax"]},
                          "kind", ["v1", "v2"], not_null="v1")


# --------------------------------------------------------------------------
# Split, fit, score, evaluate
# --------------------------------------------------------------------------

TRAIN_LAST_YEAR = 1999


@register("train_split", f"""
SELECT CASE WHEN substring(md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR))), 1, 2) < '40'
            THEN 'test' ELSE 'train' END AS split,
       count(*) AS n_rows, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price
FROM lineitem WHERE year(l_shipdate) <= {TRAIN_LAST_YEAR}
GROUP BY 1
""")
def q_train_split(spark, sf):
    """Training editions (year filter), feature/target subset, md5 split."""
    li = T(spark, sf, "lineitem").where(F.year("l_shipdate") <= TRAIN_LAST_YEAR)
    s = hash_split(li.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"),
                   ["l_orderkey", "l_linenumber"])
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").alias("sum_qty"),
                                  F.round(F.sum("l_extendedprice"), 2).alias("sum_price"))



@register("fit_ols_1d", """
SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept
FROM lineitem
""")
def q_fit_ols_1d(spark, sf):
    """Least-squares slope and intercept from one aggregate of cross-products (M2 baseline)."""
    m = fit_ols(T(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice")
    return spark.range(1).select(F.round(F.lit(m.weights[0]), 4).alias("slope"),
                                 F.round(F.lit(m.intercept), 4).alias("intercept"))


@register("fit_linear_svr", """
SELECT * FROM (VALUES ('l_quantity', CAST(3 AS DOUBLE)), ('discount_pct', CAST(-2 AS DOUBLE)), ('tax_pct', CAST(5 AS DOUBLE)),
  ('intercept', CAST(1000 AS DOUBLE))) t(term, weight)
WHERE (SELECT count(*) FROM lineitem) > 0
""")
def q_fit_linear_svr(spark, sf):
    """Robust linear fit over the training side of the hash split of lineitem.

    The target is a planted linear rule of quantity, discount and tax; on the
    fifth of the rows whose order key ends in 0 or 5 it is replaced by the
    extended price, a value far off.  Least squares is pulled away by these
    rows; the absolute-loss fit must give the planted rule back (whole numbers)."""
    li = hash_split(T(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])
    li = li.select("l_quantity", (F.col("l_discount") * 100).alias("discount_pct"), (F.col("l_tax") * 100).alias("tax_pct"),
                   "l_extendedprice", "l_orderkey", "split")
    rule = 3 * F.col("l_quantity") - 2 * F.col("discount_pct") + 5 * F.col("tax_pct") + 1000
    train = li.where(F.col("split") == "train").withColumn(
        "y", F.when(F.col("l_orderkey") % 5 == 0, F.col("l_extendedprice")).otherwise(rule))
    m = fit_linear_svr(train, ["l_quantity", "discount_pct", "tax_pct"], "y")
    return m.to_frame(spark).select("term", (F.round("weight", 0) + 0.0).alias("weight"))


# A fixed model (the result of a fit is not reproducible across engines).
FIXED_MODEL = LinearModel(["l_quantity"], [10.0], 50.0)


@register("score_linear", """
SELECT l_orderkey, l_linenumber, CAST(50.0 AS DOUBLE) + CAST(10.0 AS DOUBLE) * l_quantity AS PREVISAO
FROM lineitem
""")
def q_score_linear(spark, sf):
    """A fixed linear model applied as a column expression (M3, M4)."""
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return score_linear(li, FIXED_MODEL).drop("l_quantity")


def _evaluation(spark, sf) -> DataFrame:
    li = T(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.lit(100.0)).alias("NOT_RDC"), "l_quantity")
    scored = score_linear(li, FIXED_MODEL)
    ev = evaluation_columns("NOT_RDC", "PREVISAO")
    return scored.select("l_orderkey", "l_linenumber", *[e.alias(n) for n, e in ev.items()])


_EVAL_SQL = """
WITH s AS (SELECT l_orderkey, l_linenumber, l_extendedprice / CAST(100.0 AS DOUBLE) AS real,
                  CAST(trunc(CAST(50.0 AS DOUBLE) + CAST(10.0 AS DOUBLE) * l_quantity) AS INTEGER) AS pred
           FROM lineitem),
d AS (SELECT *, real - pred AS diff, CASE WHEN real = 0 THEN NULL ELSE pred / real * 100 END AS ratio FROM s),
p AS (SELECT *, CAST(trunc(CASE WHEN diff < 0 THEN ratio - 100 WHEN diff > 0 THEN 100 - ratio
                                ELSE 0.0 END) AS INTEGER) AS pct FROM d),
e AS (SELECT l_orderkey, l_linenumber, real AS Nota_Real, pred AS Nota_Prevista,
         CAST(trunc(CASE WHEN diff < 0 THEN -diff ELSE diff END) AS INTEGER) AS Diferenca,
         CASE WHEN diff < 0 THEN 'Atribuiu Nota Maior' WHEN diff > 0 THEN 'Atribuiu Nota Menor'
              ELSE 'Atribuiu Nota Exata' END AS Tipo_da_Diferenca,
         pct AS Percentual_da_Diferenca,
         CASE WHEN pct BETWEEN 0 AND 10 THEN '0, 10' WHEN pct BETWEEN 11 AND 20 THEN '11, 20'
              WHEN pct BETWEEN 21 AND 30 THEN '21, 30' WHEN pct BETWEEN 31 AND 40 THEN '31, 40'
              WHEN pct BETWEEN 41 AND 50 THEN '41, 50' WHEN pct BETWEEN 51 AND 60 THEN '51, 60'
              WHEN pct BETWEEN 61 AND 70 THEN '61, 70' WHEN pct BETWEEN 71 AND 80 THEN '71, 80'
              WHEN pct BETWEEN 81 AND 90 THEN '81, 90' WHEN pct BETWEEN 91 AND 100 THEN '91, 100'
              WHEN pct > 100 THEN '> 100' ELSE NULL END AS Faixa_da_Diferenca
      FROM p)"""


@register("evaluate_predictions", _EVAL_SQL + "\nSELECT * FROM e")
def q_evaluate_predictions(spark, sf):
    """Evaluation table: truncated prediction, difference, sign, percentage, band."""
    return _evaluation(spark, sf)


@register("accuracy_sql", _EVAL_SQL + """
SELECT (SELECT count(1) FROM e WHERE Percentual_da_Diferenca <= 30) / (SELECT count(1) FROM e) * 100
       AS percentual_acerto
""")
def q_accuracy_sql(spark, sf):
    """Hit rate through Spark SQL scalar subqueries over a temp view (K7, A1, A2)."""
    _evaluation(spark, sf).createOrReplaceTempView("df_resultado_spark")
    return spark.sql("""
        SELECT (SELECT count(1) FROM df_resultado_spark WHERE Percentual_da_Diferenca <= 30)
             / (SELECT count(1) FROM df_resultado_spark) * 100 AS percentual_acerto""")


# --------------------------------------------------------------------------
# profile
# --------------------------------------------------------------------------

PROFILE_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
PROFILE_OTHER = ["l_returnflag", "l_linestatus", "l_shipdate"]
PROFILE_DIGITS = 4


def _profile_summary_sql() -> str:
    parts = []
    for c in PROFILE_NUMERIC + PROFILE_OTHER:
        ms = [("count", f"count({c})"), ("nulls", f"sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)"),
              ("distinct", f"count(DISTINCT {c})")]
        if c in PROFILE_NUMERIC:
            ms += [("min", f"min({c})"), ("max", f"max({c})"), ("mean", f"avg({c})"),
                   ("stddev", f"stddev_samp({c})")]
        for m, e in ms:
            parts.append(f"SELECT '{c}' AS column_name, '{m}' AS metric, "
                         f"round(CAST({e} AS DOUBLE), {PROFILE_DIGITS}) + 0.0 AS value FROM lineitem")
    return "\nUNION ALL ".join(parts)


@register("profile_summary", _profile_summary_sql())
def q_profile_summary(spark, sf):
    """Counts, nulls, distinct, min/max/mean/stddev per column."""
    return profile_summary(T(spark, sf, "lineitem"), PROFILE_NUMERIC, PROFILE_OTHER,
                           exact_distinct=True, digits=PROFILE_DIGITS)


@register("profile_histogram", f"""
WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
w AS (SELECT lo, CASE WHEN hi > lo THEN (hi - lo) / 10 ELSE 1.0 END AS width FROM b),
k AS (SELECT CAST(least(floor((l_extendedprice - lo) / width), 9) AS INTEGER) AS bucket, lo, width
      FROM lineitem, w WHERE l_extendedprice IS NOT NULL)
SELECT 'l_extendedprice' AS column_name, bucket,
       round(lo + bucket * width, {PROFILE_DIGITS}) AS lo, round(lo + (bucket + 1) * width, {PROFILE_DIGITS}) AS hi,
       count(*) AS n_rows
FROM k GROUP BY bucket, lo, width
""")
def q_profile_histogram(spark, sf):
    """Equal-width histogram of one column."""
    return profile_histogram(T(spark, sf, "lineitem"), "l_extendedprice", 10, digits=PROFILE_DIGITS)


CORR_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql() -> str:
    parts = []
    for i, a in enumerate(CORR_COLUMNS):
        for b in CORR_COLUMNS[i + 1:]:
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), {PROFILE_DIGITS}) AS corr "
                         f"FROM lineitem")
    return "\nUNION ALL ".join(parts)


@register("profile_corr", _corr_sql())
def q_profile_corr(spark, sf):
    """Pearson correlation of every column pair."""
    return profile_corr(T(spark, sf, "lineitem"), CORR_COLUMNS, digits=PROFILE_DIGITS)


TOPK_COLUMNS = ["l_returnflag", "l_linestatus", "l_linenumber"]


@register("profile_topk", "WITH s AS (" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM lineitem" for c in TOPK_COLUMNS) + """),
c AS (SELECT column_name, value, count(*) AS n_rows FROM s GROUP BY column_name, value),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n_rows DESC, value ASC NULLS LAST) AS rank
      FROM c)
SELECT column_name, value, n_rows, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3
""")
def q_profile_topk(spark, sf):
    """Three most frequent values per column (A7); the limit is the feature.
    A sketch names the candidates, a second pass counts them."""
    return heavy_values(T(spark, sf, "lineitem"), TOPK_COLUMNS, k=3)


# --------------------------------------------------------------------------
# Data dictionary queries
# --------------------------------------------------------------------------

@register("dictionary_fields", """
SELECT g.r_name AS TABELA, f.n_nationkey AS SEQUENCIA, f.n_name AS CAMPO,
       count(d.s_suppkey) AS N_DESCRICOES, round(sum(d.s_acctbal), 2) AS TAMANHO
FROM nation f
LEFT JOIN region g ON f.n_regionkey = g.r_regionkey
LEFT JOIN supplier d ON d.s_nationkey = f.n_nationkey
GROUP BY g.r_name, f.n_nationkey, f.n_name
""")
def q_dictionary_fields(spark, sf):
    """Fields (nation) -> table (region, many-to-one, broadcast) and ->
    descriptions (supplier); SUM of sizes grouped by table/sequence/field."""
    from microstar.plans.dictionary import field_sizes
    fields = T(spark, sf, "nation").select(F.col("n_regionkey").alias("TABELA_ID"),
                                          F.col("n_nationkey").alias("SEQUENCIA"), F.col("n_name").alias("CAMPO"))
    tables = T(spark, sf, "region").select(F.col("r_regionkey").alias("TABELA_ID"), F.col("r_name").alias("TABELA"))
    descr = T(spark, sf, "supplier").select(F.col("s_nationkey").alias("SEQUENCIA"),
                                            F.col("s_suppkey").alias("DESCRICAO_ID"),
                                            F.col("s_acctbal").alias("TAMANHO"))
    return field_sizes(fields, tables, descr)


@register("dictionary_domains", """
WITH d AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS ANO, o_orderstatus AS NOME_CAMPO_RAW,
                  count(*) AS N_REGISTROS
           FROM orders GROUP BY 1, 2),
v AS (SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS ANO, l_linestatus AS NOME_CAMPO_RAW, l_returnflag AS CODIGO_DOMINIO_RAW
      FROM lineitem)
SELECT d.ANO, d.NOME_CAMPO_RAW, d.N_REGISTROS, v.CODIGO_DOMINIO_RAW
FROM d LEFT JOIN v ON d.ANO = v.ANO AND d.NOME_CAMPO_RAW = v.NOME_CAMPO_RAW
""")
def q_dictionary_domains(spark, sf):
    """Composite-key (year, raw field) one-to-many join of a field list to
    its domain values."""
    from microstar.plans.dictionary import field_domains
    o = T(spark, sf, "orders")
    fields = o.groupBy(F.year("o_orderdate").alias("ANO"), F.col("o_orderstatus").alias("NOME_CAMPO_RAW")) \
              .agg(F.count(F.lit(1)).alias("N_REGISTROS"))
    li = T(spark, sf, "lineitem")
    domains = li.select(F.year("l_shipdate").alias("ANO"), F.col("l_linestatus").alias("NOME_CAMPO_RAW"),
                        F.col("l_returnflag").alias("CODIGO_DOMINIO_RAW")).distinct()
    return field_domains(fields, domains)


@register("dictionary_tables", """
SELECT DISTINCT g.r_name AS TABELA, f.n_name AS CAMPO
FROM supplier s JOIN nation f ON s.s_nationkey = f.n_nationkey
LEFT JOIN region g ON f.n_regionkey = g.r_regionkey
""")
def q_dictionary_tables(spark, sf):
    """Distinct (table, field) members in listing order (A5)."""
    from microstar.plans.dictionary import member_listing
    s = T(spark, sf, "supplier")
    n = bounded_broadcast(T(spark, sf, "nation"))
    r = bounded_broadcast(T(spark, sf, "region"))
    j = (s.join(n, s.s_nationkey == n.n_nationkey, "inner")
          .join(r, n.n_regionkey == r.r_regionkey, "left")
          .select(F.col("r_name").alias("TABELA"), F.col("n_name").alias("CAMPO")))
    return member_listing(j, ["TABELA", "CAMPO"])


DOW = [1, 2, 3, 4, 5, 6, 7]


@register("lineage_crosstab", "SELECT event_type, " + ", ".join(
    f"count(DISTINCT user_id) FILTER (WHERE dayofweek(ts) + 1 = {d}) AS dow_{d}" for d in DOW)
    + " FROM events GROUP BY event_type")
def q_lineage_crosstab(spark, sf):
    """COUNT(DISTINCT user) by event type x weekday, one column per weekday."""
    ev = T(spark, sf, "events").select("event_type", "user_id", F.dayofweek("ts").alias("dow"))
    return crosstab_distinct(ev, ["event_type"], "dow", DOW, "user_id", names={d: f"dow_{d}" for d in DOW})


# --------------------------------------------------------------------------
# The exam pipeline end to end (S1, X1, P6, P1/P2, F1, P5, X2, X3-X11, F2,
# P3, K4, N1, F3, K6) on a 2019-layout raw text file staged from orders:
# one candidate per order.  The stand-in only writes raw cells; reading,
# cleaning, recoding, labelling, routing, typing and keying are the
# pipeline's own code.
# --------------------------------------------------------------------------

_EXAM_STANDIN_SQL = """
  SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS NUM_INS,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'SP' ELSE 'RR' END AS UF,
    CAST(o_custkey % 3 AS VARCHAR) AS P_CN, CAST(o_custkey % 2 AS VARCHAR) AS P_CH,
    CAST((o_custkey // 2) % 2 AS VARCHAR) AS P_LC, CASE WHEN o_orderstatus = 'P' THEN '0' ELSE '1' END AS P_MT,
    CAST((o_custkey * 7) % 1000 AS VARCHAR) || '.' || CAST(o_orderkey % 10 AS VARCHAR) AS G_CN,
    CAST((o_custkey * 11) % 1000 AS VARCHAR) || '.' || CAST(o_orderkey % 7 AS VARCHAR) AS G_CH,
    CAST((o_orderkey * 13) % 1000 AS VARCHAR) || '.5' AS G_LC,
    CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST((o_orderkey * 17) % 1000 AS VARCHAR) END AS G_MT,
    CAST(o_orderkey % 2 AS VARCHAR) AS LNG, CAST(o_orderkey % 10 AS VARCHAR) AS RDC_STATUS,
    CAST(o_orderkey % 201 AS VARCHAR) AS C1, CAST((o_orderkey * 2) % 201 AS VARCHAR) AS C2,
    CAST((o_orderkey * 3) % 201 AS VARCHAR) AS C3, CAST((o_orderkey * 4) % 201 AS VARCHAR) AS C4,
    CAST((o_orderkey * 5) % 201 AS VARCHAR) AS C5, CAST(o_custkey % 1001 AS VARCHAR) AS RDC,
    CAST(500 + o_custkey % 7 AS VARCHAR) AS PRV_CN, CAST(510 + o_custkey % 7 AS VARCHAR) AS PRV_CH,
    CAST(520 + o_custkey % 7 AS VARCHAR) AS PRV_LC, CAST(530 + o_custkey % 7 AS VARCHAR) AS PRV_MT,
    CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'X' WHEN o_orderstatus = 'F' THEN 'F'
         WHEN o_orderstatus = 'O' THEN 'M' ELSE 'm' END AS SEXO,
    CAST(o_custkey % 5 AS VARCHAR) AS EST_CVL, CAST(o_custkey % 8 AS VARCHAR) AS COR,
    CAST(o_orderkey % 6 AS VARCHAR) AS NAC,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(15 + o_custkey % 60 AS VARCHAR) END AS IDADE,
    CAST(o_orderkey % 3 AS VARCHAR) AS TREINEIRO, CASE WHEN o_custkey % 60 >= 45 THEN '1' ELSE '0' END AS IDOSO,
    CAST(1400000 + o_custkey % 500 AS VARCHAR) AS MUN_NSC, CAST(1400000 + o_orderkey % 500 AS VARCHAR) AS MUN_RSD,
    CAST(o_orderkey % 5 AS VARCHAR) AS ST_CONCL, CAST(o_custkey % 15 AS VARCHAR) AS ANO_CONCL,
    CAST((o_orderkey // 5) % 5 AS VARCHAR) AS ESCOLA,
    CASE o_custkey % 4 WHEN 0 THEN NULL ELSE CAST(o_custkey % 4 AS VARCHAR) END AS ENSINO,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(14000000 + o_custkey AS VARCHAR) END AS COD_ESC,
    CAST(o_custkey % 5 AS VARCHAR) AS DEP_ADM, CAST(o_orderkey % 3 AS VARCHAR) AS LOCAL_ESC,
    CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % 6 AS VARCHAR) END AS SIT_FUNC,
    CAST(1400000 + o_custkey % 300 AS VARCHAR) AS MUN_ESC,
    CASE WHEN o_orderkey % 11 = 0 THEN '1' ELSE '0' END AS AMP18,
    CASE WHEN o_custkey % 17 = 0 THEN '1' ELSE '0' END AS LEDOR,
    o_orderkey
  FROM orders"""


def _write_exam_raw_standin(spark, sf, year: int = 2019, orders: DataFrame | None = None, **override) -> str:
    """Stage one edition's raw file (its layout and separator) from orders;
    ``override`` gives other cells for named raw columns."""
    from microstar.spec.layouts import LAYOUTS, SEPARATOR
    o = T(spark, sf, "orders") if orders is None else orders
    s = lambda e: F.expr(e).cast("string")
    p_cn, p_ch, p_lc = s("o_custkey % 3"), s("o_custkey % 2"), s("(o_custkey div 2) % 2")
    p_mt = F.when(F.col("o_orderstatus") == "P", "0").otherwise("1")

    def answers(presence, tag):
        return F.when(presence == "0", F.lit("-")).otherwise(
            F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit(tag))))
    cells = {
        "NU_INSCRICAO": F.lpad(F.col("o_orderkey").cast("string"), 12, "0"),
        "NU_ANO": F.lit(str(year)),
        "SG_UF_PROVA": F.when(F.col("o_orderpriority") == "5-LOW", "SP").otherwise("RR"),
        "TP_PRESENCA_CN": p_cn, "TP_PRESENCA_CH": p_ch, "TP_PRESENCA_LC": p_lc, "TP_PRESENCA_MT": p_mt,
        "NU_NOTA_CN": F.concat(s("(o_custkey * 7) % 1000"), F.lit("."), s("o_orderkey % 10")),
        "NU_NOTA_CH": F.concat(s("(o_custkey * 11) % 1000"), F.lit("."), s("o_orderkey % 7")),
        "NU_NOTA_LC": F.concat(s("(o_orderkey * 13) % 1000"), F.lit(".5")),
        "NU_NOTA_MT": F.when(F.col("o_orderstatus") == "P", F.lit("-")).otherwise(s("(o_orderkey * 17) % 1000")),
        "TP_LINGUA": s("o_orderkey % 2"), "TP_STATUS_REDACAO": s("o_orderkey % 10"),
        "NU_NOTA_COMP1": s("o_orderkey % 201"), "NU_NOTA_COMP2": s("(o_orderkey * 2) % 201"),
        "NU_NOTA_COMP3": s("(o_orderkey * 3) % 201"), "NU_NOTA_COMP4": s("(o_orderkey * 4) % 201"),
        "NU_NOTA_COMP5": s("(o_orderkey * 5) % 201"), "NU_NOTA_REDACAO": s("o_custkey % 1001"),
        "CO_PROVA_CN": s("500 + o_custkey % 7"), "CO_PROVA_CH": s("510 + o_custkey % 7"),
        "CO_PROVA_LC": s("520 + o_custkey % 7"), "CO_PROVA_MT": s("530 + o_custkey % 7"),
        "TX_RESPOSTAS_CN": answers(p_cn, "CN"), "TX_RESPOSTAS_CH": answers(p_ch, "CH"),
        "TX_RESPOSTAS_LC": answers(p_lc, "LC"), "TX_RESPOSTAS_MT": answers(p_mt, "MT"),
        "TP_SEXO": (F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "X")
                    .when(F.col("o_orderstatus") == "F", "F").when(F.col("o_orderstatus") == "O", "M")
                    .otherwise("m")),
        "TP_ESTADO_CIVIL": s("o_custkey % 5"), "TP_COR_RACA": s("o_custkey % 8"),
        "TP_NACIONALIDADE": s("o_orderkey % 6"),
        "NU_IDADE": F.when(F.expr("o_orderkey % 13 = 0"), F.lit("-")).otherwise(s("15 + o_custkey % 60")),
        "IN_TREINEIRO": s("o_orderkey % 3"),
        "IN_IDOSO": F.when(F.expr("o_custkey % 60 >= 45"), "1").otherwise("0"),
        "IN_NOME_SOCIAL": F.lit("0"),
        "CO_MUNICIPIO_NASCIMENTO": s("1400000 + o_custkey % 500"),
        "CO_MUNICIPIO_RESIDENCIA": s("1400000 + o_orderkey % 500"),
        "TP_ST_CONCLUSAO": s("o_orderkey % 5"), "TP_ANO_CONCLUIU": s("o_custkey % 15"),
        "TP_ESCOLA": s("(o_orderkey div 5) % 5"),
        "TP_ENSINO": F.when(F.expr("o_custkey % 4 = 0"), F.lit("-")).otherwise(s("o_custkey % 4")),
        "CO_ESCOLA": F.when(F.expr("o_orderkey % 3 = 0"), F.lit("-")).otherwise(s("14000000 + o_custkey")),
        "TP_DEPENDENCIA_ADM_ESC": s("o_custkey % 5"), "TP_LOCALIZACAO_ESC": s("o_orderkey % 3"),
        "TP_SIT_FUNC_ESC": F.when(F.expr("o_orderkey % 6 = 0"), F.lit("")).otherwise(s("o_orderkey % 6")),
        "CO_MUNICIPIO_ESC": s("1400000 + o_custkey % 300"),
        "IN_AMPLIADA_18": F.when(F.expr("o_orderkey % 11 = 0"), "1").otherwise("0"),
        "IN_LEDOR": F.when(F.expr("o_custkey % 17 = 0"), "1").otherwise("0"),
        "CO_MUNICIPIO_PROVA": s("1400000 + o_custkey % 200"),
    }
    cells.update(override)
    raw = o.select(*[cells.get(c, F.lit("-")).alias(c) for c in LAYOUTS[year]])
    path = scratch_path(spark, f"exam_raw_{year}")
    write_delimited(raw, path, sep=SEPARATOR[year])
    return path


def _exam_star(spark, sf, table: str, year: int = 2019, orders: DataFrame | None = None, **override):
    """A star table from a staged raw file: checked lines -> cleaned -> curated -> typed."""
    from microstar.operators.quality import split_rejects
    from microstar.plans import exam
    path = _write_exam_raw_standin(spark, sf, year, orders, **override)
    good, _ = split_rejects(exam.check_raw(exam.read_raw(spark, path, year), year))
    cleaned = exam.clean(good, year)
    return exam.build_star(exam.curate({year: cleaned}, state="RR", tables=[table]), tables=[table])[table]


_EXAM_ROUTED = """
  FROM s WHERE UF = 'RR' AND (P_CN <> '0' OR P_CH <> '0' OR P_LC <> '0' OR P_MT <> '0')"""


@register("exam_fact_flow", f"""
WITH s AS ({_EXAM_STANDIN_SQL}),
g AS (SELECT NUM_INS, CAST(G_CN AS DOUBLE) AS CN, CAST(G_CH AS DOUBLE) AS CH, CAST(G_LC AS DOUBLE) AS LC,
        CAST(coalesce(G_MT, '0') AS DOUBLE) AS MT, CAST(RDC AS DOUBLE) AS RD,
        CASE LNG WHEN '1' THEN '0' WHEN '0' THEN '1' ELSE LNG END AS LNG_R,
        CASE RDC_STATUS WHEN '2' THEN '0' WHEN '4' THEN '1' WHEN '1' THEN '3' WHEN '3' THEN '4'
             WHEN '7' THEN '5' WHEN '8' THEN '6' WHEN '6' THEN '7' WHEN '9' THEN '8' ELSE RDC_STATUS END AS ST_R,
        C1, C2, C3, C4, C5
      {_EXAM_ROUTED})
SELECT NUM_INS, '2019' AS ANO_ENEM, CH AS NOT_CIE_HUM, CN AS NOT_CIE_NAT, MT AS NOT_MAT,
  CAST(LNG_R AS INTEGER) AS TPO_LNG_ESTG,
  CASE LNG_R WHEN '0' THEN 'Espanhol' WHEN '1' THEN 'Inglês' ELSE '' END AS DSC_TPO_LNG_ESTG,
  LC AS NOT_LNG_COD, CAST(ST_R AS INTEGER) AS COD_SIT_RDC,
  CASE ST_R WHEN '0' THEN 'Anulada' WHEN '1' THEN 'Em branco' WHEN '3' THEN 'Presente'
    WHEN '4' THEN 'Cópia de texto motivador' WHEN '5' THEN 'Não atendimento ao tipo textual'
    WHEN '6' THEN 'Texto insuficiente' WHEN '7' THEN 'Fuga ao tema'
    WHEN '8' THEN 'Parte do texto desconectada com o tema proposto' ELSE '' END AS DSC_SIT_RDC,
  CAST(C1 AS DOUBLE) AS NOT_RDC_CPT_1, CAST(C2 AS DOUBLE) AS NOT_RDC_CPT_2, CAST(C3 AS DOUBLE) AS NOT_RDC_CPT_3,
  CAST(C4 AS DOUBLE) AS NOT_RDC_CPT_4, CAST(C5 AS DOUBLE) AS NOT_RDC_CPT_5, RD AS NOT_RDC,
  (CN + CH + LC + MT + RD) / 5.0 AS NOT_MED
FROM g
""")
def q_exam_fact_flow(spark, sf):
    """Raw text -> cleaned -> curated -> FAT_NOTA (good rows, typed)."""
    from microstar.operators.quality import split_rejects
    good, _ = split_rejects(_exam_star(spark, sf, "FAT_NOTA"))
    return good


@register("exam_answers_flow", f"""
WITH s AS ({_EXAM_STANDIN_SQL}),
r AS (SELECT NUM_INS, P_CN, P_CH, P_LC, P_MT, o_orderkey, PRV_CN, PRV_CH, PRV_LC, PRV_MT {_EXAM_ROUTED}),
u AS (
  SELECT NUM_INS, 'CH' AS AREA_CCN_ITEM, md5(CAST(o_orderkey AS VARCHAR) || 'CH') AS RSP_INS, PRV_CH AS PRV
    FROM r WHERE P_CH <> '0'
  UNION ALL SELECT NUM_INS, 'CN', md5(CAST(o_orderkey AS VARCHAR) || 'CN'), PRV_CN FROM r WHERE P_CN <> '0'
  UNION ALL SELECT NUM_INS, 'LC', md5(CAST(o_orderkey AS VARCHAR) || 'LC'), PRV_LC FROM r WHERE P_LC <> '0'
  UNION ALL SELECT NUM_INS, 'MT', md5(CAST(o_orderkey AS VARCHAR) || 'MT'), PRV_MT FROM r WHERE P_MT <> '0')
SELECT row_number() OVER (ORDER BY NUM_INS, AREA_CCN_ITEM) AS DIM_RSP_PRV_PK, NUM_INS,
  CAST(PRV AS INTEGER) AS COD_PRV, AREA_CCN_ITEM, RSP_INS, '2019' AS ANO_ENEM
FROM u
""")
def q_exam_answers_flow(spark, sf):
    """Raw text -> ... -> DIM_RSP_PRV: unpivot of four (answers, exam code)
    pairs, null answers dropped, dense identity key."""
    from microstar.operators.quality import split_rejects
    good, _ = split_rejects(_exam_star(spark, sf, "DIM_RSP_PRV"))
    return good


@register("exam_presence_flow", f"""
WITH s AS ({_EXAM_STANDIN_SQL}),
p AS (SELECT NUM_INS, coalesce(P_CN, '') AS CN, P_CH AS CH, P_LC AS LC, P_MT AS MT FROM s WHERE UF = 'RR')
SELECT NUM_INS, '2019' AS ANO_ENEM,
  CASE CH WHEN '0' THEN 'Faltou à prova' WHEN '1' THEN 'Presente na prova' WHEN '2' THEN 'Eliminado na prova'
       ELSE '' END AS FL_PSC_CIE_HUM,
  CASE CN WHEN '0' THEN 'Faltou à prova' WHEN '1' THEN 'Presente na prova' WHEN '2' THEN 'Eliminado na prova'
       ELSE '' END AS FL_PSC_CIE_NAT,
  CASE LC WHEN '0' THEN 'Faltou à prova' WHEN '1' THEN 'Presente na prova' WHEN '2' THEN 'Eliminado na prova'
       ELSE '' END AS FL_PSC_LNG_COD,
  CASE MT WHEN '0' THEN 'Faltou à prova' WHEN '1' THEN 'Presente na prova' WHEN '2' THEN 'Eliminado na prova'
       ELSE '' END AS FL_PSC_MAT,
  CASE WHEN LC <> '0' THEN 'Sim' ELSE 'Não' END AS FL_PSC_DIA_1,
  CASE WHEN CN <> '0' THEN 'Sim' ELSE 'Não' END AS FL_PSC_DIA_2,
  CASE WHEN CN <> '0' OR CH <> '0' OR LC <> '0' OR MT <> '0' THEN 'Sim' ELSE 'Não' END AS FL_PSC,
  CASE WHEN CN = '0' AND CH = '0' AND LC = '0' AND MT = '0' THEN 0
       WHEN CN <> '0' AND CH <> '0' AND LC <> '0' AND MT <> '0' THEN 1 ELSE 2 END AS COD_TPO_PSC,
  CASE WHEN CN = '0' AND CH = '0' AND LC = '0' AND MT = '0' THEN 'Ausente'
       WHEN CN <> '0' AND CH <> '0' AND LC <> '0' AND MT <> '0' THEN 'Presente' ELSE 'Parcial' END AS DSC_TPO_PSC
FROM p
""")
def q_exam_presence_flow(spark, sf):
    """Raw text -> ... -> DIM_PRESENCA: presence labels, attendance class,
    exam-day rule (2019: day 1 = languages); not routed: every candidate of the
    state, present or not."""
    from microstar.operators.quality import split_rejects
    good, _ = split_rejects(_exam_star(spark, sf, "DIM_PRESENCA"))
    return good


@register("exam_cadastral_flow", f"""
WITH s AS ({_EXAM_STANDIN_SQL}),
c AS (SELECT NUM_INS, CASE upper(SEXO) WHEN 'F' THEN '0' WHEN 'M' THEN '1' ELSE SEXO END AS SEX,
        EST_CVL, COR, NAC, IDADE, TREINEIRO, IDOSO, MUN_NSC, MUN_RSD
      FROM s WHERE UF = 'RR')
SELECT NUM_INS, '2019' AS ANO_ENEM, CAST(IDADE AS INTEGER) AS IDD_INS, CAST(SEX AS INTEGER) AS COD_SEX,
  CASE SEX WHEN '0' THEN 'Feminino' WHEN '1' THEN 'Masculino' ELSE '' END AS DSC_SEX,
  CAST(COR AS INTEGER) AS COR_RCA,
  CASE COR WHEN '0' THEN 'Não declarado' WHEN '1' THEN 'Branca' WHEN '2' THEN 'Preta' WHEN '3' THEN 'Parda'
    WHEN '4' THEN 'Amarela' WHEN '5' THEN 'Indígena ' WHEN '6' THEN 'Não dispõe da informação' ELSE '' END AS DSC_RCA,
  CAST(EST_CVL AS INTEGER) AS COD_EST_CVL,
  CASE EST_CVL WHEN '0' THEN 'Não informado' WHEN '1' THEN 'Solteiro(a)'
    WHEN '2' THEN 'Casado(a)/Mora com um(a) companheiro(a)' WHEN '3' THEN 'Divorciado(a)/Desquitado(a)/Separado(a)'
    WHEN '4' THEN 'Viúvo(a)' ELSE '' END AS DSC_EST_CVL,
  CAST(NAC AS INTEGER) AS COD_NAC,
  CASE NAC WHEN '0' THEN 'Não informado' WHEN '1' THEN 'Brasileiro(a)' WHEN '2' THEN 'Brasileiro(a) Naturalizado(a)'
    WHEN '3' THEN 'Estrangeiro(a)' WHEN '4' THEN 'Brasileiro(a) Nato(a), nascido(a) no exterior' ELSE '' END AS DSC_NAC,
  MUN_NSC AS COD_MUN_NSC, MUN_RSD AS COD_MUN_RSD,
  CASE IDOSO WHEN '0' THEN 'Não' WHEN '1' THEN 'Sim' ELSE '' END AS FL_IDS,
  'Não' AS FL_NOM_SCL,
  CASE TREINEIRO WHEN '0' THEN 'Não' WHEN '1' THEN 'Sim' ELSE '' END AS FL_INS_TRE
FROM c WHERE SEX IN ('0', '1')
""")
def q_exam_cadastral_flow(spark, sf):
    """Raw text -> ... -> DIM_CADASTRAL good rows: case-insensitive sex
    recode, code and yes/no labels; rows with an invalid sex code are
    rejected by the typed load (K4) and not in the good table."""
    from microstar.operators.quality import split_rejects
    good, _ = split_rejects(_exam_star(spark, sf, "DIM_CADASTRAL"))
    return good


@register("hit_rate", _EVAL_SQL + """
SELECT avg(CASE WHEN Percentual_da_Diferenca <= 30 THEN 1.0 ELSE 0.0 END) * 100 AS percentual_acerto FROM e
""")
def q_hit_rate(spark, sf):
    """The same hit rate in one pass: a conditional average (A1)."""
    from microstar.functions.evaluation import hit_rate
    return _evaluation(spark, sf).agg(hit_rate("Percentual_da_Diferenca").alias("percentual_acerto"))


@register("exam_schooling_flow", f"""
WITH s AS ({_EXAM_STANDIN_SQL}),
c AS (SELECT NUM_INS,
        CASE upper(trim(ANO_CONCL)) WHEN '0' THEN '0' WHEN '13' THEN '1' WHEN '12' THEN '2' WHEN '11' THEN '3'
        WHEN '10' THEN '4' WHEN '9' THEN '5' WHEN '8' THEN '6' WHEN '7' THEN '7' WHEN '6' THEN '8' WHEN '5' THEN '9'
        WHEN '4' THEN '10' WHEN '3' THEN '11' WHEN '2' THEN '12' WHEN '1' THEN '13' WHEN 'A' THEN '1'
        WHEN 'B' THEN '2' WHEN 'C' THEN '3' WHEN 'D' THEN '4' WHEN 'E' THEN '5' WHEN 'F' THEN '6' WHEN 'G' THEN '7'
        WHEN 'H' THEN '8' WHEN 'I' THEN '9' WHEN 'J' THEN '10' WHEN 'K' THEN '11' WHEN 'L' THEN '12'
        WHEN 'M' THEN '13' ELSE ANO_CONCL END AS ANO,
        CASE upper(trim(ST_CONCL)) WHEN '4' THEN '0' WHEN '1' THEN '1' WHEN '2' THEN '2' WHEN '3' THEN '3' WHEN 'A' THEN '2'
        WHEN 'B' THEN '3' ELSE ST_CONCL END AS SIT,
        CASE upper(trim(ESCOLA)) WHEN '1' THEN '0' WHEN '2' THEN '1' WHEN '3' THEN '2' WHEN '4' THEN '3' ELSE ESCOLA END AS ESC,
        CASE upper(trim(coalesce(ENSINO, '-1'))) WHEN '1' THEN '0' WHEN '3' THEN '2' WHEN '2' THEN '3' WHEN 'A' THEN '2'
        WHEN 'B' THEN '3' ELSE coalesce(ENSINO, '-1') END AS ENS
      FROM s WHERE UF = 'RR')
SELECT NUM_INS, '2019' AS ANO_ENEM, '' AS TPO_ESC_ENS_FDM_DET, '' AS TPO_ENS_ESC_ENS_FDM_DET, '' AS TRN_ENS_FDM,
  CASE trim(CAST(ANO AS VARCHAR)) WHEN '0' THEN 'Não informado' WHEN '1' THEN 'Antes de 2007' WHEN '2' THEN '2007'
        WHEN '3' THEN '2008' WHEN '4' THEN '2009' WHEN '5' THEN '2010' WHEN '6' THEN '2011' WHEN '7' THEN '2012'
        WHEN '8' THEN '2013' WHEN '9' THEN '2014' WHEN '10' THEN '2015' WHEN '11' THEN '2016' WHEN '12' THEN '2017'
        WHEN '13' THEN '2018' ELSE '' END AS ANO_CCL_ENS_MED,
  CASE trim(CAST(SIT AS VARCHAR)) WHEN '0' THEN 'Não conclui e não estou cursando o Ensino Médio'
        WHEN '1' THEN 'Já concluí'
        WHEN '2' THEN 'Estou cursando e concluirei o Ensino Médio após o ano de aplicação da prova do ENEM'
        WHEN '3' THEN 'Estou cursando e concluirei o Ensino Médio no ano de aplicação da prova do ENEM' ELSE '' END AS SIT_CCL_ENS_MED,
  CASE trim(CAST(ESC AS VARCHAR)) WHEN '0' THEN 'Não Respondeu' WHEN '1' THEN 'Pública' WHEN '2' THEN 'Privada'
        WHEN '3' THEN 'Exterior' ELSE '' END AS TPO_ESC_ENS_MED,
  '' AS TPO_ESC_ENS_MED_DET,
  CASE trim(CAST(ENS AS VARCHAR)) WHEN '0' THEN 'Ensino Regular' WHEN '2' THEN 'Educação de Jovens e Adultos'
        WHEN '3' THEN 'Ensino Especial' ELSE '' END AS TPO_ENS_ESC_ENS_MED,
  '' AS TPO_ENS_ESC_ENS_MED_DET, '' AS TRN_ENS_MED, '' AS FL_SOL_CTF_ENS_MED, CAST(NULL AS VARCHAR) AS NOM_ENT_CTF
FROM c
""")
def q_exam_schooling_flow(spark, sf):
    """Raw text -> ... -> DIM_ENSINO: edition recodes (27-code conclusion
    year with placeholders, '-1' default kept by token) then labels;
    questions absent in 2019 label as ''."""
    from microstar.operators.quality import split_rejects
    good, _ = split_rejects(_exam_star(spark, sf, "DIM_ENSINO"))
    return good


@register("exam_school_flow", f"""
WITH s AS ({_EXAM_STANDIN_SQL})
SELECT NUM_INS, '2019' AS ANO_ENEM, COD_ESC, CAST(LOCAL_ESC AS INTEGER) AS COD_TPO_LCL_ESC,
  CASE trim(CAST(LOCAL_ESC AS VARCHAR)) WHEN '1' THEN 'Urbana' WHEN '2' THEN 'Rural' ELSE '' END AS DSC_TPO_LCL_ESC,
  CAST(coalesce(SIT_FUNC, '-1') AS INTEGER) AS FL_SIT_FUN_ESC,
  CASE trim(CAST(coalesce(SIT_FUNC, '-1') AS VARCHAR)) WHEN '1' THEN 'Em atividade' WHEN '2' THEN 'Paralisada'
        WHEN '3' THEN 'Extinta' WHEN '4' THEN 'Escola extinta em anos anteriores' ELSE '' END AS DSC_SIT_FUN_ESC,
  CAST(DEP_ADM AS INTEGER) AS FL_DPD_ADM_ESC, CASE trim(CAST(DEP_ADM AS VARCHAR)) WHEN '1' THEN 'Federal' WHEN '2' THEN 'Estadual' WHEN '3' THEN 'Municipal'
        WHEN '4' THEN 'Privada' ELSE '' END AS DSC_DPD_ADM_ESC,
  MUN_ESC AS COD_MUN_ESC
FROM s WHERE UF = 'RR' AND COD_ESC IS NOT NULL
""")
def q_exam_school_flow(spark, sf):
    """Raw text -> ... -> DIM_ESCOLA: routed on a non-null school code;
    school status null -> '-1' (cleaned default) -> int -1, label ''."""
    from microstar.operators.quality import split_rejects
    good, _ = split_rejects(_exam_star(spark, sf, "DIM_ESCOLA"))
    return good


@register("exam_resources_flow", f"""
WITH s AS ({_EXAM_STANDIN_SQL})
SELECT NUM_INS, '2019' AS ANO_ENEM,
  CAST(NULL AS INTEGER) AS FL_ACS,
  CASE WHEN AMP18 <> '0' THEN 1
        ELSE 0 END AS FL_AMP,
  CAST(NULL AS INTEGER) AS FL_APO_PRN,
  CAST(NULL AS INTEGER) AS FL_BRL,
  CAST(NULL AS INTEGER) AS FL_CAD_ACO,
  CAST(NULL AS INTEGER) AS FL_CAD_CAN,
  CAST(NULL AS INTEGER) AS FL_CAD_ESP,
  CAST(NULL AS INTEGER) AS FL_GUI_INT,
  CAST(NULL AS INTEGER) AS FL_LAM_OVL,
  CAST(NULL AS INTEGER) AS FL_LBR,
  CAST(LEDOR AS INTEGER) AS FL_LDR,
  CAST(NULL AS INTEGER) AS FL_LTR_LBL,
  CAST(NULL AS INTEGER) AS FL_MAQ_BRL,
  CAST(NULL AS INTEGER) AS FL_MOB_EPF,
  CAST(NULL AS INTEGER) AS FL_MOB_OBS,
  CAST(NULL AS INTEGER) AS FL_MSA_CAD_SPA,
  CAST(NULL AS INTEGER) AS FL_MTR_EPF,
  0 AS FL_PRV_DTD,
  CAST(NULL AS INTEGER) AS FL_SEM_RCS,
  CAST(NULL AS INTEGER) AS FL_SLA_ACP,
  CAST(NULL AS INTEGER) AS FL_SLA_ESP,
  CAST(NULL AS INTEGER) AS FL_SLA_IND,
  CAST(NULL AS INTEGER) AS FL_SOL_CMP,
  CAST(NULL AS INTEGER) AS FL_SRB,
  CAST(NULL AS INTEGER) AS FL_TMP_ADC,
  CAST(NULL AS INTEGER) AS FL_TRC,
  CAST(NULL AS INTEGER) AS FL_UND_HSP,
  0 AS FL_UND_PRI
FROM s WHERE UF = 'RR' AND (AMP18 <> '0' OR LEDOR <> '0')
""")
def q_exam_resources_flow(spark, sf):
    """Raw text -> ... -> DIM_RECURSO_DIFERENCIADO: routed when any of the
    29 resource flags is set; large print and lying-down any-of flags; the
    flag absent from the edition is the constant 0."""
    from microstar.operators.quality import split_rejects
    good, _ = split_rejects(_exam_star(spark, sf, "DIM_RECURSO_DIFERENCIADO"))
    return good


@register("municipality_flow", """
WITH m AS (SELECT lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS COD_SIAFI,
                  lpad(CAST(c_custkey AS VARCHAR), 14, '0') AS CNPJ, strip_accents(c_name) AS NOM_MUN,
                  CAST(c_nationkey AS VARCHAR) AS UF, reverse(lpad(CAST(c_custkey AS VARCHAR), 7, '0')) AS COD_MUN_IBGE
           FROM customer)
SELECT COD_MUN_IBGE, CAST(substring(COD_MUN_IBGE, 1, 1) AS INTEGER) AS COD_REG_UF,
  CASE substring(COD_MUN_IBGE, 1, 1) WHEN '1' THEN 'N' WHEN '2' THEN 'NE' WHEN '3' THEN 'SE'
       WHEN '4' THEN 'S' WHEN '5' THEN 'CO' ELSE '' END AS REG_UF,
  CAST(substring(COD_MUN_IBGE, 1, 2) AS INTEGER) AS COD_UF, UF, substring(COD_MUN_IBGE, 3, 5) AS COD_MUN, NOM_MUN
FROM m WHERE COD_MUN_IBGE <> '0000000'
""")
def q_municipality_flow(spark, sf):
    """Municipality list as delimited text (staged from customer) -> RAW ->
    CLEANED (accent folding, rename) -> CURATED loads, typed; the curated table."""
    from microstar.plans.municipality import load_municipality
    c = T(spark, sf, "customer")
    staged = c.select(F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0").alias("CODIGO SIAFI"),
                      F.lpad(F.col("c_custkey").cast("string"), 14, "0").alias("CNPJ"),
                      F.col("c_name").alias("DESCRICAO"), F.col("c_nationkey").cast("string").alias("UF"),
                      F.reverse(F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("CODIGO IBGE"))
    path = scratch_path(spark, "municipality_raw")
    write_delimited(staged, path, sep=";")
    paths = load_municipality(spark, path, scratch_path(spark, "municipality"))
    return read_layer(spark, paths["curated"])


from microstar.plans import catalog_loads, catalog_profiles  # noqa: E402, F401 - register their queries
