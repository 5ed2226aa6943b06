"""Query catalog, part two: safe loads, text round trips, dictionary filters.

Like ``catalog``: stand-in inputs are projections of the given tables, the
work is the library's own code, and every key has DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from microstar.plans import exam
from microstar.plans.catalog import T, _write_exam_raw_standin, register
from microstar.plans.dictionary import filter_members
from microstar.session import scratch_path
from microstar.sources.delimited import read_delimited, read_star_csv, write_delimited
from microstar.sources.publication import REJECTED

PLACE = "DIM_LOCAL_PROVA"


def _place(spark, layers: str):
    return exam.read_star_table(spark, f"{layers}/curated", PLACE)


# --------------------------------------------------------------------------
# Loads that replace exactly what they load
# --------------------------------------------------------------------------

_KEY = "lpad(CAST(o_orderkey AS VARCHAR), 12, '0')"


@register("load_stray_year", f"""
SELECT {_KEY} AS NUM_INS, CASE WHEN o_orderkey % 2 = 0 THEN '2018' ELSE '2019' END AS ANO_ENEM, 'loaded' AS status
FROM orders WHERE o_orderpriority <> '5-LOW' AND NOT (o_orderkey % 2 = 1 AND o_orderkey % 7 = 0)
UNION ALL
SELECT {_KEY}, '2018', 'rejected: NU_ANO: not 2019' FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 7 = 0
""")
def q_load_stray_year(spark, sf):
    """Load edition 2018, then a 2019 file in which some rows say 2018: these
    are rejected and the loaded 2018 rows stay."""
    o = T(spark, sf, "orders")
    out = scratch_path(spark, "load-stray")
    even, odd = o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1")
    year = F.when(F.col("o_orderkey") % 7 == 0, "2018").otherwise("2019")
    exam.load_editions(spark, {2018: _write_exam_raw_standin(spark, sf, 2018, even)}, out, tables=[PLACE])
    exam.load_editions(spark, {2019: _write_exam_raw_standin(spark, sf, 2019, odd, NU_ANO=year)}, out, tables=[PLACE])
    rejected = exam.read_layer_edition(spark, out, "raw", 2019, REJECTED).select(
        F.col("NU_INSCRICAO").alias("NUM_INS"), F.col("NU_ANO").alias("ANO_ENEM"),
        F.concat(F.lit("rejected: "), "_reject_reason").alias("status"))
    return _place(spark, out).select("NUM_INS", "ANO_ENEM", F.lit("loaded").alias("status")).union(rejected)


@register("load_empty_reload", f"""
SELECT {_KEY} AS NUM_INS, '2018' AS ANO_ENEM FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderkey % 2 = 0
""")
def q_load_empty_reload(spark, sf):
    """Load editions 2018 and 2019, then reload 2019 from a file without rows:
    nothing of 2019 is left, 2018 stays."""
    o = T(spark, sf, "orders")
    out = scratch_path(spark, "load-empty")
    even, odd = o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1")
    exam.load_editions(spark, {2018: _write_exam_raw_standin(spark, sf, 2018, even),
                               2019: _write_exam_raw_standin(spark, sf, 2019, odd)}, out, tables=[PLACE])
    exam.load_editions(spark, {2019: _write_exam_raw_standin(spark, sf, 2019, odd.where("o_orderkey < 0"))}, out,
                       tables=[PLACE])
    return _place(spark, out).select("NUM_INS", "ANO_ENEM")


@register("csv_field_count", """
SELECT CAST(o_orderkey AS VARCHAR) AS A, o_orderstatus AS B,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS C,
       CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey || ';' || o_orderstatus
            WHEN o_orderkey % 13 = 0 THEN o_orderkey || ';' || o_orderstatus || ';' || o_orderpriority || ';' || o_custkey
       END AS malformed
FROM orders
""")
def q_csv_field_count(spark, sf):
    """Text lines with too few or too many fields are told from good ones."""
    o = T(spark, sf, "orders")
    key, status = F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    whole = F.concat_ws(";", key, status, "o_orderpriority")
    line = (F.when(F.col("o_orderkey") % 11 == 0, F.concat_ws(";", key, status))
            .when(F.col("o_orderkey") % 13 == 0, F.concat_ws(";", whole, "o_custkey")).otherwise(whole))
    path = scratch_path(spark, "field-count")
    o.select(line.alias("value")).write.text(path)
    return read_delimited(spark, path, ["A", "B", "C"], header=False, malformed_column="malformed")


@register("pk_load_rejects", """
WITH s AS (SELECT lpad(CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey // 2 END AS VARCHAR), 12, '0') AS NUM_INS
           FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT NUM_INS, count(*) - 1 AS n_rejected FROM s GROUP BY NUM_INS
""")
def q_pk_load_rejects(spark, sf):
    """Load an edition in which a key holds a third of the rows and others
    repeat: each key is loaded once, the rest are rejects."""
    o = T(spark, sf, "orders")
    key = F.lpad(F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey div 2 END").cast("string"), 12, "0")
    out = scratch_path(spark, "load-pk")
    exam.load_editions(spark, {2019: _write_exam_raw_standin(spark, sf, 2019, o, NU_INSCRICAO=key)}, out, tables=[PLACE])
    rejected = (exam.read_star_rejects(spark, f"{out}/curated").where("_reject_reason = 'NUM_INS: duplicate key'")
                .groupBy("NUM_INS").agg(F.count(F.lit(1)).alias("n")))
    return (_place(spark, out).join(rejected, "NUM_INS", "left")
            .select("NUM_INS", F.coalesce("n", F.lit(0)).alias("n_rejected")))


@register("load_interrupted", f"""
SELECT {_KEY} AS NUM_INS, CASE WHEN o_orderkey % 2 = 0 THEN '2018' ELSE '2019' END AS ANO_ENEM
FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderkey % 3 <> 0
""")
def q_load_interrupted(spark, sf):
    """Load editions 2018 and 2019, then a load of other rows that stops when
    all is written but nothing published: the former editions are read (K1)."""
    o = T(spark, sf, "orders")
    out = scratch_path(spark, "load-interrupted")
    kept = o.where("o_orderkey % 3 <> 0")
    paths = {2018: _write_exam_raw_standin(spark, sf, 2018, kept.where("o_orderkey % 2 = 0")),
             2019: _write_exam_raw_standin(spark, sf, 2019, kept.where("o_orderkey % 2 = 1"))}
    exam.load_editions(spark, paths, out, tables=[PLACE])
    exam.stage_editions(spark, {2019: _write_exam_raw_standin(spark, sf, 2019, o.where("o_orderkey % 3 = 0"))}, out, tables=[PLACE])
    return _place(spark, out).select("NUM_INS", "ANO_ENEM")


@register("pk_across_loads", f"""
SELECT {_KEY} AS NUM_INS, CASE WHEN o_orderkey % 2 = 0 THEN '2018' ELSE '2019' END AS ANO_ENEM, 'loaded' AS status
FROM orders WHERE o_orderpriority <> '5-LOW'
UNION ALL
SELECT {_KEY}, '2019', 'rejected: NUM_INS: duplicate key of another edition' FROM orders
WHERE o_orderpriority <> '5-LOW' AND o_orderkey % 2 = 0 AND o_orderkey % 5 < 2
""")
def q_pk_across_loads(spark, sf):
    """Load edition 2018, then an edition 2019 that holds some of its keys
    again: the stored rows stay, the late ones are rejects (K5)."""
    o = T(spark, sf, "orders")
    out = scratch_path(spark, "load-across")
    exam.load_editions(spark, {2018: _write_exam_raw_standin(spark, sf, 2018, o.where("o_orderkey % 2 = 0"))}, out, tables=[PLACE])
    again = o.where("o_orderkey % 2 = 1 OR o_orderkey % 5 < 2")
    exam.load_editions(spark, {2019: _write_exam_raw_standin(spark, sf, 2019, again)}, out, tables=[PLACE])
    rejected = exam.read_star_rejects(spark, f"{out}/curated").select(
        "NUM_INS", "ANO_ENEM", F.concat(F.lit("rejected: "), "_reject_reason").alias("status"))
    return _place(spark, out).select("NUM_INS", "ANO_ENEM", F.lit("loaded").alias("status")).union(rejected)


# --------------------------------------------------------------------------
# Star CSV round trip
# --------------------------------------------------------------------------

@register("csv_quoted_roundtrip", """
SELECT 'd' AS kind, doc_id AS id, 0 AS turn, text FROM documents
UNION ALL SELECT 'c', conv_id, turn, '"' || role || '"' || chr(9) || text FROM conversations
""")
def q_csv_quoted_roundtrip(spark, sf):
    """Whole texts with quotes, tabs and line breaks exported as a star file
    (UTF-8) and read back with the declared schema."""
    d = T(spark, sf, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"),
                                         F.lit(0).cast("long").alias("turn"), "text")
    c = T(spark, sf, "conversations").select(F.lit("c"), "conv_id", "turn", F.concat(
        F.lit('"'), "role", F.lit('"\t'), "text"))
    path = scratch_path(spark, "csv-quoted")
    rows = d.union(c)
    write_delimited(rows, path, sep="\t", encoding="UTF-8")
    return read_star_csv(spark, path, encoding="UTF-8", schema=rows.schema, multiline=True)


# --------------------------------------------------------------------------
# Dictionary filters
# --------------------------------------------------------------------------

@register("dictionary_filter", """
SELECT r_name AS TABELA, CAST(year(o_orderdate) AS VARCHAR) AS ANO, o_orderpriority AS CAMPO, count(*) AS n_rows
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
WHERE r_name IN ('ASIA', 'EUROPE') AND year(o_orderdate) BETWEEN 1996 AND 1998 AND o_orderpriority BETWEEN '2' AND '4'
GROUP BY ALL
""")
def q_dictionary_filter(spark, sf):
    """Workbook filters: table membership, a year range, a field-name range."""
    o, c, n, r = (T(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    listing = (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
               .join(r, n.n_regionkey == r.r_regionkey)
               .select(F.col("r_name").alias("TABELA"), F.year("o_orderdate").cast("string").alias("ANO"),
                       F.col("o_orderpriority").alias("CAMPO")))
    kept = filter_members(listing, tables=("ASIA", "EUROPE"), years=(1996, 1998), fields=("2", "4"))
    return kept.groupBy("TABELA", "ANO", "CAMPO").agg(F.count(F.lit(1)).alias("n_rows"))


# --------------------------------------------------------------------------
# One star table from all five editions' layouts
# --------------------------------------------------------------------------

@register("exam_place_flow", """
SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS NUM_INS, CAST(2015 + o_orderkey % 5 AS VARCHAR) AS ANO_ENEM,
       CAST(1400000 + o_custkey % 200 AS VARCHAR) AS COD_MUN_PRV
FROM orders WHERE o_orderpriority <> '5-LOW'
""")
def q_exam_place_flow(spark, sf):
    """Raw text of the editions 2015 to 2019, each in its own layout ->
    checked -> cleaned -> curated -> DIM_LOCAL_PROVA, loaded and read back."""
    o = T(spark, sf, "orders")
    out = scratch_path(spark, "load-place")
    paths = {y: _write_exam_raw_standin(spark, sf, y, o.where(F.col("o_orderkey") % 5 == y - 2015)) for y in exam.YEARS}
    exam.load_editions(spark, paths, out, tables=[PLACE])
    return _place(spark, out)
