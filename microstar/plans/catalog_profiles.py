"""Query catalog, part three: stored profiles, quantiles, bitmaps, bucketed joins, the notebook flow.

Like ``catalog``: stand-in inputs are projections of the given tables, the
work is the library's own code, and every key has DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from microstar.operators.join import bounded_broadcast, star_join
from microstar.operators.profile import profile_histograms
from microstar.operators.profile_merge import (edition_bitmaps, edition_profile, exact_quantiles, merged_crosstab, merged_profile)
from microstar.plans.catalog import DOW, PROFILE_DIGITS, T, register
from microstar.session import scratch_path
from microstar.sources.bucketed import read_bucketed, write_star_bucketed

# --------------------------------------------------------------------------
# profile
# --------------------------------------------------------------------------

MERGED_NUMERIC = ["l_linenumber", "l_quantity", "l_discount", "l_tax"]
MERGED_OTHER = ["l_returnflag", "l_linestatus"]


@register("profile_merged", "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_nulls, count(DISTINCT {c}) AS distinct_values, "
    + (f"CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi, round(avg({c}), {PROFILE_DIGITS}) AS mean"
       if c in MERGED_NUMERIC else "CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi, CAST(NULL AS DOUBLE) AS mean")
    + " FROM lineitem" for c in MERGED_NUMERIC + MERGED_OTHER))
def q_profile_merged(spark, sf):
    """Profiles of the ship years stored one by one, then merged without reading
    a row again (A7).  Distinct counts are HyperLogLog estimates (within 5 %:
    three standard errors of 2**12 registers); these columns have few values,
    which a sketch counts exactly."""
    path = scratch_path(spark, "stored-profile")
    rows = T(spark, sf, "lineitem").withColumn("edition", F.year("l_shipdate"))
    # two loads: the later one adds its editions
    for part in (F.col("edition") < 1995, F.coalesce(F.col("edition") >= 1995, F.lit(True))):
        edition_profile(rows.where(part), "edition", MERGED_NUMERIC, MERGED_OTHER).write.mode("append").parquet(path)
    merged = merged_profile(spark.read.parquet(path))
    return merged.withColumnRenamed("distinct", "distinct_values").withColumn("mean", F.round("mean", PROFILE_DIGITS))


QUANTILE_COLUMNS, SHARES = ["l_quantity", "l_extendedprice", "l_partkey"], [0.05, 0.25, 0.5, 0.75, 0.99]


@register("profile_quantiles", "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({p} AS DOUBLE) AS share, CAST(quantile_disc({c}, {p}) AS DOUBLE) AS value FROM lineitem"
    for c in QUANTILE_COLUMNS for p in SHARES))
def q_profile_quantiles(spark, sf):
    """Exact quantiles by counting ranges, without a sort."""
    return exact_quantiles(T(spark, sf, "lineitem"), QUANTILE_COLUMNS, SHARES)


HISTOGRAM_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@register("profile_histograms", "\nUNION ALL ".join(f"""
SELECT '{c}' AS column_name, bucket, round(lo + bucket * width, {PROFILE_DIGITS}) AS lo,
       round(lo + (bucket + 1) * width, {PROFILE_DIGITS}) AS hi, count(*) AS n_rows
FROM (SELECT CAST(least(floor(({c} - lo) / width), 9) AS INTEGER) AS bucket, lo, width FROM lineitem,
      (SELECT CAST(min({c}) AS DOUBLE) AS lo, CASE WHEN max({c}) > min({c}) THEN (max({c}) - min({c})) / 10.0 ELSE 1.0 END AS width FROM lineitem)
      WHERE {c} IS NOT NULL) GROUP BY bucket, lo, width""" for c in HISTOGRAM_COLUMNS))
def q_profile_histograms(spark, sf):
    """Equal-width histograms of all numeric columns in two scans."""
    return profile_histograms(T(spark, sf, "lineitem"), HISTOGRAM_COLUMNS, 10, digits=PROFILE_DIGITS)


# --------------------------------------------------------------------------
# A4: crosstab of stored bitmaps
# --------------------------------------------------------------------------

@register("lineage_crosstab_merged", "SELECT event_type, " + ", ".join(
    f"count(DISTINCT user_id) FILTER (WHERE dayofweek(ts) + 1 = {d}) AS dow_{d}" for d in DOW)
    + " FROM events GROUP BY event_type")
def q_lineage_crosstab_merged(spark, sf):
    """COUNT(DISTINCT user) by event type x weekday from bitmaps stored a month
    at a time and merged (A4, N2): no event is read again."""
    path = scratch_path(spark, "stored-bitmaps")
    events = T(spark, sf, "events").select("event_type", "user_id", F.dayofweek("ts").alias("dow"), F.date_format("ts", "yyyy-MM").alias("month"))
    edition_bitmaps(events, "month", ["event_type"], "dow", "user_id").write.parquet(path)
    return merged_crosstab(spark.read.parquet(path), ["event_type"], "dow", DOW, {d: f"dow_{d}" for d in DOW})


# --------------------------------------------------------------------------
# The star join on a bucketed star
# --------------------------------------------------------------------------

@register("star_join_bucketed", """
SELECT a.*, c.l_linenumber, c.l_quantity, n.n_name
FROM orders a JOIN lineitem c ON a.o_orderkey = c.l_orderkey AND c.l_returnflag = 'R'
JOIN customer b ON a.o_custkey = b.c_custkey LEFT JOIN nation n ON b.c_nationkey = n.n_nationkey
""")
def q_star_join_bucketed(spark, sf):
    """Orders and lineitem bucketed and sorted by the order key: their join
    needs no exchange (J1, J3); the bridge to nation is broadcast (J4)."""
    orders, lines = T(spark, sf, "orders"), T(spark, sf, "lineitem")
    names = write_star_bucketed({"orders_b": orders, "lineitem_b": lines}, {"orders_b": "o_orderkey", "lineitem_b": "l_orderkey"}, lines.count())
    a, c = (read_bucketed(spark, names[t]).alias(x) for t, x in (("orders_b", "a"), ("lineitem_b", "c")))
    b = T(spark, sf, "customer").select("c_custkey", "c_nationkey").alias("b")
    n = bounded_broadcast(T(spark, sf, "nation")).alias("n")
    return star_join(a, [
        (c.hint("merge"), (F.col("a.o_orderkey") == F.col("c.l_orderkey")) & (F.col("c.l_returnflag") == "R"), "inner"),
        (b, F.col("a.o_custkey") == F.col("b.c_custkey"), "inner"),
        (n, F.col("b.c_nationkey") == F.col("n.n_nationkey"), "left"),
    ], select=["a.*", "c.l_linenumber", "c.l_quantity", "n.n_name"])


# --------------------------------------------------------------------------
# M5: the notebook flow, from exported text to the evaluated edition
# --------------------------------------------------------------------------

_GRADES_SQL = """
SELECT *, h + n + l + m0 + (h + n + l + m0 + 1) % 2 AS total FROM (
  SELECT o_orderkey, o_custkey, o_orderstatus, 400 + o_custkey % 300 AS h, 350 + (o_orderkey * 7) % 400 AS n,
         380 + (o_custkey * 3) % 320 AS l, 300 + (o_orderkey * 13) % 500 AS m0 FROM orders)"""


@register("notebook_flow", f"""
WITH g AS ({_GRADES_SQL}),
s AS (SELECT CAST(200 + 2 * ((o_custkey * 11) % 400) AS DOUBLE) AS real, CAST(trunc(total / 4.0) AS INTEGER) AS pred
      FROM g WHERE o_orderkey % 5 = 4 AND o_orderstatus <> 'P' AND o_orderkey % 17 <> 0),
d AS (SELECT *, real - pred AS diff, pred / real * 100 AS ratio FROM s),
p AS (SELECT *, CAST(trunc(CASE WHEN diff < 0 THEN ratio - 100 WHEN diff > 0 THEN 100 - ratio ELSE 0.0 END) AS INTEGER) AS pct FROM d)
SELECT real AS Nota_Real, pred AS Nota_Prevista, CAST(trunc(abs(diff)) AS INTEGER) AS Diferenca,
       CASE WHEN diff < 0 THEN 'Atribuiu Nota Maior' WHEN diff > 0 THEN 'Atribuiu Nota Menor' ELSE 'Atribuiu Nota Exata' END AS Tipo_da_Diferenca,
       pct AS Percentual_da_Diferenca,
       CASE WHEN pct BETWEEN 0 AND 10 THEN '0, 10' WHEN pct BETWEEN 11 AND 20 THEN '11, 20' WHEN pct BETWEEN 21 AND 30 THEN '21, 30'
            WHEN pct BETWEEN 31 AND 40 THEN '31, 40' WHEN pct BETWEEN 41 AND 50 THEN '41, 50' WHEN pct BETWEEN 51 AND 60 THEN '51, 60'
            WHEN pct BETWEEN 61 AND 70 THEN '61, 70' WHEN pct BETWEEN 71 AND 80 THEN '71, 80' WHEN pct BETWEEN 81 AND 90 THEN '81, 90'
            WHEN pct BETWEEN 91 AND 100 THEN '91, 100' WHEN pct > 100 THEN '> 100' ELSE NULL END AS Faixa_da_Diferenca,
       round(100.0 * count(*) FILTER (WHERE pct <= 30) OVER () / count(*) OVER (), 6) AS percentual_acerto
FROM p
""")
def q_notebook_flow(spark, sf):
    """The analysis from end to end (M5): star tables exported as text with
    decimal commas, read back, joined, the model fitted on the editions up to
    2018 and the 2019 edition scored and evaluated.  The grades of the earlier
    editions follow a planted rule (a quarter of the sum of the four), so what
    the fitted model must predict for 2019 is known."""
    from microstar.plans import analysis as A
    o = T(spark, sf, "orders")
    key = F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("NUM_INS")
    year = (F.lit(2015) + F.col("o_orderkey") % 5).cast("string").alias("ANO_ENEM")
    g = o.selectExpr("*", "400 + o_custkey % 300 AS h", "350 + (o_orderkey * 7) % 400 AS n", "380 + (o_custkey * 3) % 320 AS l",
                     "300 + (o_orderkey * 13) % 500 AS m0").selectExpr("*", "m0 + (h + n + l + m0 + 1) % 2 AS m")
    essay = F.expr("IF(o_orderkey % 5 = 4, CAST(200 + 2 * ((o_custkey * 11) % 400) AS DOUBLE), (h + n + l + m) / 4.0D)")
    tables = {
        "cadastral": o.select(key, year, F.lit(20).alias("IDD_INS"), F.lit(1).alias("COD_SEX"), *[F.lit("x").alias(c) for c in A.CADASTRAL_DROPPED]),
        "presenca": o.select(key, F.when(F.col("o_orderstatus") == "P", "Parcial").otherwise(A.PRESENT).alias("DSC_TPO_PSC")),
        "nota": g.where("o_orderkey % 17 <> 0").select(
            key, F.col("h").cast("double").alias("NOT_CIE_HUM"), F.col("n").cast("double").alias("NOT_CIE_NAT"),
            F.col("l").cast("double").alias("NOT_LNG_COD"), F.col("m").cast("double").alias("NOT_MAT"), essay.alias("NOT_RDC"), essay.alias("NOT_MED")),
        "ensino": o.where("o_orderkey % 3 = 0").select(key, F.lit(None).cast("string").alias("TPO_ESC_ENS_MED_DET")),
        "local": o.select(key, F.lpad((F.col("o_custkey") % 50).cast("string"), 7, "0").alias("COD_MUN_PRV")),
        "municipio": T(spark, sf, "customer").where("c_custkey < 50").select(
            F.lpad(F.col("c_custkey").cast("string"), 7, "0").alias("COD_MUN_IBGE"), F.col("c_name").alias("NOM_MUN"), F.lit("RR").alias("UF"), F.lit("N").alias("REG_UF")),
        "socio": o.select(key, *[F.lit(1).alias(q) for q in ("Q001", "Q002", "Q003", "Q004", "Q006", "Q014")]),
    }
    back = A.read_star_exports(spark, A.export_star_csv(tables, scratch_path(spark, "notebook-star")))
    found = A.fit_and_evaluate(spark, A.join_star(back))
    rate = found.scored_hit_rate.first()[0]  # one number
    return found.scored.withColumn("percentual_acerto", F.round(F.lit(rate).cast("double"), 6))


# --------------------------------------------------------------------------
# The two star tables that the other flows do not reach
# --------------------------------------------------------------------------

_CONDITIONS = """FL_AUT FL_BXA_VIS FL_CEG FL_DEF_AUD FL_DEF_FIS FL_DEF_MTL FL_DFC_ATC FL_DIS FL_DLX FL_GST FL_LAC FL_MDC FL_MDD_GLC
FL_MRC_PSS FL_MSA_CAD_RDA FL_OUT_DEF FL_PTT_AUR FL_SBT FL_SDZ FL_SDZ_CEG FL_SND FL_VIS_MON""".split()


def _condition_sql(year: int, rows: str, own: dict[str, str]) -> str:
    return (f"SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS NUM_INS, '{year}' AS ANO_ENEM, "
            + ", ".join(f"CAST({own.get(c, 'NULL')} AS INTEGER) AS {c}" for c in _CONDITIONS)
            + f" FROM orders WHERE o_orderpriority <> '5-LOW' AND {rows}")


@register("exam_condition_flow",
          _condition_sql(2016, "o_orderkey % 2 = 0 AND (o_orderkey % 11 = 0 OR o_custkey % 13 = 0 OR o_custkey % 7 = 1)", {
              "FL_AUT": "CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END", "FL_SBT": "CASE WHEN o_custkey % 13 = 0 THEN 1 ELSE 0 END",
              "FL_GST": "CASE WHEN o_custkey % 7 = 1 THEN 1 WHEN o_custkey % 7 = 2 THEN NULL ELSE 0 END"})
          + "\nUNION ALL " + _condition_sql(2018, "o_orderkey % 2 = 1 AND (o_orderkey % 11 = 0 OR o_custkey % 7 = 1)", {
              "FL_AUT": "CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END", "FL_SBT": "0",
              "FL_GST": "CASE WHEN o_custkey % 7 = 1 THEN 1 WHEN o_custkey % 7 = 2 THEN NULL ELSE 0 END"}))
def q_exam_condition_flow(spark, sf):
    """Raw text -> ... -> DIM_CONDICAO_ESPECIAL of the editions 2016 (its own
    sabbath flag) and 2018 (the flag is the constant 0): routed when any of the
    22 special conditions is set; a null flag is not set."""
    from microstar.operators.quality import split_rejects
    from microstar.plans.catalog import _exam_star
    o = T(spark, sf, "orders")
    flag = lambda cond: F.when(F.expr(cond), "1").otherwise("0")
    cells = {"IN_AUTISMO": flag("o_orderkey % 11 = 0"), "IN_SABATISTA": flag("o_custkey % 13 = 0"),
             "IN_GESTANTE": F.expr("CASE o_custkey % 7 WHEN 1 THEN '1' WHEN 2 THEN '-' ELSE '0' END")}
    parts = [split_rejects(_exam_star(spark, sf, "DIM_CONDICAO_ESPECIAL", year, o.where(F.col("o_orderkey") % 2 == year // 2 % 2), **cells))[0]
             for year in (2016, 2018)]
    return parts[0].unionByName(parts[1])


_STUDY = ("CASE {q} WHEN 0 THEN 'Não sei' WHEN 1 THEN 'Não estudou' WHEN 2 THEN 'Da 1ª à 4ª série do Ensino Fundamental (antigo primário)' "
          "WHEN 3 THEN 'Não completou a 4ª série/5º ano do Ensino Fundamental.' WHEN 5 THEN 'Ensino Médio Incompleto' "
          "WHEN 6 THEN 'Ensino Médio Completo' WHEN 7 THEN 'Ensino Superior Incompleto' WHEN 8 THEN 'Ensino Superior' "
          "WHEN 9 THEN 'Pós-graduação' ELSE '' END")
_YES_NO_SQL = "CASE {q} WHEN 0 THEN 'Não' WHEN 1 THEN 'Sim' ELSE '' END"

#: Question of the star: its code from the staged letters, and its label.
_SOCIO_SQL = {
    1: ("CASE o_custkey % 9 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 5 WHEN 4 THEN 7 WHEN 5 THEN 8 WHEN 6 THEN 9 WHEN 7 THEN 0 END", _STUDY),
    2: ("CASE o_orderkey % 9 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 5 WHEN 4 THEN 6 WHEN 5 THEN 7 WHEN 6 THEN 8 WHEN 7 THEN 0 END", _STUDY),
    13: ("CASE WHEN o_custkey % 20 < 3 THEN 1 WHEN o_custkey % 20 < 7 THEN 2 WHEN o_custkey % 20 < 10 THEN 3 ELSE 4 END",
         "CASE {q} WHEN 1 THEN 'Uma a três' WHEN 2 THEN 'Quatro a sete' WHEN 3 THEN 'Oito a dez' WHEN 4 THEN 'Mais de dez' ELSE '' END"),
    14: ("o_orderkey % 2", _YES_NO_SQL),
    16: ("CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE 1 END", _YES_NO_SQL),
    33: ("CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 1 END", _YES_NO_SQL),
}


def _socio_columns() -> str:
    out = []
    for n in range(1, 93):
        code, label = _SOCIO_SQL.get(n, (None, None))
        if code:
            out.append(f"CAST(q{n} AS INTEGER) AS Q{n:03d}, {label.format(q=f'q{n}')} AS DSC_Q{n:03d}")
        else:
            kind = "VARCHAR" if n in (27, 35) else "INTEGER"
            out.append(f"CAST(NULL AS {kind}) AS Q{n:03d}" + ("" if 73 <= n <= 91 else f", '' AS DSC_Q{n:03d}"))
    return ",\n  ".join(out)


@register("exam_socio_flow", f"""
WITH s AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS NUM_INS, {', '.join(f'{c} AS q{n}' for n, (c, _) in _SOCIO_SQL.items())}
           FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT NUM_INS, '2019' AS ANO_ENEM,
  {_socio_columns()}
FROM s
""")
def q_exam_socio_flow(spark, sf):
    """Raw text -> ... -> DIM_SOCIO_ECONOMICO of 2019 (167 columns): questions
    renamed and crossed (Q001 and Q002 change places), letters recoded to the
    standard codes, labels; questions the edition lacks are null, labelled ''."""
    from microstar.operators.quality import split_rejects
    from microstar.plans.catalog import _exam_star
    letter = lambda e: F.expr(f"CASE WHEN {e} = 8 THEN '-' ELSE chr(65 + {e}) END")
    cells = {"Q002": letter("o_custkey % 9"), "Q001": letter("o_orderkey % 9"), "Q005": F.expr("CAST(1 + o_custkey % 20 AS STRING)"),
             "Q025": F.expr("chr(65 + o_orderkey % 2)"), "Q008": F.expr("chr(65 + o_custkey % 5)"), "Q007": F.expr("chr(65 + o_orderkey % 4)")}
    good, _ = split_rejects(_exam_star(spark, sf, "DIM_SOCIO_ECONOMICO", **cells))
    return good


# --------------------------------------------------------------------------
# The stored dictionary
# --------------------------------------------------------------------------

@register("dictionary_stored", r"""
WITH f AS (SELECT 'T_' || p_size % 7 AS TABELA, p_partkey AS SEQUENCIA, 'COD_' || p_size || '_X' || p_partkey % 3 AS CAMPO FROM part),
t AS (SELECT 'T_' || r_regionkey AS TABELA, r_name || chr(10) || '"' || r_regionkey || '"' AS DESCRICAO_TABELA, 'DIM' AS TIPO_TABELA FROM region),
d AS (SELECT DISTINCT 'COD_' || s_nationkey || '_X1' AS CAMPO, s_nationkey FROM supplier),
m AS (SELECT 'X' || n_nationkey AS MNEMONICO, n_name AS DESCRICAO FROM nation WHERE n_nationkey < 2)
SELECT f.TABELA, DESCRICAO_TABELA, TIPO_TABELA, CAST(f.SEQUENCIA AS INTEGER) AS SEQUENCIA, f.CAMPO,
       CASE WHEN d.CAMPO IS NOT NULL THEN 'campo ' || s_nationkey END AS DESCRICAO_CAMPO_CLEANED,
       CASE WHEN d.CAMPO IS NOT NULL THEN 'INT' END AS TIPO_DADOS, CAST(s_nationkey + 1 AS INTEGER) AS TAMANHO,
       'Código ' || split_part(f.CAMPO, '_', 2) || ' ' || coalesce(m.DESCRICAO, split_part(f.CAMPO, '_', 3)) AS NOME_EXTENSO
FROM f LEFT JOIN t ON f.TABELA = t.TABELA LEFT JOIN d ON f.CAMPO = d.CAMPO LEFT JOIN m ON split_part(f.CAMPO, '_', 3) = m.MNEMONICO
""")
def q_dictionary_stored(spark, sf):
    """Dictionary sheets as delimited text (staged from part, region, supplier
    and nation), read back with their types; fields with the descriptions of
    their table and their own, and their names spelled out by mnemonics."""
    from microstar.plans.dictionary import described_fields, read_dictionary, spelled_names
    from microstar.sources.delimited import write_delimited
    folder = scratch_path(spark, "dictionary")
    sheets = {
        "CAMPOS_CURATED": T(spark, sf, "part").selectExpr("concat('T_', p_size % 7) AS TABELA", "CAST(p_partkey AS INT) AS SEQUENCIA",
                                                          "concat('COD_', p_size, '_X', p_partkey % 3) AS CAMPO"),
        "TABELAS_CURATED": T(spark, sf, "region").selectExpr("concat('T_', r_regionkey) AS TABELA",
                                                             "concat(r_name, chr(10), '\"', r_regionkey, '\"') AS DESCRICAO_TABELA", "'DIM' AS TIPO_TABELA"),
        "DESCRICAO_CAMPOS_CURATED": T(spark, sf, "supplier").selectExpr(
            "concat('COD_', s_nationkey, '_X1') AS NOME_CAMPO_CLEANED", "concat('campo ', s_nationkey) AS DESCRICAO_CAMPO_CLEANED", "'INT' AS TIPO_DADOS",
            "CAST(s_nationkey + 1 AS INT) AS TAMANHO").distinct(),
        "MNEMONICOS": T(spark, sf, "nation").where("n_nationkey < 2").selectExpr("concat('X', n_nationkey) AS MNEMONICO", "n_name AS DESCRICAO")
                       .union(spark.sql("SELECT 'COD', 'Código'")),
    }
    for name, frame in sheets.items():
        write_delimited(frame, f"{folder}/{name}", sep="\t", encoding="UTF-8")
    stored = read_dictionary(spark, folder)
    fields = described_fields(stored)
    return fields.join(spelled_names(fields, stored["MNEMONICOS"]), "CAMPO")
