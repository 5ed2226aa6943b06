"""Analysis of the star: join, profile, fit, score, evaluate.

The reference pulled the joined table into one driver-side frame for
profiling and model fitting.  Here every step stays a Spark job: the
profile is a handful of aggregations, the fit is an iterated aggregation
of cross-products (d = 4 features, so only 5x5 numbers reach the driver),
and scoring/evaluation are column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from microstar.functions import comma_decimal, evaluation_columns
from microstar.functions.evaluation import hit_rate
from microstar.operators.join import bounded_broadcast, star_join
from microstar.operators.ml import LinearModel, fit_linear_svr, hash_split, score_linear
from microstar.operators.profile import profile_corr, profile_histograms, profile_summary, profile_topk
from microstar.operators.project import drop_columns, null_to_empty
from microstar.session import scratch_path
from microstar.sources.delimited import read_star_csv, write_delimited

# Fixed values of the analysis.
CADASTRAL_DROPPED = ["COD_MUN_NSC", "COD_MUN_RSD", "FL_IDS", "FL_NOM_SCL", "FL_INS_TRE", "COD_NAC", "DSC_NAC",
                     "DSC_SEX", "DSC_RCA", "DSC_EST_CVL"]
GRADE_COLUMNS = ["NOT_CIE_HUM", "NOT_CIE_NAT", "NOT_MAT", "NOT_LNG_COD", "NOT_RDC", "NOT_MED"]
FEATURES = ["NOT_CIE_HUM", "NOT_CIE_NAT", "NOT_LNG_COD", "NOT_MAT"]
LABEL = "NOT_RDC"
PRESENT = "Presente"
LAST_TRAIN_YEAR = 2018
SCORED_YEAR = 2019
JOINED_EXTRA = ["TPO_ESC_ENS_MED_DET", "NOM_MUN", "UF", "REG_UF", "Q001", "Q002", "Q003", "Q004", "Q006",
                "Q014", "NOT_CIE_HUM", "NOT_CIE_NAT", "NOT_MAT", "NOT_LNG_COD", "NOT_RDC", "NOT_MED"]
STAR_EXPORTS = {"cadastral": "DIM_CADASTRAL", "ensino": "DIM_ENSINO", "presenca": "DIM_PRESENCA",
                "local": "DIM_LOCAL_PROVA", "socio": "DIM_SOCIO_ECONOMICO", "municipio": "DIM_IBGE_MUNICIPIO",
                "nota": "FAT_NOTA"}


def export_star_csv(tables: dict[str, DataFrame], out_dir: str) -> dict[str, str]:
    """Export star tables as the analysis reads them: tab-separated,
    ISO-8859-1, header, grades with a decimal comma."""
    paths = {}
    for name, df in tables.items():
        cols = [F.regexp_replace(F.col(c).cast("string"), "\\.", ",").alias(c) if c in GRADE_COLUMNS else F.col(c)
                for c in df.columns]
        paths[name] = f"{out_dir}/{name}"
        write_delimited(df.select(cols), paths[name], sep="\t")
    return paths


def read_star_exports(spark: SparkSession, paths: dict[str, str],
                      schemas: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Read the exported star (S6), with the given ``schemas`` or inferred
    types (one more pass over the text, so give them at scale), then: drop ten
    cadastral columns (P8), null -> '' on the school detail (P7), parse the
    comma-decimal grades rounded to 2 (X15)."""
    t = {k: read_star_csv(spark, p, schema=(schemas or {}).get(k)) for k, p in paths.items()}
    t["cadastral"] = drop_columns(t["cadastral"], CADASTRAL_DROPPED)
    t["ensino"] = null_to_empty(t["ensino"].withColumn("TPO_ESC_ENS_MED_DET",
                                                       F.col("TPO_ESC_ENS_MED_DET").cast("string")),
                                ["TPO_ESC_ENS_MED_DET"])
    t["nota"] = t["nota"].withColumns({c: comma_decimal(c, 2) for c in GRADE_COLUMNS})
    return t


def read_star(spark: SparkSession, star_dir: str) -> dict[str, DataFrame]:
    """The exported star under ``star_dir`` (one sub-folder per table)."""
    return read_star_exports(spark, {k: f"{star_dir}/{k}" for k in STAR_EXPORTS})


def join_star(t: dict[str, DataFrame]) -> DataFrame:
    """Candidates present at every exam with grades, enriched by schooling,
    exam place, municipality and socio-economic answers (J1-J4, F6, P9).

    Inner joins to presence (predicate inside the condition) and grades,
    left joins to the others; the municipality list is reached through the
    exam-place bridge key and broadcast after a row-count check.  The
    large joins are equi-joins on NUM_INS: with AQE, a skewed key is split.
    """
    a = t["cadastral"].alias("a")
    b = t["presenca"].alias("b")
    c = t["nota"].alias("c")
    d = t["ensino"].alias("d")
    e = t["local"].alias("e")
    f = bounded_broadcast(t["municipio"]).alias("f")
    g = t["socio"].alias("g")
    k = F.col("a.NUM_INS")
    return star_join(a, [
        (b, (k == F.col("b.NUM_INS")) & (F.col("b.DSC_TPO_PSC") == PRESENT), "inner"),
        (c, k == F.col("c.NUM_INS"), "inner"),
        (d, k == F.col("d.NUM_INS"), "left"),
        (e, k == F.col("e.NUM_INS"), "left"),
        (f, F.col("e.COD_MUN_PRV") == F.col("f.COD_MUN_IBGE"), "left"),
        (g, k == F.col("g.NUM_INS"), "left"),
    ], select=["a.*"] + [F.col(x) for x in JOINED_EXTRA])


def profile(df: DataFrame, numeric: list[str] | None = None, categorical: list[str] | None = None,
            exact_distinct: bool = False) -> dict[str, DataFrame]:
    """Profile report as DataFrames (A7): summary, histograms, correlations, top values."""
    numeric = numeric or [c for c, t in df.dtypes if t in ("int", "bigint", "double", "float")]
    categorical = categorical or [c for c, t in df.dtypes if t == "string"]
    out = {"summary": profile_summary(df, numeric, categorical, exact_distinct=exact_distinct,
                                      quantiles=(0.25, 0.5, 0.75)),
           "topk": profile_topk(df, categorical, k=10) if categorical else None}
    if len(numeric) >= 2:
        out["corr"] = profile_corr(df, numeric)
    if numeric:
        out["histogram"] = profile_histograms(df, numeric)
    return out


@dataclass
class Evaluation:
    model: LinearModel
    holdout: DataFrame
    holdout_hit_rate: DataFrame
    scored: DataFrame
    scored_hit_rate: DataFrame


def evaluate(scored: DataFrame, truth: str = LABEL, pred: str = "PREVISAO") -> DataFrame:
    """Evaluation table: real, predicted, difference, sign, percentage, band (M5)."""
    ev = evaluation_columns(truth, pred)
    return scored.select(*[e.alias(n) for n, e in ev.items()])


def hit_rate_sql(spark: SparkSession, evaluation: DataFrame, view: str) -> DataFrame:
    """Share of predictions within 30 % of the real grade, as the ratio of two
    scalar-subquery counts over a temp view (K7, A1, A2)."""
    evaluation.createOrReplaceTempView(view)
    return spark.sql(f"""
        SELECT (SELECT count(1) FROM {view} WHERE Percentual_da_Diferenca <= 30)
             / (SELECT count(1) FROM {view}) * 100 AS percentual_acerto""")


def fit_and_evaluate(spark: SparkSession, joined: DataFrame, last_train_year: int = LAST_TRAIN_YEAR,
                     scored_year: int = SCORED_YEAR) -> Evaluation:
    """Train on editions up to ``last_train_year`` (F5) with a 75/25 md5
    split on the candidate id (M1), fit (M2), score the hold-out and the
    scored edition (M3, M4), evaluate both (M5)."""
    year = F.col("ANO_ENEM").cast("int")
    cols = ["NUM_INS"] + FEATURES + [LABEL]
    # the star join runs once: fit, both scorings and both hit rates read its written, pruned result
    path = scratch_path(spark, "joined-star")
    joined.select(year.alias("ANO_ENEM"), *cols).write.parquet(path)
    joined, year = spark.read.parquet(path), F.col("ANO_ENEM")
    train_full = hash_split(joined.where(year <= last_train_year).select(*cols), ["NUM_INS"])
    model = fit_linear_svr(train_full.where(F.col("split") == "train"), FEATURES, LABEL)
    holdout = evaluate(score_linear(train_full.where(F.col("split") == "test"), model))
    scored = evaluate(score_linear(joined.where(year == scored_year).select(*cols), model))
    rate = lambda frame: frame.agg(hit_rate("Percentual_da_Diferenca").alias("percentual_acerto"))
    return Evaluation(model, holdout, rate(holdout), scored, rate(scored))
