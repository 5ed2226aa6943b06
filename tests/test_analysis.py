"""Analysis plan: evaluation semantics, star join, exports, fit and hit rate."""

import pytest
from pyspark.sql import functions as F

from microstar.plans import analysis as A


def test_evaluation_golden_rows(spark):
    rows = [(0.0, 100.0),     # real 0: percentage null, counts as a miss
            (500.0, 500.7),   # prediction truncated to 500: exact
            (500.0, 554.5),   # 554 -> 10.8 % over -> band '0, 10'
            (1000.0, 691.0),  # 30.9 % under -> truncated to 30 -> hit
            (1000.0, 690.0),  # 31 % -> miss
            (100.0, 250.0)]   # 150 % -> '> 100'
    df = spark.createDataFrame(rows, "NOT_RDC double, PREVISAO double")
    ev = {(r["Nota_Real"], r["Nota_Prevista"]): r for r in A.evaluate(df).collect()}
    assert ev[(0.0, 100)]["Percentual_da_Diferenca"] is None and ev[(0.0, 100)]["Faixa_da_Diferenca"] is None
    assert ev[(0.0, 100)]["Tipo_da_Diferenca"] == "Atribuiu Nota Maior"
    assert (ev[(500.0, 500)]["Tipo_da_Diferenca"], ev[(500.0, 500)]["Faixa_da_Diferenca"]) == \
        ("Atribuiu Nota Exata", "0, 10")
    assert (ev[(500.0, 554)]["Diferenca"], ev[(500.0, 554)]["Percentual_da_Diferenca"]) == (54, 10)
    assert ev[(1000.0, 691)]["Percentual_da_Diferenca"] == 30
    assert ev[(1000.0, 691)]["Tipo_da_Diferenca"] == "Atribuiu Nota Menor"
    assert ev[(1000.0, 690)]["Faixa_da_Diferenca"] == "31, 40"
    assert ev[(100.0, 250)]["Faixa_da_Diferenca"] == "> 100"
    rate = A.hit_rate_sql(spark, A.evaluate(df), "t_eval").first()["percentual_acerto"]
    assert rate == pytest.approx(50.0)


def _star(spark):
    cad = spark.createDataFrame(
        [(f"{i:012d}", "2018" if i % 2 else "2019", 18 + i % 5, i % 2, "x", "x", "x", "x", "x", "x", "x",
          "x", "x", "x") for i in range(1, 7)],
        "NUM_INS string, ANO_ENEM string, IDD_INS int, COD_SEX int, " +
        ", ".join(f"{c} string" for c in A.CADASTRAL_DROPPED))
    pres = spark.createDataFrame([(f"{i:012d}", "Presente" if i != 2 else "Parcial") for i in range(1, 7)],
                                 "NUM_INS string, DSC_TPO_PSC string")
    nota = spark.createDataFrame([(f"{i:012d}", 500.0 + i, 510.0, 520.0, 530.0, 600.0 + i, 550.0)
                                  for i in range(1, 6)],
                                 "NUM_INS string, NOT_CIE_HUM double, NOT_CIE_NAT double, NOT_MAT double, "
                                 "NOT_LNG_COD double, NOT_RDC double, NOT_MED double")
    ens = spark.createDataFrame([(f"{i:012d}", None if i == 1 else "Somente em escola pública")
                                 for i in range(1, 4)], "NUM_INS string, TPO_ESC_ENS_MED_DET string")
    loc = spark.createDataFrame([(f"{i:012d}", "1400100") for i in range(1, 6)], "NUM_INS string, COD_MUN_PRV string")
    mun = spark.createDataFrame([("1400100", "Boa Vista", "RR", "N")],
                                "COD_MUN_IBGE string, NOM_MUN string, UF string, REG_UF string")
    socio = spark.createDataFrame([(f"{i:012d}", 1, 2, 3, 4, 5, 1) for i in range(1, 7)],
                                  "NUM_INS string, Q001 int, Q002 int, Q003 int, Q004 int, Q006 int, Q014 int")
    return {"cadastral": cad, "presenca": pres, "nota": nota, "ensino": ens, "local": loc,
            "municipio": mun, "socio": socio}


def test_join_star_semantics_and_plan(spark):
    t = _star(spark)
    t["cadastral"] = t["cadastral"].drop(*A.CADASTRAL_DROPPED)
    j = A.join_star(t)
    rows = {r["NUM_INS"]: r for r in j.collect()}
    assert set(rows) == {f"{i:012d}" for i in (1, 3, 4, 5)}   # 2 is partial, 6 has no grades
    assert rows[f"{4:012d}"]["TPO_ESC_ENS_MED_DET"] is None     # left join, no schooling row
    assert rows[f"{1:012d}"]["NOM_MUN"] == "Boa Vista"
    assert j.columns[:4] == ["NUM_INS", "ANO_ENEM", "IDD_INS", "COD_SEX"]
    plan = j._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_export_and_read_back(spark, tmp_path):
    t = _star(spark)
    paths = A.export_star_csv(t, str(tmp_path / "star"))
    back = A.read_star_exports(spark, paths)
    assert "DSC_SEX" not in back["cadastral"].columns
    g = {int(r["NUM_INS"]): r for r in back["nota"].collect()}      # inferred as a number
    assert g[1]["NOT_CIE_HUM"] == pytest.approx(501.0)
    assert dict(back["nota"].dtypes)["NOT_RDC"] == "double"
    e = {int(r["NUM_INS"]): r["TPO_ESC_ENS_MED_DET"] for r in back["ensino"].collect()}
    assert e[1] == ""                                  # null -> ''


def test_fit_and_evaluate_recovers_linear_rule(spark):
    n = 4000
    df = spark.range(n).select(
        "id", F.format_string("%012d", "id").alias("NUM_INS"),
        F.when(F.col("id") % 5 == 0, "2019").otherwise("2018").alias("ANO_ENEM"),
        (400 + (F.col("id") * 37) % 300).cast("double").alias("NOT_CIE_HUM"),
        (450 + (F.col("id") * 53) % 250).cast("double").alias("NOT_CIE_NAT"),
        (420 + (F.col("id") * 71) % 280).cast("double").alias("NOT_LNG_COD"),
        (380 + (F.col("id") * 29) % 320).cast("double").alias("NOT_MAT"))
    df = df.withColumn("NOT_RDC", 0.5 * F.col("NOT_CIE_HUM") + 0.3 * F.col("NOT_LNG_COD")
                       + 0.2 * F.col("NOT_MAT") + 20 + ((F.col("id") * 13) % 7 - 3)).drop("id")
    ev = A.fit_and_evaluate(spark, df)
    w = dict(zip(ev.model.features, ev.model.weights))
    assert w["NOT_CIE_HUM"] == pytest.approx(0.5, abs=0.02)
    assert w["NOT_LNG_COD"] == pytest.approx(0.3, abs=0.02)
    assert ev.holdout_hit_rate.first()["percentual_acerto"] == pytest.approx(100.0)
    assert ev.scored.count() == n // 5
    assert 0.15 < ev.holdout.count() / (n - n // 5) < 0.35      # ~25 % hold-out
