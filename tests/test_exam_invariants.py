"""Star invariants and the notebook flow on editions staged from orders
(sf0.001: 1,500 candidates; 2018 layout before 1998, 2019 layout after)."""

import math

import pytest
from pyspark.sql import functions as F

from microstar.operators.quality import check_unique, split_rejects
from microstar.plans import analysis as A
from microstar.plans import catalog as C
from microstar.plans import exam
from microstar.plans.municipality import curate_municipality
from microstar.session import checkpoint_root
from microstar.spec import star as S

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def built(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    paths = {2018: C._write_exam_raw_standin(spark, SF, 2018, o.where(F.year("o_orderdate") < 1998)),
             2019: C._write_exam_raw_standin(spark, SF, 2019, o.where(F.year("o_orderdate") >= 1998))}
    cleaned = {y: exam.clean(exam.read_raw(spark, p, y), y) for y, p in paths.items()}
    checkpoint_root(spark)
    base = exam.curate(cleaned).checkpoint(eager=True)
    return base, exam.build_star(base)


def test_routing_counts(built):
    base, star = built
    n = base.count()
    assert n > 0
    assert star["DIM_CADASTRAL"].count() == n and star["DIM_PRESENCA"].count() == n
    assert star["FAT_NOTA"].count() == base.where(F.col("FL_PSC") == "Sim").count()
    assert star["DIM_ESCOLA"].count() == base.where(F.col("COD_ESC").isNotNull()).count()
    present = base.where(F.col("FL_PSC") == "Sim")
    answers = sum(present.where(F.col(cols[0]).isNotNull()).count() for cols in S.ANSWER_GROUPS.values())
    assert star["DIM_RSP_PRV"].count() == answers


def test_keys_unique_and_identity_dense(built):
    _, star = built
    for name, df in star.items():
        keys = ["NUM_INS", "AREA_CCN_ITEM"] if name == "DIM_RSP_PRV" else ["NUM_INS"]
        assert check_unique(df, keys).count() == 0, name
    pk = star["DIM_RSP_PRV"].agg(F.min("DIM_RSP_PRV_PK"), F.max("DIM_RSP_PRV_PK"),
                                 F.countDistinct("DIM_RSP_PRV_PK"), F.count(F.lit(1))).first()
    assert (pk[0], pk[1], pk[2]) == (1, pk[3], pk[3])


def test_mean_and_attendance_partition(built):
    base, star = built
    for r in split_rejects(star["FAT_NOTA"])[0].collect():
        total = r["NOT_CIE_NAT"] + r["NOT_CIE_HUM"] + r["NOT_LNG_COD"] + r["NOT_MAT"] + r["NOT_RDC"]
        assert math.isclose(r["NOT_MED"] * 5, total, rel_tol=1e-12)
    counts = {r[0]: r[1] for r in base.groupBy("COD_TPO_PSC").count().collect()}
    assert set(counts) <= {0, 1, 2} and sum(counts.values()) == base.count()
    zero = F.lit(True)
    for c in S.PRESENCE_FLAGS:
        zero = zero & (F.col(c) == "0")
    assert base.where(zero).count() == counts.get(0, 0)


def test_notebook_flow_end_to_end(spark, built, tmp_path):
    _, star = built
    good = {k: split_rejects(v)[0] for k, v in star.items()}
    mun = curate_municipality(spark.read.parquet(f"{SF}/customer.parquet").select(
        F.lpad(F.col("c_custkey").cast("string"), 7, "1").alias("COD_MUN_IBGE"),
        F.col("c_name").alias("NOM_MUN"), F.col("c_nationkey").cast("string").alias("UF")))
    tables = {"cadastral": good["DIM_CADASTRAL"], "ensino": good["DIM_ENSINO"], "presenca": good["DIM_PRESENCA"],
              "local": good["DIM_LOCAL_PROVA"], "socio": good["DIM_SOCIO_ECONOMICO"], "municipio": mun,
              "nota": good["FAT_NOTA"]}
    back = A.read_star_exports(spark, A.export_star_csv(tables, str(tmp_path / "star")))
    joined = A.join_star(back)
    present = good["DIM_PRESENCA"].where(F.col("DSC_TPO_PSC") == "Presente")
    expected = present.join(good["FAT_NOTA"], "NUM_INS").join(good["DIM_CADASTRAL"], "NUM_INS").count()
    assert joined.count() == expected
    ev = A.fit_and_evaluate(spark, joined)
    assert all(math.isfinite(w) for w in ev.model.weights)
    assert ev.scored.count() == joined.where(F.col("ANO_ENEM") == 2019).count()
    rate = ev.holdout_hit_rate.first()["percentual_acerto"]
    assert rate is None or 0.0 <= rate <= 100.0
    assert set(A.profile(joined.select(*A.FEATURES, "ANO_ENEM"))) >= {"summary", "corr", "histogram"}


def test_command_line_load_and_analysis(spark, built, tmp_path):
    from microstar.__main__ import main
    o = spark.read.parquet(f"{SF}/orders.parquet")
    p18 = C._write_exam_raw_standin(spark, SF, 2018, o.where(F.year("o_orderdate") < 1998))
    p19 = C._write_exam_raw_standin(spark, SF, 2019, o.where(F.year("o_orderdate") >= 1998))
    out = str(tmp_path / "lake")
    assert main(["load", "--edition", f"2018={p18}", "--edition", f"2019={p19}", "--out", out]) == 0
    cur = f"{out}/curated"
    mun = curate_municipality(spark.read.parquet(f"{SF}/customer.parquet").select(
        F.lpad(F.col("c_custkey").cast("string"), 7, "1").alias("COD_MUN_IBGE"),
        F.col("c_name").alias("NOM_MUN"), F.col("c_nationkey").cast("string").alias("UF")))
    tables = {k: (mun if k == "municipio" else exam.read_star_table(spark, cur, v)) for k, v in A.STAR_EXPORTS.items()}
    A.export_star_csv(tables, str(tmp_path / "export"))
    assert main(["analyse", "--star", str(tmp_path / "export"), "--report", str(tmp_path / "report")]) == 0
    assert spark.read.parquet(str(tmp_path / "report" / "model")).count() == len(A.FEATURES) + 1
