"""Golden domain tests: every recode pair of every edition and every label
pair is one row; expected values come from the specs (SURVEY App. A, E)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from microstar.operators.ml import fit_linear_svr
from microstar.plans import exam
from microstar.spec import labels as L
from microstar.spec.recodes import recodes_for
from tests import exam_fixtures as X


@pytest.mark.parametrize("year", exam.YEARS)
def test_every_recode_pair(spark, year):
    cols = exam.curated_input_columns()
    cases = [(c, src, dst) for c, m in recodes_for(year).items() for src, dst in m.items()]
    cases += [(c, src.lower(), dst) for c, m in recodes_for(year).items() for src, dst in m.items()
              if src.isalpha()][:5]                                    # lower-case input
    cases += [(c, "ZZ", "ZZ") for c in recodes_for(year)]               # unknown code passes
    rows = []
    for i, (c, src, _) in enumerate(cases):
        r = {k: None for k in cols}
        r.update(NUM_INS=f"{i:012d}", ANO_ENEM=str(year), UF_PRV="RR", **{c: src})
        rows.append(tuple(r[k] for k in cols))
    df = spark.createDataFrame(rows, ", ".join(f"`{k}` string" for k in cols))
    out = exam.curate_year(df, year).select("NUM_INS", *sorted(recodes_for(year))).collect()
    got = {r["NUM_INS"]: r for r in out}
    for i, (c, src, dst) in enumerate(cases):
        assert got[f"{i:012d}"][c] == dst, (year, c, src)


def test_every_label_pair(spark):
    cases = [(t, s, code, lab) for t, s, name in L.CODE_LABELS for code, lab in L.LABELS[name].items()
             if not (t == "DSC_EST_CVL")]
    cases += [(t, s, code, lab) for t, s in L.YES_NO_LABELS for code, lab in L.YES_NO.items()]
    cases += [(t, s, "99", "") for t, s, _ in L.CODE_LABELS]               # unmatched -> ''
    sources = sorted({s for _, s, _, _ in cases} | {"Q048", "Q044"} | set(exam.S.PRESENCE_FLAGS)
                     | set(exam.S.GRADES) | {"ANO_ENEM"})
    flags = sorted(set(exam.S.SPECIAL_CONDITION_FLAGS) | set(exam.S.resource_flags(2015))
                   | set(exam.S.LARGE_PRINT_FLAGS))
    allcols = sorted(set(sources) | set(flags))
    rows = []
    for i, (t, s, code, _) in enumerate(cases):
        r = {k: None for k in allcols}
        r.update(ANO_ENEM="2019", **{s: code})
        rows.append(tuple(r[k] for k in allcols))
    df = spark.createDataFrame(rows, ", ".join(f"`{k}` string" for k in allcols))
    df = df.withColumn("_i", F.monotonically_increasing_id())
    der = exam.derivations(2019)
    out = df.select("_i", *[e.alias(n) for n, e in der.items()]).orderBy("_i").collect()
    for (t, s, code, lab), r in zip(cases, out):
        assert r[t] == lab, (t, s, code)


def test_civil_status_label_variants(spark):
    df = spark.createDataFrame([("0",), ("1",)], "COD_EST_CVL string")
    for year, zero in ((2015, "Não informado"), (2016, ""), (2017, ""), (2019, "Não informado")):
        got = [r[0] for r in df.select(exam.derivations(year)["DSC_EST_CVL"]).collect()]
        assert got == [zero, "Solteiro(a)"], year


def test_q048_quirk_and_fix(spark):
    df = spark.createDataFrame([("0", "1"), ("1", "1"), ("1", "0")], "Q048 string, Q044 string")
    assert [r[0] for r in df.select(exam.derivations(2019)["DSC_Q048"]).collect()] == ["Não", "Sim", ""]
    assert [r[0] for r in df.select(exam.derivations(2019, fixes=True)["DSC_Q048"]).collect()] == \
        ["Não", "Sim", "Sim"]


def test_all_five_editions_share_one_star_schema(spark, tmp_path):
    cleaned = {}
    for year in exam.YEARS:
        path = X.write_raw(str(tmp_path), year, X.rows_year(year))
        cleaned[year] = exam.clean(exam.read_raw(spark, path, year), year)
    per_year = {y: exam.build_star(exam.curate({y: df}), answers_key=False) for y, df in cleaned.items()}
    for name in per_year[2019]:
        schemas = {y: per_year[y][name].schema for y in exam.YEARS}
        assert len({s.simpleString() for s in schemas.values()}) == 1, name
    union = exam.build_star(exam.curate(cleaned), answers_key=False)
    assert union["DIM_CADASTRAL"].count() == 5


def _numpy_svr_objective(x, y, iters=300):
    """Brute-force reference: dense IRLS in numpy to convergence."""
    mu, my = x.mean(0), y.mean()
    z = np.column_stack([x - mu, np.ones(len(y))])
    yc = y - my
    beta = np.linalg.lstsq(z, yc, rcond=None)[0]
    reg = np.eye(z.shape[1])
    reg[-1, -1] = 0
    for _ in range(iters):
        w = 1 / np.maximum(np.abs(yc - z @ beta), 1e-6)
        beta = np.linalg.solve((z * w[:, None]).T @ z + reg, (z * w[:, None]).T @ yc)
    return 0.5 * beta[:-1] @ beta[:-1] + np.abs(yc - z @ beta).sum()


def test_linear_svr_objective_matches_brute_force(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    feats = ["l_quantity", "l_discount", "l_tax"]
    m = fit_linear_svr(li, feats, "l_extendedprice")
    pdf = li.select(*feats, "l_extendedprice").toPandas()          # 6,000-row fixture
    x, y = pdf[feats].to_numpy(float), pdf["l_extendedprice"].to_numpy(float)
    ours = 0.5 * float(np.dot(m.weights, m.weights)) + np.abs(y - x @ np.array(m.weights) - m.intercept).sum()
    assert ours == pytest.approx(_numpy_svr_objective(x, y), rel=1e-5)


def test_linear_svr_epsilon_tube_minimises_its_objective(spark):
    from microstar.operators.ml import fit_ols
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    feats, eps = ["l_quantity", "l_discount", "l_tax"], 5000.0
    pdf = li.select(*feats, "l_extendedprice").toPandas()
    x, y = pdf[feats].to_numpy(float), pdf["l_extendedprice"].to_numpy(float)

    def objective(m):
        w = np.array(m.weights)
        return 0.5 * w @ w + np.maximum(np.abs(y - x @ w - m.intercept) - eps, 0).sum()
    tube = fit_linear_svr(li, feats, "l_extendedprice", epsilon=eps)
    assert objective(tube) <= objective(fit_ols(li, feats, "l_extendedprice")) * (1 + 1e-6)
    assert objective(tube) <= objective(fit_linear_svr(li, feats, "l_extendedprice")) * (1 + 1e-6)
