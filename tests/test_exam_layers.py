"""Exam pipeline on tiny raw files: golden values, routing invariants, keys."""

import pytest
from pyspark.sql import functions as F

from microstar.operators.quality import check_unique, split_rejects
from microstar.plans import exam
from microstar.session import checkpoint_root
from tests import exam_fixtures as X


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("raw")
    paths = {2019: X.write_raw(str(d), 2019, X.rows_2019()),
             2016: X.write_raw(str(d), 2016, X.rows_year(2016)),
             2017: X.write_raw(str(d), 2017, X.rows_year(2017))}
    cleaned = {y: exam.clean(exam.read_raw(spark, p, y), y) for y, p in paths.items()}
    # checkpoint the derived base once: ten tables fan out of it
    checkpoint_root(spark)
    base = exam.curate(cleaned, state="RR").checkpoint(eager=True)
    tables = exam.build_star(base)
    good = {}
    rejects = {}
    for name, df in tables.items():
        g, b = split_rejects(df)
        good[name] = {r["NUM_INS"] + ("/" + r["AREA_CCN_ITEM"] if "AREA_CCN_ITEM" in g.columns else ""):
                      r.asDict() for r in g.collect()}
        rejects[name] = [r.asDict() for r in b.collect()]
    return {"good": good, "rejects": rejects, "tables": tables, "paths": paths, "cleaned": cleaned}


def test_raw_is_positional_trimmed_and_nulls(spark, star):
    raw = exam.read_raw(spark, star["paths"][2019], 2019)
    rows = {r["NU_INSCRICAO"]: r for r in raw.collect()}
    assert set(rows) == {f"19000000000{i}" for i in range(1, 6)}       # padded key trimmed
    assert rows["190000000002"]["NU_NOTA_CN"] is None                  # '-' -> null
    assert rows["190000000002"]["NU_NOTA_CH"] is None                  # quoted empty -> null
    assert rows["190000000001"]["NO_MUNICIPIO_RESIDENCIA"] == "São João da Baliza"


def test_cleaned_renames_permutes_folds_and_defaults(star):
    c = {r["NUM_INS"]: r for r in star["cleaned"][2019].collect()}
    r1 = c["190000000001"]
    assert r1["Q002"] == "A" and r1["Q001"] == "H"                      # Q001 <-> Q002 swap
    assert r1["Q013"] == "3" and r1["Q014"] == "B"
    assert r1["NOM_MUN_RSD"] == "Sao Joao da Baliza"                    # accents folded
    assert c["190000000002"]["NOT_CIE_NAT"] == "0"                      # null grade -> '0'
    assert c["190000000003"]["TPO_ENS_ESC_ENS_MED"] == "-1"             # null TP_ENSINO -> '-1'
    assert len(star["cleaned"][2019].columns) == 136


def test_state_filter(star):
    for name, rows in star["good"].items():
        assert not any(k.startswith("190000000005") for k in rows), name


def test_recode_and_labels(star):
    cad = star["good"]["DIM_CADASTRAL"]
    assert cad["190000000001"]["COD_SEX"] == 0 and cad["190000000001"]["DSC_SEX"] == "Feminino"
    assert cad["190000000002"]["COD_SEX"] == 1 and cad["190000000002"]["DSC_SEX"] == "Masculino"  # 'm'
    assert cad["190000000001"]["DSC_RCA"] == "Parda"
    assert cad["190000000002"]["DSC_EST_CVL"] == "Não informado"
    assert cad["160000000001"]["DSC_EST_CVL"].startswith("Casado")      # 2016 recode 1 -> 2
    socio = star["good"]["DIM_SOCIO_ECONOMICO"]["190000000001"]
    assert socio["Q001"] == 0 and socio["DSC_Q001"] == "Não sei"
    assert socio["Q002"] == 1 and socio["DSC_Q002"] == "Não estudou"
    assert socio["Q003"] == 0 and socio["Q004"] == 2 and socio["DSC_Q004"].startswith("Grupo 2:")
    assert socio["Q013"] == 1 and socio["DSC_Q013"] == "Uma a três"
    assert socio["Q006"] == 3 and socio["DSC_Q006"] == "De 1 a 1,5 salário mínimo"
    assert socio["DSC_Q014"] == "Sim"
    assert socio["Q007"] is None and socio["DSC_Q007"] == ""             # absent in 2019
    s3 = star["good"]["DIM_SOCIO_ECONOMICO"]["190000000003"]
    assert s3["Q001"] == 7 and s3["DSC_Q001"] == "Ensino Superior Incompleto"
    ens = star["good"]["DIM_ENSINO"]
    assert ens["190000000001"]["ANO_CCL_ENS_MED"] == "2018"
    assert ens["190000000003"]["ANO_CCL_ENS_MED"] == "Antes de 2007"
    assert ens["190000000001"]["TPO_ESC_ENS_MED"] == "Pública"
    assert ens["190000000001"]["TPO_ENS_ESC_ENS_MED"] == "Ensino Regular"
    assert ens["190000000003"]["TPO_ENS_ESC_ENS_MED"] == ""             # '-1' stays '-1', no label
    nota = star["good"]["FAT_NOTA"]
    assert nota["190000000001"]["DSC_SIT_RDC"] == "Presente" and nota["190000000001"]["COD_SIT_RDC"] == 3
    assert nota["190000000003"]["DSC_SIT_RDC"] == "Em branco"
    assert nota["190000000001"]["TPO_LNG_ESTG"] == 0 and nota["190000000001"]["DSC_TPO_LNG_ESTG"] == "Espanhol"


def test_attendance_and_routing(star):
    pres = star["good"]["DIM_PRESENCA"]
    assert (pres["190000000001"]["COD_TPO_PSC"], pres["190000000001"]["DSC_TPO_PSC"]) == (1, "Presente")
    assert (pres["190000000002"]["COD_TPO_PSC"], pres["190000000002"]["DSC_TPO_PSC"]) == (0, "Ausente")
    assert (pres["190000000003"]["COD_TPO_PSC"], pres["190000000003"]["DSC_TPO_PSC"]) == (2, "Parcial")
    assert (pres["190000000004"]["COD_TPO_PSC"], pres["190000000004"]["DSC_TPO_PSC"]) == (2, "Parcial")
    assert pres["190000000003"]["FL_PSC_CIE_NAT"] == "Eliminado na prova"
    assert pres["190000000002"]["FL_PSC"] == "Não" and pres["190000000003"]["FL_PSC"] == "Sim"
    # the day rule flips in 2017 for the same flags
    assert (pres["160000000001"]["FL_PSC_DIA_1"], pres["160000000001"]["FL_PSC_DIA_2"]) == ("Sim", "Não")
    assert (pres["170000000001"]["FL_PSC_DIA_1"], pres["170000000001"]["FL_PSC_DIA_2"]) == ("Não", "Sim")
    assert "190000000002" not in star["good"]["FAT_NOTA"]               # absent: no grades row
    assert set(star["good"]["DIM_CONDICAO_ESPECIAL"]) == {"190000000003"}
    assert set(star["good"]["DIM_RECURSO_DIFERENCIADO"]) == {"190000000003"}
    assert star["good"]["DIM_RECURSO_DIFERENCIADO"]["190000000003"]["FL_AMP"] == 1
    assert "190000000003" not in star["good"]["DIM_ESCOLA"]             # null school code
    assert "190000000001" in star["good"]["DIM_ESCOLA"]


def test_grades_mean_and_2016_crossing(star, spark):
    nota = star["good"]["FAT_NOTA"]
    assert nota["190000000001"]["NOT_MED"] == pytest.approx((500.1 + 600.2 + 550.3 + 650.4 + 640) / 5)
    # 2016 quirk kept by default: CH grade lands in NOT_CIE_NAT
    assert nota["160000000001"]["NOT_CIE_NAT"] == pytest.approx(600.2)
    fixed = exam.clean(exam.read_raw(spark, star["paths"][2016], 2016), 2016, fixes=True).first()
    assert fixed["NOT_CIE_NAT"] == "500.1" and fixed["NOT_CIE_HUM"] == "600.2"


def test_answers_unpivot_and_identity(star):
    ans = star["good"]["DIM_RSP_PRV"]
    areas_1 = {k for k in ans if k.startswith("190000000001/")}
    assert len(areas_1) == 4
    assert {k for k in ans if k.startswith("190000000003/")} == {f"190000000003/{a}" for a in ("CH", "CN", "LC")}
    assert not any(k.startswith("190000000002/") for k in ans)          # absent: no answers
    keys = sorted(r["DIM_RSP_PRV_PK"] for r in ans.values())
    assert keys == list(range(1, len(ans) + 1))                         # dense identity
    assert ans["190000000001/CH"]["COD_PRV"] == 507


def test_reject_reasons(star):
    rej = star["rejects"]["DIM_CADASTRAL"]
    assert [(r["NUM_INS"], r["_reject_reason"]) for r in rej] == [("190000000004", "COD_SEX: not int")]


def test_keys_unique_and_one_schema(star):
    for name, df in star["tables"].items():
        keys = ["NUM_INS", "AREA_CCN_ITEM"] if name == "DIM_RSP_PRV" else ["NUM_INS"]
        assert check_unique(df, keys).count() == 0, name
    assert star["tables"]["DIM_SOCIO_ECONOMICO"].columns[:4] == ["NUM_INS", "ANO_ENEM", "Q001", "DSC_Q001"]


def test_load_star_partitioned_and_idempotent(spark, star, tmp_path):
    out = str(tmp_path / "curated")
    exam.load_star(star["tables"], out)
    exam.load_star(star["tables"], out)                                 # rerun: no duplicates
    cad = exam.read_star_table(spark, out, "DIM_CADASTRAL")
    assert cad.count() == len(star["good"]["DIM_CADASTRAL"])
    assert cad.where(F.col("ANO_ENEM") == 2016).count() == 1


def test_load_editions_writes_all_layers_idempotently(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    too_long = X.base_row(2019, "1900000000099")                         # 13 characters: VARCHAR(12)
    paths = {2019: X.write_raw(str(d), 2019, X.rows_2019() + [too_long]),
             2015: X.write_raw(str(d), 2015, X.rows_year(2015))}
    out = str(tmp_path / "layers")
    exam.load_editions(spark, paths, out)
    assert exam.read_layer_edition(spark, out, "raw", 2019).count() == 5
    rej = exam.read_layer_edition(spark, out, "raw", 2019, "rejected").collect()
    assert [(r["NU_INSCRICAO"], r["_reject_reason"]) for r in rej] == [("1900000000099", "NU_INSCRICAO: longer than 12")]
    assert exam.read_layer_edition(spark, out, "cleaned", 2019, "rejected").count() == 0
    assert len(exam.read_layer_edition(spark, out, "cleaned", 2015).columns) == 166
    cad = exam.read_star_table(spark, f"{out}/curated", "DIM_CADASTRAL")
    assert sorted(r["NUM_INS"] for r in cad.collect()) == ["150000000001", "190000000001", "190000000002",
                                                             "190000000003"]
    assert exam.read_star_rejects(spark, f"{out}/curated").count() == 1
    ans = exam.read_star_table(spark, f"{out}/curated", "DIM_RSP_PRV")
    assert ans.count() == 4 + 3 + 4 + 4                                   # 001, 003, 004, 2015 row
    assert sorted(r[0] for r in ans.select("DIM_RSP_PRV_PK").collect()) == list(range(1, 16))
    keys_2015 = sorted(r[0] for r in ans.where("ANO_ENEM = 2015").select("DIM_RSP_PRV_PK").collect())
    cad_before = sorted(tuple(r) for r in exam.read_star_table(spark, f"{out}/curated", "DIM_CADASTRAL").collect())
    # reload 2019 alone (a rerun): nothing is duplicated, 2015 keeps its keys,
    # 2019 continues after the largest kept key
    exam.load_editions(spark, {2019: paths[2019]}, out)
    assert sorted(tuple(r) for r in exam.read_star_table(spark, f"{out}/curated", "DIM_CADASTRAL").collect()) == cad_before
    assert exam.read_layer_edition(spark, out, "raw", 2019).count() == 5
    ans = exam.read_star_table(spark, f"{out}/curated", "DIM_RSP_PRV")
    keys = [r[0] for r in ans.select("DIM_RSP_PRV_PK").collect()]
    assert len(keys) == len(set(keys)) == 15
    assert sorted(r[0] for r in ans.where("ANO_ENEM = 2015").select("DIM_RSP_PRV_PK").collect()) == keys_2015
    assert min(r[0] for r in ans.where("ANO_ENEM = 2019").select("DIM_RSP_PRV_PK").collect()) == max(keys_2015) + 1
    # load one table of one edition: the other tables and their rejects are untouched
    exam.load_editions(spark, {2019: paths[2019]}, out, tables=["FAT_NOTA"])
    assert exam.read_star_rejects(spark, f"{out}/curated").count() == 1
    assert sorted(tuple(r) for r in exam.read_star_table(spark, f"{out}/curated", "DIM_CADASTRAL").collect()) == cad_before


def test_layer_widths():
    from microstar.spec.widths import cleaned_widths, raw_width
    assert [raw_width(2019, c) for c in ("NU_INSCRICAO", "TX_RESPOSTAS_LC", "TX_RESPOSTAS_MT", "NU_NOTA_MT",
                                         "NU_NOTA_COMP3", "IN_SEM_RECURSO", "Q005", "TP_SEXO")] == \
        [12, 50, 45, 5, 3, 101, 2, 1]
    assert raw_width(2015, "NU_NOTA_MT") == 6 and raw_width(2015, "TP_STATUS_REDACAO") == 2
    w = cleaned_widths(2019)
    assert (w["TPO_ENS_ESC_ENS_MED"], w["FL_SIT_FUN_ESC"], w["NOM_MUN_RSD"], w["NUM_INS"]) == (2, 2, 120, 12)
