"""Data dictionary built from the specs: lineage crosstab and domains."""

from pyspark.sql import functions as F

from microstar.plans import dictionary as D


def test_lineage_crosstab_by_edition(spark):
    lin = D.lineage_frame(spark)
    years = ["2015", "2016", "2017", "2018", "2019"]
    ct = D.lineage_crosstab(lin, ["NOME_CAMPO_CLEANED", "NOME_CAMPO_RAW"], "ANO", years, "ANO")
    rows = {(r["NOME_CAMPO_CLEANED"], r["NOME_CAMPO_RAW"]): r for r in ct.collect()}
    assert [rows[("NOT_CIE_NAT", "NU_NOTA_CH")][y] for y in years] == [0, 1, 0, 0, 0]   # 2016 crossing
    assert [rows[("NOT_CIE_NAT", "NU_NOTA_CN")][y] for y in years] == [1, 0, 1, 1, 1]
    assert [rows[("Q001", "Q002")][y] for y in years] == [1, 1, 1, 1, 1]
    assert lin.where(F.col("ANO") == "2019").count() == 136


def test_domains_and_field_join(spark):
    dom = D.domain_frame(spark)
    r = dom.where((F.col("ANO") == "2019") & (F.col("NOME_CAMPO_CLEANED") == "COD_SIT_RDC")
                  & (F.col("CODIGO_DOMINIO_RAW") == "1")).first()
    assert (r["CODIGO_DOMINIO_CURATED"], r["DESCRICAO_CURATED"]) == (3, "Presente")
    lin = D.lineage_frame(spark)
    j = D.field_domains(lin, dom, keys=("ANO", "NOME_CAMPO_CLEANED"))
    assert j.where((F.col("ANO") == "2015") & (F.col("NOME_CAMPO_RAW") == "TP_SEXO")).count() == 2
    listing = D.member_listing(lin.where(F.col("ANO") == "2017"), ["NOME_CAMPO_CLEANED"])
    assert listing.count() == 137


def test_curated_dictionary_sizes(spark):
    fields, types = D.curated_fields_frame(spark), D.curated_types_frame(spark)
    assert fields.where(F.col("TABELA") == "DIM_CADASTRAL_RR").count() == 16
    sizes = D.table_sizes(fields, types)
    per_table = {r["TABELA"]: r["s"] for r in sizes.groupBy("TABELA").agg(F.sum("TAMANHO").alias("s")).collect()}
    # NUM_INS 12, ANO_ENEM 4, 5 INT (4 bytes), DSC 20+50+50+50, 2 codes 7, 3 flags 3
    assert per_table["DIM_CADASTRAL_RR"] == 12 + 4 + 5 * 4 + 20 + 50 + 50 + 50 + 7 + 7 + 3 * 3
    assert sizes.where(F.col("TIPO_DADOS").isNull()).count() == 0


def test_member_and_range_filters(spark):
    lin = D.lineage_frame(spark)
    f = D.filter_members(lin, years=(2017, 2018), fields=("Q001", "Q009"), field_col="NOME_CAMPO_CLEANED")
    got = {(r["ANO"], r["NOME_CAMPO_CLEANED"]) for r in f.collect()}
    assert {a for a, _ in got} == {"2017", "2018"}
    assert {c for _, c in got} == {"Q001", "Q002", "Q003", "Q004", "Q006"}
    cad = D.filter_members(D.curated_fields_frame(spark), tables=["DIM_CADASTRAL_RR"])
    assert cad.count() == 16
