"""Municipality dimension: raw list -> cleaned -> curated."""

from microstar.plans.municipality import clean_municipality, curate_municipality, read_municipality_raw

ROWS = [("0101", "00000000000101", "São Luís", "MA", "2111300"),
        ("0303", "00000000000303", "Boa Vista", "RR", "1400100"),
        ("0505", "00000000000505", "Curitiba", "PR", "4106902"),
        ("0707", "00000000000707", "São Paulo", "SP", "3550308"),
        ("0909", "00000000000909", "Brasília", "DF", "5300108"),
        ("9999", "-", "Dummy", "-", "0000000")]


def test_municipality_flow(spark, tmp_path):
    path = tmp_path / "tabmun.csv"
    with open(path, "w", encoding="iso-8859-1") as fh:
        fh.write("CÓDIGO SIAFI;CNPJ;DESCRIÇÃO;UF;CÓDIGO IBGE\n")
        for r in ROWS:
            fh.write(";".join(r) + "\n")
    raw = read_municipality_raw(spark, str(path))
    cleaned = clean_municipality(raw)
    assert cleaned.columns == ["COD_SIAFI", "CNPJ", "UF", "COD_MUN_IBGE", "NOM_MUN"]
    cur = {r["COD_MUN_IBGE"]: r for r in curate_municipality(cleaned).collect()}
    assert "0000000" not in cur                                   # dummy row dropped
    assert cur["2111300"]["NOM_MUN"] == "Sao Luis"                # accents folded
    assert [cur[c]["REG_UF"] for c in ("1400100", "2111300", "3550308", "4106902", "5300108")] == \
        ["N", "NE", "SE", "S", "CO"]
    assert (cur["1400100"]["COD_REG_UF"], cur["1400100"]["COD_UF"], cur["1400100"]["COD_MUN"]) == ("1", "14", "00100")
    assert list(cur["1400100"].asDict()) == ["COD_MUN_IBGE", "COD_REG_UF", "REG_UF", "COD_UF", "UF", "COD_MUN",
                                            "NOM_MUN"]
