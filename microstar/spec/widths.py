"""VARCHAR widths of the RAW and CLEANED layers.

Fixed values: the layer tables declare every column VARCHAR(n); n follows
the raw column name (first matching rule below, 1 otherwise), with three
per-edition exceptions.  CLEANED keeps the raw width of the renamed column
and widens the two columns that receive the '-1' default.
"""

from microstar.spec.renames import rename_list

RAW_WIDTH_RULES = [
    ("NU_INSCRICAO", 12), ("NU_ANO", 4), ("NU_IDADE", 2), ("NU_NOTA_COMP", 3), ("NU_NOTA_REDACAO", 4),
    ("NU_NOTA_", 5), ("CO_MUNICIPIO_", 7), ("NO_", 120), ("CO_UF_", 2), ("SG_UF_", 2), ("CO_PROVA_", 3),
    ("CO_ESCOLA", 8), ("TX_RESPOSTAS_LC", 50), ("TX_GABARITO_LC", 50), ("TX_", 45), ("TP_ANO_CONCLUIU", 2),
    ("Q005", 2),
]
RAW_WIDTH_EXCEPTIONS = {
    2015: {"NU_NOTA_MT": 6, "TP_STATUS_REDACAO": 2},
    2019: {"IN_SEM_RECURSO": 101},
}
CLEANED_WIDENED = {"TPO_ENS_ESC_ENS_MED": 2, "FL_SIT_FUN_ESC": 2}
# Municipality names are narrower in the CLEANED tables of three editions.
CLEANED_EXCEPTIONS = {
    2015: {"NOM_MUN_RSD": 100, "NOM_MUN_ESC": 100, "NOM_MUN_NSC": 100, "NOM_MUN_PRV": 100},
    2016: {"NOM_MUN_RSD": 100, "NOM_MUN_ESC": 100, "NOM_MUN_NSC": 100, "NOM_MUN_PRV": 100},
    2017: {"NOM_MUN_RSD": 100, "NOM_MUN_ESC": 100, "NOM_MUN_NSC": 100, "NOM_MUN_PRV": 100},
}


def raw_width(year: int, name: str) -> int:
    if name in RAW_WIDTH_EXCEPTIONS.get(year, {}):
        return RAW_WIDTH_EXCEPTIONS[year][name]
    for prefix, width in RAW_WIDTH_RULES:
        if name.startswith(prefix):
            return width
    return 1


def cleaned_widths(year: int) -> dict[str, int]:
    out = {}
    for src, dst in rename_list(year):
        out[dst] = CLEANED_WIDENED.get(dst, raw_width(year, src.removesuffix("_ORG")))
    return out | CLEANED_EXCEPTIONS.get(year, {})
