"""Tiny raw exam files with the edge rows every fixture must have."""

from __future__ import annotations

import os

from microstar.spec.layouts import LAYOUTS, SEPARATOR


def base_row(year: int, num: str, state: str = "RR") -> dict:
    r = {c: "0" for c in LAYOUTS[year] if c.startswith("IN_")}
    r.update({
        "NU_INSCRICAO": num, "NU_ANO": str(year), "SG_UF_PROVA": state, "CO_MUNICIPIO_PROVA": "1400100",
        "NO_MUNICIPIO_PROVA": "Boa Vista", "NO_MUNICIPIO_RESIDENCIA": "São João da Baliza",
        "NO_MUNICIPIO_NASCIMENTO": "Caracaraí", "NO_MUNICIPIO_ESC": "Mucajaí", "NU_IDADE": "18",
        "TP_SEXO": "F", "TP_ESTADO_CIVIL": "1", "TP_COR_RACA": "3", "TP_NACIONALIDADE": "1",
        "TP_ST_CONCLUSAO": "2", "TP_ANO_CONCLUIU": "1", "TP_ESCOLA": "2", "TP_ENSINO": "1",
        "CO_ESCOLA": "14000001", "TP_DEPENDENCIA_ADM_ESC": "2", "TP_LOCALIZACAO_ESC": "1",
        "TP_SIT_FUNC_ESC": "1",
        "TP_PRESENCA_CN": "1", "TP_PRESENCA_CH": "1", "TP_PRESENCA_LC": "1", "TP_PRESENCA_MT": "1",
        "CO_PROVA_CN": "503", "CO_PROVA_CH": "507", "CO_PROVA_LC": "511", "CO_PROVA_MT": "515",
        "NU_NOTA_CN": "500.1", "NU_NOTA_CH": "600.2", "NU_NOTA_LC": "550.3", "NU_NOTA_MT": "650.4",
        "TX_RESPOSTAS_CN": "ABCDE" * 9, "TX_RESPOSTAS_CH": "EDCBA" * 9, "TX_RESPOSTAS_LC": "AABBC" * 9,
        "TX_RESPOSTAS_MT": "CCDDE" * 9, "TP_LINGUA": "1", "TP_STATUS_REDACAO": "1",
        "NU_NOTA_COMP1": "120", "NU_NOTA_COMP2": "140", "NU_NOTA_COMP3": "120", "NU_NOTA_COMP4": "160",
        "NU_NOTA_COMP5": "100", "NU_NOTA_REDACAO": "640",
        "Q001": "A", "Q002": "H", "Q003": "B", "Q004": "F", "Q005": "3", "Q006": "C", "Q025": "B",
    })
    return r


def rows_2019() -> list[dict]:
    rows = []
    r = base_row(2019, "190000000001")                       # all present, F, reference row
    rows.append(r)
    r = base_row(2019, "190000000002")                       # all absent
    r.update({"TP_PRESENCA_CN": "0", "TP_PRESENCA_CH": "0", "TP_PRESENCA_LC": "0", "TP_PRESENCA_MT": "0",
              "TX_RESPOSTAS_CN": "-", "TX_RESPOSTAS_CH": "-", "TX_RESPOSTAS_LC": "-", "TX_RESPOSTAS_MT": "-",
              "NU_NOTA_CN": "-", "NU_NOTA_CH": "", "NU_NOTA_LC": "-", "NU_NOTA_MT": "-", "TP_SEXO": "m",
              "TP_ESTADO_CIVIL": "0"})
    rows.append(r)
    r = base_row(2019, "190000000003")                       # mixed, eliminated, null answers in MT
    r.update({"TP_PRESENCA_CN": "2", "TP_PRESENCA_CH": "1", "TP_PRESENCA_LC": "0", "TP_PRESENCA_MT": "1",
              "TX_RESPOSTAS_MT": "", "TP_ENSINO": "", "CO_ESCOLA": "-", "IN_DISLEXIA": "1",
              "IN_AMPLIADA_18": "1", "TP_STATUS_REDACAO": "4", "TP_ANO_CONCLUIU": "13", "Q002": "E"})
    rows.append(r)
    r = base_row(2019, "190000000004")                       # one presence flag null
    r.update({"TP_PRESENCA_CN": "-", "TP_SEXO": "X"})
    rows.append(r)
    rows.append(base_row(2019, "190000000005", state="SP"))  # other state: filtered out
    return rows


def rows_year(year: int) -> list[dict]:
    r = base_row(year, f"{year % 100}0000000001")
    r.update({"TP_PRESENCA_CN": "1", "TP_PRESENCA_LC": "0"})  # day rule flips between 2016 and 2017
    return [r]


def cell(v: str, sep: str) -> str:
    if v is None:
        return ""
    if v == "":
        return '""'                                         # quoted empty cell
    if sep in v or '"' in v:
        return '"' + v.replace('"', '""') + '"'
    return v


def write_raw(dirpath: str, year: int, rows: list[dict], pad: bool = True) -> str:
    sep = SEPARATOR[year]
    lay = LAYOUTS[year]
    path = os.path.join(dirpath, f"MICRODADOS_{year}.csv")
    with open(path, "w", encoding="iso-8859-1") as fh:
        fh.write(sep.join(f"H{i}" for i in range(len(lay))) + "\n")   # header names are not used
        for r in rows:
            vals = [cell(r.get(c), sep) for c in lay]
            if pad:
                vals[0] = "  " + vals[0] + " "                          # padded cell
            fh.write(sep.join(vals) + "\n")
        fh.write("\n")                                                  # empty line is skipped
    return path
