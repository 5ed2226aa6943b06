"""Star schema of the curated layer: projections, routing, constants, types.

Fixed values: table and column names, routing predicates, per-edition
constants and column types of the curated tables.
"""


def _cols(text: str) -> list:
    """'a, b>c' -> ['a', ('b', 'c')] (source>target renames)."""
    out = []
    for item in text.replace("\n", " ").split(","):
        item = item.strip()
        if not item:
            continue
        out.append(tuple(p.strip() for p in item.split(">")) if ">" in item else item)
    return out


def _qs(nums) -> list[str]:
    return [f"Q{n:03d}" for n in nums]


SOCIO_COLUMNS = ["NUM_INS", "ANO_ENEM"]
for _n in list(range(1, 73)) + [92]:
    SOCIO_COLUMNS += [f"Q{_n:03d}", f"DSC_Q{_n:03d}"]
SOCIO_COLUMNS += _qs(range(73, 92))
SOCIO_COLUMNS = (SOCIO_COLUMNS[:2]
                 + sorted(SOCIO_COLUMNS[2:], key=lambda c: (int(c[-3:]), c.startswith("DSC"))))

STAR_COLUMNS = {
    "DIM_CADASTRAL": _cols("""NUM_INS, ANO_ENEM, IDD_INS, COD_SEX, DSC_SEX, COR_RCA, DSC_RCA, COD_EST_CVL,
        DSC_EST_CVL, COD_NAC, DSC_NAC, COD_MUN_NSC, COD_MUN_RSD, FL_IDS_TRAT>FL_IDS, FL_NOM_SCL_TRAT>FL_NOM_SCL,
        FL_INS_TRE_TRAT>FL_INS_TRE"""),
    "DIM_CONDICAO_ESPECIAL": _cols("""NUM_INS, ANO_ENEM, FL_AUT, FL_BXA_VIS, FL_CEG, FL_DEF_AUD, FL_DEF_FIS,
        FL_DEF_MTL, FL_DFC_ATC, FL_DIS, FL_DLX, FL_GST, FL_LAC, FL_MDC, FL_MDD_GLC, FL_MRC_PSS, FL_MSA_CAD_RDA,
        FL_OUT_DEF, FL_PTT_AUR, FL_SBT, FL_SDZ, FL_SDZ_CEG, FL_SND, FL_VIS_MON"""),
    "DIM_ENSINO": _cols("""NUM_INS, ANO_ENEM, TPO_ESC_ENS_FDM_DET_TRAT>TPO_ESC_ENS_FDM_DET,
        TPO_ENS_ESC_ENS_FDM_DET_TRAT>TPO_ENS_ESC_ENS_FDM_DET, TRN_ENS_FDM_TRAT>TRN_ENS_FDM,
        ANO_CCL_ENS_MED_TRAT>ANO_CCL_ENS_MED, SIT_CCL_ENS_MED_TRAT>SIT_CCL_ENS_MED,
        TPO_ESC_ENS_MED_TRAT>TPO_ESC_ENS_MED, TPO_ESC_ENS_MED_DET_TRAT>TPO_ESC_ENS_MED_DET,
        TPO_ENS_ESC_ENS_MED_TRAT>TPO_ENS_ESC_ENS_MED, TPO_ENS_ESC_ENS_MED_DET_TRAT>TPO_ENS_ESC_ENS_MED_DET,
        TRN_ENS_MED_TRAT>TRN_ENS_MED, FL_SOL_CTF_ENS_MED_TRAT>FL_SOL_CTF_ENS_MED, NOM_ENT_CTF"""),
    "DIM_ESCOLA": _cols("""NUM_INS, ANO_ENEM, COD_ESC, TPO_LCL_ESC>COD_TPO_LCL_ESC, DSC_TPO_LCL_ESC,
        FL_SIT_FUN_ESC, DSC_SIT_FUN_ESC, FL_DPD_ADM_ESC, DSC_DPD_ADM_ESC, COD_MUN_ESC"""),
    "FAT_NOTA": _cols("""NUM_INS, ANO_ENEM, NOT_CIE_HUM, NOT_CIE_NAT, NOT_MAT, TPO_LNG_ESTG, DSC_TPO_LNG_ESTG,
        NOT_LNG_COD, COD_SIT_RDC, DSC_SIT_RDC, NOT_RDC_CPT_1, NOT_RDC_CPT_2, NOT_RDC_CPT_3, NOT_RDC_CPT_4,
        NOT_RDC_CPT_5, NOT_RDC, NOT_MED"""),
    "DIM_LOCAL_PROVA": _cols("NUM_INS, ANO_ENEM, COD_MUN_PRV"),
    "DIM_PRESENCA": _cols("""NUM_INS, ANO_ENEM, FL_PSC_CIE_HUM_TRAT>FL_PSC_CIE_HUM,
        FL_PSC_CIE_NAT_TRAT>FL_PSC_CIE_NAT, FL_PSC_LNG_COD_TRAT>FL_PSC_LNG_COD, FL_PSC_MAT_TRAT>FL_PSC_MAT,
        FL_PSC_DIA_1, FL_PSC_DIA_2, FL_PSC, COD_TPO_PSC, DSC_TPO_PSC"""),
    "DIM_RECURSO_DIFERENCIADO": _cols("""NUM_INS, ANO_ENEM, FL_ACS, FL_AMP, FL_APO_PRN, FL_BRL, FL_CAD_ACO,
        FL_CAD_CAN, FL_CAD_ESP, FL_GUI_INT, FL_LAM_OVL, FL_LBR, FL_LDR, FL_LTR_LBL, FL_MAQ_BRL, FL_MOB_EPF,
        FL_MOB_OBS, FL_MSA_CAD_SPA, FL_MTR_EPF, FL_PRV_DTD_TRAT>FL_PRV_DTD, FL_SEM_RCS, FL_SLA_ACP, FL_SLA_ESP,
        FL_SLA_IND, FL_SOL_CMP, FL_SRB, FL_TMP_ADC, FL_TRC, FL_UND_HSP, FL_UND_PRI"""),
    "DIM_SOCIO_ECONOMICO": SOCIO_COLUMNS,
}

# The answers table is the unpivot of four (answers, exam code) pairs.
ANSWER_GROUPS = {
    "CH": ["RSP_INS_CIE_HUM", "COD_PRV_CIE_HUM"],
    "CN": ["RSP_INS_CIE_NAT", "COD_PRV_CIE_NAT"],
    "LC": ["RSP_INS_LNG_COD", "COD_PRV_LNG_COD"],
    "MT": ["RSP_INS_MAT", "COD_PRV_MAT"],
}
ANSWER_COLUMNS = ["DIM_RSP_PRV_PK", "NUM_INS", "COD_PRV", "AREA_CCN_ITEM", "RSP_INS"]

# Routing predicates (column, value); None = every row.
ROUTES = {
    "DIM_CADASTRAL": None,
    "DIM_CONDICAO_ESPECIAL": ("FL_CDC_ESP", "Sim"),
    "DIM_ENSINO": None,
    "DIM_ESCOLA": ("COD_ESC", "NOT NULL"),
    "FAT_NOTA": ("FL_PSC", "Sim"),
    "DIM_LOCAL_PROVA": None,
    "DIM_PRESENCA": None,
    "DIM_RECURSO_DIFERENCIADO": ("FL_RCS_DIF", "Sim"),
    "DIM_SOCIO_ECONOMICO": None,
    "DIM_RSP_PRV": ("FL_PSC", "Sim"),
}

# Columns an edition lacks get a constant: '0' for these flags, null otherwise.
FLAG_DEFAULTS = {"FL_UND_PRI": "0", "FL_TMP_ADC": "0", "FL_SBT": "0"}

# Flags behind the any-of derivations.
SPECIAL_CONDITION_FLAGS = ["FL_AUT", "FL_BXA_VIS", "FL_CEG", "FL_DEF_AUD", "FL_DEF_FIS", "FL_DEF_MTL",
                           "FL_DFC_ATC", "FL_DIS", "FL_DLX", "FL_GST", "FL_LAC", "FL_MDC", "FL_MDD_GLC",
                           "FL_MRC_PSS", "FL_MSA_CAD_RDA", "FL_OUT_DEF", "FL_PTT_AUR", "FL_SBT", "FL_SDZ",
                           "FL_SDZ_CEG", "FL_SND", "FL_VIS_MON"]
_RESOURCES = ["FL_ACS", "FL_AMP_18", "FL_AMP_24", "FL_APO_PRN", "FL_BRL", "FL_CAD_ACO", "FL_CAD_CAN",
              "FL_CAD_ESP", "FL_GUI_INT", "FL_LAM_OVL", "FL_LBR", "FL_LDR", "FL_LTR_LBL", "FL_MAQ_BRL",
              "FL_MCA", "FL_MOB_EPF", "FL_MOB_OBS", "FL_MSA_CAD_SPA", "FL_MTR_EPF", "FL_PRV_DTD", "FL_SEM_RCS",
              "FL_SLA_ACP", "FL_SLA_ESP", "FL_SLA_IND", "FL_SOL_CMP", "FL_SRB", "FL_TMP_ADC", "FL_TRC",
              "FL_UND_HSP", "FL_UND_PRI"]


def resource_flags(year: int) -> list[str]:
    """30 flags in 2015/16 (with the stretcher FL_MCA), 29 afterwards."""
    return _RESOURCES if year <= 2016 else [f for f in _RESOURCES if f != "FL_MCA"]


def lying_down_flags(year: int) -> list[str]:
    return ["FL_MCA", "FL_PRV_DTD"] if year <= 2016 else ["FL_PRV_DTD"]


LARGE_PRINT_FLAGS = ["FL_AMP_18", "FL_AMP_24"]
PRESENCE_FLAGS = ["FL_PSC_CIE_NAT", "FL_PSC_CIE_HUM", "FL_PSC_LNG_COD", "FL_PSC_MAT"]
GRADES = ["NOT_CIE_NAT", "NOT_CIE_HUM", "NOT_LNG_COD", "NOT_MAT", "NOT_RDC"]
DAY_RULE_CUTOVER = 2017

# Curated column types (Spark SQL type, max characters for strings).
_V = "string"
TYPES = {
    "NUM_INS": (_V, 12), "ANO_ENEM": (_V, 4), "IDD_INS": ("int", None), "COD_SEX": ("int", None),
    "DSC_SEX": (_V, 20), "COR_RCA": ("int", None), "DSC_RCA": (_V, 50), "COD_EST_CVL": ("int", None),
    "DSC_EST_CVL": (_V, 50), "COD_NAC": ("int", None), "DSC_NAC": (_V, 50), "COD_MUN_NSC": (_V, 7),
    "COD_MUN_RSD": (_V, 7), "FL_IDS": (_V, 3), "FL_NOM_SCL": (_V, 3), "FL_INS_TRE": (_V, 3),
    "TPO_ESC_ENS_FDM_DET": (_V, 60), "TPO_ENS_ESC_ENS_FDM_DET": (_V, 120), "TRN_ENS_FDM": (_V, 50),
    "ANO_CCL_ENS_MED": (_V, 20), "SIT_CCL_ENS_MED": (_V, 100), "TPO_ESC_ENS_MED": (_V, 60),
    "TPO_ESC_ENS_MED_DET": (_V, 60), "TPO_ENS_ESC_ENS_MED": (_V, 120), "TPO_ENS_ESC_ENS_MED_DET": (_V, 120),
    "TRN_ENS_MED": (_V, 50), "FL_SOL_CTF_ENS_MED": (_V, 3), "NOM_ENT_CTF": (_V, 120),
    "COD_ESC": (_V, 8), "COD_TPO_LCL_ESC": ("int", None), "DSC_TPO_LCL_ESC": (_V, 50),
    "FL_SIT_FUN_ESC": ("int", None), "DSC_SIT_FUN_ESC": (_V, 50), "FL_DPD_ADM_ESC": ("int", None),
    "DSC_DPD_ADM_ESC": (_V, 20), "COD_MUN_ESC": (_V, 7), "COD_MUN_PRV": (_V, 7),
    "FL_PSC_CIE_HUM": (_V, 20), "FL_PSC_CIE_NAT": (_V, 20), "FL_PSC_LNG_COD": (_V, 20), "FL_PSC_MAT": (_V, 20),
    "FL_PSC_DIA_1": (_V, 3), "FL_PSC_DIA_2": (_V, 3), "FL_PSC": (_V, 3), "COD_TPO_PSC": ("int", None),
    "DSC_TPO_PSC": (_V, 20),
    "NOT_CIE_HUM": ("double", None), "NOT_CIE_NAT": ("double", None), "NOT_MAT": ("double", None),
    "TPO_LNG_ESTG": ("int", None), "DSC_TPO_LNG_ESTG": (_V, 20), "NOT_LNG_COD": ("double", None),
    "COD_SIT_RDC": ("int", None), "DSC_SIT_RDC": (_V, 50), "NOT_RDC_CPT_1": ("double", None),
    "NOT_RDC_CPT_2": ("double", None), "NOT_RDC_CPT_3": ("double", None), "NOT_RDC_CPT_4": ("double", None),
    "NOT_RDC_CPT_5": ("double", None), "NOT_RDC": ("double", None), "NOT_MED": ("double", None),
    "DIM_RSP_PRV_PK": ("bigint", None), "COD_PRV": ("int", None), "AREA_CCN_ITEM": (_V, 2),
    "RSP_INS": (_V, 50),
    "DSC_Q001": (_V, 60), "DSC_Q002": (_V, 60), "DSC_Q003": (_V, 450), "DSC_Q004": (_V, 450),
    "DSC_Q005": (_V, 50), "DSC_Q006": (_V, 50), "DSC_Q008": (_V, 20), "DSC_Q009": (_V, 50),
    "DSC_Q011": (_V, 70), "DSC_Q012": (_V, 50), "DSC_Q013": (_V, 20), "Q027": (_V, 3), "Q035": (_V, 3),
    "DSC_Q035": (_V, 20), "DSC_Q036": (_V, 100), "DSC_Q038": (_V, 20), "DSC_Q040": (_V, 50),
    "DSC_Q053": (_V, 100),
}
# Every other socio-economic code is INT; every other description VARCHAR(3);
# every other curated flag INT.


def column_type(name: str) -> tuple[str, int | None]:
    if name in TYPES:
        return TYPES[name]
    if name.startswith("DSC_Q"):
        return (_V, 3)
    if name.startswith("Q") or name.startswith("FL_"):
        return ("int", None)
    raise KeyError(name)
