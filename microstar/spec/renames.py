"""Raw -> cleaned column names per edition (one simultaneous select).

Fixed values: the cleaned taxonomy names.  The 2019 list is complete and in
output order; the other editions state their additions/changes and the
2019 entries they do not have.
"""


def _pairs(text: str) -> list[tuple[str, str]]:
    out = []
    for item in text.replace("\n", " ").split(","):
        item = item.strip()
        if item:
            src, dst = item.split("->")
            out.append((src.strip(), dst.strip()))
    return out


RENAME_2019 = _pairs("""
NU_INSCRICAO->NUM_INS, NU_ANO->ANO_ENEM, CO_MUNICIPIO_RESIDENCIA->COD_MUN_RSD,
NO_MUNICIPIO_RESIDENCIA_ORG->NOM_MUN_RSD, CO_UF_RESIDENCIA->COD_UF_RSD, SG_UF_RESIDENCIA->UF_RSD,
NU_IDADE->IDD_INS, TP_SEXO->COD_SEX, TP_ESTADO_CIVIL->COD_EST_CVL, TP_COR_RACA->COR_RCA,
TP_NACIONALIDADE->COD_NAC, CO_MUNICIPIO_NASCIMENTO->COD_MUN_NSC, NO_MUNICIPIO_NASCIMENTO_ORG->NOM_MUN_NSC,
CO_UF_NASCIMENTO->COD_UF_NSC, SG_UF_NASCIMENTO->UF_NSC, TP_ST_CONCLUSAO->SIT_CCL_ENS_MED,
TP_ANO_CONCLUIU->ANO_CCL_ENS_MED, TP_ESCOLA->TPO_ESC_ENS_MED, TP_ENSINO->TPO_ENS_ESC_ENS_MED,
IN_TREINEIRO->FL_INS_TRE, CO_ESCOLA->COD_ESC, CO_MUNICIPIO_ESC->COD_MUN_ESC,
NO_MUNICIPIO_ESC_ORG->NOM_MUN_ESC, CO_UF_ESC->COD_UF_ESC, SG_UF_ESC->UF_ESC,
TP_DEPENDENCIA_ADM_ESC->FL_DPD_ADM_ESC, TP_LOCALIZACAO_ESC->TPO_LCL_ESC, TP_SIT_FUNC_ESC->FL_SIT_FUN_ESC,
IN_BAIXA_VISAO->FL_BXA_VIS, IN_CEGUEIRA->FL_CEG, IN_SURDEZ->FL_SDZ, IN_DEFICIENCIA_AUDITIVA->FL_DEF_AUD,
IN_SURDO_CEGUEIRA->FL_SDZ_CEG, IN_DEFICIENCIA_FISICA->FL_DEF_FIS, IN_DEFICIENCIA_MENTAL->FL_DEF_MTL,
IN_DEFICIT_ATENCAO->FL_DFC_ATC, IN_DISLEXIA->FL_DLX, IN_DISCALCULIA->FL_DIS, IN_AUTISMO->FL_AUT,
IN_VISAO_MONOCULAR->FL_VIS_MON, IN_OUTRA_DEF->FL_OUT_DEF, IN_GESTANTE->FL_GST, IN_LACTANTE->FL_LAC,
IN_IDOSO->FL_IDS, IN_ESTUDA_CLASSE_HOSPITALAR->FL_UND_HSP, IN_SEM_RECURSO->FL_SEM_RCS, IN_BRAILLE->FL_BRL,
IN_AMPLIADA_24->FL_AMP_24, IN_AMPLIADA_18->FL_AMP_18, IN_LEDOR->FL_LDR, IN_ACESSO->FL_ACS,
IN_TRANSCRICAO->FL_TRC, IN_LIBRAS->FL_LBR, IN_TEMPO_ADICIONAL->FL_TMP_ADC, IN_LEITURA_LABIAL->FL_LTR_LBL,
IN_MESA_CADEIRA_RODAS->FL_MSA_CAD_RDA, IN_MESA_CADEIRA_SEPARADA->FL_MSA_CAD_SPA, IN_APOIO_PERNA->FL_APO_PRN,
IN_GUIA_INTERPRETE->FL_GUI_INT, IN_COMPUTADOR->FL_SOL_CMP, IN_CADEIRA_ESPECIAL->FL_CAD_ESP,
IN_CADEIRA_CANHOTO->FL_CAD_CAN, IN_CADEIRA_ACOLCHOADA->FL_CAD_ACO, IN_PROVA_DEITADO->FL_PRV_DTD,
IN_MOBILIARIO_OBESO->FL_MOB_OBS, IN_LAMINA_OVERLAY->FL_LAM_OVL, IN_PROTETOR_AURICULAR->FL_PTT_AUR,
IN_MEDIDOR_GLICOSE->FL_MDD_GLC, IN_MAQUINA_BRAILE->FL_MAQ_BRL, IN_SOROBAN->FL_SRB, IN_MARCA_PASSO->FL_MRC_PSS,
IN_SONDA->FL_SND, IN_MEDICAMENTOS->FL_MDC, IN_SALA_INDIVIDUAL->FL_SLA_IND, IN_SALA_ESPECIAL->FL_SLA_ESP,
IN_SALA_ACOMPANHANTE->FL_SLA_ACP, IN_MOBILIARIO_ESPECIFICO->FL_MOB_EPF, IN_MATERIAL_ESPECIFICO->FL_MTR_EPF,
IN_NOME_SOCIAL->FL_NOM_SCL, CO_MUNICIPIO_PROVA->COD_MUN_PRV, NO_MUNICIPIO_PROVA_ORG->NOM_MUN_PRV,
CO_UF_PROVA->COD_UF_PRV, SG_UF_PROVA->UF_PRV, TP_PRESENCA_CN->FL_PSC_CIE_NAT, TP_PRESENCA_CH->FL_PSC_CIE_HUM,
TP_PRESENCA_LC->FL_PSC_LNG_COD, TP_PRESENCA_MT->FL_PSC_MAT, CO_PROVA_CN->COD_PRV_CIE_NAT,
CO_PROVA_CH->COD_PRV_CIE_HUM, CO_PROVA_LC->COD_PRV_LNG_COD, CO_PROVA_MT->COD_PRV_MAT,
NU_NOTA_CN->NOT_CIE_NAT, NU_NOTA_CH->NOT_CIE_HUM, NU_NOTA_LC->NOT_LNG_COD, NU_NOTA_MT->NOT_MAT,
TX_RESPOSTAS_CN->RSP_INS_CIE_NAT, TX_RESPOSTAS_CH->RSP_INS_CIE_HUM, TX_RESPOSTAS_LC->RSP_INS_LNG_COD,
TX_RESPOSTAS_MT->RSP_INS_MAT, TP_LINGUA->TPO_LNG_ESTG, TX_GABARITO_CN->GAB_CIE_NAT,
TX_GABARITO_CH->GAB_CIE_HUM, TX_GABARITO_LC->GAB_LNG_COD, TX_GABARITO_MT->GAB_MAT,
TP_STATUS_REDACAO->COD_SIT_RDC, NU_NOTA_COMP1->NOT_RDC_CPT_1, NU_NOTA_COMP2->NOT_RDC_CPT_2,
NU_NOTA_COMP3->NOT_RDC_CPT_3, NU_NOTA_COMP4->NOT_RDC_CPT_4, NU_NOTA_COMP5->NOT_RDC_CPT_5,
NU_NOTA_REDACAO->NOT_RDC, Q002->Q001, Q001->Q002, Q004->Q003, Q003->Q004, Q006->Q006, Q005->Q013,
Q025->Q014, Q018->Q015, Q008->Q016, Q010->Q017, Q024->Q018, Q016->Q019, Q013->Q020, Q012->Q021,
Q017->Q022, Q014->Q023, Q015->Q024, Q011->Q025, Q009->Q026, Q022->Q028, Q023->Q029, Q019->Q030,
Q021->Q031, Q020->Q032, Q007->Q033
""")

# Per edition: (added or changed pairs, 2019 pairs it does not have).
EDITION_CHANGES = {
    2015: (_pairs("""
        Q042->TPO_ESC_ENS_FDM_DET, Q043->TPO_ENS_ESC_ENS_FDM_DET, Q044->TRN_ENS_FDM,
        Q047->TPO_ESC_ENS_MED_DET, Q048->TPO_ENS_ESC_ENS_MED_DET, Q049->TRN_ENS_MED, IN_SABATISTA->FL_SBT,
        IN_MACA->FL_MCA, IN_MATERIAL_ESPECÍFICO->FL_MTR_EPF, IN_CERTIFICADO->FL_SOL_CTF_ENS_MED,
        NO_ENTIDADE_CERTIFICACAO->NOM_ENT_CTF, CO_UF_ENTIDADE_CERTIFICACAO->COD_UF_ENT_CTF,
        SG_UF_ENTIDADE_CERTIFICACAO->UF_ENT_CTF, Q026->Q007, Q027->Q008, Q028->Q009, Q045->Q034,
        Q046->Q036, Q050->Q037, Q036->Q075, Q035->Q076, Q034->Q082, Q032->Q087, Q029->Q088, Q033->Q089,
        Q031->Q090, Q030->Q091, Q037->Q074, Q038->Q079, Q039->Q078, Q040->Q073, Q041->Q080"""),
        _pairs("IN_TEMPO_ADICIONAL->FL_TMP_ADC, IN_MATERIAL_ESPECIFICO->FL_MTR_EPF")),
    2016: (_pairs("""
        Q042->TPO_ESC_ENS_FDM_DET, Q043->TPO_ENS_ESC_ENS_FDM_DET, Q044->TRN_ENS_FDM,
        Q047->TPO_ESC_ENS_MED_DET, Q048->TPO_ENS_ESC_ENS_MED_DET, Q049->TRN_ENS_MED, IN_SABATISTA->FL_SBT,
        IN_MACA->FL_MCA, IN_CERTIFICADO->FL_SOL_CTF_ENS_MED, NO_ENTIDADE_CERTIFICACAO->NOM_ENT_CTF,
        CO_UF_ENTIDADE_CERTIFICACAO->COD_UF_ENT_CTF, SG_UF_ENTIDADE_CERTIFICACAO->UF_ENT_CTF,
        NU_NOTA_CH->NOT_CIE_NAT, NU_NOTA_CN->NOT_CIE_HUM, Q026->Q007, Q027->Q008, Q028->Q009, Q045->Q034,
        Q046->Q036, Q050->Q037, Q040->Q073, Q037->Q074, Q036->Q075, Q035->Q076, Q039->Q078, Q038->Q079,
        Q041->Q080, Q034->Q082, Q032->Q087, Q029->Q088, Q033->Q089, Q031->Q090, Q030->Q091"""),
        _pairs("IN_TEMPO_ADICIONAL->FL_TMP_ADC, NU_NOTA_CN->NOT_CIE_NAT, NU_NOTA_CH->NOT_CIE_HUM")),
    2017: (_pairs("Q027->TPO_ESC_ENS_MED_DET, Q026->Q036"), _pairs("IN_TEMPO_ADICIONAL->FL_TMP_ADC")),
    2018: (_pairs("Q027->TPO_ESC_ENS_MED_DET, Q026->Q036"), _pairs("IN_TEMPO_ADICIONAL->FL_TMP_ADC")),
    2019: ([], []),
}

# The 2016 grades are crossed in the reference (CH -> NOT_CIE_NAT, CN ->
# NOT_CIE_HUM).  ``fixes=True`` maps them straight instead.
FIX_2016_GRADES = _pairs("NU_NOTA_CN->NOT_CIE_NAT, NU_NOTA_CH->NOT_CIE_HUM")


def rename_list(year: int, fixes: bool = False) -> list[tuple[str, str]]:
    added, missing = EDITION_CHANGES[year]
    drop = set(missing)
    pairs = [p for p in RENAME_2019 if p not in drop]
    if year == 2016 and fixes:
        added = [p for p in added if p[0] not in ("NU_NOTA_CH", "NU_NOTA_CN")] + FIX_2016_GRADES
    return pairs + list(added)
