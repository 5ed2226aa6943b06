"""Code -> label maps of the curated layer.

Fixed values: every label text and code below must equal the reference's
curated derivations; they are stated as data, in code order.  A code that
is not listed labels as '' (the formulas' last ELSE).
"""

YES_NO = {"0": "Não", "1": "Sim"}

PRESENCE = {"0": "Faltou à prova", "1": "Presente na prova", "2": "Eliminado na prova"}

PARENT_SCHOOLING = {
    "0": "Não sei",
    "1": "Não estudou",
    "2": "Da 1ª à 4ª série do Ensino Fundamental (antigo primário)",
    "3": "Não completou a 4ª série/5º ano do Ensino Fundamental.",
    "4": "Da 5ª à 8ª série do Ensino Fundamental (antigo ginásio)",
    "5": "Ensino Médio Incompleto",
    "6": "Ensino Médio Completo",
    "7": "Ensino Superior Incompleto",
    "8": "Ensino Superior",
    "9": "Pós-graduação",
    "11": "Mestrado",
    "12": "Doutorado",
}

MOTHER_OCCUPATION = {
    "0": "Não sei",
    "1": "Grupo 1: Lavradora, agricultora sem empregados, bóia fria, criadora de animais (gado, porcos, "
         "galinhas, ovelhas, cavalos etc.), apicultora, pescadora, lenhadora, seringueira, extrativista.",
    "2": "Grupo 2: Diarista, empregada doméstica, cuidadora de idosos, babá, cozinheira (em casas "
         "particulares), motorista particular, jardineira, faxineira de empresas e prédios, vigilante, "
         "porteira, carteira, office-boy, vendedora, caixa, atendente de loja, auxiliar administrativa, "
         "recepcionista, servente de pedreiro, repositora de mercadoria.",
    "3": "Grupo 3: Padeira, cozinheira industrial ou em restaurantes, sapateira, costureira, joalheira, "
         "torneira mecânica, operadora de máquinas, soldadora, operária de fábrica, trabalhadora da "
         "mineração, pedreira, pintora, eletricista, encanadora, motorista, caminhoneira, taxista.",
    "4": "Grupo 4: Professora (de ensino fundamental ou médio, idioma, música, artes etc.), técnica (de "
         "enfermagem, contabilidade, eletrônica etc.), policial, militar de baixa patente (soldado, cabo, "
         "sargento), corretora de imóveis, supervisora, gerente, mestre de obras, pastora, microempresária "
         "(proprietária de empresa com menos de 10 empregados), pequena comerciante, pequena proprietária "
         "de terras, trabalhadora autônoma ou por conta própria.",
    "5": "Grupo 5: Médica, engenheira, dentista, psicóloga, economista, advogada, juíza, promotora, "
         "defensora, delegada, tenente, capitã, coronel, professora universitária, diretora em empresas "
         "públicas ou privadas, política, proprietária de empresas com mais de 10 empregados.",
}

FATHER_OCCUPATION = {
    "0": "Não sei",
    "1": "Grupo 1: Lavrador, agricultor sem empregados, bóia fria, criador de animais (gado, porcos, "
         "galinhas, ovelhas, cavalos etc.), apicultor, pescador, lenhador, seringueiro, extrativista.",
    "2": "Grupo 2: Diarista, empregado doméstico, cuidador de idosos, babá, cozinheiro (em casas "
         "particulares), motorista particular, jardineiro, faxineiro de empresas e prédios, vigilante, "
         "porteiro, carteiro, office-boy, vendedor, caixa, atendente de loja, auxiliar administrativo, "
         "recepcionista, servente de pedreiro, repositor de mercadoria.",
    "3": "Grupo 3: Padeiro, cozinheiro industrial ou em restaurantes, sapateiro, costureiro, joalheiro, "
         "torneiro mecânico, operador de máquinas, soldador, operário de fábrica, trabalhador da "
         "mineração, pedreiro, pintor, eletricista, encanador, motorista, caminhoneiro, taxista.",
    "4": "Grupo 4: Professor (de ensino fundamental ou médio, idioma, música, artes etc.), técnico (de "
         "enfermagem, contabilidade, eletrônica etc.), policial, militar de baixa patente (soldado, cabo, "
         "sargento), corretor de imóveis, supervisor, gerente, mestre de obras, pastor, microempresário "
         "(proprietário de empresa com menos de 10 empregados), pequeno comerciante, pequeno proprietário "
         "de terras, trabalhador autônomo ou por conta própria.",
    "5": "Grupo 5: Médico, engenheiro, dentista, psicólogo, economista, advogado, juiz, promotor, "
         "defensor, delegado, tenente, capitão, coronel, professor universitário, diretor em empresas "
         "públicas ou privadas, político, proprietário de empresas com mais de 10 empregados.",
}

INCOME_Q005 = {
    "0": "Nenhuma renda", "1": "Até 1 salário mínimo", "2": "De 1 a 3 salários mínimos",
    "3": "De 1 a 1,5 salário mínimo", "4": "De 1,5 a 2 salários mínimos", "7": "De 2 a 5 salários mínimos",
    "9": "De 3 a 6 salários mínimos", "12": "De 5 a 7 salários mínimos", "14": "De 6 a 9 salários mínimos",
    "16": "De 7 a 10 salários mínimos", "19": "De 9 a 12 salários mínimos",
    "20": "De 10 a 12 salários mínimos", "21": "De 12 a 15 salários mínimos",
    "22": "Mais de 15 salários mínimos", "23": "Mais de 15 salários mínimos",
}

INCOME_Q006 = {
    "0": "Nenhuma renda", "1": "Até 1 salário mínimo", "2": "De 1 a 3 salários mínimos",
    "3": "De 1 a 1,5 salário mínimo", "4": "De 1,5 a 2 salários mínimos", "5": "De 2 a 2,5 salários mínimos",
    "6": "De 2,5 a 3 salários mínimos", "7": "De 2 a 5 salários mínimos", "8": "De 3 a 4 salários mínimos",
    "9": "De 3 a 6 salários mínimos", "10": "De 4 a 5 salários mínimos", "11": "De 5 a 6 salários mínimos",
    "12": "De 5 a 7 salários mínimos", "13": "De 6 a 7 salários mínimos", "14": "De 6 a 9 salários mínimos",
    "15": "De 7 a 8 salários mínimos", "16": "De 7 a 10 salários mínimos", "17": "De 8 a 9 salários mínimos",
    "18": "De 9 a 10 salários mínimos", "19": "De 9 a 12 salários mínimos",
    "20": "De 10 a 12 salários mínimos", "21": "De 12 a 15 salários mínimos",
    "22": "Mais de 15 salários mínimos",
}

CIVIL_STATUS = {
    "0": "Não informado", "1": "Solteiro(a)", "2": "Casado(a)/Mora com um(a) companheiro(a)",
    "3": "Divorciado(a)/Desquitado(a)/Separado(a)", "4": "Viúvo(a)",
}
# 2016 and 2017 editions have no label for code 0.
CIVIL_STATUS_NO_ZERO = {k: v for k, v in CIVIL_STATUS.items() if k != "0"}

# Year labels of the high-school conclusion code.
CONCLUSION_YEAR = {
    "0": "Não informado", "1": "Antes de 2007", "2": "2007", "3": "2008", "4": "2009", "5": "2010",
    "6": "2011", "7": "2012", "8": "2013", "9": "2014", "10": "2015", "11": "2016", "12": "2017",
    "13": "2018",
}

LABELS = {
    "DSC_SEX": {"0": "Feminino", "1": "Masculino"},
    "DSC_RCA": {"0": "Não declarado", "1": "Branca", "2": "Preta", "3": "Parda", "4": "Amarela",
                "5": "Indígena ", "6": "Não dispõe da informação"},
    "DSC_EST_CVL": CIVIL_STATUS,
    "DSC_NAC": {"0": "Não informado", "1": "Brasileiro(a)", "2": "Brasileiro(a) Naturalizado(a)",
                "3": "Estrangeiro(a)", "4": "Brasileiro(a) Nato(a), nascido(a) no exterior"},
    "DSC_DPD_ADM_ESC": {"1": "Federal", "2": "Estadual", "3": "Municipal", "4": "Privada"},
    "DSC_SIT_FUN_ESC": {"1": "Em atividade", "2": "Paralisada", "3": "Extinta",
                        "4": "Escola extinta em anos anteriores"},
    "DSC_TPO_LCL_ESC": {"1": "Urbana", "2": "Rural"},
    "DSC_TPO_LNG_ESTG": {"0": "Espanhol", "1": "Inglês"},
    "DSC_SIT_RDC": {"0": "Anulada", "1": "Em branco", "3": "Presente", "4": "Cópia de texto motivador",
                    "5": "Não atendimento ao tipo textual", "6": "Texto insuficiente", "7": "Fuga ao tema",
                    "8": "Parte do texto desconectada com o tema proposto"},
    "FL_PSC_TRAT": PRESENCE,
    "ANO_CCL_ENS_MED_TRAT": CONCLUSION_YEAR,
    "SIT_CCL_ENS_MED_TRAT": {
        "0": "Não conclui e não estou cursando o Ensino Médio", "1": "Já concluí",
        "2": "Estou cursando e concluirei o Ensino Médio após o ano de aplicação da prova do ENEM",
        "3": "Estou cursando e concluirei o Ensino Médio no ano de aplicação da prova do ENEM"},
    "TPO_ESC_ENS_MED_TRAT": {"0": "Não Respondeu", "1": "Pública", "2": "Privada", "3": "Exterior"},
    "TPO_ESC_ENS_MED_DET_TRAT": {"0": "Somente em escola pública", "2": "Somente em escola particular",
                                 "5": "Parte em escola pública e parte em escola privada",
                                 "7": "Não frequentei a escola"},
    "TPO_ENS_ESC_ENS_MED_TRAT": {"0": "Ensino Regular", "2": "Educação de Jovens e Adultos",
                                 "3": "Ensino Especial"},
    "TPO_ENS_ESC_ENS_MED_DET_TRAT": {
        "0": "Cursei o Ensino Médio somente na modalidade regular.",
        "1": "Cursei o Ensino Médio parte na modalidade regular e parte na modalidade EJA (Educação de "
             "Jovens e Adultos).",
        "2": "Cursei o Ensino Médio somente na modalidade EJA (Educação de Jovens e Adultos).",
        "3": "Outras modalidades."},
    "TPO_ENS_ESC_ENS_FDM_DET_TRAT": {
        "0": "Cursei o Ensino Fundamental somente na modalidade regular.",
        "1": "Cursei o Ensino Fundamental parte na modalidade regular e parte na modalidade EJA (Educação "
             "de Jovens e Adultos).",
        "2": "Cursei o Ensino Fundamental somente na modalidade EJA (Educação de Jovens e Adultos).",
        "3": "Outras modalidades."},
    "TPO_ESC_ENS_FDM_DET_TRAT": {
        "1": "Somente em escola indígena", "2": "Somente em escola situada em comunidade quilombola",
        "3": "Somente em escola pública", "4": "Somente em escola particular",
        "5": "Maior parte em escola indígena", "6": "Maior parte em escola situada em comunidade quilombola",
        "7": "Maior parte em escola pública", "8": "Maior parte em escola particular"},
    "TRN_ENS_FDM_TRAT": {"0": "Somente no diurno", "1": "Parte no diurno e parte no noturno",
                         "2": "Somente no noturno"},
    "TRN_ENS_MED_TRAT": {"0": "Somente no diurno", "1": "Parte no diurno e parte no noturno",
                         "2": "Somente no noturno"},
    "DSC_Q001": PARENT_SCHOOLING,
    "DSC_Q002": PARENT_SCHOOLING,
    "DSC_Q003": MOTHER_OCCUPATION,
    "DSC_Q004": FATHER_OCCUPATION,
    "DSC_Q005": INCOME_Q005,
    "DSC_Q006": INCOME_Q006,
    "DSC_Q008": {"1": "Antes dos 14 anos.", "2": "Entre 14 e 16 anos.", "3": "Entre 17 e 18 anos.",
                 "4": "Após 18 anos."},
    "DSC_Q009": {"0": "Sem jornada fixa, até 10 horas semanais", "1": "De 11 a 20 horas semanais",
                 "2": "De 21 a 30 horas semanais", "3": "De 31 a 40 horas semanais",
                 "4": "Mais de 40 horas semanais"},
    "DSC_Q011": {"0": "Cedida", "1": "Alugada",
                 "2": "Outra situação (loteamento não regularizado, ocupação etc.)", "3": "Própria"},
    "DSC_Q012": {"0": "Zona urbana", "1": "Zona rural", "2": "Comunidade quilombola",
                 "3": "Comunidade indígena"},
    "DSC_Q013": {"1": "Uma a três", "2": "Quatro a sete", "3": "Oito a dez", "4": "Mais de dez"},
    "DSC_Q035": {"0": "Não cursei", "1": "Não concluí", "2": "Menos de 8 anos", "3": "8 anos", "4": "9 anos",
                 "5": "10 anos", "6": "11 anos", "7": "Mais de 11 anos"},
    "DSC_Q036": {"0": "Não concluí e não estou cursando o Ensino Médio.", "1": "Já concluí o Ensino Médio.",
                 "2": "Estou cursando e concluirei o Ensino Médio no ano de aplicação da prova do ENEM",
                 "3": "Estou cursando e concluirei o Ensino Médio após o ano de aplicação da prova do ENEM"},
    "DSC_Q038": {"0": "Não cursei", "1": "Não concluí", "2": "Menos de 3 anos", "3": "3 anos",
                 "4": "4 anos", "5": "5 anos", "6": "6 anos ou mais"},
    "DSC_Q040": {"0": "Não deixei de frequentar", "1": "Menos de 10 anos", "2": "Entre 10 e 14 anos",
                 "3": "Entre 15 e 18 anos", "4": "Entre 19 e 24 anos", "5": "Entre 25 e 30 anos",
                 "6": "Mais de 30 anos"},
    "DSC_Q053": {"0": "Curso a distância (via rádio, televisão, internet, correio, com apostilas)",
                 "1": "Curso semi-presencial em escola privada", "2": "Curso semi-presencial em escola pública",
                 "3": "Curso presencial em escola privada", "4": "Curso presencial em escola pública",
                 "5": "Curso presencial na empresa em que trabalhei, instituição filantrópica ou religiosa"},
}

# Code-label derivations: (target, source, map name in LABELS).
CODE_LABELS = [
    ("DSC_SEX", "COD_SEX", "DSC_SEX"),
    ("DSC_RCA", "COR_RCA", "DSC_RCA"),
    ("DSC_EST_CVL", "COD_EST_CVL", "DSC_EST_CVL"),
    ("DSC_NAC", "COD_NAC", "DSC_NAC"),
    ("DSC_DPD_ADM_ESC", "FL_DPD_ADM_ESC", "DSC_DPD_ADM_ESC"),
    ("DSC_SIT_FUN_ESC", "FL_SIT_FUN_ESC", "DSC_SIT_FUN_ESC"),
    ("DSC_TPO_LCL_ESC", "TPO_LCL_ESC", "DSC_TPO_LCL_ESC"),
    ("DSC_TPO_LNG_ESTG", "TPO_LNG_ESTG", "DSC_TPO_LNG_ESTG"),
    ("DSC_SIT_RDC", "COD_SIT_RDC", "DSC_SIT_RDC"),
    ("FL_PSC_CIE_HUM_TRAT", "FL_PSC_CIE_HUM", "FL_PSC_TRAT"),
    ("FL_PSC_CIE_NAT_TRAT", "FL_PSC_CIE_NAT", "FL_PSC_TRAT"),
    ("FL_PSC_LNG_COD_TRAT", "FL_PSC_LNG_COD", "FL_PSC_TRAT"),
    ("FL_PSC_MAT_TRAT", "FL_PSC_MAT", "FL_PSC_TRAT"),
    ("ANO_CCL_ENS_MED_TRAT", "ANO_CCL_ENS_MED", "ANO_CCL_ENS_MED_TRAT"),
    ("SIT_CCL_ENS_MED_TRAT", "SIT_CCL_ENS_MED", "SIT_CCL_ENS_MED_TRAT"),
    ("TPO_ESC_ENS_MED_TRAT", "TPO_ESC_ENS_MED", "TPO_ESC_ENS_MED_TRAT"),
    ("TPO_ESC_ENS_MED_DET_TRAT", "TPO_ESC_ENS_MED_DET", "TPO_ESC_ENS_MED_DET_TRAT"),
    ("TPO_ENS_ESC_ENS_MED_TRAT", "TPO_ENS_ESC_ENS_MED", "TPO_ENS_ESC_ENS_MED_TRAT"),
    ("TPO_ENS_ESC_ENS_MED_DET_TRAT", "TPO_ENS_ESC_ENS_MED_DET", "TPO_ENS_ESC_ENS_MED_DET_TRAT"),
    ("TPO_ENS_ESC_ENS_FDM_DET_TRAT", "TPO_ENS_ESC_ENS_FDM_DET", "TPO_ENS_ESC_ENS_FDM_DET_TRAT"),
    ("TPO_ESC_ENS_FDM_DET_TRAT", "TPO_ESC_ENS_FDM_DET", "TPO_ESC_ENS_FDM_DET_TRAT"),
    ("TRN_ENS_FDM_TRAT", "TRN_ENS_FDM", "TRN_ENS_FDM_TRAT"),
    ("TRN_ENS_MED_TRAT", "TRN_ENS_MED", "TRN_ENS_MED_TRAT"),
] + [(f"DSC_Q{n:03d}", f"Q{n:03d}", f"DSC_Q{n:03d}")
     for n in (1, 2, 3, 4, 5, 6, 8, 9, 11, 12, 13, 35, 36, 38, 40, 53)]

# Yes/No derivations (target, source): 0 -> Não, 1 -> Sim, else ''.
YES_NO_LABELS = [(f"DSC_Q{n:03d}", f"Q{n:03d}") for n in (
    7, 10, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34, 37, 39,
    41, 42, 43, 44, 45, 46, 47, 49, 50, 51, 52, 54, 55, 56, 57, 58, 59, 60, 61, 62, 63, 64, 65, 66, 67,
    68, 69, 70, 71, 72, 92)] + [
    ("FL_IDS_TRAT", "FL_IDS"), ("FL_INS_TRE_TRAT", "FL_INS_TRE"), ("FL_NOM_SCL_TRAT", "FL_NOM_SCL"),
    ("FL_SOL_CTF_ENS_MED_TRAT", "FL_SOL_CTF_ENS_MED")]

# Quirk kept by default: DSC_Q048 tests Q048 for "Não" but Q044 for "Sim".
DSC_Q048 = ("Q048", "Q044")
