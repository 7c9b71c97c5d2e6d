"""Names, ranges, labels and lookup tables that every result depends on.

Everything here is a fixed value: changing one changes the published tables.
"""

# ---------------------------------------------------------------- fixed values: canonical columns
# target column -> (kind, source names in order of preference)
CANONICAL_COLUMNS = {
    "ID_INSCRICAO": ("string", ["NU_SEQUENCIAL", "ID_INSCRICAO", "NU_INSCRICAO", "INSCRICAO"]),
    "ANO": ("integer", ["ANO", "NU_ANO"]),
    "SG_UF_PROVA": ("upper", ["SG_UF_PROVA", "SG_UF_RESIDENCIA", "UF_PROVA"]),
    "CO_MUNICIPIO_PROVA": (
        "string",
        ["CO_MUNICIPIO_PROVA", "CO_MUNICIPIO_RESIDENCIA", "COD_MUNICIPIO_PROVA"],
    ),
    "NO_MUNICIPIO_PROVA": (
        "string",
        ["NO_MUNICIPIO_PROVA", "NO_MUNICIPIO_RESIDENCIA", "MUNICIPIO_PROVA"],
    ),
    "TP_SEXO": ("upper", ["TP_SEXO", "SEXO", "CAT_SEXO"]),
    "TP_COR_RACA": ("integer", ["TP_COR_RACA", "TP_ETNIA"]),
    "TP_FAIXA_ETARIA": ("integer", ["TP_FAIXA_ETARIA"]),
    "NU_IDADE": ("integer", ["NU_IDADE", "IDADE"]),
    "Q006": ("string", ["Q006", "Q06"]),
    "TP_PRESENCA_CN": ("integer", ["TP_PRESENCA_CN"]),
    "TP_PRESENCA_CH": ("integer", ["TP_PRESENCA_CH"]),
    "TP_PRESENCA_LC": ("integer", ["TP_PRESENCA_LC"]),
    "TP_PRESENCA_MT": ("integer", ["TP_PRESENCA_MT"]),
    "TP_STATUS_REDACAO": ("integer", ["TP_STATUS_REDACAO"]),
    "NOTA_CIENCIAS_NATUREZA": (
        "numeric",
        ["NOTA_CIENCIAS_NATUREZA", "NU_NOTA_CN", "NOTA_CN", "NT_CN"],
    ),
    "NOTA_CIENCIAS_HUMANAS": (
        "numeric",
        ["NOTA_CIENCIAS_HUMANAS", "NU_NOTA_CH", "NOTA_CH", "NT_CH"],
    ),
    "NOTA_LINGUAGENS_CODIGOS": (
        "numeric",
        ["NOTA_LINGUAGENS_CODIGOS", "NU_NOTA_LC", "NOTA_LC", "NT_LC"],
    ),
    "NOTA_MATEMATICA": ("numeric", ["NOTA_MATEMATICA", "NU_NOTA_MT", "NOTA_MT", "NT_MT"]),
    "NOTA_REDACAO": ("numeric", ["NOTA_REDACAO", "NU_NOTA_REDACAO", "NU_NOTA_COMP5", "NT_REDACAO"]),
}

SCORES = [
    "NOTA_CIENCIAS_NATUREZA",
    "NOTA_CIENCIAS_HUMANAS",
    "NOTA_LINGUAGENS_CODIGOS",
    "NOTA_MATEMATICA",
    "NOTA_REDACAO",
]
GEO = ["SG_UF_PROVA", "CO_MUNICIPIO_PROVA", "NO_MUNICIPIO_PROVA"]
DEMOGRAPHY = ["TP_SEXO", "TP_COR_RACA", "TP_FAIXA_ETARIA", "NU_IDADE"]

# A results file is recognised by these score columns.
RAW_SCORE_COLUMNS = ["NU_NOTA_CN", "NU_NOTA_CH", "NU_NOTA_LC", "NU_NOTA_MT", "NU_NOTA_REDACAO"]

# Renames applied when gold tables are built straight from older cleaned files.
GOLD_RENAMES = {
    "NU_INSCRICAO": "ID_INSCRICAO",
    "NU_NOTA_CN": "NOTA_CIENCIAS_NATUREZA",
    "NU_NOTA_CH": "NOTA_CIENCIAS_HUMANAS",
    "NU_NOTA_LC": "NOTA_LINGUAGENS_CODIGOS",
    "NU_NOTA_MT": "NOTA_MATEMATICA",
    "NU_NOTA_REDACAO": "NOTA_REDACAO",
}

# Score column -> attendance flag that must be 1 for the score to count (essay: same day as LC).
PRESENCE = {
    "NOTA_CIENCIAS_NATUREZA": "TP_PRESENCA_CN",
    "NOTA_CIENCIAS_HUMANAS": "TP_PRESENCA_CH",
    "NOTA_LINGUAGENS_CODIGOS": "TP_PRESENCA_LC",
    "NOTA_MATEMATICA": "TP_PRESENCA_MT",
    "NOTA_REDACAO": "TP_PRESENCA_LC",
}

# ---------------------------------------------------------------- fixed values: ranges and years
SCORE_MIN, SCORE_MAX = 0, 1000
AGE_MIN, AGE_MAX = 8, 120
FIRST_YEAR, LAST_YEAR = 1998, 2024
CHART_FIRST_YEAR, CHART_LAST_YEAR = 2009, 2024

# ---------------------------------------------------------------- fixed values: text
ACCENTED = "ÁÀÂÃÄáàâãäÉÈÊËéèêëÍÌÎÏíìîïÓÒÔÕÖóòôõöÚÙÛÜúùûüÇç"
UNACCENTED = "AAAAAaaaaaEEEEeeeeIIIIiiiiOOOOOoooooUUUUuuuuCc"

# Cells that the usual CSV readers take for a missing value.
MISSING_MARKERS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# ---------------------------------------------------------------- fixed values: lookups
UF_BY_CODE = {
    11: "RO", 12: "AC", 13: "AM", 14: "RR", 15: "PA", 16: "AP", 17: "TO",
    21: "MA", 22: "PI", 23: "CE", 24: "RN", 25: "PB", 26: "PE", 27: "AL", 28: "SE", 29: "BA",
    31: "MG", 32: "ES", 33: "RJ", 35: "SP",
    41: "PR", 42: "SC", 43: "RS",
    50: "MS", 51: "MT", 52: "GO", 53: "DF",
}

INCOME_CLASS_BY_LETTER = {
    "A": "Sem Renda",
    "B": "Classe E (< 2 SM)",
    "C": "Classe E (< 2 SM)",
    "D": "Classe D (2-4 SM)",
    "E": "Classe D (2-4 SM)",
    "F": "Classe C (4-10 SM)",
    "G": "Classe C (4-10 SM)",
    "H": "Classe B (10-20 SM)",
    "I": "Classe B (10-20 SM)",
    "J": "Classe B (10-20 SM)",
    "K": "Classe B (10-20 SM)",
    "L": "Classe B (10-20 SM)",
    "M": "Classe A (> 20 SM)",
    "N": "Classe A (> 20 SM)",
    "O": "Classe A (> 20 SM)",
    "P": "Classe A (> 20 SM)",
    "Q": "Classe A (> 20 SM)",
}
INCOME_CLASS_ORDER = [
    "Classe A (> 20 SM)",
    "Classe B (10-20 SM)",
    "Classe C (4-10 SM)",
    "Classe D (2-4 SM)",
    "Classe E (< 2 SM)",
    "Sem Renda",
]

RACE_LABELS = {
    0: "Não Declarado",
    1: "Branca",
    2: "Preta",
    3: "Parda",
    4: "Amarela",
    5: "Indígena",
    6: "Não Disp.",
}
RACE_MISSING_LABEL = "Não Disp."

# Minimum-wage range per income letter (alternative class set).
WAGE_RANGE_BY_LETTER = {
    "A": "0-1 SM",
    "B": "1-3 SM",
    "C": "3-5 SM",
    "D": "5-10 SM",
    "E": "10+ SM",
}

# ---------------------------------------------------------------- fixed values: bands
# (id, lower bound, upper bound, description); every band is [low, high) but the last is closed.
MEAN_BANDS = [
    (1, 0, 400, "Abaixo de 400"),
    (2, 400, 600, "Intermediário baixo"),
    (3, 600, 800, "Intermediário alto"),
    (4, 800, 1000, "Alto desempenho"),
]
DISPLAY_BANDS = ["Abaixo de 400", "400 a 600", "600 a 800", "Acima de 800"]

AGE_CLASSES = ["ATE_17", "18_A_24", "25_A_34", "35_MAIS"]
CLASS_COLUMNS = ["CLASS_FAIXA_ETARIA", "CLASS_NOTA_GLOBAL", "CLASS_RENDA_FAMILIAR"]

# ---------------------------------------------------------------- fixed values: display labels
SUBJECT_LABELS = {
    "NOTA_MATEMATICA": "Matemática",
    "NOTA_CIENCIAS_NATUREZA": "Ciências da Natureza",
    "NOTA_CIENCIAS_HUMANAS": "Ciências Humanas",
    "NOTA_LINGUAGENS_CODIGOS": "Linguagens e Códigos",
    "NOTA_REDACAO": "Redação",
}
SUBJECT_SLUGS = {
    "NOTA_MATEMATICA": "matematica",
    "NOTA_CIENCIAS_NATUREZA": "natureza",
    "NOTA_CIENCIAS_HUMANAS": "humanas",
    "NOTA_LINGUAGENS_CODIGOS": "linguagens",
    "NOTA_REDACAO": "redacao",
}
REPORT_LABELS = {
    "ANO": "Ano",
    "SG_UF_PROVA": "UF",
    "NO_MUNICIPIO_PROVA": "Município",
    "INSCRITOS": "Inscritos",
    "NOTA_REDACAO_count": "Provas Aplicadas",
    "NOTA_CIENCIAS_NATUREZA_mean": "Ciências da Natureza",
    "NOTA_CIENCIAS_HUMANAS_mean": "Ciências Humanas",
    "NOTA_LINGUAGENS_CODIGOS_mean": "Linguagens e Códigos",
    "NOTA_MATEMATICA_mean": "Matemática",
    "NOTA_REDACAO_mean": "Redação",
}
TABLE_SCORE_HEADERS = {
    "NOTA_CIENCIAS_NATUREZA_mean": "Natureza",
    "NOTA_CIENCIAS_HUMANAS_mean": "Humanas",
    "NOTA_LINGUAGENS_CODIGOS_mean": "Linguagens",
    "NOTA_MATEMATICA_mean": "Matemática",
    "NOTA_REDACAO_mean": "Redação",
}
PERSONAL_COLUMNS = ["NU_INSCRICAO", "CPF", "NOME_CANDIDATO", "EMAIL"]
FORBIDDEN_SQL_VERBS = ["drop ", "delete ", "truncate ", "update ", "insert ", "alter "]
