"""Municipality dimension: fixed values."""

# Region digit of the municipality code -> region label.
REGION_LABELS = {"1": "N", "2": "NE", "3": "SE", "4": "S", "5": "CO"}

# Fixed value: the dummy municipality row dropped by the curated load.
DUMMY_MUNICIPALITY = "0000000"

# Raw columns of the municipality list, in file order, and their cleaned names.
RAW_COLUMNS = ["CODIGO_SIAFI", "CNPJ", "DESCRICAO", "UF", "CODIGO_IBGE"]
CLEAN_RENAME = [("CODIGO_SIAFI", "COD_SIAFI"), ("CNPJ", "CNPJ"), ("UF", "UF"),
                ("CODIGO_IBGE", "COD_MUN_IBGE"), ("DESCRICAO_ORG", "NOM_MUN")]
CURATED_COLUMNS = ["COD_MUN_IBGE", "COD_REG_UF", "REG_UF", "COD_UF", "UF", "COD_MUN", "NOM_MUN"]
# Widths of the layer tables, and the types of the curated one.
RAW_WIDTHS = {"CODIGO_SIAFI": 4, "CNPJ": 14, "DESCRICAO": 120, "UF": 2, "CODIGO_IBGE": 7}
CLEANED_WIDTHS = {"COD_SIAFI": 4, "CNPJ": 14, "UF": 2, "COD_MUN_IBGE": 7, "NOM_MUN": 100}
CURATED_TYPES = {"COD_MUN_IBGE": ("string", 7), "COD_REG_UF": ("int", None), "REG_UF": ("string", 2),
                 "COD_UF": ("int", None), "UF": ("string", 2), "COD_MUN": ("string", 5), "NOM_MUN": ("string", 120)}
