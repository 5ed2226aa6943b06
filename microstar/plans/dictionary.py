"""Data-dictionary and lineage queries.

The dictionary tables are small metadata frames; the many-to-one side of
each join is broadcast after a row-count check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from microstar.operators.join import bounded_broadcast
from microstar.operators.reshape import crosstab_distinct


def field_sizes(fields: DataFrame, tables: DataFrame, descriptions: DataFrame,
                table_key: str = "TABELA_ID", field_key: str = "SEQUENCIA",
                group_by: tuple = ("TABELA", "SEQUENCIA", "CAMPO"),
                size_col: str = "TAMANHO", count_col: str = "DESCRICAO_ID") -> DataFrame:
    """Fields -> table (many-to-one, left) and -> descriptions (left); the
    size is summed per (table, sequence, field) (A3, J5)."""
    j = (fields.join(bounded_broadcast(tables), table_key, "left")
               .join(descriptions, field_key, "left"))
    return j.groupBy(*group_by).agg(F.count(count_col).alias("N_DESCRICOES"),
                                    F.round(F.sum(size_col), 2).alias(size_col))


def field_domains(fields: DataFrame, domains: DataFrame,
                  keys: tuple = ("ANO", "NOME_CAMPO_RAW")) -> DataFrame:
    """Composite-key one-to-many left join of fields to their domain values."""
    return fields.join(domains, list(keys), "left")


def member_listing(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct members in listing order (A5)."""
    return df.select(*cols).distinct().orderBy(*cols)


def lineage_crosstab(mapping: DataFrame, rows: list[str], year_col: str, years: list,
                     distinct_col: str) -> DataFrame:
    """Raw <-> cleaned names x year: COUNT(DISTINCT year) per cell."""
    return crosstab_distinct(mapping, rows, year_col, years, distinct_col)


# ---- the exam data dictionary, derived from the pipeline's own specs ----

def lineage_frame(spark) -> DataFrame:
    """DICIONARIO_RAW_CLEANED: (ANO, SEQUENCIA, NOME_CAMPO_RAW, NOME_CAMPO_CLEANED)
    for every edition, in output order (a few hundred rows per edition)."""
    from microstar.plans.exam import YEARS
    from microstar.spec.renames import rename_list
    rows = []
    for year in YEARS:
        for seq, (raw, clean) in enumerate(rename_list(year), start=1):
            rows.append((str(year), seq, raw.removesuffix("_ORG"), clean))
    return spark.createDataFrame(rows, "ANO string, SEQUENCIA int, NOME_CAMPO_RAW string, "
                                       "NOME_CAMPO_CLEANED string")


def domain_frame(spark) -> DataFrame:
    """DOMINIOS_RAW_CLEANED: (ANO, NOME_CAMPO_CLEANED, CODIGO_DOMINIO_RAW,
    CODIGO_DOMINIO_CURATED, DESCRICAO_CURATED) from the edition recodes and
    the curated labels."""
    from microstar.plans.exam import YEARS
    from microstar.spec.labels import CODE_LABELS, LABELS
    from microstar.spec.recodes import recodes_for
    label_of = {src: LABELS[name] for _, src, name in CODE_LABELS}
    rows = []
    for year in YEARS:
        for col, mapping in recodes_for(year).items():
            labels = label_of.get(col, {})
            for raw, cur in mapping.items():
                rows.append((str(year), col, raw, int(cur), labels.get(cur, "")))
    return spark.createDataFrame(rows, "ANO string, NOME_CAMPO_CLEANED string, CODIGO_DOMINIO_RAW string, "
                                       "CODIGO_DOMINIO_CURATED int, DESCRICAO_CURATED string")


def curated_fields_frame(spark) -> DataFrame:
    """CAMPOS_CURATED: (TABELA, SEQUENCIA, CAMPO) of every curated table."""
    from microstar.spec.star import ANSWER_COLUMNS, STAR_COLUMNS
    rows = []
    tables = dict(STAR_COLUMNS)
    tables["DIM_RSP_PRV"] = ANSWER_COLUMNS
    for table, cols in tables.items():
        for seq, c in enumerate(cols, start=1):
            rows.append((f"{table}_RR" if table != "DIM_RSP_PRV" else table, seq,
                         c if isinstance(c, str) else c[1]))
    return spark.createDataFrame(rows, "TABELA string, SEQUENCIA int, CAMPO string")


def curated_types_frame(spark) -> DataFrame:
    """DESCRICAO_CAMPOS_CURATED without the free-text description:
    (NOME_CAMPO_CLEANED, TIPO_DADOS, TAMANHO) from the curated types
    (TAMANHO = declared characters for strings, 4/8 bytes for INT/FLOAT)."""
    from microstar.spec.star import ANSWER_COLUMNS, STAR_COLUMNS, column_type
    sizes = {"int": ("INT", 4), "bigint": ("INT", 4), "double": ("FLOAT", 8)}
    names = {c if isinstance(c, str) else c[1] for cols in STAR_COLUMNS.values() for c in cols}
    names |= set(ANSWER_COLUMNS)
    rows = []
    for name in sorted(names):
        t, n = column_type(name)
        rows.append((name,) + (("VARCHAR", n) if t == "string" else sizes[t]))
    return spark.createDataFrame(rows, "NOME_CAMPO_CLEANED string, TIPO_DADOS string, TAMANHO int")


def table_sizes(fields: DataFrame, types: DataFrame) -> DataFrame:
    """SUM(TAMANHO) by table, sequence, field and type (A3) over the
    curated dictionary: fields -> types is a many-to-one broadcast join."""
    j = fields.join(bounded_broadcast(types), fields.CAMPO == types.NOME_CAMPO_CLEANED, "left")
    return j.groupBy("TABELA", "SEQUENCIA", "CAMPO", "TIPO_DADOS").agg(F.sum("TAMANHO").alias("TAMANHO"))


def filter_members(df: DataFrame, tables=None, years: tuple | None = None,
                   fields: tuple | None = None, table_col: str = "TABELA", year_col: str = "ANO",
                   field_col: str = "CAMPO") -> DataFrame:
    """Workbook filters (A6): table membership, an inclusive year range and
    an inclusive field-name range; each is applied only when given."""
    out = df
    if tables:
        out = out.where(F.col(table_col).isin(list(tables)))
    if years:
        out = out.where(F.col(year_col).cast("int").between(int(years[0]), int(years[1])))
    if fields:
        out = out.where(F.col(field_col).between(fields[0], fields[1]))
    return out


# ---- the stored dictionary: one delimited text per sheet ----

#: Sheets of the dictionary workbooks and their columns.
STORED_TABLES = {
    "CAMPOS_CURATED": "TABELA string, SEQUENCIA int, CAMPO string",
    "DESCRICAO_CAMPOS_CURATED": "NOME_CAMPO_CLEANED string, DESCRICAO_CAMPO_CLEANED string, TIPO_DADOS string, TAMANHO int",
    "TABELAS_CURATED": "TABELA string, DESCRICAO_TABELA string, TIPO_TABELA string",
    "DICIONARIO_RAW_CLEANED": "ANO string, TIPO_ARQUIVO string, SEQUENCIA int, NOME_CAMPO_RAW string, DESCRICAO_CAMPO_RAW string, "
                              "NOME_CAMPO_CLEANED string, DESCRICAO_CAMPO_CLEANED string",
    "DOMINIOS_RAW_CLEANED": "ANO string, NOME_CAMPO_RAW string, CODIGO_DOMINIO_RAW string, DESCRICAO_RAW string, "
                            "NOME_CAMPO_CLEANED string, CODIGO_DOMINIO_CURATED int, DESCRICAO_CURATED string",
    "MNEMONICOS": "MNEMONICO string, DESCRICAO string",
}


def read_dictionary(spark, folder: str, sep: str = "\t", encoding: str = "UTF-8") -> dict[str, DataFrame]:
    """The stored dictionary tables under ``folder``, one delimited text (file or
    folder) a sheet, with their declared types (S8).  Descriptions may hold
    line breaks.  A sheet that is not there is left out."""
    from microstar.sources.delimited import read_star_csv
    found = {}
    for name, schema in STORED_TABLES.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            found[name] = read_star_csv(spark, f"{folder}/{name}", sep=sep, encoding=encoding, schema=schema, multiline=True)
    return found


def described_fields(tables: dict[str, DataFrame]) -> DataFrame:
    """Fields of the star with their table's and their own description, type and size.

    Fields without a description and tables without one stay, with nulls.
    """
    t = bounded_broadcast(tables["TABELAS_CURATED"])
    d = tables["DESCRICAO_CAMPOS_CURATED"].withColumnRenamed("NOME_CAMPO_CLEANED", "CAMPO")
    return (tables["CAMPOS_CURATED"].join(t, "TABELA", "left").join(d, "CAMPO", "left")
            .select("TABELA", "DESCRICAO_TABELA", "TIPO_TABELA", "SEQUENCIA", "CAMPO", "DESCRICAO_CAMPO_CLEANED", "TIPO_DADOS", "TAMANHO"))


def spelled_names(fields: DataFrame, mnemonics: DataFrame, name: str = "CAMPO") -> DataFrame:
    """(name, NOME_EXTENSO): each part of a field name in words, unknown parts as they are."""
    parts = fields.select(name).distinct().select(name, F.posexplode(F.split(name, "_")).alias("n", "MNEMONICO"))
    words = parts.join(bounded_broadcast(mnemonics), "MNEMONICO", "left").select(
        name, F.struct("n", F.coalesce("DESCRICAO", "MNEMONICO").alias("word")).alias("part"))
    return words.groupBy(name).agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["word"]), " ").alias("NOME_EXTENSO"))
