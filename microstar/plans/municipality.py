"""Municipality dimension: raw list -> cleaned -> curated."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from microstar.functions import code_parts, region_label, strip_accents
from microstar.operators.project import select_rename
from microstar.operators.quality import FieldSpec, enforce_schema, reject_duplicates, split_rejects
from microstar.operators.route import filter_ne
from microstar.sources.delimited import read_delimited
from microstar.sources.layers import overwrite_load
from microstar.spec.municipality import (CLEAN_RENAME, CLEANED_WIDTHS, CURATED_COLUMNS, CURATED_TYPES,
                                         DUMMY_MUNICIPALITY, RAW_COLUMNS, RAW_WIDTHS)


MALFORMED = "malformed line: more or fewer fields than the layout"
_BAD_LINE = "_EXTRA_FIELDS"


def read_municipality_raw(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """The municipality list exported as delimited text (5 string columns);
    malformed lines are left out (``check_municipality_raw`` rejects them)."""
    return _read(spark, path, sep).where(F.col(_BAD_LINE).isNull()).drop(_BAD_LINE)


def _read(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    return read_delimited(spark, path, RAW_COLUMNS, sep=sep, malformed_column=_BAD_LINE)


def check_municipality_raw(raw: DataFrame) -> DataFrame:
    """RAW typing (K4): malformed lines and values wider than their column."""
    return enforce_schema(raw, [FieldSpec(c, "string", n) for c, n in RAW_WIDTHS.items()],
                          [(F.col(_BAD_LINE).isNotNull(), MALFORMED)])


def check_municipality_cleaned(cleaned: DataFrame) -> DataFrame:
    """CLEANED typing (K4): names are narrower here than in RAW."""
    return enforce_schema(cleaned, [FieldSpec(c, "string", CLEANED_WIDTHS[c]) for c in cleaned.columns])


def check_municipality(curated: DataFrame) -> DataFrame:
    """Curated typing (K4) and primary key (K5): the region and state codes
    are numbers, ``COD_MUN_IBGE`` is unique and not null."""
    spec = [FieldSpec(c, *CURATED_TYPES[c], nullable=c != "COD_MUN_IBGE") for c in curated.columns]
    return reject_duplicates(enforce_schema(curated, spec), ["COD_MUN_IBGE"])


def load_municipality(spark: SparkSession, path: str, out_dir: str, sep: str = ";") -> dict[str, str]:
    """Municipality list -> RAW, CLEANED and CURATED loads, each with its rejects."""
    paths = {}

    def load(layer: str, checked: DataFrame) -> DataFrame:
        checked = checked.persist(StorageLevel.DISK_ONLY)
        good, bad = split_rejects(checked)
        paths[layer], paths[f"{layer}_rejects"] = f"{out_dir}/{layer}", f"{out_dir}/{layer}_rejects"
        overwrite_load(good, paths[layer])
        overwrite_load(bad, paths[f"{layer}_rejects"])
        checked.unpersist()
        return spark.read.schema(good.schema).parquet(paths[layer])

    raw = load("raw", check_municipality_raw(_read(spark, path, sep)))
    cleaned = load("cleaned", check_municipality_cleaned(clean_municipality(raw)))
    load("curated", check_municipality(curate_municipality(cleaned)))
    return paths


def clean_municipality(raw: DataFrame) -> DataFrame:
    """Fold accents of the name, rename to the cleaned taxonomy."""
    return select_rename(raw.withColumn("DESCRICAO_ORG", strip_accents("DESCRICAO")), CLEAN_RENAME)


def curate_municipality(cleaned: DataFrame) -> DataFrame:
    """Split the 7-digit code, label the region, drop the dummy row, reorder.

    Row-local: no shuffle.  The result (one row per municipality) is the
    small dimension that the star join broadcasts after a size check.
    """
    parts = code_parts("COD_MUN_IBGE")
    out = cleaned.withColumns(parts)
    out = out.withColumn("REG_UF", region_label("COD_REG_UF"))
    out = filter_ne(out, "COD_MUN_IBGE", DUMMY_MUNICIPALITY)
    return out.select(*CURATED_COLUMNS)
