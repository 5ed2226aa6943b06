"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from microstar.session import scratch_path

#: A word: a longest run of characters other than the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)


def n_words(text: Column) -> Column:
    """Number of words of a text column as long, JVM-side (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file, the same on the driver and the executors."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` as a written table in the shared folder: its lineage ends there.

    The shuffle files of the write are of no use afterwards and are removed.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        frame.write.parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    return spark.read.schema(frame.schema).parquet(path)


def texts(column: pa.Array) -> list[str]:
    """The texts of an Arrow column, null as the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of about ``limit`` bytes of ``column`` (one row at least).

    No row is split or left out; the bound only limits working memory.
    """
    import numpy as np

    sizes = np.asarray(_byte_lengths(batch.column(column)), dtype=np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def _byte_lengths(column: pa.Array):
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
