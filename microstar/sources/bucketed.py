"""Tables kept in buckets of their key, so that joins and key checks on it need no exchange."""

from __future__ import annotations

import uuid
from math import ceil

from pyspark.sql import DataFrame, SparkSession

from microstar.session import scratch_path

#: Rows of a bucket aimed at.
BUCKET_ROWS = 5_000_000


def buckets_for(n_rows: int, at_least: int = 8) -> int:
    """A power of two, the same for tables of like size, so that their buckets match."""
    wanted = max(at_least, ceil(n_rows / BUCKET_ROWS))
    return 1 << (wanted - 1).bit_length()


def write_bucketed(df: DataFrame, key: str, n_buckets: int, name: str, path: str | None = None) -> str:
    """Write ``df`` bucketed and sorted by ``key``; returns the name of the table in the session's catalog.

    Rows are dealt out by the key first, so a bucket is one file.
    """
    table = f"{name}_{uuid.uuid4().hex[:8]}"
    (df.repartition(n_buckets, key).write.bucketBy(n_buckets, key).sortBy(key)
     .option("path", path or scratch_path(df.sparkSession, name)).saveAsTable(table))
    return table


def write_star_bucketed(tables: dict[str, DataFrame], keys: dict[str, str], n_rows: int) -> dict[str, str]:
    """The tables of a star, each bucketed by its join key into the same number of buckets."""
    n = buckets_for(n_rows)
    return {name: write_bucketed(df, keys[name], n, name) for name, df in tables.items()}


def read_bucketed(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)
