"""Layer tables on Parquet (S3-S5, K1-K3) and the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Full table scan of ``base/name.parquet`` (or a directory table)."""
    path = f"{base.rstrip('/')}/{name}"
    if not path.endswith(".parquet"):
        path += ".parquet"
    return spark.read.parquet(path)


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    """Scan a layer table; filters on the partition column prune directories."""
    return spark.read.parquet(path)


def overwrite_load(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Truncate-and-load (K1).

    With ``partition_by`` only the partitions present in ``df`` are replaced
    (dynamic partition overwrite): re-running one year rewrites that year
    and leaves the others alone, so reruns are idempotent.
    """
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: list[str], named: list[tuple]) -> None:
    """Truncate-and-load of exactly the ``named`` partitions (K1).

    Those present in ``df`` are overwritten; those named but absent from it
    are removed afterwards, so a reload that yields no rows leaves no old
    ones.  Others stay as they are.  ``df`` is read twice: persist it.
    """
    spark = df.sparkSession
    overwrite_load(df, path, partition_by)
    present = {tuple(map(str, r)) for r in df.select(*partition_by).distinct().collect()}  # one row a partition
    for values in named:
        if tuple(map(str, values)) not in present:
            part = "/".join(f"{c}={v}" for c, v in zip(partition_by, values))
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def append_load(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append load (K2): yearly runs accumulate into one table (UNION ALL)."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
