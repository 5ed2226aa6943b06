"""Raw files arriving in a folder -> CLEANED and CURATED, incrementally.

``stream_cleaned``: file source (new files only, tracked in the checkpoint)
-> positional read -> the batch load's RAW check -> ``clean`` -> CLEANED
check -> one folder per batch id for good rows and for each layer's
rejects; a replayed batch overwrites its own folders.

``stream_curated``: CLEANED Parquet as a stream -> per micro-batch
``curate`` + ``build_star`` -> one folder per (table, batch id).  A replayed
batch overwrites its own folder, so a retry never duplicates rows.  The
answers identity key is left null here; ``surrogate_key`` assigns it when
the table is consolidated in batch.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from microstar.operators.quality import split_rejects
from microstar.plans import exam
from microstar.sources.delimited import DEFAULT_ENCODING, clean_cell, string_schema
from microstar.spec.layouts import LAYOUTS, SEPARATOR


def read_raw_stream(spark: SparkSession, raw_dir: str, year: int,
                    encoding: str = DEFAULT_ENCODING, max_files: int | None = None) -> DataFrame:
    """New raw files as a stream, bound by position, plus the sentinel
    column of malformed lines that ``exam.check_raw`` turns into a reject."""
    cols = LAYOUTS[year] + [exam.OVERFLOW]
    reader = (spark.readStream.schema(string_schema(cols))
              .option("header", True).option("enforceSchema", True).option("sep", SEPARATOR[year])
              .option("quote", '"').option("escape", '"').option("encoding", encoding)
              .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
              .option("columnNameOfCorruptRecord", exam.OVERFLOW).option("columnPruning", False))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    raw = reader.csv(raw_dir)
    return raw.select([clean_cell(F.col(c)).alias(c) for c in LAYOUTS[year]] + [F.col(exam.OVERFLOW)])


def write_cleaned_batch(batch: DataFrame, batch_id: int, year: int, out_path: str, rejects_path: str,
                        fixes: bool = False) -> None:
    """One micro-batch of raw lines -> typed RAW check -> clean -> typed
    CLEANED check; good rows and each layer's rejects go to batch folders."""
    batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        raw_good, raw_bad = split_rejects(exam.check_raw(batch, year))
        good, bad = split_rejects(exam.check_cleaned(exam.clean(raw_good, year, fixes), year))
        good.write.mode("overwrite").parquet(f"{out_path}/_batch={batch_id}")
        raw_bad.write.mode("overwrite").parquet(f"{rejects_path}/raw/_batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{rejects_path}/cleaned/_batch={batch_id}")
    finally:
        batch.unpersist()


def stream_cleaned(spark: SparkSession, raw_dir: str, year: int, out_path: str, checkpoint: str,
                   available_now: bool = True, rejects_path: str | None = None,
                   fixes: bool = False) -> StreamingQuery:
    """New raw files of one edition -> CLEANED Parquet, with the batch load's
    RAW and CLEANED checks; rejects under ``rejects_path`` (default
    ``<out_path>_rejects``).  One folder per batch id: a replayed batch
    overwrites its own output, the checkpoint skips files already read."""
    rejects_path = rejects_path or f"{out_path}_rejects"
    w = (read_raw_stream(spark, raw_dir, year).writeStream
         .option("checkpointLocation", checkpoint)
         .foreachBatch(lambda df, bid: write_cleaned_batch(df, bid, year, out_path, rejects_path, fixes)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def write_star_batch(batch: DataFrame, batch_id: int, year: int, out_dir: str,
                     state: str | None = exam.DEFAULT_STATE) -> None:
    """Curate one micro-batch and write each star table to its batch folder.

    The batch feeds twenty writes (good and rejected rows of ten tables), so
    it is persisted once for the duration of the batch and released after.
    """
    batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        star = exam.build_star(exam.curate({year: batch}, state), answers_key=False)
        for name, checked in star.items():
            good, bad = split_rejects(checked)
            good.write.mode("overwrite").parquet(f"{out_dir}/{name}/_batch={batch_id}")
            bad.write.mode("overwrite").parquet(f"{out_dir}/_rejects/{name}/_batch={batch_id}")
    finally:
        batch.unpersist()


def stream_curated(spark: SparkSession, cleaned_path: str, year: int, out_dir: str, checkpoint: str,
                   state: str | None = exam.DEFAULT_STATE, available_now: bool = True) -> StreamingQuery:
    """CLEANED Parquet stream -> curated star tables, one folder per batch."""
    schema = spark.read.parquet(cleaned_path).schema
    src = spark.readStream.schema(schema).parquet(cleaned_path)
    w = (src.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda df, bid: write_star_batch(df, bid, year, out_dir, state)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
