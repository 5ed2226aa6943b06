"""Delimited text whose quoted values hold line breaks, read by many tasks a file.

Whether a line begins a record depends on the quotes before it: inside a
record their number is odd (a doubled quote counts twice).  A first pass sums
the quotes of each split of a file; a running sum over these few rows says in
which state a split begins.  A second pass puts the lines of each split
together to records; what is left at a split's edges, one piece at most at
each end, is joined with its neighbours' pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from microstar.operators.join import bounded_broadcast

_PIECES = "file string, block long, first boolean, kind int, text binary"
#: Whole records; the end of one that began in an earlier split; the beginning of one that does not end in this split.
WHOLE, HEAD, TAIL = 0, 1, 2


def _lines(spark: SparkSession, path) -> DataFrame:
    """Lines of files as bytes, with the file and the split they were read in; carriage returns stay."""
    place = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(
        place["file_path"].alias("file"), place["file_block_start"].alias("block"), F.col("value").cast("binary").alias("line"))


def split_states(lines: DataFrame, quote: str = '"') -> DataFrame:
    """(file, block, inside) for each split: whether it begins inside a quoted value."""
    quotes = F.length("line") - F.octet_length(F.replace(F.col("line").cast("string"), F.lit(quote), F.lit("")))
    sums = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"))
    before = F.sum("quotes").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return sums.select("file", "block", (F.coalesce(before, F.lit(0)) % 2 == 1).alias("inside"))


def _assemble(mark: bytes):
    """Lines of whole splits, in order, to records and edge pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        split, held, kind, open_, first = None, [], WHOLE, False, False

        def flush():
            nonlocal rows
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*rows), (pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()))], ["file", "block", "first", "kind", "text"])
            rows = []
            return out

        def leave():
            if split is not None and held:
                rows.append((*split, first, TAIL if kind == WHOLE else HEAD, b"\n".join(held)))

        for batch in batches:
            for file, block, inside, line in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, block) != split:
                    leave()
                    split, held, open_, first = (file, block), [], inside, block == 0
                    kind = HEAD if inside else WHOLE
                held.append(line)
                if line.count(mark) & 1:
                    open_ = not open_
                if not open_:
                    rows.append((*split, first, kind, b"\n".join(held)))
                    held, kind, first = [], WHOLE, False
                if len(rows) >= 5000:
                    yield flush()
        leave()
        if rows:
            yield flush()

    return run


def quoted_records(spark: SparkSession, path, header: bool = True, quote: str = '"') -> DataFrame:
    """(record) bytes of every record of the files; header records and blank lines are left out."""
    lines = _lines(spark, path)
    states = bounded_broadcast(split_states(lines, quote))
    pieces = lines.join(states, ["file", "block"]).select("file", "block", "inside", "line").mapInArrow(_assemble(quote.encode()), _PIECES)
    whole = pieces.where(F.col("kind") == WHOLE).select("first", F.col("text").alias("record"))
    # a record over several splits: its beginning, whole splits, its end; two pieces a split at most
    order = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, 0)
    edges = pieces.where(F.col("kind") != WHOLE).withColumn("begun", F.count_if(F.col("kind") == TAIL).over(order))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "kind", F.hex("text").alias("text")))), lambda p: p["text"])
    joined = edges.groupBy("file", "begun").agg(F.bool_or("first").alias("first"), F.unhex(F.array_join(parts, "0A")).alias("record"))
    records = whole.union(joined.select("first", "record"))
    if header:
        records = records.where(~F.col("first"))
    return records.select("record").where(F.length("record") > 0)


def read_quoted(spark: SparkSession, path, schema: T.StructType, sep: str, encoding: str, options: dict) -> DataFrame:
    """Records with line breaks inside quotes as typed rows; ``options`` are those of the CSV reader."""
    text = F.regexp_replace(F.decode("record", encoding), "\r$", "")
    own = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items() if k != "header"} | {"sep": sep, "multiLine": "true"}
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    rows = quoted_records(spark, path, header=bool(options.get("header")), quote=options["quote"])
    return rows.select(F.from_csv(text, ddl, own).alias("row")).select("row.*")
