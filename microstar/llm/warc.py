"""WARC archives written and read as a table of payload chunks.

A payload travels as rows (record, chunk number, bytes) of at most
``CHUNK_BYTES``, cut by Spark before any Python sees it.  Writers compress
and readers digest chunk by chunk, so no task allocates a whole record
beyond what Spark holds for the input row itself.  An archive is a row of
gzip members, one a record, so a record can be read alone.

Of records with equal payloads of ``least_bytes`` or more, the one with the
largest id is written as response and the others as revisits that refer to
it, without the payload.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from microstar.llm import files
from microstar.session import scratch_path

CHUNK_BYTES = 256 << 10
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"

_CHUNKS = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, sha1 string, "
           "chunk long, data binary")


def classify(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
             least_bytes: int = 1000) -> DataFrame:
    """Pages with payload size, SHA-1, and whether each is a response or a revisit.

    Equal payloads are told by size, SHA-1 and SHA-256.  Only these small
    columns meet in the grouping; a payload shared by very many pages is
    first reduced inside each task, and the join back is an ordinary
    equi-join that adaptive execution splits where it is skewed.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = (pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                         F.col(html_col).alias("html")))
    keys = (rows.select("page_id", F.octet_length(payload).cast("long").alias("payload_bytes"),
                        F.sha1(payload).alias("sha1"), F.sha2(payload, 256).alias("sha256"))
            .where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull()))
    equal = ["payload_bytes", "sha1", "sha256"]
    heads = keys.groupBy(*equal).agg(F.max("page_id").alias("head"), F.min("page_id").alias("least"))
    shared = heads.where("head > least").drop("least")  # payloads of one page need no lookup
    revisits = (keys.join(shared, equal).where("page_id < head").groupBy("page_id", "sha256")
                .agg(F.max("head").alias("refers_to")).withColumnsRenamed({"page_id": "id__", "sha256": "sha256__"}))
    whole = rows.withColumn("payload", payload).select(
        "page_id", "url", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("sha256"), "payload")
    marked = whole.join(revisits, (F.col("page_id") == F.col("id__")) & (F.col("sha256") == F.col("sha256__")), "left")
    return marked.select("page_id", "url", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
                         .alias("record_type"), "refers_to", "payload_bytes", "sha1", "payload")


def chunked(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row for each chunk of a payload (one, empty, for revisits and empty payloads), in order."""
    stored = F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(F.lit(0))
    last = F.greatest(F.ceil(stored / F.lit(float(chunk_bytes))) - 1, F.lit(0)).cast("long")
    piece = F.substring(F.col("payload"), (F.col("chunk") * chunk_bytes + 1).cast("int"), F.lit(chunk_bytes))
    return (records.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
            .select("page_id", "url", "record_type", "refers_to", "payload_bytes", "sha1", "chunk",
                    F.when(F.col("record_type") == "response", piece).otherwise(F.lit(b"")).alias("data")))


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _header(page_id, url, record_type, refers_to, payload_bytes, sha1) -> bytes:
    """Header of a record; the payload digest is that of the full payload also for revisits."""
    fields = [VERSION, f"WARC-Type: {record_type}", f"WARC-Record-ID: {_record_id(page_id)}",
              "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        fields.append(f"WARC-Target-URI: {' '.join(url.split())}")
    fields.append(f"WARC-Payload-Digest: sha1:{sha1}")
    if record_type == "revisit":
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    fields += ["Content-Type: text/html; charset=utf-8",
               f"Content-Length: {payload_bytes if record_type == 'response' else 0}"]
    return (CRLF.join(fields) + CRLF + CRLF).encode("utf-8")


def write(pages: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, **columns) -> DataFrame:
    """Write a record for every page; returns the written files (part, path, n_records).

    The chunks of a record follow each other inside its task.  The list of
    files of finished attempts is kept as Parquet in ``folder``/manifest; a
    file of a lost attempt is in no list.
    """
    spark = pages.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, path = files.attempt_path(folder, ".warc.gz")
        stream, packer, count = None, None, 0
        for batch in batches:
            if stream is None and batch.num_rows:
                system, place = files.shared(path)
                system.create_dir(place.rsplit("/", 1)[0])
                stream = system.open_output_stream(place, compression=None)
            ids, urls, types, refers, sizes, sha1s, chunks = (batch.column(i).to_pylist() for i in range(7))
            data = batch.column(7)
            for i, chunk in enumerate(chunks):
                if chunk == 0:
                    if packer is not None:
                        _finish(stream, packer)
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    stream.write(packer.compress(_header(ids[i], urls[i], types[i], refers[i], sizes[i], sha1s[i])))
                    count += 1
                stream.write(packer.compress(data[i].as_buffer()))
        if stream is not None:
            _finish(stream, packer)
            stream.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_records": [count]})

    written = chunked(classify(pages, **columns), chunk_bytes).mapInArrow(
        run, "part long, path string, n_records long")
    written.write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def _finish(stream, packer) -> None:
    stream.write(packer.compress((CRLF + CRLF).encode()))
    stream.write(packer.flush())


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("part long, path string, n_records long").parquet(f"{folder}/manifest")


class Record:
    """A record being read: header fields, and its payload's running length and digest."""

    def __init__(self, fields: dict[str, str]):
        self.fields = fields
        self.left = int(fields["content-length"])
        self.bytes, self.sha1, self.chunk = 0, hashlib.sha1(), 0


def read_records(stream, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[Record, bytes, bool]]:
    """Stream an archive: (record, chunk of its payload, whether it is the last).

    Members are decompressed with a bound on each step's output.  Digests are
    updated chunk by chunk and the record's own digest is compared at its end.
    """
    member, raw, held = zlib.decompressobj(31), b"", bytearray()
    record = None
    ended = False

    def more() -> bool:
        nonlocal member, raw, ended
        while True:
            if member.eof:
                raw = member.unused_data or raw
                member = zlib.decompressobj(31)
            if not raw:
                raw = stream.read(chunk_bytes)
                if not raw:
                    ended = True
                    return False
            out = member.decompress(raw, chunk_bytes)
            raw = member.unconsumed_tail if not member.eof else member.unused_data
            if member.eof:
                member = zlib.decompressobj(31)
            if out:
                held.extend(out)
                return True

    while True:
        if record is None:
            at = held.find(b"\r\n\r\n")
            while at < 0:
                if not more():
                    if held.strip():
                        raise ValueError("the archive ends inside a header")
                    return
                at = held.find(b"\r\n\r\n")
            lines = bytes(held[:at]).decode("utf-8").split(CRLF)
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
            del held[:at + 4]
            record = Record({k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])})
        while len(held) < min(record.left, chunk_bytes):
            if not more():
                raise ValueError("the archive ends inside a payload")
        size = min(record.left, chunk_bytes)
        data = bytes(held[:size])
        del held[:size]
        record.left -= size
        record.bytes += size
        record.sha1.update(data)
        last = record.left == 0
        if last:
            while len(held) < 4:
                if not more():
                    raise ValueError("the archive ends inside a record")
            if held[:4] != b"\r\n\r\n":
                raise ValueError("a record does not end where its length says")
            del held[:4]
            if record.fields["warc-type"] == "response" and \
                    record.fields["warc-payload-digest"] != f"sha1:{record.sha1.hexdigest()}":
                raise ValueError(f"digest mismatch in {record.fields['warc-record-id']}")
        yield record, data, last
        record.chunk += 1
        if last:
            record = None


_TABLE = ("page_id long, url string, record_type string, refers_to long, chunk long, last boolean, "
          "chunk_bytes long, running_bytes long, running_sha1 string, header_sha1 string")


def read(spark: SparkSession, folder: str, chunk_bytes: int = CHUNK_BYTES, with_data: bool = False) -> DataFrame:
    """The chunk table of all archives of a folder: one row for each chunk of each record.

    ``running_bytes`` and ``running_sha1`` cover the payload up to and with
    the chunk; in the ``last`` row they are the record's own.  The bytes
    themselves come on request.
    """
    schema = _TABLE + (", data binary" if with_data else "")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(),
             pa.string(), pa.string(), *([pa.binary()] if with_data else [])]

    def number(urn: str | None) -> int | None:
        text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text not in ("", "none") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = files.shared(path)
                rows, held = [], 0
                with system.open_input_file(place) as stream:
                    for record, data, last in read_records(stream, chunk_bytes):
                        f = record.fields
                        row = (number(f["warc-record-id"]), f.get("warc-target-uri"), f["warc-type"],
                               number(f.get("warc-refers-to")), record.chunk, last, len(data), record.bytes,
                               record.sha1.hexdigest(), f["warc-payload-digest"].removeprefix("sha1:"))
                        rows.append((*row, data) if with_data else row)
                        held += len(data) if with_data else 100
                        if held > 4 << 20 or len(rows) == 5000:
                            yield _batch(rows, names, kinds)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, names, kinds)

    paths = files.one_a_task(manifest(spark, folder).select("path"))
    return paths.mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def write_and_read(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages, read the archives back, and describe every record.

    Returns one row per page: ``page_id, payload_bytes, payload_digest,
    record_type, refers_to``.  A revisit's size is that of the response it
    refers to, found by its id; its digest is in its own header.  Null html
    is empty.  Null ids are written but are never revisits; rows with equal
    ids and payloads are written each, all as responses if they hold the
    largest id.  Other columns are not read.  An empty table gives an empty
    result.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    write(pages, folder)
    records = read(spark, folder).where("last")
    sizes = (records.where("record_type = 'response' AND page_id IS NOT NULL")
             .groupBy(F.col("page_id").alias("refers_to"), F.col("running_sha1").alias("header_sha1"))
             .agg(F.max("running_bytes").alias("full")))
    # the plan's size estimate comes from the small list of files, so a broadcast must be ruled out
    return (records.join(sizes.hint("merge"), ["refers_to", "header_sha1"], "left")
            .select("page_id", F.coalesce("full", "running_bytes").alias("payload_bytes"),
                    F.col("header_sha1").alias("payload_digest"), "record_type", "refers_to"))


#: DuckDB SQL for the rows of ``write_and_read(pages)``.
ORACLE = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS head FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < head THEN head END AS refers_to
FROM m
"""
