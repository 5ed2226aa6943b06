"""Token ids in binary files of independent zstandard frames with a seek table.

A file is a row of frames, each the little-endian 32-bit ids of whole
documents up to about ``FRAME_BYTES``; then a skippable frame with the
directory (ids of the documents and their numbers of tokens); then the seek
table of the public seekable zstandard format, a skippable frame with each
frame's compressed size, size and checksum (low 32 bits of XXH64).  Plain
zstandard readers see the ids alone.  A reader of some documents finds their
frames by directory and seek table and decompresses no other frame.

Documents are range-partitioned by id, so files and their frames are in
ascending order; a running sum over the files' totals gives each document's
place in the whole.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from microstar.llm import common, files
from microstar.session import scratch_path

# Fixed values of the seekable format.
SEEK_MAGIC, SKIP_SEEK, SKIP_DIRECTORY = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50
HAS_CHECKSUMS = 0x80
FRAME_BYTES = 1 << 20

# Text that is encoded at a time: words that come again in it are encoded once.
SLICE_BYTES = 8 << 20

_PRE = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z\xe0-\xf6\xf8-\xff\xdf]+|[0-9]|"
                  r"[^\sa-z\xe0-\xf6\xf8-\xff\xdf0-9]+")
_ODD = "[^!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]"


class WordEncoder:
    """Encodes texts with a tokenizers file, each distinct word of some texts once.

    Words between ASCII white space are independent for tokenizers that drop
    white space before merging; the distinct ones of the texts at hand are
    encoded together, in Arrow columns.  Words of ASCII and Latin-1 letters,
    digits and marks share the library's merges of their parts (after
    lower-casing and splitting as the tokenizer does): the distinct parts go
    to the library as one text, and the suffix of a part's last token shows
    where it ends.  Any other word goes through the library whole.  A
    tokenizer of another build encodes whole texts.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.library = Tokenizer.from_file(path)
        steps = [s["type"] for s in (made.get("normalizer") or {}).get("normalizers", [])]
        splits = (made.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        pattern = splits[0].get("pattern", {}).get("Regex", "")
        # Fixed value: the split of this family of tokenizers, the one the shortcut is right for.
        known = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        vocabulary, suffix = made["model"]["vocab"], made["model"].get("end_of_word_suffix")
        self.by_word = (steps == ["NFC", "Replace", "Lowercase"] and pattern == known and bool(suffix)
                        and all(letter + suffix in vocabulary for letter in ByteLevel.alphabet()))
        if self.by_word:
            self.closing = np.zeros(self.library.get_vocab_size(), dtype=bool)
            self.closing[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
            self.merges = Tokenizer(self.library.model)
            self.merges.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.odd = "|".join([_ODD, *(re.escape(t["content"]) for t in made.get("added_tokens", []))])

    def _parts(self, parts: pa.Array) -> pa.Array:
        """Ids of lower-cased parts, merged by the library."""
        ids = _ids(self.merges, [_joined(parts, [0, len(parts)], " ")[0].as_py()])[0]
        ends = 4 * (np.flatnonzero(self.closing[np.frombuffer(ids, "<u4")]) + 1)
        if len(ends) != len(parts):  # a suffix that is text
            return pa.array(_ids(self.merges, parts.to_pylist()), pa.large_binary())
        places = np.append(0, ends).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(parts), [None, pa.py_buffer(places), pa.py_buffer(ids)])

    def _words(self, words: pa.Array) -> pa.Array:
        """Ids of words without ASCII white space."""
        odd = pc.match_substring_regex(words, self.odd)
        plain = words.filter(pc.invert(odd))
        lines = _joined(plain, [0, len(plain)], "\n")[0].as_py() + "\n" * (len(plain) > 0)
        found = pa.array(_PRE.findall(lines.lower()), pa.large_string())
        last = pc.equal(found, "\n")
        ends = np.flatnonzero(last.to_numpy(zero_copy_only=False))
        parts = found.filter(pc.invert(last)).dictionary_encode()
        made = _joined(self._parts(parts.dictionary).take(parts.indices), np.append(0, ends - np.arange(len(ends))), b"")
        if len(plain) == len(words):
            return made
        place = np.argsort(np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable"))
        whole = pa.array(_ids(self.library, words.filter(odd).to_pylist()), pa.large_binary())
        return pa.concat_arrays([made, whole]).take(pa.array(place))

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text (null: empty) as little-endian unsigned 32-bit integers."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_word:
            return _ids(self.library, texts.to_pylist())
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        return _joined(self._words(words.dictionary).take(words.indices), split.offsets, b"").to_pylist()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return self.encode_all(pa.array([text], pa.string()))[0]


def _ids(library, texts: list[str]) -> list[bytes]:
    """Ids of each text by the tokenizers library."""
    made = library.encode_batch_fast(texts, add_special_tokens=False)
    return [np.asarray(m.ids, dtype="<u4").tobytes() for m in made]


def _joined(values: pa.Array, bounds, between: str | bytes) -> pa.Array:
    """The values between each two ``bounds`` joined."""
    lists = pa.LargeListArray.from_arrays(pa.array(np.asarray(bounds), pa.int64()), values)
    return pc.binary_join(lists, pa.scalar(between, values.type))


_LOADED: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of a tokenizer file, made once in a Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


class FrameWriter:
    """Writes documents to a binary stream in frames, the directory and the seek table last."""

    def __init__(self, stream, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.stream, self.frame_bytes = stream, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True)
        self.pending: list[bytes] = []
        self.held = 0
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        self.total = 0

    def add(self, doc_id: int | None, tokens: bytes) -> None:
        if self.held and self.held + len(tokens) > self.frame_bytes:
            self._flush()
        self.pending.append(tokens)
        self.held += len(tokens)
        self.ids.append(doc_id)
        self.counts.append(len(tokens) // 4)
        self.total += len(tokens) // 4

    def _flush(self) -> None:
        import xxhash

        if not self.pending:
            return
        raw = b"".join(self.pending)
        packed = self.packer.compress(raw)
        self.stream.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.pending, self.held = [], 0

    def close(self) -> None:
        self._flush()
        known = np.asarray([i is not None for i in self.ids], dtype="u1").tobytes()
        ids = np.asarray([i or 0 for i in self.ids], dtype="<i8").tobytes()
        directory = self.packer.compress(known + ids + np.asarray(self.counts, dtype="<u4").tobytes())
        body = struct.pack("<Q", len(self.ids)) + directory
        self.stream.write(struct.pack("<II", SKIP_DIRECTORY, len(body)) + body)
        entries = [(8 + len(body), 0, 0)]
        table = b"".join(struct.pack("<III", *e) for e in self.frames + entries)
        foot = struct.pack("<IBI", len(self.frames) + 1, HAS_CHECKSUMS, SEEK_MAGIC)
        self.stream.write(struct.pack("<II", SKIP_SEEK, len(table) + len(foot)) + table + foot)


class FrameReader:
    """Reads documents of a file; only the frames of the wanted ones are read and decompressed."""

    def __init__(self, stream, size: int):
        import zstandard

        self.stream = stream
        self.unpacker = zstandard.ZstdDecompressor()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or not flags & HAS_CHECKSUMS:
            raise ValueError("not a seekable file with checksums")
        table = self._at(size - 9 - 12 * count, 12 * count)
        self.frames = [struct.unpack_from("<III", table, 12 * i) for i in range(count - 1)]
        packed = np.cumsum([0, *(f[0] for f in self.frames)])
        self.frame_at = packed.tolist()
        skip, length = struct.unpack("<II", self._at(self.frame_at[-1], 8))
        if skip != SKIP_DIRECTORY:
            raise ValueError("the directory is missing")
        body = self._at(self.frame_at[-1] + 8, length)
        n = struct.unpack_from("<Q", body)[0]
        raw = self.unpacker.decompress(body[8:]) if n else b""
        known = np.frombuffer(raw, dtype="u1", count=n)
        ids = np.frombuffer(raw, dtype="<i8", count=n, offset=n)
        self.ids = [i if k else None for i, k in zip(ids.tolist(), known.tolist())]
        self.counts = np.frombuffer(raw, dtype="<u4", count=n, offset=9 * n).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.first = np.cumsum([0, *(f[1] // 4 for f in self.frames)])

    def _at(self, place: int, length: int) -> bytes:
        self.stream.seek(place)
        return self.stream.read(length)

    def frame(self, k: int) -> bytes:
        import xxhash

        packed, size, checksum = self.frames[k]
        raw = self.unpacker.decompress(self._at(self.frame_at[k], packed), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} does not match its checksum")
        return raw

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, ids before it in the file, its ids) of all or the wanted documents, in file order."""
        wanted = None if wanted is None else set(wanted)
        now, raw = -1, b""
        for doc_id, start, count in zip(self.ids, self.starts.tolist(), self.counts.tolist()):
            if wanted is not None and doc_id not in wanted:
                continue
            if not count:
                yield doc_id, start, b""
                continue
            k = int(np.searchsorted(self.first, start, side="right")) - 1
            if k != now:
                now, raw = k, self.frame(k)
            at = 4 * (start - int(self.first[k]))
            yield doc_id, start, raw[at:at + 4 * count]


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Encode all texts and write them to ``folder`` in ascending id order.

    Returns the written files as (part, path, n_docs, n_ids, start), also kept as
    Parquet in ``folder``/manifest.  Null texts are empty and hold the end id
    alone; null ids come first; rows with equal ids are ordered by text.
    Other columns are not read.  An empty table gives no files.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, path = files.attempt_path(folder, ".zst")
        writer = None
        end = struct.pack("<I", end_id)
        for batch in batches:
            if writer is None and batch.num_rows:
                system, place = files.shared(path)
                system.create_dir(place.rsplit("/", 1)[0])
                stream = system.open_output_stream(place, compression=None)
                writer, encode = FrameWriter(stream), encoder(tokenizer_path).encode_all
            for some in common.slices(batch, "text", SLICE_BYTES):
                for doc_id, ids in zip(some.column(0).to_pylist(), encode(some.column(1))):
                    writer.add(doc_id, ids + end)
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_docs": [len(writer.ids)],
                                              "n_ids": [writer.total]})

    ordered = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))
    written = ordered.mapInArrow(run, "part long, path string, n_docs long, n_ids long")
    written.write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder in order, with the ids before each (one row a file)."""
    found = spark.read.schema("part long, path string, n_docs long, n_ids long").parquet(f"{folder}/manifest")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return found.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, read from the files.

    Every frame is checked against its checksum; ``ids_crc32`` is over the
    document's ids as little-endian unsigned 32-bit integers.
    """
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, place = files.shared(path)
                with system.open_input_file(place) as stream:
                    rows = []
                    for doc_id, start, ids in FrameReader(stream, stream.size()).documents():
                        row = (doc_id, before + start, len(ids) // 4, zlib.crc32(ids))
                        rows.append((*row, np.frombuffer(ids, "<u4").astype(np.int64)) if with_ids else row)
                        if len(rows) == 2000:
                            yield _batch(rows, names)
                            rows = []
                    if rows:
                        yield _batch(rows, names)

    paths = files.one_a_task(manifest(spark, folder).select("path", "start"))
    return paths.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"
                            + (", ids array<long>" if with_ids else ""))


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.int64()] * 4 + [pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def write_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write all documents to a fresh shared folder and read the files back."""
    folder = scratch_path(docs.sparkSession, "token-files")
    write(docs, folder, tokenizer_path, end_id)
    return read(docs.sparkSession, folder)
