"""Substring dedup by difference-cover anchors.

A difference cover of a period holds, for any two places, a common shift
under the period that brings both to cover positions.  So if two windows of
``window`` words are equal, some shift below the period aligns both on cover
positions, and the ``window - period + 1`` words that start there are equal
too.  It is enough to hash those shorter windows, the anchors, at cover
positions only (4 of every 13 words here).

1. Anchors of all documents meet by hash; those that occur once are dropped.
2. Each repeated anchor extends: every full window around it that could
   have brought it about is fingerprinted (96 bits).
3. Equal windows meet; all but the earliest (document, start) are repeats,
   and the words they cover go.

A passage shared by very many documents is reduced where it is read: of
equal anchors or windows in one slice of a task only one meets those of
other slices, and the others are known as repeats at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from microstar.llm import common, hashing
from microstar.llm.common import written

_U = np.uint64
SLICE_BYTES = 4 << 20

#: Perfect difference covers by period.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}


@dataclass(frozen=True)
class Cover:
    window: int = 20       # words of a window
    least_anchor: int = 6  # words of the shortest anchor

    @property
    def period(self) -> int:
        fitting = [p for p in COVERS if self.window - p + 1 >= min(self.least_anchor, self.window)]
        return max(fitting, default=1)

    @property
    def places(self) -> tuple[int, ...]:
        return COVERS.get(self.period, (0,))

    @property
    def anchor(self) -> int:
        return self.window - self.period + 1


def anchor_places(bounds: np.ndarray, cover: Cover) -> tuple[np.ndarray, np.ndarray]:
    """Word places where an anchor starts, and the text of each."""
    starts, text = hashing.window_starts(bounds, cover.anchor)
    residue = (starts - bounds[:-1][text]) % cover.period
    at = np.isin(residue, cover.places)
    return starts[at], text[at]


def _scatter(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Keys that send rows anywhere, to meet nothing."""
    return hashing.mix(hashes ^ hashing.mix(at.astype(np.uint64) + _U(0x5BD1E995)))


def _first_of_equal(*keys: np.ndarray) -> np.ndarray:
    """Which entries are the first, by place, of those with equal keys."""
    order = np.lexsort(keys[::-1])  # stable: equal keys stay in place order
    new = np.ones(len(order), dtype=bool)
    if len(order) > 1:
        new[1:] = False
        for key in keys:
            new[1:] |= np.diff(key[order]) != 0
    first = np.empty(len(order), dtype=bool)
    first[order] = new
    return first


def _fingerprints(hashes: np.ndarray, starts: np.ndarray, cover: Cover) -> tuple[np.ndarray, np.ndarray]:
    """64 and 31 bits of the windows at ``starts``."""
    return (hashing.windows(hashes, cover.window, starts),
            hashing.windows(hashes, cover.window, starts, seed=17) >> _U(33))


def repeated_anchors(docs: DataFrame, cover: Cover) -> DataFrame:
    """(doc_id, places): word places of a document where a repeated anchor starts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text", SLICE_BYTES):
                found = hashing.words(batch.column(1))
                starts, text = anchor_places(found.bounds, cover)
                hashes = hashing.windows(found.hashes, cover.anchor, starts)
                _, back, counts = np.unique(hashes, return_inverse=True, return_counts=True)
                known = counts[back] > 1
                meets = ~known | _first_of_equal(hashes)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                places = starts - found.bounds[:-1][text]
                # a known repeat is sent on its own; one of its kind also tells other slices
                key = np.concatenate((hashes[meets], _scatter(hashes[known], starts[known])))
                rows = np.concatenate((np.flatnonzero(meets), np.flatnonzero(known)))
                sure = np.concatenate((np.zeros(meets.sum(), np.int32), np.ones(known.sum(), np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(ids[text[rows]]),
                     pa.array((places[rows] * 2 + sure).astype(np.int32))], ["key", "doc_id", "place2"])

    anchors = docs.where("doc_id IS NOT NULL").mapInArrow(run, "key long, doc_id long, place2 int")
    met = F.count(F.lit(1)).over(W.partitionBy("key"))
    return (anchors.withColumn("met", met).where((F.col("met") > 1) | (F.col("place2") % 2 == 1))
            .groupBy("doc_id").agg(F.collect_set(F.floor(F.col("place2") / 2).cast("int")).alias("places")))


def repeated_windows(docs: DataFrame, anchors: DataFrame, cover: Cover) -> DataFrame:
    """(doc_id, starts): windows that also start earlier, as 31 bits of the fingerprint over the start.

    The bits tell apart different texts under one id.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text", SLICE_BYTES):
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                found = hashing.words(batch.column(1))
                lists = batch.column(2)
                owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                places = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                n_words = np.diff(found.bounds)
                wanted = np.zeros(len(found.hashes) + 1, dtype=np.int64)
                low = found.bounds[:-1][owner] + np.maximum(places - cover.period + 1, 0)
                high = found.bounds[:-1][owner] + np.minimum(places, n_words[owner] - cover.window) + 1
                some = high > low
                np.add.at(wanted, low[some], 1)
                np.add.at(wanted, high[some], -1)
                starts = np.flatnonzero(np.cumsum(wanted)[:-1] > 0)
                text = np.searchsorted(found.bounds, starts, side="right") - 1
                h1, h2 = _fingerprints(found.hashes, starts, cover)
                owners, at = ids[text], starts - found.bounds[:-1][text]
                # repeated rows have their windows at one (document, start): one of them speaks for all
                once = _first_of_equal(h1, h2, owners, at)
                h1, h2, owners, at = h1[once], h2[once], owners[once], at[once]
                order = np.lexsort((at, owners))  # so that the first of equals is the earliest
                h1, h2, owners, at = h1[order], h2[order], owners[order], at[order]
                first = _first_of_equal(h1, h2)
                # a known repeat meets nothing but others of its document
                h1 = np.where(first, h1, hashing.mix(owners.astype(np.int64).view(np.uint64)))
                start2 = at * 2 + ~first
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1.view(np.int64)), pa.array(owners),
                     pa.array(((h2 << _U(32)) | start2.astype(np.uint64)).view(np.int64))], ["h1", "doc_id", "packed"])

    around = docs.join(anchors, "doc_id").select("doc_id", "text", "places").mapInArrow(
        run, "h1 long, doc_id long, packed long").repartition("h1")
    h2 = F.shiftright("packed", 32)
    start2 = F.col("packed").bitwiseAND(0xFFFFFFFF)
    known = start2 % 2 == 1
    rows = around.select("h1", "doc_id", F.when(known, -1).otherwise(h2).alias("group"), known.alias("known"),
                         F.shiftright(start2, 1).alias("start"), h2.alias("h2"))
    place = F.struct("doc_id", "start")
    earliest = F.min(F.when(~F.col("known"), place)).over(W.partitionBy("h1", "group"))
    return (rows.withColumn("earliest", earliest).where(F.col("known") | (place > F.col("earliest")))
            .groupBy("doc_id")
            .agg(F.collect_list(F.shiftleft("h2", 32).bitwiseOR(F.col("start"))).alias("starts")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cover: Cover = Cover(),
          with_text: bool = False) -> DataFrame:
    """Remove every word under a window that also starts earlier.

    Returns one row per input row: ``doc_id, n_words, n_removed,
    kept_sha256`` and, on request, ``kept`` (the words left, joined by
    single spaces).  Earlier is a smaller id, or an earlier start in the
    same document.  Null texts have no words.  Rows without an id lose
    nothing and make nobody else lose; rows with the same id and text are
    the same document and fare alike; of different texts with one id,
    windows are ordered by start alone.  Ids are integers; other columns
    are not read.  An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    anchors = written(repeated_anchors(docs, cover), "anchors")
    repeats = written(repeated_windows(docs, anchors, cover), "repeats")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text", SLICE_BYTES):
                rows = []
                for doc_id, text, starts in zip(batch.column(0).to_pylist(), common.texts(batch.column(1)),
                                                batch.column(2)):
                    words = common.WORD.findall(text)
                    n = len(words)
                    if starts.is_valid:
                        words = _kept(words, text, starts.values, cover)
                    kept = " ".join(words)
                    row = (doc_id, n, n - len(words), hashlib.sha256(kept.encode("utf-8")).hexdigest())
                    rows.append((*row, kept) if with_text else row)
                kinds = [pa.int64()] * 3 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return (docs.join(repeats, "doc_id", "left").select("doc_id", "text", "starts")
            .mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string"
                        + (", kept string" if with_text else "")))


def _kept(words: list[str], text: str, packed: pa.Array, cover: Cover) -> list[str]:
    """The words outside the windows that begin at this text's own ``starts``."""
    packed = packed.to_numpy(zero_copy_only=False).astype(np.int64)
    at, bits = packed & 0xFFFFFFFF, (packed >> 32).astype(np.uint64)
    inside = at + cover.window <= len(words)
    at, bits = at[inside], bits[inside]
    at = at[_fingerprints(hashing.words(pa.array([text])).hashes, at, cover)[1] == bits]
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + cover.window, -1)
    gone = np.cumsum(depth)[:-1] > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]
