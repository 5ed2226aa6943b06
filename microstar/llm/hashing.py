"""Vectorised word and word-window fingerprints of a batch of texts (numpy, inside tasks).

A word's fingerprint is a sum modulo 2**64 of a mixed value for each
(place in the word, byte) pair; a window's fingerprint combines the
fingerprints of its words with one random odd multiplier per place.  Equal
words and windows have equal fingerprints; others agree with probability
about 2**-64 for each pair.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

_GOLDEN = 0x9E3779B97F4A7C15
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    """``n`` odd pseudo-random 64-bit multipliers."""
    base = (np.arange(1, n + 1, dtype=np.uint64) + _U(seed * 1_000_003)) * _U(_GOLDEN)
    return mix(base) | _U(1)


class Words(NamedTuple):
    """Words of a batch: fingerprints, and for each text the bounds of its words.

    ``starts``/``ends`` are byte places in ``data``; words of text ``i`` are
    ``bounds[i]:bounds[i + 1]``.
    """

    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and text offsets of an Arrow string column (null: empty)."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    first, last = int(offsets[0]), int(offsets[-1])
    if data is None or first == last:
        return np.empty(0, np.uint8), offsets - first
    return np.frombuffer(data, dtype=np.uint8)[first:last], offsets - first


def words(column: pa.Array, lower: bool = False, seed: int = 1) -> Words:
    """Find and fingerprint the words of every text; ``lower`` folds A-Z first."""
    data, offsets = text_bytes(column)
    if lower and len(data):
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    size = len(data)
    if not size:
        none = np.empty(0, np.int64)
        return Words(data, np.empty(0, np.uint64), none, none, np.zeros(len(offsets), np.int64))
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = np.zeros(size + 1, dtype=bool)  # where a text begins, whatever stands before
    first[offsets] = True
    before = np.empty(size, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:size]))
    after = np.empty(size, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    place = np.arange(size, dtype=np.int64)
    lengths = ends - starts
    # place of each byte in its word; white space gets rubbish that no word sums up
    begin = np.zeros(size, dtype=np.int64)
    begin[starts] = starts
    np.maximum.accumulate(begin, out=begin)
    place -= begin
    value = ((place.astype(np.uint64) << _U(8)) | data.astype(np.uint64)) + _U(seed) * _U(_GOLDEN)
    total = np.zeros(size + 1, dtype=np.uint64)
    np.cumsum(mix(value * _U(_GOLDEN)), out=total[1:])
    hashes = mix(total[ends] - total[starts] + lengths.astype(np.uint64) * _U(_GOLDEN))
    bounds = np.searchsorted(starts, offsets)
    return Words(data, hashes, starts, ends, bounds.astype(np.int64))


def windows(hashes: np.ndarray, length: int, at: np.ndarray | None = None, seed: int = 7) -> np.ndarray:
    """Fingerprints of the ``length``-word windows that start ``at`` these places.

    ``at`` defaults to every place; a window must lie inside ``hashes``.
    """
    if at is None:
        at = np.arange(max(0, len(hashes) - length + 1), dtype=np.int64)
    total = np.zeros(len(at), dtype=np.uint64)
    for k, factor in enumerate(seeds(length, seed)):
        total += hashes[at + k] * factor
    return mix(total)


def window_starts(bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows that stay within one text, and the text of each."""
    counts = np.maximum(np.diff(bounds) - length + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    ahead = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - ahead[text] + bounds[:-1][text], text
