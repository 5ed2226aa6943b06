"""Spelling variants: words one edit apart, found through Bloom filters of the vocabulary.

Runs of letters are counted over all texts; those that are long and frequent
enough are the vocabulary.  Of each word all results of deleting one code
point or replacing one by a later letter are made as hashes and looked up in
blocked Bloom filters of the vocabulary, one for each word length, which are
broadcast.  (An insertion is a deletion seen from the other word, and a
replacement by an earlier letter a replacement by a later one.)  Only what
the filters let through becomes text and goes to a join with the vocabulary
itself, which removes the false positives.

A filter row is a block of 512 bits.  Filters of more than ``filter_bytes``
in all are met in several passes, each with the words of one hash range, so
what is broadcast stays under that bound whatever the vocabulary.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from microstar.llm.common import slices, texts, written
from microstar.llm.hashing import mix

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: The letters of a run after A-Z are lower-cased.
LETTERS = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)], dtype=np.uint64)

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)
#: Bits of a filter for each word, bits set for each, 64-bit lanes of a block.
BITS, PROBES, LANES = 24, 5, 8


# ------------------------------------------------------------- words ----

def folded(text: str) -> str:
    """A-Z lower-cased, nothing else (bytes lower-case only ASCII)."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def slip(prefix: int, run: str, every: int) -> str:
    """The run, or the run without one code point where ``every`` divides its hash.

    ``prefix`` is the crc32 of what stands before the run in the hashed text.
    """
    h = zlib.crc32(run.encode("utf-8"), prefix)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _runs(text: str) -> Counter[str]:
    """How often each run occurs; of a very long text no list of all runs is made."""
    return Counter(RUN.findall(text) if len(text) < 1 << 20 else (m[0] for m in RUN.finditer(text)))


def counted(docs: DataFrame, least_length: int, every: int, doc_id: str, text: str) -> DataFrame:
    """(word, n) of all texts: counted in each slice of a task, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                found: Counter[str] = Counter()
                for id_, one in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                    prefix = zlib.crc32(f"{'' if id_ is None else id_}:".encode())
                    for word, n in _runs(folded(one)).items():
                        if len(word) >= least_length:
                            found[slip(prefix, word, every)] += n
                kept = [w for w in found if len(w) >= least_length]
                yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array([found[w] for w in kept], pa.int64())], ["word", "n"])

    each = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n"))


# ----------------------------------------------------------- filters ----

def _place_factors(n: int) -> np.ndarray:
    """One odd multiplier for each place in a word."""
    return mix((np.arange(1, n + 1, dtype=np.uint64)) * _GOLDEN) | _U(1)


def _values(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(np.uint64) * _GOLDEN + _U(1))


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), -1).astype(np.uint64)


def word_hashes(codes: np.ndarray) -> np.ndarray:
    """Sum of place times value, so that an edit changes few terms; mixed only when it is looked up."""
    return (_values(codes) * _place_factors(codes.shape[1])).sum(1, dtype=np.uint64)


class Layout(NamedTuple):
    """Where the words of each length lie: blocks of a length, and the number of passes."""

    blocks: dict[int, int]
    passes: int

    def part(self, hashes: np.ndarray) -> np.ndarray:
        """The pass in which a word is looked up."""
        return (mix(hashes ^ _U(0xA5A5)) % _U(self.passes)).astype(np.int64)

    def block(self, hashes: np.ndarray, length: int) -> np.ndarray:
        return (mix(hashes) >> _U(32)) % _U(self.blocks[length])


def layout(vocabulary: DataFrame, filter_bytes: int) -> Layout:
    """Sizes of the filters from the number of words of each length (one row a length)."""
    n = {r["length"]: r["n"] for r in vocabulary.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(64 * ceil(v * BITS / 512) for v in n.values())
    passes = max(1, ceil(total / filter_bytes))
    return Layout({k: ceil(v * BITS / 512 / passes) for k, v in n.items()}, passes)


def _bits(hashes: np.ndarray) -> np.ndarray:
    """For each hash the 512 bits it sets, as eight lanes."""
    lanes = np.zeros((len(hashes), LANES), dtype=np.uint64)
    h, rows = mix(hashes + _GOLDEN), np.arange(len(hashes))
    for k in range(PROBES):
        bit = (h >> _U(9 * k)) & _U(511)
        lanes[rows, (bit >> _U(6)).astype(np.int64)] |= _U(1) << (bit & _U(63))
    return lanes


def filters(vocabulary: DataFrame, plan: Layout) -> DataFrame:
    """(part, length, block, lane_0..lane_7): the filter rows, by a partial aggregate of the words' bits."""
    lanes = [f"lane_{i}" for i in range(LANES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, _, words in _by_length(batch.column(0).to_pylist()):
                hashes = word_hashes(_codes(words))
                bits = _bits(hashes).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(plan.part(hashes)), pa.array(np.full(len(words), length)), pa.array(plan.block(hashes, length).astype(np.int64)),
                     *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(LANES))], ["part", "length", "block", *lanes])

    rows = vocabulary.select("word").mapInArrow(run, "part long, length long, block long, " + ", ".join(f"{x} long" for x in lanes))
    return rows.groupBy("part", "length", "block").agg(*[F.bit_or(x).alias(x) for x in lanes])


def _by_length(words: list[str]) -> Iterator[tuple[int, list[int], list[str]]]:
    """(length, indexes, words) for each length among the words."""
    found: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        found.setdefault(len(w), []).append(i)
    for length, at in found.items():
        yield length, at, [words[i] for i in at]


def _arrays(rows: list, plan: Layout) -> dict[int, np.ndarray]:
    """The filters of one pass as arrays of blocks, by length."""
    out = {length: np.zeros((n, LANES), dtype=np.uint64) for length, n in plan.blocks.items()}
    for r in rows:
        out[r["length"]][r["block"]] = np.array(r[2:], dtype=np.int64).view(np.uint64)
    return out


def _positive(held: dict[int, np.ndarray], plan: Layout, part: int, length: int, hashes: np.ndarray) -> np.ndarray:
    """Indexes of the hashes that this pass's filter of this length lets through."""
    if length not in held:
        return np.empty(0, dtype=np.int64)
    at = np.arange(len(hashes)) if plan.passes == 1 else np.flatnonzero(plan.part(hashes) == part)
    block = plan.block(hashes[at], length).astype(np.int64)
    h = mix(hashes[at] + _GOLDEN)
    for k in range(PROBES):  # most fall at the first bits
        bit = (h >> _U(9 * k)) & _U(511)
        hit = (held[length][block, (bit >> _U(6)).astype(np.int64)] >> (bit & _U(63))) & _U(1) > 0
        at, block, h = at[hit], block[hit], h[hit]
    return at


# ---------------------------------------------------- neighbourhoods ----

def deletions(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word index, place, hash) of all words without one code point; of equal neighbours the first goes."""
    codes = _codes(words)
    n, length = codes.shape
    factors, values = _place_factors(length), _values(codes)
    kept = np.zeros((n, length + 1), dtype=np.uint64)
    moved = np.zeros((n, length + 1), dtype=np.uint64)
    np.cumsum(values * factors, axis=1, out=kept[:, 1:])
    moved[:, 2:] = np.cumsum(values[:, 1:] * factors[:-1], axis=1)  # a place to the left
    hashes = kept[:, :-1] + moved[:, -1:] - moved[:, 1:]
    first = np.ones((n, length), dtype=bool)
    first[:, 1:] = codes[:, 1:] != codes[:, :-1]
    row, place = np.nonzero(first)
    yield row, place, hashes[row, place]


def replacements(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(word index, place, letter, hash) of all words with one code point replaced by a later letter, place by place."""
    codes = _codes(words)
    whole = word_hashes(codes)
    factors, values = _place_factors(codes.shape[1]), _values(LETTERS)
    for place in range(codes.shape[1]):
        own = codes[:, place]
        rest = whole - _values(own) * factors[place]
        row, letter = np.nonzero(LETTERS[None] > own[:, None])
        yield row, np.full(len(row), place), LETTERS[letter], rest[row] + values[letter] * factors[place]


def _edits(words: list[str], held: dict[int, np.ndarray], plan: Layout, part: int) -> Iterator[tuple[list[int], list[str]]]:
    """(word indexes, edited words) that the filters let through; the words have one length."""
    length = len(words[0])
    if length - 1 in held:
        for row, place, hashes in deletions(words):
            at = _positive(held, plan, part, length - 1, hashes)
            yield row[at].tolist(), [words[r][:p] + words[r][p + 1:] for r, p in zip(row[at].tolist(), place[at].tolist())]
    if length in held:
        for row, place, letter, hashes in replacements(words):
            at = _positive(held, plan, part, length, hashes)
            yield row[at].tolist(), [words[r][:p] + chr(c) + words[r][p + 1:]
                                     for r, p, c in zip(row[at].tolist(), place[at].tolist(), letter[at].tolist())]


def near_pairs(vocabulary: DataFrame, filter_bytes: int = 32 << 20) -> DataFrame:
    """(word, n, other, other_n): all pairs of vocabulary words one edit apart, in one order each.

    ``vocabulary`` has distinct words with their counts; it is read once a pass.
    """
    plan = layout(vocabulary, filter_bytes)
    spark = vocabulary.sparkSession
    blocks = written(filters(vocabulary, plan), "bloom-blocks")
    found = None
    for part in range(plan.passes):
        rows = blocks.where(F.col("part") == part).drop("part").collect()  # at most filter_bytes of lanes
        sent = spark.sparkContext.broadcast(_arrays(rows, plan))
        positives = vocabulary.mapInArrow(_prober(sent, plan, part), "word string, n long, edit string")
        # only what the filters let through is shuffled; the vocabulary removes the false positives
        real = positives.join(vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n")), F.col("edit") == F.col("other"))
        pairs = written(real.select("word", "n", "other", "other_n"), "near-words")
        sent.unpersist()
        found = pairs if found is None else found.union(pairs)
    return found


def _prober(sent, plan: Layout, part: int):
    #: Places times words looked at together.
    most = 1 << 15

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            counts = batch.column(1).to_pylist()
            for length, at, words in _by_length(batch.column(0).to_pylist()):
                step = max(1, most // length)
                for a in range(0, len(words), step):
                    for row, edits in _edits(words[a:a + step], held, plan, part):
                        if row:
                            index = [at[a + r] for r in row]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([words[a + r] for r in row], pa.string()), pa.array([counts[i] for i in index], pa.int64()),
                                 pa.array(edits, pa.string())], ["word", "n", "edit"])

    return run


# ------------------------------------------------------------- forms ----

def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the (word, form) links, each word's forms followed to the last.

    A form is more frequent than its word, so links make no rings; each round
    doubles the way that has been followed.
    """
    way = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = way.select(F.col("word").alias("at"), F.col("root").alias("further"))
        longer = way.join(on, F.col("root") == F.col("at"), "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        longer = written(longer, "roots")
        way = longer.select("word", "root")
        if longer.where("moved").limit(1).count() == 0:
            return way


def variants(docs: DataFrame, least_length: int = 6, least_n: int = 5, times: int = 5, every: int = 199,
             filter_bytes: int = 32 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per word: ``word, form, root, n, n_near, form_n``.

    Words are the runs of letters of all texts with A-Z lower-cased; where
    ``every`` divides the hash of id and run, the run loses the code point
    that the hash points at.  Those of ``least_length`` code points and
    ``least_n`` occurrences count.  A word's form is the word one edit away
    with the largest n (ties: the smaller word) if that is at least ``times``
    the word's own; its root is the end of the chain of forms.
    Null and empty texts have no words; a null id hashes as an empty one;
    repeated rows count each; long texts are read whole.  An empty table
    gives an empty result.  Other columns are not read.
    """
    vocabulary = written(counted(docs, least_length, every, doc_id, text).where(F.col("n") >= least_n), "vocabulary")
    pairs = near_pairs(vocabulary, filter_bytes)
    both = pairs.union(pairs.select("other", "other_n", "word", "n")).toDF("word", "n", "other", "other_n")
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form")))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    listed = vocabulary.join(near, "word", "left")
    is_form = -F.col("best.minus") >= times * F.col("n")
    listed = written(listed.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                   F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n")), "forms")
    ends = roots(listed.where("form IS NOT NULL"))
    return (listed.join(ends, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
