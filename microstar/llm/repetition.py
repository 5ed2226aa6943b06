"""Quality rules on repetition inside a text, from a suffix array over its words.

For each text a suffix array of its words and the longest-common-prefix
array of neighbouring suffixes are built.  Intervals of that array that
stay at or above a length, and whose places differ in the word before, are
the maximal repeated substrings.  The union of their spans gives the
covered share of words; the deepest interval gives the longest repeat.

Everything is decided inside one row: no shuffle, memory follows the
longest single text (8-byte words of numpy per word and doubling round).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from microstar.llm import common

SPACES = "\x20\x09\x0A\x0B\x0C\x0D"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Limits of the quality rules (percentages are of the text's words)."""

    min_words: int = 20
    window: int = 8                  # words of a repeated window
    max_repeat_percent: int = 30     # base rule: words in repeated windows
    min_repeat: int = 5              # words of the shortest maximal repeat that counts
    max_covered_percent: int = 40    # words under maximal repeats
    max_longest_percent: int = 20    # words of the longest repeat


def suffix_array(ranks: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array by prefix doubling, and the ranks at 1, 2, 4, ... words.

    Ties of equal prefixes are broken when a longer prefix differs; a suffix
    that ends sorts before one that goes on.
    """
    n, levels, width = len(ranks), [ranks], 1
    while width < n:
        nxt = np.zeros(n, dtype=np.int64)
        nxt[:n - width] = ranks[width:] + 1
        key = ranks * (n + 1) + nxt
        order = np.argsort(key, kind="stable")
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        ranks = new
        if ranks[order[-1]] == n - 1:
            return order, levels
        levels.append(ranks)
        width *= 2
    return np.argsort(ranks, kind="stable"), levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """``lcp[r]``: words that the suffixes of rank ``r - 1`` and ``r`` share at their start."""
    n = len(order)
    lcp = np.zeros(n, dtype=np.int64)
    if n < 2:
        return lcp
    left, right = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        ok = (left + (1 << k) <= n) & (right + (1 << k) <= n)
        at = np.flatnonzero(ok)
        at = at[levels[k][left[at]] == levels[k][right[at]]]
        left[at] += 1 << k
        right[at] += 1 << k
    lcp[1:] = left - order[:-1]
    return lcp


def maximal_intervals(ids: np.ndarray, order: np.ndarray, lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Maximal repeated substrings of ``least`` words or more: (length, first rank, end rank), inner before outer.

    Walks the intervals of ``lcp`` with a stack.  A repeat is maximal when
    its occurrences neither all extend to the right (an interval's own
    length) nor all follow the same word (checked here).
    """
    found: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []  # (length, first rank)
    before = np.where(order > 0, ids[order - 1], -1)
    changes = np.concatenate(([0], np.cumsum(np.diff(before) != 0))).tolist()

    def close(length: int, low: int, high: int) -> None:
        if changes[high - 1] != changes[low]:
            found.append((length, low, high))

    hot = np.flatnonzero(lcp >= least)
    last = -2
    for r, here in zip(hot.tolist(), lcp[hot].tolist()):
        if r != last + 1:
            while stack:
                close(*stack.pop(), last + 1)
        start = r - 1
        while stack and stack[-1][0] > here:
            length, start = stack.pop()
            close(length, start, r)
        if not stack or stack[-1][0] < here:
            stack.append((here, start))
        last = r
    while stack:
        close(*stack.pop(), last + 1)
    return found


def maximal_repeats(ids: np.ndarray, order: np.ndarray, lcp: np.ndarray, least: int) -> list[tuple[int, list[int]]]:
    """Maximal repeated substrings of ``least`` words or more: (length, places)."""
    return [(length, sorted(order[low:high].tolist())) for length, low, high in maximal_intervals(ids, order, lcp, least)]


def longest_spans(order: np.ndarray, intervals: list[tuple[int, int, int]]) -> np.ndarray:
    """Words of the longest maximal repeat that starts at each place (0: none).

    Intervals lie inside each other or apart, so each adds what it is longer
    than the one around it to its ranks: linear, however deep they lie.
    """
    grows = np.zeros(len(order) + 1, dtype=np.int64)
    if intervals:
        length, low, high = np.array(intervals, dtype=np.int64).T
        around = np.zeros(len(intervals), dtype=np.int64)
        outer: list[int] = []  # intervals with none around them so far
        for k, (size, start, _) in enumerate(intervals):
            while outer and intervals[outer[-1]][1] >= start:
                around[outer.pop()] = size
            outer.append(k)
        np.add.at(grows, low, length - around)
        np.add.at(grows, high, around - length)
    at = np.empty(len(order), dtype=np.int64)
    at[order] = np.cumsum(grows)[:-1]
    return at


def covered(lengths: np.ndarray, least: int) -> int:
    """Words under the union of the spans ``[i, i + lengths[i])`` of ``least`` words or more."""
    at = np.flatnonzero(lengths >= least)
    if not len(at):
        return 0
    ends = np.maximum.accumulate(at + lengths[at])
    gaps = np.maximum(at[1:], ends[:-1])
    return int(ends[0] - at[0] + np.maximum(ends[1:] - gaps, 0).sum())


def repetition(words: list[str], rules: Rules) -> tuple[int, int, int]:
    """Words in repeated windows, words under maximal repeats, longest repeat.

    The union of the longest maximal repeats that start at each word is the
    union of all their occurrences, without listing every occurrence.
    """
    n = len(words)
    if n < 2:
        return 0, 0, 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    if len(seen) == n:
        return 0, 0, 0
    order, levels = suffix_array(ids)
    lcp = common_prefixes(order, levels)
    longest, least = int(lcp.max()), min(rules.window, rules.min_repeat)
    if longest < least:
        return 0, 0, longest
    at = longest_spans(order, maximal_intervals(ids, order, lcp, least))
    return covered(at, rules.window), covered(at, rules.min_repeat), longest


def judge(text: str, rules: Rules = Rules()) -> tuple:
    """All measures of one text and the two verdicts."""
    words = common.WORD.findall(text)
    n = len(words)
    word_chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x and not x.isspace() or x.strip(SPACES)]
    duplicates = len(lines) - len(set(lines))
    repeated, under, longest = repetition(words, rules)
    failed = n < rules.min_words or 100 * repeated > rules.max_repeat_percent * n
    kept = not failed and 100 * under <= rules.max_covered_percent * n and 100 * longest <= rules.max_longest_percent * n
    return n, word_chars, symbols, duplicates, repeated, failed, kept, under, longest


_SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
           "kept boolean, n_covered_words long, longest_repeat long")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Measure every whole text and judge it.

    Returns one row per input row: ``doc_id``, the base measures, the base
    verdict, ``kept``, the words under maximal repeats and the longest
    repeat.  Null and empty texts have no words: all counts 0, failed, not
    kept.  Null ids and repeated rows are passed through, each judged alone;
    other columns are not read.  An empty table gives an empty result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", *(c.split()[0] for c in _SCHEMA.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(t, rules) for t in common.texts(batch.column(1))]
            columns = list(zip(*rows)) or [[]] * (len(names) - 1)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {id_type}, {_SCHEMA}")
