"""Secret scans: base patterns, and weak parts of credentials linked where they occur together.

A credential has parts: an identifier, a secret, an endpoint.  Alone, most
of them look like ordinary text.  All parts of a text are found as
intervals, each part is joined with the parts that lie within its scope
(the same block of lines, at most ``Scope.reach`` code points apart), and a
weak part is reported only if its complement is there.  The interval join
is a sweep over sorted places inside the row, so it needs no shuffle and is
linear in the parts but for a binary search.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from microstar.llm import common

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Order of kinds where spans start together.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")

# Weak parts.
IDENTIFIER = re.compile(
    r"""\b(?:access_?key(?:_?id)?|client_?id|key_?id|account(?:_?id)?|user(?:_?name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})""",
    re.IGNORECASE | re.ASCII)
SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(
    r"""\b(?:[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]{4,}|(?:endpoint|host(?:name)?|server|bucket)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{4,})""",
    re.IGNORECASE | re.ASCII)
_LONG_RUN = re.compile(r"[A-Za-z0-9+/_-]{20}")


@dataclass(frozen=True)
class Scope:
    """How near the parts of one credential stand."""

    reach: int = 400       # code points between a weak part and its complement
    entropy: float = 3.5   # bits per character that a weak secret needs


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The base findings (start, end, kind), leftmost and not overlapping within a kind.

    Matches that fail their least length are dropped, not searched again.
    """
    spans = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if _LONG_RUN.search(text):
        spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return spans


def entropy(token: str) -> float:
    """Bits per character of a token's own character distribution."""
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def _weak_secret(token: str, least: float) -> bool:
    return (any(c.isdigit() for c in token) and any(c.islower() for c in token) and any(c.isupper() for c in token)
            and entropy(token) >= least)


def _blocks(text: str) -> list[int]:
    """Where blocks of lines begin: after every blank line."""
    return [0, *(m.end() for m in re.finditer(r"\n[\x20\t\r]*\n", text))]


class _Cover:
    """Intervals asked whether one of them holds or touches another; each question is one search."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        ordered = sorted(spans)
        self.starts = [s for s, _ in ordered]
        self.reach = list(accumulate((e for _, e in ordered), max))  # the farthest end so far

    def holds(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, start)
        return k > 0 and self.reach[k - 1] >= end

    def touches(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k > 0 and self.reach[k - 1] > start


class _Near:
    """Sorted intervals of one part, asked for one within a scope."""

    def __init__(self, spans: list[tuple[int, int]], blocks: list[int], reach: int):
        self.spans, self.blocks, self.reach = sorted(spans), blocks, reach
        self.starts, self.ends = [s for s, _ in self.spans], sorted(e for _, e in self.spans)

    def meets(self, start: int, end: int) -> bool:
        k = bisect_left(self.blocks, start + 1)
        low = max(self.blocks[k - 1], start - self.reach)
        high = min(self.blocks[k] if k < len(self.blocks) else end + self.reach, end + self.reach)
        after, before = bisect_left(self.starts, end), bisect_right(self.ends, low)
        return (after < len(self.starts) and self.starts[after] < high
                or before < len(self.ends) and self.ends[before] <= start)


def find_secrets(text: str, scope: Scope = Scope()) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans: the base ones and the weak parts that have their complement.

    A weak secret needs an identifier or a base access span in scope; a weak
    identifier needs a secret (base or weak); an endpoint needs both an
    identifier and a secret.  Weak parts inside a base span are not parts.
    """
    base = base_spans(text)
    taken = _Cover((s, e) for s, e, _ in base)
    ids = [m.span() for m in IDENTIFIER.finditer(text) if not taken.touches(*m.span())] if "=" in text or ":" in text else []
    access = [(s, e) for s, e, kind in base if kind == "access"]
    strong = [(s, e) for s, e, kind in base if kind != "access"]
    if not (ids or access):  # without an identifier nothing weak is reported
        return base, sorted(base, key=_order)
    ends = [m.span() for m in ENDPOINT.finditer(text) if not taken.touches(*m.span())]
    parts = _Cover(ends + ids)
    weak = [m.span() for m in SECRET.finditer(text)
            if not taken.touches(*m.span()) and not parts.holds(*m.span()) and _weak_secret(m[0], scope.entropy)]
    blocks = _blocks(text)
    identifiers = _Near(ids + access, blocks, scope.reach)
    secrets = _Near(weak + strong, blocks, scope.reach)
    spans = list(base)
    spans += [(s, e, "secret") for s, e in weak if identifiers.meets(s, e)]
    spans += [(s, e, "identifier") for s, e in ids if secrets.meets(s, e)]
    spans += [(s, e, "endpoint") for s, e in ends if identifiers.meets(s, e) and secrets.meets(s, e)]
    return base, sorted(spans, key=_order)


def _order(span: tuple[int, int, str]) -> tuple[int, int]:
    return span[0], KINDS.index(span[2])


def joined(spans: list[tuple[int, int, str]]) -> str:
    """Spans as kind:start:end by start, then kind, comma-joined."""
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in sorted(spans, key=_order))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: Scope = Scope()) -> DataFrame:
    """Spans of secrets in every whole text.

    Returns one row per input row: ``doc_id, n_assign, n_access, n_hex,
    base_sha256, spans, n_linked`` (``n_linked``: weak parts reported).  Null
    and empty texts have no spans (empty string).  Null ids and repeated
    rows pass through; other columns are not read.  An empty table gives an
    empty result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in common.texts(batch.column(1)):
                base, spans = find_secrets(text, scope)
                kinds = Counter(k for _, _, k in base)
                rows.append((kinds["assign"], kinds["access"], kinds["hex"],
                             hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)))
            columns = list(zip(*rows)) or [[]] * 6
            kinds_of = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds_of))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long")


def masked(text: str, spans: list[tuple[int, int, str]], mark: str = "<SECRET>") -> str:
    """``text`` with each span, overlapping ones together, replaced by ``mark``."""
    out, at = [], 0
    end = 0
    for s, e, _ in sorted(spans):
        if s >= end:
            out += [text[at:s], mark]
        end = max(end, e)
        at = end
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, text_col: str = "text", scope: Scope = Scope(), mark: str = "<SECRET>") -> DataFrame:
    """``docs`` with every found span of ``text_col`` replaced by ``mark``; other columns as they are.

    Null texts stay null; texts without spans stay byte for byte.
    """
    @F.pandas_udf("string")
    def clean(column):
        return column.map(lambda t: t if t is None else masked(t, find_secrets(t, scope)[1], mark))

    return docs.withColumn(text_col, clean(F.col(text_col)))
