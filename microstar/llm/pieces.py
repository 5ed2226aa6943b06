"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by score, then by
place; the best pair merges, its new neighbours join the agenda, and pairs
whose symbols have changed are passed over.  What no merge can make becomes
bytes.  Decoding puts pieces and bytes back together.

A text is cut before each run of spaces, around line feeds and where marks
follow something else, as far as no piece of the vocabulary holds such a pair
of characters inside, as then no merge reaches across; the vocabulary decides,
so a cut never changes a result.  Ids of short stretches are kept in a table
of bounded size per task.  Every Arrow batch is checked against the
sentencepiece library, text by text.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from itertools import chain
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from microstar.llm import common

SPACE = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_NEVER = float("-inf")


class MergeVocabulary:
    """Pieces, scores and byte pieces of a merge-type model, with encode and decode."""

    #: Stretches up to this length are remembered, twice this many at most.
    REMEMBER_CHARS, REMEMBER = 48, 400_000

    def __init__(self, model_path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = lib.vocab_size()
        pieces = lib.id_to_piece(list(range(size)))
        plain = [not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)) for i in range(size)]
        if any(lib.is_unused(i) for i in range(size)):
            raise ValueError("vocabularies with unused pieces are not supported")
        # space marks are held as spaces: a text's own marks mean the same
        self.ids = {p.replace(SPACE, " "): i for i, p in enumerate(pieces) if plain[i]}
        self.scores = {p: lib.get_score(i) for p, i in self.ids.items()}
        beside = {p[k:k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.bytes = {int(_BYTE.fullmatch(p)[1], 16): i for i, p in enumerate(pieces) if lib.is_byte(i)}
        self.unknown = lib.unk_id()
        self.surface = {i: p.replace(SPACE, " ") if plain[i] else "" for i, p in enumerate(pieces)}
        self.surface[self.unknown] = f" {chr(0x2047)} "  # what the library shows for an unknown piece
        self.decimal = list(map(str, range(size)))
        self.byte_ids = set(self.bytes.values())
        # an ASCII byte stands for itself whatever is beside it; others have to be put together
        self.surface |= {i: chr(b) for b, i in self.bytes.items() if b < 0x80}
        self.value = {i: b for b, i in self.bytes.items() if b >= 0x80}
        self.cut = _cut(beside)
        self.known = _Known(self)

    def normalized(self, text: str) -> str:
        """What is encoded: one space in front, space marks as spaces (nothing for the empty text)."""
        return " " + text.replace(SPACE, " ") if text else ""

    def merge(self, stretch: str) -> list[int]:
        """Ids of a normalized stretch by the agenda of adjacent pairs."""
        merged = self._merge_short(stretch) if len(stretch) <= 40 else self._merge_long(stretch)
        ids, out = self.ids, []
        for symbol in merged:
            if symbol in ids:
                out.append(ids[symbol])
            elif self.bytes:
                out.extend([self.bytes[b] for b in symbol.encode("utf-8")])
            else:
                out.append(self.unknown)
        return out

    def _merge_short(self, stretch: str) -> list[str]:
        """The agenda as a plain list in place order: its best entry is cheap to find while it is short."""
        get, symbols = self.scores.get, list(stretch)
        agenda = [get(a + b, _NEVER) for a, b in zip(symbols, symbols[1:])]
        while agenda:
            best = max(agenda)
            if best == _NEVER:
                break
            i = agenda.index(best)  # the leftmost of equals
            symbols[i] = merged = symbols[i] + symbols[i + 1]
            del symbols[i + 1], agenda[i]
            if i:
                agenda[i - 1] = get(symbols[i - 1] + merged, _NEVER)
            if i < len(agenda):
                agenda[i] = get(merged + symbols[i + 1], _NEVER)
        return symbols

    def _merge_long(self, stretch: str) -> list[str]:
        """The agenda as a heap of (score, place, piece), symbols as a linked list."""
        symbols: list[str | None] = list(stretch)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        scores, agenda = self.scores, []
        for i in range(n - 1):
            piece = symbols[i] + symbols[i + 1]
            if piece in scores:
                agenda.append((-scores[piece], i, i + 1, piece))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, piece = heapq.heappop(agenda)
            if symbols[left] is None or symbols[right] is None or after[left] != right \
                    or symbols[left] + symbols[right] != piece:
                continue  # one of the two has merged with another
            symbols[left], symbols[right] = piece, None
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            for a, b in ((before[left], left), (left, after[left])):
                if a >= 0 and b < n and (piece := symbols[a] + symbols[b]) in scores:
                    heapq.heappush(agenda, (-scores[piece], a, b, piece))
        return [s for s in symbols if s is not None]

    def encode(self, text: str) -> list[int]:
        """Ids of a raw text, without begin or end ids."""
        return list(chain.from_iterable(map(self.known.__getitem__, self.cut.findall(self.normalized(text)))))

    def joined(self, ids: Iterable[int]) -> str:
        """Pieces and bytes of ids in order, space marks as spaces, the first one kept.

        Control pieces give nothing; bytes that are no UTF-8 become the
        replacement character, one for each byte.
        """
        surface, value = self.surface, self.value
        if value.keys().isdisjoint(ids):
            return "".join([surface[i] for i in ids])
        out: list[str] = []
        run = bytearray()
        for i in ids:
            byte = value.get(i)
            if byte is not None:
                run.append(byte)
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            out.append(surface[i])
        if run:
            out.append(_utf8(bytes(run)))
        return "".join(out)

    def drops_space(self, ids: Iterable[int]) -> bool:
        """Whether decoding drops the first character: the first piece that shows begins with a space mark."""
        for i in ids:
            if i in self.byte_ids:
                return False
            if self.surface[i]:
                return self.surface[i][0] == " " and i != self.unknown
        return False

    def decode(self, ids: Sequence[int]) -> str:
        """Text of any ids; one space mark in front is dropped."""
        return self.joined(ids)[1 if self.drops_space(ids) else 0:]


class _Known(dict):
    """Ids of stretches; short ones are remembered, twice ``REMEMBER`` at most, the older half until the newer is full."""

    def __init__(self, vocabulary: MergeVocabulary):
        super().__init__()
        self.own = vocabulary
        self.before: dict[str, tuple[int, ...]] = {}

    def __missing__(self, stretch: str) -> tuple[int, ...]:
        found = self.before.get(stretch)
        if found is None:
            found = tuple(self.own.merge(stretch))
        if len(stretch) <= self.own.REMEMBER_CHARS:
            if len(self) >= self.own.REMEMBER:
                self.before = dict(self)
                self.clear()
            self[stretch] = found
        return found


def _cut(beside: set[str]) -> re.Pattern:
    """Pattern of the stretches into which a text may be cut; ``beside`` are all pairs of characters inside pieces.

    A mark is a character of the pieces that is no letter, digit or space and
    that stands in no piece after anything but a space or another mark.
    """
    if any(pair[1] == " " and pair[0] != " " for pair in beside):
        return re.compile(r"[\s\S]+")  # some piece goes on into a space: no cheap cut
    marks = {c for pair in beside for c in pair if not (c.isalpha() or c.isdecimal() or c in " \n")}
    while wrong := {b for a, b in beside if b in marks and a != " " and a not in marks}:
        marks -= wrong
    line, m = "" if any("\n" in pair for pair in beside) else "\n", re.escape("".join(sorted(marks)))
    plain = f"[^ {line}{m}]"
    first = f" *[{m}]+{plain}*|" if marks else ""
    return re.compile(f"{'\n|' if line else ''}{first} *{plain}+| +")


def _utf8(run: bytes) -> str:
    out, at = [], 0
    while at < len(run):
        lead = run[at]
        width = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
        try:
            out.append(run[at:at + width].decode("utf-8") if width else "\ufffd")
            at += width or 1
        except UnicodeDecodeError:
            out.append("\ufffd")
            at += 1
    return "".join(out)


_LOADED: dict[str, MergeVocabulary] = {}


def vocabulary(model_path: str) -> MergeVocabulary:
    """The vocabulary of a model file, read once in a Python worker."""
    if model_path not in _LOADED:
        _LOADED[model_path] = MergeVocabulary(model_path)
    return _LOADED[model_path]


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                  keep: Sequence[str] = (), with_ids: bool = False) -> DataFrame:
    """Encode every whole text, decode it again, and check both against the library.

    Returns one row per input row: ``doc_id, n_tokens, ids_sha256,
    decoded_sha256, library_agrees`` and, on request, ``ids`` and
    ``decoded``; the columns named in ``keep`` come along.
    ``library_agrees`` is false where the library's ids or decoded text
    differ.  Null texts count as empty: no ids.  Null ids and
    repeated rows pass through, each on its own; other columns are not read.
    An empty table gives an empty result.  ``model_path`` must exist on every
    executor.
    """
    kept = [F.col(c) for c in keep]
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", *keep, "n_tokens", "ids_sha256", "decoded_sha256", "library_agrees"]
    types = [pa.int64(), pa.string(), pa.string(), pa.bool_()]
    schema = f"doc_id {id_type}, " + "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    schema += "n_tokens long, ids_sha256 string, decoded_sha256 string, library_agrees boolean"
    if with_ids:
        names, types = [*names, "ids", "decoded"], [*types, pa.list_(pa.int32()), pa.string()]
        schema += ", ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(model_path)
        gc.disable()  # nothing here makes cycles, and the remembered tuples would be walked again and again
        try:
            yield from encoded(own, batches)
        finally:
            gc.enable()

    def encoded(own: MergeVocabulary, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decimal = own.decimal
        for whole in batches:
            for batch in common.slices(whole, "text", 4 << 20):
                rows = []
                held = common.texts(batch.column(1))
                reference = own.library.encode(held, num_threads=1)
                for text, theirs, shown in zip(held, reference, own.library.decode(reference, num_threads=1)):
                    ids = own.encode(text)
                    decoded = own.decode(ids)
                    row = (len(ids), _digest(",".join([decimal[i] for i in ids])), _digest(decoded), theirs == ids and shown == decoded)
                    rows.append((*row, ids, decoded) if with_ids else row)
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *batch.columns[2:], *(pa.array(c, t) for c, t in zip(columns, types))], names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *kept).mapInArrow(run, schema)
