"""Text functions: accent folding (X1), code substrings (X13), region label."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from microstar.functions._util import col, as_code, map_literal
from microstar.spec.municipality import REGION_LABELS

# Code-point blocks whose precomposed letters are folded by the JVM-side
# ``translate``: Latin-1 Supplement, Latin Extended-A/B, Greek, Cyrillic and
# Latin Extended Additional.  The table is derived from Unicode's canonical
# decomposition (NFD), so it is a rule, not a hand-written list.
_FOLD_BLOCKS = ((0x00C0, 0x024F), (0x0370, 0x03FF), (0x0400, 0x04FF), (0x1E00, 0x1EFF))
_COMBINING_MARKS = (0x0300, 0x036F)

# The reference's accent folding (a Java library call) also
# maps these two letters, which have no canonical decomposition.
EXTRA_FOLDS = {"Ł": "L", "ł": "l"}


def _base_letter(ch: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", ch) if not unicodedata.combining(c))


def _fold_table() -> tuple[str, str]:
    src, dst = [], []
    for lo, hi in _FOLD_BLOCKS:
        for cp in range(lo, hi + 1):
            ch = chr(cp)
            base = _base_letter(ch)
            if base != ch and len(base) == 1:
                src.append(ch)
                dst.append(base)
    for ch, base in EXTRA_FOLDS.items():
        src.append(ch)
        dst.append(base)
    # characters in ``matching`` beyond the length of ``replace`` are deleted
    marks = "".join(chr(cp) for cp in range(_COMBINING_MARKS[0], _COMBINING_MARKS[1] + 1))
    return "".join(src) + marks, "".join(dst)


FOLD_FROM, FOLD_TO = _fold_table()


def strip_accents(c) -> Column:
    """Remove diacritics from Latin, Greek and Cyrillic letters.

    One ``translate`` call: runs in the JVM inside whole-stage codegen.
    Equal to NFD + dropping combining marks for every character of the
    folded blocks and for text already in decomposed form.
    """
    return F.translate(col(c), FOLD_FROM, FOLD_TO)


@F.pandas_udf(T.StringType())
def _strip_accents_nfd(s: pd.Series) -> pd.Series:
    def one(v):
        if v is None:
            return None
        out = "".join(ch for ch in unicodedata.normalize("NFD", v) if not unicodedata.combining(ch))
        for k, r in EXTRA_FOLDS.items():
            out = out.replace(k, r)
        return out
    return s.map(one)


def strip_accents_unicode(c) -> Column:
    """Full-Unicode accent folding (any script) through an Arrow-batched UDF.

    The slow path: use only when text outside the folded blocks must be
    decomposed too (e.g. Hangul syllables or Indic scripts).
    """
    return _strip_accents_nfd(col(c))


def code_parts(c) -> dict[str, Column]:
    """Split a 7-character municipality code.

    Positions are 0-based, end-exclusive in the source: region [0,1),
    state [0,2), municipality [2,7).
    """
    c = col(c)
    return {
        "COD_REG_UF": F.substring(c, 1, 1),
        "COD_UF": F.substring(c, 1, 2),
        "COD_MUN": F.substring(c, 3, 5),
    }


def region_label(c) -> Column:
    """Region digit -> N/NE/SE/S/CO, '' otherwise."""
    return F.coalesce(F.try_element_at(map_literal(REGION_LABELS), as_code(c)), F.lit(""))
