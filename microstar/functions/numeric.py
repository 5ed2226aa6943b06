"""Numeric derivations: row mean (X11) and comma-decimal parsing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from microstar.functions._util import col


def row_mean(cols) -> Column:
    """(c1 + ... + cn) / n on doubles (X11).  Nulls were defaulted upstream."""
    cs = [col(c).try_cast("double") if isinstance(c, str) else col(c).cast("double") for c in cols]
    return reduce(lambda a, b: a + b, cs) / F.lit(float(len(cs)))


def comma_decimal(c, scale: int = 2) -> Column:
    """'512,3' -> 512.3 rounded to ``scale``; unparsable text -> null."""
    return F.round(F.regexp_replace(col(c).cast("string"), ",", ".").try_cast("double"), scale)
