"""Flag derivations: any-of flags (X5-X7), attendance class (X8, X9) and the
year-dependent exam-day rule (X10).

A null flag counts as "not set": ``c <> '0'`` is null and a null condition
takes the else branch, as the surveyed decision prescribes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from microstar.functions._util import as_code, col
from microstar.functions.labels import NO, YES

# Attendance class codes and labels.
ABSENT, PRESENT, PARTIAL = 0, 1, 2
ATTENDANCE_LABELS = {ABSENT: "Ausente", PRESENT: "Presente", PARTIAL: "Parcial"}


def _set(c) -> Column:
    return as_code(c) != F.lit("0")


def _any(cols) -> Column:
    return reduce(lambda a, b: a | b, [_set(c) for c in cols])


def any_flag(cols, yes: str = YES, no: str = NO) -> Column:
    """'Sim' if any flag is set (not '0'), else 'Não' (X5, X6, X9)."""
    return F.when(_any(cols), F.lit(yes)).otherwise(F.lit(no))


def any_flag_int(cols) -> Column:
    """1 if any flag is set, else 0."""
    return F.when(_any(cols), F.lit(1)).otherwise(F.lit(0))


def attendance_code(cols) -> Column:
    """0 when all flags are '0', 1 when none is '0', 2 otherwise."""
    all_zero = reduce(lambda a, b: a & b, [as_code(c) == F.lit("0") for c in cols])
    none_zero = reduce(lambda a, b: a & b, [_set(c) for c in cols])
    return (F.when(all_zero, F.lit(ABSENT))
            .when(none_zero, F.lit(PRESENT))
            .otherwise(F.lit(PARTIAL)))


def attendance_label(code) -> Column:
    code = col(code)
    out = None
    for k, v in ATTENDANCE_LABELS.items():
        out = (F.when(code == k, F.lit(v)) if out is None else out.when(code == k, F.lit(v)))
    return out


def day_attendance(year, before_cutover, from_cutover, cutover: int = 2017) -> Column:
    """'Sim' if the area sat on that day was attended.

    Before ``cutover`` the day's area is ``before_cutover``; from
    ``cutover`` on it is ``from_cutover`` (the editions swapped the areas
    of the two exam days in 2017).
    """
    y = as_code(year).try_cast("int")
    cond = (((y < cutover) & _set(before_cutover)) | ((y >= cutover) & _set(from_cutover)))
    return F.when(cond, F.lit(YES)).otherwise(F.lit(NO))
