"""Prediction evaluation columns (X16-X20) and the hit rate (A1, A2)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from microstar.functions._util import col

# Labels of the sign of the difference and the error bands.
OVER, UNDER, EXACT = "Atribuiu Nota Maior", "Atribuiu Nota Menor", "Atribuiu Nota Exata"
BANDS = [(0, 10), (11, 20), (21, 30), (31, 40), (41, 50), (51, 60), (61, 70),
         (71, 80), (81, 90), (91, 100)]
ABOVE_LAST_BAND = "> 100"
HIT_THRESHOLD = 30


def band(pct) -> Column:
    """Eleven-way band on an integer percentage; null outside."""
    pct = col(pct)
    out = None
    for lo, hi in BANDS:
        cond, lab = pct.between(lo, hi), F.lit(f"{lo}, {hi}")
        out = F.when(cond, lab) if out is None else out.when(cond, lab)
    return out.when(pct > 100, F.lit(ABOVE_LAST_BAND)).otherwise(F.lit(None).cast("string"))


def evaluation_columns(real, pred) -> dict[str, Column]:
    """Columns of the evaluation table.

    The prediction is truncated to int *before* the difference (X20); the
    difference and the percentage are truncated to int (X16, X18); a real
    value of 0 gives a null percentage (``try_divide``) instead of an error.
    Casts are ``try_cast``: an out-of-range value becomes null rather than
    failing the whole job under ANSI mode.
    """
    real = col(real)
    pred_i = col(pred).try_cast("int")
    diff = real - pred_i
    ratio = F.try_divide(pred_i, real) * 100
    pct = (F.when(diff < 0, ratio - 100)
           .when(diff > 0, 100 - ratio)
           .otherwise(F.lit(0.0)))
    pct_i = pct.try_cast("int")
    return {
        "Nota_Real": real,
        "Nota_Prevista": pred_i,
        "Diferenca": F.when(diff < 0, -diff).otherwise(diff).try_cast("int"),
        "Tipo_da_Diferenca": (F.when(diff < 0, F.lit(OVER)).when(diff > 0, F.lit(UNDER))
                              .otherwise(F.lit(EXACT))),
        "Percentual_da_Diferenca": pct_i,
        "Faixa_da_Diferenca": band(pct_i),
    }


def hit_rate(pct, threshold: int = HIT_THRESHOLD) -> Column:
    """Share (x100) of rows with percentage <= threshold.  A null percentage
    counts as a miss, as in the ratio of two counts (A1)."""
    return F.avg(F.when(col(pct) <= threshold, F.lit(1.0)).otherwise(F.lit(0.0))) * 100
