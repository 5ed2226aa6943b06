"""Code -> label derivations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from microstar.functions._util import as_code, map_literal

# The yes/no labels of the curated layer.
NO, YES = "Não", "Sim"


def label(c, mapping: dict[str, str], default: str | None = "") -> Column:
    """Label a code with a fixed map; ``default`` ('' in the reference) otherwise.

    Codes are compared as trimmed strings.  One map lookup replaces the
    reference's nested IF chains (up to 23 deep), which keeps generated code
    small even with hundreds of derived columns.
    """
    hit = F.try_element_at(map_literal(mapping), as_code(c))
    return hit if default is None else F.coalesce(hit, F.lit(default))


def yes_no(c) -> Column:
    """0 -> 'Não', 1 -> 'Sim', anything else -> '' (X4)."""
    return label(c, {"0": NO, "1": YES})
