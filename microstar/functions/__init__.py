"""Column -> Column expressions.  All are built-in Spark expressions (JVM
side, whole-stage codegen); the only Python one is ``strip_accents_unicode``.
"""

from microstar.functions.text import strip_accents, strip_accents_unicode, code_parts, region_label
from microstar.functions.recode import Rule, recode_sequential, recode_map, compose_rules
from microstar.functions.labels import label, yes_no
from microstar.functions.flags import (any_flag, any_flag_int, attendance_code, attendance_label,
                                       day_attendance)
from microstar.functions.numeric import row_mean, comma_decimal
from microstar.functions.evaluation import evaluation_columns, hit_rate

__all__ = [
    "strip_accents", "strip_accents_unicode", "code_parts", "region_label",
    "Rule", "recode_sequential", "recode_map", "compose_rules",
    "label", "yes_no",
    "any_flag", "any_flag_int", "attendance_code", "attendance_label", "day_attendance",
    "row_mean", "comma_decimal", "evaluation_columns", "hit_rate",
]
