"""Sequential whole-word, case-insensitive literal replacement of domain
codes (X2), in two equivalent forms.

``recode_sequential`` folds one ``regexp_replace`` per rule, so later rules
see earlier results -- the literal semantics of a replace-rule chain.

``recode_map`` composes the rule list at plan-build time (plain Python) into
one ``source -> final`` map and emits a single map lookup.  For values that
are one token (all domain codes are) both forms are equal; the map form is
one expression instead of up to 27 chained regex passes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from microstar.functions._util import col, map_literal


@dataclass(frozen=True)
class Rule:
    search: str
    replace: str


def _java_quote(s: str) -> str:
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _java_replacement(s: str) -> str:
    return s.replace("\\", "\\\\").replace("$", "\\$")


def recode_sequential(c, rules: list[Rule]) -> Column:
    """Apply rules in order, each as a whole-word case-insensitive replace."""
    out = col(c)
    for r in rules:
        out = F.regexp_replace(out, F.lit("(?i)\\b" + _java_quote(r.search) + "\\b"),
                               F.lit(_java_replacement(r.replace)))
    return out


def compose_rules(rules: list[Rule]) -> dict[str, str]:
    """Collapse a rule chain into ``UPPER(source) -> final`` for single tokens.

    Every search string (placeholders included) is a possible input token;
    its final value is obtained by running the chain on it with token
    equality.  Every search token is kept, even when its chain ends on the
    same letters: the match is case-insensitive but the replacement text is
    what lands in the value, so 'a' under the rule A -> A becomes 'A'.
    """
    out: dict[str, str] = {}
    for token in dict.fromkeys(r.search.upper() for r in rules):
        value = token
        for r in rules:
            if value.upper() == r.search.upper():
                value = r.replace
        out[token] = value
    return out


def recode_map(c, rules: list[Rule] | dict[str, str]) -> Column:
    """One map lookup on the upper-cased trimmed token; unmatched values pass."""
    mapping = rules if isinstance(rules, dict) else compose_rules(rules)
    c = col(c)
    if not mapping:
        return c
    return F.coalesce(F.try_element_at(map_literal(mapping), F.upper(F.trim(c))), c)
