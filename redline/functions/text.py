"""Column functions for literal-pattern detection in text.

All of these are built-in Spark expressions (JVM side, whole-stage codegen);
no Python runs per row.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R

def trim_ws(col: Column) -> Column:
    """Trim leading/trailing white space (Unicode white space, not only ' '):
    ``btrim`` with the white-space characters as the trim set."""
    return F.btrim(col, F.lit(R.WHITESPACE_CHARS))


def has_non_blank(col: Column) -> Column:
    """True when the value holds at least one non-white-space character
    (the first character decides in the common case; the regex runs only
    on values that start with white space)."""
    first = F.substring(col, 1, 1)
    non_ws = "[^" + R.WHITESPACE_CHARS + "]"
    return (
        F.when(col.isNull() | (F.length(col) == 0), F.lit(False))
        .when(~first.isin(*list(R.WHITESPACE_CHARS)), F.lit(True))
        .otherwise(col.rlike(non_ws))
    )


def may_hit_default_rules(text: Column) -> Column:
    """Cheap necessary condition for any built-in rule to match in ``text``
    (used on whole sources before they are split into lines).

    EMAIL needs '@'; PHONE, SSN, CREDIT_CARD and IP a digit; a MAC ':' or
    '-'; PRIVATE_KEY and the sk-/pk- keys '-'; ghp_ keys '_'; AWS keys
    'AKIA'; TOKEN 'eyJ'.  One single-class regex plus two literal searches
    (an alternation of all rules costs several times more per character).
    """
    gate = text.rlike(R.SOURCE_GATE_CLASS)
    for lit_ in R.SOURCE_GATE_LITERALS:
        gate = gate | (F.instr(text, lit_) > 0)
    return F.coalesce(gate, F.lit(False))


def accepts(prefilter: str | Callable[[Column], Column], text: Column) -> Column:
    """Apply a prefilter given as a regex or as a Column function."""
    return prefilter(text) if callable(prefilter) else text.rlike(prefilter)


def split_lines(content: Column, prefilter=None) -> Column:
    """``array<struct<line_no int, line string>>`` of the non-empty lines.

    Lines are split on LF, trailing CRs are removed, empty lines are dropped
    and numbers are 1-based positions in the original split.  With a
    ``prefilter`` (a regex, or a Column function returning boolean) only the
    lines it accepts are kept; this runs inside the array, before any row is
    generated.
    """
    parts = F.split(content, "\n", -1)
    numbered = F.transform(
        parts,
        lambda x, i: F.struct(
            (i + 1).cast("int").alias("line_no"),
            F.rtrim(x, F.lit("\r")).alias("line"),
        ),
    )
    if prefilter is None:
        return F.filter(numbered, lambda s: F.length(s["line"]) > 0)
    return F.filter(numbered, lambda s: (F.length(s["line"]) > 0) & accepts(prefilter, s["line"]))


def digits_only(col: Column) -> Column:
    return F.regexp_replace(col, "[^0-9]", "")


def luhn_valid(col: Column) -> Column:
    """Luhn mod-10 over the digits of ``col`` (other characters ignored),
    requiring 13..19 digits."""
    d = digits_only(col)
    return (
        F.length(d).between(R.LUHN_MIN_DIGITS, R.LUHN_MAX_DIGITS)
        & F.coalesce(F.call_function("luhn_check", d), F.lit(False))
    )


VALIDATORS: dict[str, Callable[[Column], Column]] = {"luhn": luhn_valid}


@dataclass(frozen=True)
class TextRule:
    """A detection rule: a data type, a Java regex, an optional validator
    applied to each match (a Column function returning boolean) and optional
    literals of which a line must contain one for the regex to be tried."""

    ordinal: int
    data_type: str
    pattern: str
    validator: Callable[[Column], Column] | None = None
    requires: tuple[str, ...] = ()


def default_rules(unicode: bool = False) -> list[TextRule]:
    """The nine built-in rules.  ``unicode=True`` is the parity mode:
    ``\\d``, ``\\w``, ``\\s`` and ``\\b`` become Unicode-aware (``(?U)``), as
    in the reference's regex engine; the default is ASCII classes."""
    prefix = "(?U)" if unicode else ""
    return [
        TextRule(o, t, prefix + p, VALIDATORS[v] if v else None, tuple(R.RULE_REQUIRES.get(t, ())))
        for (o, t, p, v) in R.TEXT_RULES
    ]


def rule_matches(line: Column, rules: list[TextRule]) -> Column:
    """All matches of all rules in one line, as
    ``array<struct<rule_ord int, data_type string, match_ord int, match string>>``.

    Rules run independently (overlaps and duplicates are kept); validators
    filter inside the array, so no row is produced for a rejected match.
    """
    per_rule = []
    for rule in rules:
        found = F.regexp_extract_all(line, F.lit(rule.pattern), 0)
        if rule.requires:
            # the regex runs only on lines holding one of the rule's literals
            has = None
            for lit_ in rule.requires:
                c = F.instr(line, lit_) > 0
                has = c if has is None else (has | c)
            found = F.when(has, found).otherwise(F.array().cast("array<string>"))
        tagged = F.transform(found, _tagger(rule))
        if rule.validator is not None:
            tagged = F.filter(tagged, _checker(rule.validator))
        per_rule.append(tagged)
    return F.flatten(F.array(*per_rule))


def _tagger(rule: TextRule):
    def tag(m: Column, i: Column) -> Column:
        return F.struct(
            F.lit(rule.ordinal).cast("int").alias("rule_ord"),
            F.lit(rule.data_type).alias("data_type"),
            (i + 1).cast("int").alias("match_ord"),
            m.alias("match"),
        )

    return tag


def _checker(validator: Callable[[Column], Column]):
    def check(s: Column) -> Column:
        return validator(s["match"])

    return check
