"""Literal-pattern detection over ``sources`` (one finding per match).

Plan shape: scan → filter(source may hit) → project(lines kept by the
prefilter, matches of all rules as one array) → explode → project.  No
shuffle, except one round-robin of the candidate sources when the input has
fewer splits than cores; every rule runs in the same pass over a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import TextRule, accepts, default_rules, may_hit_default_rules, rule_matches, split_lines, trim_ws
from ..schemas import detection_finding
from ..session import spread_for_cpu


def scan_text(
    sources: DataFrame,
    scan_id: str | None = None,
    rules: list[TextRule] | None = None,
    prefilter=None,
    source_gate=None,
    keep_match: bool = False,
    created_at: Column | None = None,
    unicode: bool = False,
) -> DataFrame:
    """Findings for every match of every rule in every non-empty line.

    ``rules`` defaults to the nine built-in rules, with a cheap gate on whole
    sources and a precise line prefilter; with custom rules give a
    ``prefilter`` (regex or Column function) that every possible match
    requires (and optionally a coarser ``source_gate``), or none.
    ``unicode=True`` runs the built-in rules with Unicode-aware classes
    (parity with the reference's engine; the cheap ASCII gate is then off).
    The snippet is the trimmed whole line; location is ``file:line``.
    """
    from .detect_code import with_scan_id

    sources = with_scan_id(sources, scan_id)
    if rules is None:
        rules = default_rules(unicode)
        if prefilter is None:
            prefilter = R.LINE_PREFILTER_UNICODE if unicode else R.LINE_PREFILTER
        if source_gate is None and not unicode:
            source_gate = may_hit_default_rules
    src = sources.where(F.col("content").isNotNull())
    gate = source_gate if source_gate is not None else prefilter
    if gate is not None:
        # whole-source check first: a source with no candidate character is
        # never split into lines
        src = src.where(accepts(gate, F.col("content")))
    # few input splits (small inputs, single row groups): spread the
    # candidate sources over the cores before the per-line regex work
    src = spread_for_cpu(src.select("scan_id", "file_name", "content"))
    lines = src.select(
        "scan_id",
        "file_name",
        F.explode(split_lines(F.col("content"), prefilter)).alias("l"),
    )
    return _findings(lines, rules, keep_match, created_at)


def scan_lines(lines: DataFrame, rules: list[TextRule] | None = None, prefilter=None, keep_match: bool = False, created_at: Column | None = None) -> DataFrame:
    """Findings of numbered lines (``scan_id, file_name, line_no, line``), as
    ``scan_text`` gives them of the whole sources."""
    if rules is None:
        rules, prefilter = default_rules(False), prefilter or R.LINE_PREFILTER
    kept = lines.where(accepts(prefilter, F.col("line"))) if prefilter is not None else lines
    fields = F.struct("line_no", "line").alias("l")
    return _findings(kept.select("scan_id", "file_name", fields), rules, keep_match, created_at)


def _findings(lines: DataFrame, rules: list[TextRule], keep_match: bool, created_at: Column | None) -> DataFrame:
    hits = lines.select(
        "scan_id",
        "file_name",
        F.col("l.line_no").alias("line_no"),
        F.col("l.line").alias("line"),
        F.explode(rule_matches(F.col("l.line"), rules)).alias("m"),
    )
    cols = detection_finding(
        scan_id=F.col("scan_id"),
        data_type=F.col("m.data_type"),
        location=F.concat(F.col("file_name"), F.lit(":"), F.col("line_no").cast("string")),
        file_name=F.col("file_name"),
        line_no=F.col("line_no"),
        column_name=F.lit(None).cast("string"),
        rule_ord=F.col("m.rule_ord"),
        match_ord=F.col("m.match_ord"),
        snippet=trim_ws(F.col("line")),
        detected_by=F.lit(R.DETECTED_BY_REGEX),
        created_at=created_at,
    )
    if keep_match:
        cols.append(F.col("m.match").alias("match"))
    return hits.select(*cols)


def split_source_lines(sources: DataFrame) -> DataFrame:
    """All non-empty lines of every source: ``(file_name, line_no, line)``."""
    return sources.select(
        "source_id", "file_name", F.explode(split_lines(F.col("content"))).alias("l")
    ).select("source_id", "file_name", F.col("l.line_no").alias("line_no"), F.col("l.line").alias("line"))
