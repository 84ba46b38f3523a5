"""Column functions for reports and review views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R


def risk_band(score: Column) -> Column:
    expr = None
    for bound, label in R.RISK_BANDS:
        expr = F.when(score >= bound, F.lit(label)) if expr is None else expr.when(score >= bound, F.lit(label))
    return expr.otherwise(F.lit(R.RISK_BAND_ELSE))


def compliance_from_counts(critical: Column, high: Column) -> Column:
    return F.greatest(
        F.lit(0),
        F.lit(100) - critical * R.COMPLIANCE_CRITICAL_PENALTY - high * R.COMPLIANCE_HIGH_PENALTY,
    ).cast("int")


def residual_weight(severity: Column, status: Column) -> Column:
    """Penalty of one finding for the residual score (approved -> 0)."""
    w = F.create_map(*[F.lit(x) for kv in R.RESIDUAL_WEIGHTS.items() for x in kv])
    return F.when(status == "APPROVED", F.lit(0)).otherwise(F.coalesce(w[severity], F.lit(0)))


def clamp_score(penalty: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - penalty)).cast("int")


def scan_status_view(status: Column) -> Column:
    s = F.upper(F.coalesce(status, F.lit("")))
    return F.when(s.isin("DONE", "ERROR"), F.lit("done")).when(s == "SCANNING", F.lit("running")).otherwise(F.lit("pending"))


def finding_status_view(status: Column) -> Column:
    s = F.upper(F.coalesce(status, F.lit("")))
    return F.when(s == "APPROVED", F.lit("approved")).when(s == "REJECTED", F.lit("rejected")).otherwise(F.lit("pending"))


def source_type(file_or_location: Column) -> Column:
    """'dataset' for .csv/.json files, else 'code'."""
    f = F.split(F.lower(F.coalesce(file_or_location, F.lit(""))), ":", -1)[0]
    return F.when(f.endswith(".csv") | f.endswith(".json"), F.lit("dataset")).otherwise(F.lit("code"))


def _contains_any(t: Column, needles: list[str]) -> Column:
    cond = None
    for n in needles:
        c = F.instr(t, n) > 0
        cond = c if cond is None else (cond | c)
    return cond


def permanent_fix_advice(data_type: Column, fix_tool: Column) -> Column:
    """Durable remediation advice: by data type, then by fix tool."""
    t = F.upper(F.coalesce(data_type, F.lit("")))
    tool = F.upper(F.coalesce(fix_tool, F.lit("")))
    expr = None
    for needles, text in R.PERMANENT_FIX_BY_TYPE:
        c = _contains_any(t, needles)
        expr = F.when(c, F.lit(text)) if expr is None else expr.when(c, F.lit(text))
    for tools, text in R.PERMANENT_FIX_BY_TOOL:
        expr = expr.when(tool.isin(*tools), F.lit(text))
    return expr.otherwise(F.lit(R.PERMANENT_FIX_DEFAULT))
