"""Scores, summaries and review views.

All aggregates are plain ``groupBy`` with partial (map-side) aggregation;
the audit report is flat (one row per finding with its scan's header and
summary), so no scan's findings are ever gathered into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.policy import policy_of
from ..functions.report import clamp_score, compliance_from_counts, residual_weight, risk_band


def _cnt(cond) -> F.Column:
    return F.count(F.when(cond, F.lit(1))).cast("bigint")


def status_summary(findings: DataFrame) -> DataFrame:
    """Per scan: total, critical, high, approved, rejected, pending."""
    return findings.groupBy("scan_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("total"),
        _cnt(F.col("severity") == "CRITICAL").alias("critical"),
        _cnt(F.col("severity") == "HIGH").alias("high"),
        _cnt(F.col("status") == "APPROVED").alias("approved"),
        _cnt(F.col("status") == "REJECTED").alias("rejected"),
        _cnt(F.col("status") == "PENDING_REVIEW").alias("pending"),
    )


def compliance_score(findings: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """``max(0, 100 - 20*critical - 10*high)`` per scan, every status
    counted; a scan without findings scores 100."""
    agg = findings.groupBy("scan_id").agg(
        _cnt(F.col("severity") == "CRITICAL").alias("critical"),
        _cnt(F.col("severity") == "HIGH").alias("high"),
    )
    if scans is not None:
        agg = scans.select("scan_id").join(agg, "scan_id", "left").fillna(0, ["critical", "high"])
    return agg.select(
        "scan_id", "critical", "high", compliance_from_counts(F.col("critical"), F.col("high")).alias("compliance_score")
    )


def residual_score(findings: DataFrame) -> DataFrame:
    """Dashboard score: weights 26/14/8/3 over findings not approved,
    clamped to 0..100."""
    return findings.groupBy("scan_id").agg(
        F.sum(residual_weight(F.col("severity"), F.col("status"))).cast("bigint").alias("penalty")
    ).select("scan_id", "penalty", clamp_score(F.col("penalty")).alias("residual_score"))


def severity_counts(findings: DataFrame) -> DataFrame:
    """Per scan: a count for every severity (zeros included) and the total."""
    aggs = [_cnt(F.col("severity") == s).alias(s.lower()) for s in R.SEVERITIES]
    return findings.groupBy("scan_id").agg(*aggs, F.count(F.lit(1)).cast("bigint").alias("total"))


def scores_with_bands(findings: DataFrame) -> DataFrame:
    c = compliance_score(findings)
    r = residual_score(findings)
    return c.join(r, "scan_id").select(
        "scan_id",
        "compliance_score",
        risk_band(F.col("compliance_score")).alias("compliance_band"),
        "residual_score",
        risk_band(F.col("residual_score")).alias("residual_band"),
    )


def audit_report(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Flat audit trail: scan header + summary + score on every finding row;
    a scan without findings gives one row with NULL finding fields."""
    summ = status_summary(findings).withColumn("compliance_score", compliance_from_counts(F.col("critical"), F.col("high")))
    head = (
        scans.join(summ, "scan_id", "left")
        .fillna(0, ["total", "critical", "high", "approved", "rejected", "pending"])
        .fillna(100, ["compliance_score"])
    )
    cols = [
        "finding_id", "data_type", "severity", "location", "snippet", "detected_by",
        "policy_clause_id", "policy_clause_text", "explanation", F.col("status").alias("finding_status"),
        "fix_tool", "fix_args", "approved_by", "approved_at",
    ]
    # Findings stand on the left, so the scans' side may be broadcast when its
    # measured size allows, and AQE may split a scan that holds many findings.
    f = findings.select("scan_id", *cols)
    none = head.where("total = 0")
    none = none.select(*none.columns, *[F.lit(None).cast(f.schema[c].dataType).alias(c) for c in f.columns[1:]])
    return f.join(head, "scan_id").select(*none.columns).unionByName(none)


def available_policies(findings: DataFrame) -> DataFrame:
    """Distinct policy labels cited per scan."""
    return findings.select("scan_id", policy_of(F.col("policy_clause_id")).alias("policy")).distinct()


def filter_findings(findings: DataFrame, severity: str | None = None, policies: list[str] | None = None) -> DataFrame:
    """Severity filter AND policy filter; ``None``/'ALL'/empty means all."""
    out = findings
    if severity and severity.upper() != "ALL":
        out = out.where(F.col("severity") == severity)
    if policies:
        out = out.where(policy_of(F.col("policy_clause_id")).isin(*policies))
    return out


def files_with_findings(sources: DataFrame, findings: DataFrame) -> DataFrame:
    """Sources having at least one finding (left-semi join on scan and file)."""
    keys = _file_keys(sources, findings)
    return sources.join(findings.select(*keys).distinct(), keys, "left_semi")


def _file_keys(left: DataFrame, findings: DataFrame) -> list[str]:
    """What names a file: the scan too, where the left side tells it."""
    return (["scan_id"] if "scan_id" in left.columns and "scan_id" in findings.columns else []) + ["file_name"]


def annotate_lines(sources: DataFrame, findings: DataFrame) -> DataFrame:
    """Every line of every source (empty lines included) with the last
    finding of that line (by rule, then match order)."""
    keys = _file_keys(sources, findings)
    lines = sources.select(
        *keys, F.posexplode(F.split(F.col("content"), "\n", -1)).alias("pos", "text")
    ).select(*keys, (F.col("pos") + 1).cast("int").alias("line_no"), "text")
    per_line = findings.where(F.col("line_no").isNotNull()).groupBy(*keys, "line_no").agg(
        F.max_by(
            F.struct("finding_id", "data_type", "severity"),
            F.struct(F.coalesce("rule_ord", F.lit(0)), F.coalesce("match_ord", F.lit(0)), "finding_id"),
        ).alias("f")
    )
    return lines.join(per_line, [*keys, "line_no"], "left").select(
        *keys, "line_no", "text",
        F.col("f.finding_id").alias("finding_id"),
        F.col("f.data_type").alias("data_type"),
        F.col("f.severity").alias("severity"),
    )


def annotate_columns(columns: DataFrame, findings: DataFrame) -> DataFrame:
    """Every dataset column ``(file_name, col_pos, column_name)`` with the
    last finding naming it (trimmed header match)."""
    keys = _file_keys(columns, findings)
    per_col = findings.where(F.col("column_name").isNotNull()).groupBy(*keys, F.col("column_name").alias("_t")).agg(
        F.max_by(F.struct("finding_id", "data_type", "severity"), F.col("finding_id")).alias("f")
    )
    c = columns.withColumn("_t", F.trim(F.col("column_name")))
    return c.join(per_col, [*keys, "_t"], "left").select(
        *keys, "col_pos", "column_name",
        F.col("f.finding_id").alias("finding_id"),
        F.col("f.data_type").alias("data_type"),
        F.col("f.severity").alias("severity"),
    )


def scan_detail(scans: DataFrame, findings: DataFrame, sources: DataFrame) -> DataFrame:
    """Scan status and score with every file of the scan (its current
    content) and the number of findings in it; flat, one row per file; a scan
    without files gives one row.

    The scan's own columns are few and are joined to the counts per file
    first; the file rows stand on the left of one join by (scan, file), so the
    counts are broadcast when small and no exchange is by scan alone."""
    per_file = findings.groupBy("scan_id", "file_name").agg(F.count(F.lit(1)).cast("bigint").alias("n_findings"))
    head = scans.select("scan_id", "policy_id", "status").join(compliance_score(findings, scans).select("scan_id", "compliance_score"), "scan_id", "left")
    names = sources.select("scan_id", "file_name")
    files = names.distinct().join(per_file, ["scan_id", "file_name"], "left").fillna(0, ["n_findings"])
    slim = files.join(head, "scan_id")
    out = sources.select("scan_id", "file_name", "content").join(slim, ["scan_id", "file_name"])
    columns = ["scan_id", "policy_id", "status", "compliance_score", "file_name", "content", "n_findings"]
    empty = head.join(names.select("scan_id").distinct(), "scan_id", "left_anti").withColumns(
        {"file_name": F.lit(None).cast("string"), "content": F.lit(None).cast("string"), "n_findings": F.lit(0).cast("bigint")}
    )
    return out.select(*columns).unionByName(empty.select(*columns))


def policy_summary(clauses: DataFrame) -> DataFrame:
    """Clauses per policy with the policy's description (NULL when
    unknown), ordered by name."""
    from ..functions.policy import policy_description

    return (
        clauses.groupBy("policy_name")
        .agg(F.count(F.lit(1)).cast("bigint").alias("clause_count"))
        .select("policy_name", policy_description(F.col("policy_name")).alias("description"), "clause_count")
        .orderBy("policy_name")
    )
