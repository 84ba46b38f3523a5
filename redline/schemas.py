"""Fixed table contracts: findings, scans, clauses, decisions, outcomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import rules as R

FINDINGS = T.StructType(
    [
        T.StructField("finding_id", T.StringType()),
        T.StructField("scan_id", T.StringType()),
        T.StructField("data_type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("line_no", T.IntegerType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("rule_ord", T.IntegerType()),
        T.StructField("match_ord", T.IntegerType()),
        T.StructField("snippet", T.StringType()),
        T.StructField("detected_by", T.StringType()),
        T.StructField("policy_clause_id", T.StringType()),
        T.StructField("policy_clause_text", T.StringType()),
        T.StructField("explanation", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("fix_tool", T.StringType()),
        T.StructField("fix_args", T.MapType(T.StringType(), T.StringType())),
        T.StructField("approved_by", T.StringType()),
        T.StructField("approved_at", T.TimestampType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
FINDING_COLUMNS = [f.name for f in FINDINGS.fields]

SCANS = T.StructType(
    [
        T.StructField("scan_id", T.StringType()),
        T.StructField("policy_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("input_file_names", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("compliance_score", T.IntegerType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("completed_at", T.TimestampType()),
    ]
)

CLAUSES = T.StructType(
    [
        T.StructField("policy_name", T.StringType()),
        T.StructField("clause_ord", T.IntegerType()),
        T.StructField("clause_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("clause_text", T.StringType()),
        T.StructField("example_violations", T.ArrayType(T.StringType())),
    ]
)

DECISIONS = T.StructType(
    [
        T.StructField("finding_id", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("approved_by", T.StringType()),
        T.StructField("decided_at", T.TimestampType()),
    ]
)

SOURCES = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("language", T.StringType()),
    ]
)


def finding_id(
    scan_id: Column,
    file_name: Column,
    line_no: Column,
    column_name: Column,
    detected_by: Column,
    rule_ord: Column,
    match_ord: Column,
) -> Column:
    """Deterministic finding id (stable under task retries)."""
    return F.sha2(
        F.concat_ws(
            "|",
            scan_id,
            file_name,
            line_no.cast("string"),
            column_name,
            detected_by,
            rule_ord.cast("string"),
            match_ord.cast("string"),
        ),
        256,
    )


def detection_finding(
    *,
    scan_id: Column,
    data_type: Column,
    location: Column,
    file_name: Column,
    line_no: Column,
    column_name: Column,
    rule_ord: Column,
    match_ord: Column,
    snippet: Column,
    detected_by: Column,
    created_at: Column | None = None,
) -> list[Column]:
    """Columns of a detection-stage finding, in contract order.  Severity is
    the default, citation/fix fields are empty, status is PENDING_REVIEW."""
    line_no = line_no.cast("int")
    rule_ord = rule_ord.cast("int")
    match_ord = match_ord.cast("int")
    return [
        finding_id(scan_id, file_name, line_no, column_name, detected_by, rule_ord, match_ord).alias("finding_id"),
        scan_id.alias("scan_id"),
        data_type.alias("data_type"),
        F.lit(R.DEFAULT_SEVERITY).alias("severity"),
        location.alias("location"),
        file_name.alias("file_name"),
        line_no.alias("line_no"),
        column_name.cast("string").alias("column_name"),
        rule_ord.alias("rule_ord"),
        match_ord.alias("match_ord"),
        snippet.alias("snippet"),
        detected_by.alias("detected_by"),
        F.lit(None).cast("string").alias("policy_clause_id"),
        F.lit(None).cast("string").alias("policy_clause_text"),
        F.lit(None).cast("string").alias("explanation"),
        F.lit("PENDING_REVIEW").alias("status"),
        F.lit(None).cast("string").alias("fix_tool"),
        F.lit(None).cast("map<string,string>").alias("fix_args"),
        F.lit(None).cast("string").alias("approved_by"),
        F.lit(None).cast("timestamp").alias("approved_at"),
        (created_at if created_at is not None else F.lit(None)).cast("timestamp").alias("created_at"),
    ]
