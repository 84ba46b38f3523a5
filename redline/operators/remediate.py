"""Review decisions and fixes.

* ``fix_plan``: every approved finding's target (file, column or line),
  tool, arguments and outcome (applied or the reason it is not).
* ``apply_column_fixes``: the approved column fixes of one dataset of one scan
  folded in approval order: the chains travel as one value, and each
  value is folded with ``aggregate``, so no data row leaves its task.
* ``apply_line_redactions``: the approved line redactions of text sources.
* ``approve`` / ``reject`` / ``approve_all_high``: status transitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.reason import location_column, location_file_name, location_line
from ..functions.remediate import anonymize, lower_keys, mask, redact_lines, redaction_note

COLUMN_TOOLS = ["MASK_COLUMN", "DROP_COLUMN", "ANONYMIZE_COLUMN"]
DEFAULT_LABEL = "redline"


def _args_lower(args: Column) -> Column:
    return lower_keys(F.coalesce(args, F.create_map().cast("map<string,string>")))


def fix_plan(approved: DataFrame, files: DataFrame) -> DataFrame:
    """Target and outcome of each approved finding.

    ``files(file_name, columns array<string>)`` lists what exists: datasets
    with their column names, text sources with ``columns = NULL``.  Fixes of
    one (scan, file, column) apply in ``approved_at`` order; after a DROP the
    column is gone, so later fixes on it are not applied.  ``files`` names the
    scan of each file in ``scan_id``; without that column its files belong to
    every scan.
    """
    by_scan = "scan_id" in files.columns
    a = _args_lower(F.col("fix_args"))
    tool = F.upper(F.col("fix_tool"))
    fname = location_file_name(F.col("location"))
    arg_col = a["column"]
    col_name = F.when(F.coalesce(F.trim(arg_col), F.lit("")) != "", arg_col).otherwise(
        location_column(F.col("location"), "applier")
    )
    line = F.coalesce(a["line"].try_cast("int"), location_line(F.col("location")))
    base = approved.select(
        "finding_id",
        "scan_id",
        "data_type",
        "location",
        F.col("fix_tool"),
        tool.alias("tool"),
        fname.alias("target_file"),
        col_name.alias("target_column"),
        line.alias("target_line"),
        a["style"].alias("style"),
        a["salt"].alias("salt"),
        a["reason"].alias("reason"),
        F.col("approved_at"),
    )
    f = files.select(F.col("file_name").alias("_f"), F.col("columns").alias("_cols"), *([F.col("scan_id").alias("_s")] if by_scan else []))
    same = base["target_file"] == f["_f"]
    j = base.join(f, same & base["scan_id"].eqNullSafe(f["_s"]) if by_scan else same, "left")
    found_col = F.filter(F.coalesce(F.col("_cols"), F.array().cast("array<string>")), lambda c: F.lower(c) == F.lower(F.col("target_column")))
    j = j.withColumn("resolved_column", F.try_element_at(found_col, F.lit(1)))
    is_col_tool = F.col("tool").isin(*COLUMN_TOOLS)
    # first DROP per (file, column): a partial/final aggregation, so a hot
    # column is never one task's whole group
    order_key = F.struct(F.col("approved_at"), F.col("finding_id"))
    j = j.withColumn("_col_key", F.lower(F.col("resolved_column"))).withColumn("_order", order_key)
    first_drop = (
        j.where(is_col_tool & (F.col("tool") == "DROP_COLUMN") & F.col("_col_key").isNotNull())
        .groupBy(F.col("scan_id").alias("_ds"), F.col("target_file").alias("_df"), F.col("_col_key").alias("_dk"))
        .agg(F.min("_order").alias("_first_drop"))
    )
    j = j.join(
        first_drop,
        j["scan_id"].eqNullSafe(first_drop["_ds"]) & (j["target_file"] == first_drop["_df"]) & (j["_col_key"] == first_drop["_dk"]),
        "left",
    ).withColumn(
        "_dropped_before",
        F.when(is_col_tool & F.col("_first_drop").isNotNull() & (F.col("_order") > F.col("_first_drop")), 1).otherwise(0),
    )
    fn = F.coalesce(F.col("target_file"), F.lit(""))
    detail = (
        F.when(F.coalesce(F.trim(F.col("fix_tool")), F.lit("")) == "", F.lit("No fix tool was proposed for this finding."))
        .when(F.col("target_file").isNull(), F.concat(F.lit("Could not parse a file name from location '"), F.coalesce(F.col("location"), F.lit("")), F.lit("'.")))
        .when(F.col("_f").isNull(), F.concat(F.lit("File '"), fn, F.lit("' was not found for this scan.")))
        .when(~(is_col_tool | (F.col("tool") == "REDACT_CODE_LINE")), F.concat(F.lit("Unknown fix tool '"), F.col("fix_tool"), F.lit("'.")))
        .when((F.col("tool") == "REDACT_CODE_LINE") & F.col("target_line").isNull(), F.lit("No line number was available to redact."))
        .when(F.col("tool") == "REDACT_CODE_LINE", F.concat(F.lit("Redacted line "), F.col("target_line").cast("string"), F.lit(" of "), fn, F.lit(".")))
        .when(F.coalesce(F.trim(F.col("target_column")), F.lit("")) == "", F.lit("No column was specified for the dataset fix."))
        .when(F.col("resolved_column").isNull() | (F.col("_dropped_before") == 1), F.concat(F.lit("Column '"), F.col("target_column"), F.lit("' was not found in "), fn, F.lit(".")))
        .otherwise(F.concat(F.lit("Applied "), F.col("tool"), F.lit(" to column '"), F.col("target_column"), F.lit("' in "), fn, F.lit(".")))
    )
    applied = detail.startswith("Applied ") | detail.startswith("Redacted line ")
    return j.select(
        "finding_id", "scan_id", "data_type", "tool", "target_file", "resolved_column", "target_line",
        F.coalesce(F.when(F.trim(F.col("style")) != "", F.col("style")), F.lit(R.MASK_STYLE_DEFAULT)).alias("style"),
        F.when(F.trim(F.col("salt")) != "", F.col("salt")).alias("salt"),
        F.when(F.trim(F.col("reason")) != "", F.col("reason")).otherwise(
            F.concat(F.lit("Contains "), F.coalesce(F.col("data_type"), F.lit("")))
        ).alias("reason"),
        "approved_at",
        applied.alias("applied"),
        detail.alias("detail"),
    )


def _fold(value: Column, ops: Column) -> Column:
    def step(acc: Column, op: Column) -> Column:
        repeat = F.sequence(F.lit(1), F.greatest(op["times"], F.lit(1)))
        return (
            F.when(op["tool"] == "MASK_COLUMN", mask(acc, op["style"]))
            .when(op["tool"] == "ANONYMIZE_COLUMN", F.aggregate(repeat, acc, lambda a, _i: anonymize(a, op["salt"])))
            .otherwise(acc)
        )

    return F.aggregate(ops, value, step)


def column_chains(plan: DataFrame) -> DataFrame:
    """One row per dataset: ``scan_id, target_file, chains map<lower column,
    array<op>>``, the column's applied masks and anonymisations in approval
    order.  Repetitions of one fix that follow each other are one op with
    ``times`` (a mask is idempotent: once); the windows stream, so only the
    ops, not the fixes, are gathered.
    """
    col_fixes = plan.where(F.col("applied") & F.col("tool").isin("MASK_COLUMN", "ANONYMIZE_COLUMN"))
    col_fixes = col_fixes.withColumn("col_key", F.lower(F.col("resolved_column")))
    kind = F.when(F.col("tool") == "MASK_COLUMN", F.struct("tool", F.lower("style").alias("x"))).otherwise(F.struct("tool", F.col("salt").alias("x")))
    w = Window.partitionBy("scan_id", "target_file", "col_key").orderBy("approved_at", "finding_id")
    runs = col_fixes.withColumn("kind", kind).withColumn("new", F.when(F.lag("kind").over(w).eqNullSafe(F.col("kind")), 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("new").over(w)).groupBy("scan_id", "target_file", "col_key", "run").agg(
        F.first("tool").alias("tool"), F.first("style").alias("style"), F.first("salt").alias("salt"),
        F.when(F.first("tool") == "MASK_COLUMN", 1).otherwise(F.count(F.lit(1))).cast("int").alias("times"),
    )
    per_col = runs.groupBy("scan_id", "target_file", "col_key").agg(
        F.sort_array(F.collect_list(F.struct("run", "tool", "style", "salt", "times"))).alias("ops")
    )
    return per_col.groupBy("scan_id", "target_file").agg(F.map_from_entries(F.collect_list(F.struct("col_key", "ops"))).alias("chains"))


def dropped_columns(plan: DataFrame, dataset: str, scan_id: str | None = None) -> list[str]:
    """Lower-cased names of the columns of ``dataset`` an applied DROP
    removes (a subset of the dataset's schema, so a small list)."""
    rows = (
        _of_dataset(plan, dataset, scan_id)
        .where(F.col("applied") & (F.col("tool") == "DROP_COLUMN"))
        .select(F.lower(F.col("resolved_column")).alias("c"))
        .distinct()
        .collect()
    )
    return [r["c"] for r in rows]


def _of_dataset(plan: DataFrame, dataset: str, scan_id: str | None) -> DataFrame:
    mine = plan.where(F.col("target_file") == dataset)
    return mine if scan_id is None else mine.where(F.col("scan_id") == scan_id)


def apply_column_fixes(df: DataFrame, dataset: str, plan: DataFrame, scan_id: str | None = None) -> DataFrame:
    """The cleaned copy of ``df``: dropped columns removed, masked and
    anonymised values replaced (all values as the scanner's strings).

    ``scan_id`` names the scan the dataset belongs to; without it the plan
    must be of one scan.  The chains of the dataset are one value (its columns
    with their approved fixes), a scalar subquery.
    """
    drop = set(dropped_columns(plan, dataset, scan_id))
    chains = column_chains(_of_dataset(plan, dataset, scan_id)).agg(F.first("chains").alias("_chains"))
    joined = df.select(F.struct("*").alias("_row"), chains.scalar().alias("_chains"))
    out = []
    for c in df.columns:
        if c.lower() not in drop:
            v = F.col("_row").getField(c).cast("string")
            ops = F.col("_chains")[c.lower()]
            out.append(F.when(ops.isNull(), v).otherwise(_fold(v, F.coalesce(ops, F.array().cast(OPS)))).alias(c))
    return joined.select(*out)


OPS = "array<struct<run:bigint,tool:string,style:string,salt:string,times:int>>"


def apply_line_redactions(sources: DataFrame, plan: DataFrame, label: str = DEFAULT_LABEL) -> DataFrame:
    """Sources with every approved line redaction applied; for several
    notes on one line the last approved wins."""
    red = plan.where(F.col("applied") & (F.col("tool") == "REDACT_CODE_LINE")).withColumnRenamed("target_file", "file_name")
    keys = (["scan_id"] if "scan_id" in sources.columns else []) + ["file_name"]
    notes = red.groupBy(*keys, "target_line").agg(
        F.max_by(F.col("reason"), F.struct(F.col("approved_at"), F.col("finding_id"))).alias("reason")
    ).groupBy(*keys).agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.col("target_line"), redaction_note(F.col("reason"), label)))
        ).alias("_notes")
    )
    j = sources.join(notes, keys, "left")
    new = F.when(F.col("_notes").isNull(), F.col("content")).otherwise(redact_lines(F.col("content"), F.col("_notes")))
    return j.select(*[new.alias("content") if c == "content" else F.col(c) for c in sources.columns])


def approve(findings: DataFrame, decisions: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """Apply APPROVE / REJECT decisions.

    The decisions on a finding are replayed in order of ``decided_at`` (null
    first, then by action).  APPROVE: an already approved finding is
    untouched, so the first approval is kept; otherwise status APPROVED,
    approver (default ``system``) and time are set, even when the fix was not
    applied.  REJECT: status REJECTED from any state.
    """
    replay = decisions.groupBy("finding_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("decided_at").alias("at"), F.upper(F.col("action")).alias("action"), F.col("approved_by").alias("by")))).alias("_decisions")
    )
    j = findings.join(replay, "finding_id", "left")

    def step(now: Column, d: Column) -> Column:
        return (
            F.when(d["action"] == "REJECT", F.struct(F.lit("REJECTED").alias("status"), now["by"].alias("by"), now["at"].alias("at")))
            .when(
                (d["action"] == "APPROVE") & ~now["status"].eqNullSafe(F.lit("APPROVED")),
                F.struct(F.lit("APPROVED").alias("status"), F.coalesce(d["by"], F.lit(R.DEFAULT_APPROVER)).alias("by"), d["at"].alias("at")),
            )
            .otherwise(now)
        )

    start = F.struct(F.col("status").alias("status"), F.col("approved_by").alias("by"), F.col("approved_at").alias("at"))
    j = j.withColumn("_end", F.when(F.col("_decisions").isNull(), start).otherwise(F.aggregate("_decisions", start, step)))
    new = {"status": F.col("_end.status"), "approved_by": F.col("_end.by"), "approved_at": F.col("_end.at")}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in findings.columns])


def reject(findings: DataFrame, finding_ids: DataFrame) -> DataFrame:
    """Status REJECTED for the given findings; data untouched."""
    d = finding_ids.select("finding_id", F.lit("REJECT").alias("action"), F.lit(None).cast("string").alias("approved_by"), F.lit(None).cast("timestamp").alias("decided_at"))
    return approve(findings, d)


def approve_all_high_decisions(findings: DataFrame, approver: str | None = None, at: Column | None = None) -> DataFrame:
    """Decisions approving every pending CRITICAL or HIGH finding."""
    return findings.where(
        (F.col("status") == "PENDING_REVIEW") & F.col("severity").isin("CRITICAL", "HIGH")
    ).select(
        "finding_id",
        F.lit("APPROVE").alias("action"),
        F.lit(approver).cast("string").alias("approved_by"),
        (at if at is not None else F.lit(None)).cast("timestamp").alias("decided_at"),
    )


def approve_all_high(findings: DataFrame, approver: str | None = None, at: Column | None = None) -> DataFrame:
    return approve(findings, approve_all_high_decisions(findings, approver, at))


def files_of_datasets(datasets: dict[str, DataFrame]) -> list[tuple[str, list[str]]]:
    """``(file_name, columns)`` of datasets, from their schemas."""
    return [(name, list(df.columns)) for name, df in datasets.items()]
