"""Named queries over the driver tables (``queries()`` of the entry module).

Every query reads whole tables from ``sf_dir`` and runs the library's own
operators.  Stand-in inputs the tables do not carry are derived from them by
fixed rules, and only give rows in the schema the job expects:

* a *scan* is one ``documents.source``; its policy id is picked from the
  source number (``ALL``, ``gdpr``, ``HIPAA``, ``Secrets`` in turn);
* review *decisions*: ``reviewer`` approves CRITICAL and EMAIL findings,
  rejects IP findings, leaves the rest pending (no decision time);
* file names with extensions for the routing views are built from
  ``doc_id`` and a fixed list of extensions.
"""

from __future__ import annotations

import weakref

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.code import classify_identifier
from ..functions.columns import classify_column_name, entity_category_counts
from ..functions.policy import build_query, policy_of, resolve_policy_name, tokenize
from ..functions.reason import (
    default_fix_args,
    default_fix_tool,
    default_severity,
    fix_args_text,
    location_column,
    location_file_name,
    location_line,
)
from ..functions.remediate import anonymize, mask
from ..functions.report import permanent_fix_advice, source_type
from ..functions.text import TextRule, default_rules, luhn_valid, rule_matches, split_lines
from ..operators import detect_code, detect_columns, detect_text, enrich, remediate, report, retrieve
from ..sources.files import as_sources, guess_language
from ..session import materialize
from ..sources.policies import load_policy_clauses

Query = Callable[[SparkSession, str], DataFrame]

# Tables scanned by the column detector, with their row order.
COLUMN_TABLES: list[tuple[str, str | list[str]]] = [
    ("customer", "c_custkey"),
    ("supplier", "s_suppkey"),
    ("part", "p_partkey"),
    ("nation", "n_nationkey"),
    ("region", "r_regionkey"),
    ("orders", "o_orderkey"),
    ("lineitem", ["l_orderkey", "l_linenumber"]),
    ("events", "event_id"),
    ("documents", "doc_id"),
]
SAMPLE_TABLES = ["customer", "supplier", "part"]
SCAN_POLICY_CYCLE = ["ALL", "gdpr", "HIPAA", "Secrets"]
STANDIN_EXTENSIONS = [".cs", ".JSON", ".csv", ".py", ".js", ".ts", ".txt", ".Cs"]
CUSTOM_RULES = [
    TextRule(1, "HEX_SECRET", r"\b[0-9a-f]{40}\b"),
    TextRule(2, "URL", r"https?://[A-Za-z0-9.-]+"),
]
REVIEWER = "reviewer"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- inputs


def doc_sources(spark: SparkSession, d: str, prefix: str = "documents/", suffix: str = "") -> DataFrame:
    return as_sources(table(spark, d, "documents"), "doc_id", "text", prefix, suffix, scan_col="source")


def scans(spark: SparkSession, d: str) -> DataFrame:
    """One scan per documents.source (stand-in scan requests)."""
    n = F.regexp_extract(F.col("source"), r"(\d+)", 1).try_cast("int")
    cycle = F.array(*[F.lit(p) for p in SCAN_POLICY_CYCLE])
    return (
        table(spark, d, "documents")
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_files"))
        .select(
            F.col("source").alias("scan_id"),
            F.element_at(cycle, (F.pmod(F.coalesce(n, F.lit(0)), F.lit(len(SCAN_POLICY_CYCLE))) + 1).cast("int")).alias(
                "policy_id"
            ),
            F.lit("DONE").alias("status"),
            F.col("n_files").cast("bigint").alias("n_files"),
        )
    )


def clauses(spark: SparkSession) -> DataFrame:
    return load_policy_clauses(spark)


_CLAUSE_INDEX: "weakref.WeakKeyDictionary[SparkSession, DataFrame]" = weakref.WeakKeyDictionary()


def clause_idx(spark: SparkSession) -> DataFrame:
    """The shipped policy corpus as a retrieval index, cached per session
    (reference data of a few dozen rows)."""
    if spark not in _CLAUSE_INDEX:
        _CLAUSE_INDEX[spark] = retrieve.clause_index(clauses(spark)).cache()
    return _CLAUSE_INDEX[spark]


def doc_findings(spark: SparkSession, d: str, keep_match: bool = False) -> DataFrame:
    return detect_text.scan_text(doc_sources(spark, d), keep_match=keep_match)


def column_findings(spark: SparkSession, d: str, names: list[str] | None = None) -> DataFrame:
    frames = [
        detect_columns.scan_table(table(spark, d, name), name, key, scan_id="tables")
        for name, key in COLUMN_TABLES
        if names is None or name in names
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def enriched_doc_findings(spark: SparkSession, d: str) -> DataFrame:
    f = enrich.attach_scan_policy(doc_findings(spark, d), scans(spark, d))
    return enrich.enrich(f, clause_idx(spark), policy_id=F.col("scan_policy_id")).drop("scan_policy_id")


def decisions(findings: DataFrame) -> DataFrame:
    """Stand-in review decisions: a reviewer approves every CRITICAL and
    every EMAIL finding, rejects IP findings and leaves the rest pending."""
    action = (
        F.when((F.col("severity") == "CRITICAL") | (F.col("data_type") == "EMAIL"), F.lit("APPROVE"))
        .when(F.col("data_type") == "IP", F.lit("REJECT"))
    )
    return findings.select(
        "finding_id",
        action.alias("action"),
        F.lit(REVIEWER).alias("approved_by"),
        F.lit(None).cast("timestamp").alias("decided_at"),
    ).where(F.col("action").isNotNull())


def reviewed_doc_findings(spark: SparkSession, d: str, materialized: bool = False) -> DataFrame:
    """Enriched findings after the stand-in review.  The decisions derive
    from the findings themselves, so the findings are written once
    (checkpoint) and both sides of the decision join read them."""
    f = materialize(enriched_doc_findings(spark, d))
    out = remediate.approve(f, decisions(f))
    return materialize(out) if materialized else out


def standin_file_names(spark: SparkSession, d: str) -> DataFrame:
    exts = F.array(*[F.lit(e) for e in STANDIN_EXTENSIONS])
    pick = (F.pmod(F.col("doc_id"), F.lit(len(STANDIN_EXTENSIONS))) + 1).cast("int")
    return table(spark, d, "documents").select(
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.element_at(exts, pick)).alias("file_name")
    )


def _i(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


# ---------------------------------------------------------------- text


def q_scan_text_findings(spark, d):
    f = doc_findings(spark, d)
    return f.select(
        "finding_id", "scan_id", "file_name", _i("line_no").alias("line_no"), "data_type",
        _i("rule_ord").alias("rule_ord"), _i("match_ord").alias("match_ord"), "location", "snippet",
        "detected_by", "severity", "status",
    )


def _rule_matches(spark, d, dtype):
    f = doc_findings(spark, d, keep_match=True).where(F.col("data_type") == dtype)
    return f.select("file_name", _i("line_no").alias("line_no"), _i("match_ord").alias("match_ord"), "match")


def q_scan_rule_email(spark, d):
    return _rule_matches(spark, d, "EMAIL")


def q_scan_rule_phone(spark, d):
    return _rule_matches(spark, d, "PHONE")


def q_scan_rule_ip(spark, d):
    return _rule_matches(spark, d, "IP")


def q_scan_rule_credit_card_luhn(spark, d):
    """Every card candidate with its Luhn verdict (validator shown, not applied)."""
    card = [TextRule(r.ordinal, r.data_type, r.pattern) for r in default_rules() if r.data_type == "CREDIT_CARD"]
    lines = doc_sources(spark, d).select("file_name", F.explode(split_lines(F.col("content"), r"\d")).alias("l"))
    m = lines.select("file_name", "l.line_no", F.explode(rule_matches(F.col("l.line"), card)).alias("m"))
    return m.select(
        "file_name", _i("line_no").alias("line_no"), _i("m.match_ord").alias("match_ord"),
        F.col("m.match").alias("match"), luhn_valid(F.col("m.match")).alias("luhn_valid"),
    )


def _custom_sources(spark, d):
    docs = doc_sources(spark, d)
    pages = as_sources(table(spark, d, "pages"), "page_id", "html", "pages/").withColumn("scan_id", F.lit("pages"))
    return docs.unionByName(pages)


def q_scan_custom_rules(spark, d):
    f = detect_text.scan_text(_custom_sources(spark, d), rules=CUSTOM_RULES, keep_match=True)
    return f.select(
        "file_name", _i("line_no").alias("line_no"), _i("rule_ord").alias("rule_ord"), "data_type",
        _i("match_ord").alias("match_ord"), "match",
    )


def q_scan_pages(spark, d):
    src = as_sources(table(spark, d, "pages"), "page_id", "html", "pages/")
    f = detect_text.scan_text(src, scan_id="pages")
    return f.select(
        "finding_id", "file_name", _i("line_no").alias("line_no"), "data_type", _i("rule_ord").alias("rule_ord"),
        _i("match_ord").alias("match_ord"), "snippet",
    )


def q_scan_conversations(spark, d):
    """Negative text scan: conversation turns hold no personal data."""
    turns = table(spark, d, "conversations").withColumn("turn_id", F.concat_ws("/", "conv_id", "turn"))
    src = as_sources(turns, "turn_id", "text", "conversations/")
    return detect_text.scan_text(src, scan_id="conversations").select("finding_id", "file_name", _i("line_no").alias("line_no"), "data_type")


def q_scan_benchmark(spark, d):
    """Negative text scan over the benchmark passages."""
    src = as_sources(table(spark, d, "benchmark"), "item_id", "text", "benchmark/")
    return detect_text.scan_text(src, scan_id="benchmark").select("finding_id", "file_name", _i("line_no").alias("line_no"), "data_type")


def q_findings_by_label(spark, d):
    """Findings per labelled document (documents ⋈ labels on doc_id)."""
    f = doc_findings(spark, d).select(
        F.regexp_extract("file_name", r"(\d+)$", 1).cast("bigint").alias("doc_id"), "data_type"
    )
    per_doc = f.groupBy("doc_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_findings"))
    lab = table(spark, d, "labels")
    return lab.join(per_doc, "doc_id", "left").select(
        _i("doc_id").alias("doc_id"), _i("quality").alias("quality"), _i("toxic").alias("toxic"),
        F.coalesce("n_findings", F.lit(0)).cast("bigint").alias("n_findings"),
    )


def q_split_lines(spark, d):
    return detect_text.split_source_lines(doc_sources(spark, d)).select(
        "file_name", _i("line_no").alias("line_no"), "line"
    )


def q_guess_language(spark, d):
    return standin_file_names(spark, d).select("file_name", guess_language(F.col("file_name")).alias("language"))


def q_source_type(spark, d):
    return standin_file_names(spark, d).select("file_name", source_type(F.col("file_name")).alias("source_type"))


# ---------------------------------------------------------------- columns


def _samples(spark, d, names):
    frames = [
        detect_columns.sample_table_values(table(spark, d, name), name, key)
        for name, key in COLUMN_TABLES
        if names is None or name in names
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _per_column(spark, d, names=None):
    return detect_columns.column_samples(_samples(spark, d, names))


def q_column_samples(spark, d):
    return _samples(spark, d, SAMPLE_TABLES).select(
        "dataset", _i("col_pos").alias("col_pos"), "column_name", _i("sample_ord").alias("sample_ord"), "value"
    )


def q_column_name_types(spark, d):
    return _per_column(spark, d).select(
        "dataset", "column_name", classify_column_name(F.col("column_name")).alias("name_type")
    )


def q_column_value_entities(spark, d):
    pc = _per_column(spark, d)
    counts = entity_category_counts(F.array_join(F.col("samples"), "\n"))
    return pc.select("dataset", "column_name", F.explode(counts).alias("e")).select(
        "dataset", "column_name", F.col("e.category").alias("category"), _i("e.cnt").alias("cnt")
    )


def q_dominant_category(spark, d):
    pc = detect_columns.classify_columns(_per_column(spark, d))
    return pc.select("dataset", "column_name", "value_type")


def q_scan_columns(spark, d):
    f = column_findings(spark, d)
    return f.select("finding_id", "scan_id", "data_type", "location", "column_name", "snippet", "detected_by")


# ---------------------------------------------------------------- code


def q_classify_identifier(spark, d):
    la = detect_code.literal_assignments(doc_sources(spark, d))
    return la.select(
        "file_name", _i("line_no").alias("line_no"), _i("match_ord").alias("match_ord"), "identifier",
        classify_identifier(F.col("identifier")).alias("data_type"),
    )


def q_literal_assignment(spark, d):
    f = detect_code.sensitive_literal_assignment(doc_sources(spark, d))
    return f.select("finding_id", "file_name", _i("line_no").alias("line_no"), "data_type", "snippet", "detected_by")


def q_route_detectors(spark, d):
    from ..plans.scan import route_detectors

    f = route_detectors(doc_sources(spark, d), {"customer": (table(spark, d, "customer"), "c_custkey")})
    return f.select("finding_id", "scan_id", "file_name", "data_type", "detected_by", "location")


# ---------------------------------------------------------------- policy


def q_tokenize(spark, d):
    f = doc_findings(spark, d)
    q = build_query(F.col("data_type"), F.col("location"), F.col("detected_by"), F.col("snippet"))
    return f.select("finding_id", F.explode(tokenize(q)).alias("token"))


def q_keyword_top1(spark, d):
    f = doc_findings(spark, d)
    q = build_query(F.col("data_type"), F.col("location"), F.col("detected_by"), F.col("snippet"))
    r = retrieve.retrieve_top1(f.withColumn("query", q), clause_idx(spark), query=F.col("query"))
    return r.select(
        "finding_id",
        F.col("match.clause_id").alias("clause_id"),
        F.col("match.policy_name").alias("policy_name"),
        _i(F.round(F.col("match.score") * F.size(tokenize(F.col("query"))))).alias("hits"),
        _i(F.size(tokenize(F.col("query")))).alias("n_tokens"),
    )


def label_exemplars(emb: DataFrame) -> DataFrame:
    """Candidate index of one vector per label: the lowest vec_id's."""
    ex = emb.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return ex.select(
        F.lit("LABELS").alias("policy_name"),
        F.col("label").cast("int").alias("clause_ord"),
        F.col("label").cast("string").alias("clause_id"),
        F.lit("").alias("title"),
        F.lit("").alias("clause_text"),
        F.array().cast("array<string>").alias("tokens"),
        F.col("embedding"),
    )


def q_cosine_top1(spark, d):
    emb = table(spark, d, "embeddings")
    r = retrieve.retrieve_top1(
        emb.select("vec_id", "embedding", F.lit("").alias("query")),
        label_exemplars(emb),
        key="vec_id",
        query=F.col("query"),
        query_vec=F.col("embedding"),
    )
    return r.select(_i("vec_id").alias("vec_id"), F.col("match.clause_id").alias("best_label"))


def q_resolve_policy(spark, d):
    return scans(spark, d).select("scan_id", "policy_id", resolve_policy_name(F.col("policy_id")).alias("policy_name"))


def q_validate_policy(spark, d):
    from ..plans.scan import validate_policy_requests

    return validate_policy_requests(scans(spark, d), clauses(spark)).select("scan_id", "policy_id")


# ---------------------------------------------------------------- reasoning


def _all_findings(spark, d):
    return doc_findings(spark, d).unionByName(column_findings(spark, d, ["customer", "orders"]))


def q_severity(spark, d):
    return _all_findings(spark, d).select("finding_id", "data_type", default_severity(F.col("data_type")).alias("severity"))


def q_fix_tool(spark, d):
    return _all_findings(spark, d).select(
        "finding_id", default_fix_tool(F.col("data_type"), F.col("detected_by"), F.col("location")).alias("fix_tool")
    )


def q_fix_args(spark, d):
    f = _all_findings(spark, d)
    tool = default_fix_tool(F.col("data_type"), F.col("detected_by"), F.col("location"))
    return f.select("finding_id", fix_args_text(default_fix_args(F.col("data_type"), F.col("location"), tool)).alias("fix_args"))


def q_parse_location(spark, d):
    return _all_findings(spark, d).select(
        "finding_id",
        "location",
        location_file_name(F.col("location")).alias("file"),
        _i(location_line(F.col("location"))).alias("line"),
        location_column(F.col("location"), "applier").alias("column_applier"),
        location_column(F.col("location"), "reasoner").alias("column_reasoner"),
    )


def q_enrich(spark, d):
    f = enriched_doc_findings(spark, d)
    return f.select(
        "finding_id", "scan_id", "severity", "policy_clause_id", "policy_clause_text", "explanation", "fix_tool",
        fix_args_text(F.col("fix_args")).alias("fix_args"), "status",
    )


# ---------------------------------------------------------------- remediation


def q_mask_partial(spark, d):
    c = table(spark, d, "customer")
    return c.select(_i("c_custkey").alias("c_custkey"), mask(F.col("c_name")).alias("c_name"), mask(F.col("c_mktsegment")).alias("c_mktsegment"))


def q_mask_full(spark, d):
    c = table(spark, d, "customer")
    return c.select(_i("c_custkey").alias("c_custkey"), mask(F.col("c_name"), "full").alias("c_name"))


def q_anonymize(spark, d):
    c = table(spark, d, "customer")
    return c.select(
        _i("c_custkey").alias("c_custkey"),
        anonymize(F.col("c_name")).alias("c_name"),
        anonymize(F.col("c_name"), "s1").alias("c_name_salted"),
    )


def q_anonymize_join(spark, d):
    """Orders joined to customers on pseudonymised keys: same pairs as the
    join on the raw keys."""
    o = table(spark, d, "orders").select("o_orderkey", anonymize(F.col("o_custkey").cast("string")).alias("k"))
    c = table(spark, d, "customer").select(anonymize(F.col("c_custkey").cast("string")).alias("k"), "c_mktsegment")
    return o.join(c, "k").select(_i("o_orderkey").alias("o_orderkey"), F.col("k").alias("anon_custkey"), "c_mktsegment")


def _customer_plan(spark, d, tool_override: str | None = None):
    c = table(spark, d, "customer")
    f = detect_columns.scan_table(c, "customer", "c_custkey", scan_id="customer")
    f = enrich.enrich(f, clause_idx(spark))
    if tool_override:
        f = f.withColumn("fix_tool", F.lit(tool_override))
    files = spark.createDataFrame(remediate.files_of_datasets({"customer": c}), "file_name string, columns array<string>")
    return c, remediate.fix_plan(f, files)


def q_drop_column(spark, d):
    c, plan = _customer_plan(spark, d, "DROP_COLUMN")
    out = remediate.apply_column_fixes(c, "customer", plan)
    return out.select(*[F.col(x).cast("string").alias(x) for x in out.columns])


def q_apply_fixes(spark, d):
    c, plan = _customer_plan(spark, d)
    out = remediate.apply_column_fixes(c, "customer", plan)
    return out.select(*[F.col(x).cast("string").alias(x) for x in out.columns])


def _code_flow(spark, d):
    """Documents as code files (stand-in '.py' names): findings become line
    redactions; every finding is approved."""
    src = doc_sources(spark, d, "code/", ".py")
    f = detect_text.scan_text(src)
    f = enrich.enrich(f, clause_idx(spark))
    approved = remediate.approve(f, f.select("finding_id", F.lit("APPROVE").alias("action"), F.lit(REVIEWER).alias("approved_by"), F.lit(None).cast("timestamp").alias("decided_at")))
    files = src.select("file_name", F.lit(None).cast("array<string>").alias("columns"))
    return src, remediate.fix_plan(approved, files)


def q_redact_lines(spark, d):
    src, plan = _code_flow(spark, d)
    out = remediate.apply_line_redactions(src, plan)
    return out.select("file_name", "content")


def q_fix_outcomes(spark, d):
    _, plan = _code_flow(spark, d)
    _, cplan = _customer_plan(spark, d)
    both = plan.unionByName(cplan)
    return both.select(
        "finding_id", "tool", "target_file", "resolved_column", _i("target_line").alias("target_line"), "applied", "detail"
    )


def q_approve(spark, d):
    f = reviewed_doc_findings(spark, d)
    return f.select("finding_id", "status", "approved_by")


def q_reject(spark, d):
    f = enriched_doc_findings(spark, d)
    ids = f.where(F.col("severity") == "MEDIUM").select("finding_id")
    return remediate.reject(f, ids).select("finding_id", "status")


def q_approve_all_high(spark, d):
    f = remediate.approve_all_high(enriched_doc_findings(spark, d), REVIEWER)
    return f.select("finding_id", "severity", "status", "approved_by")


# ---------------------------------------------------------------- reports


def q_compliance_score(spark, d):
    return report.compliance_score(enriched_doc_findings(spark, d), scans(spark, d))


def q_residual_score(spark, d):
    return report.residual_score(reviewed_doc_findings(spark, d))


def q_risk_band(spark, d):
    return report.scores_with_bands(reviewed_doc_findings(spark, d))


def q_severity_counts(spark, d):
    return report.severity_counts(enriched_doc_findings(spark, d))


def q_status_summary(spark, d):
    return report.status_summary(reviewed_doc_findings(spark, d))


def q_audit_report(spark, d):
    a = report.audit_report(scans(spark, d), reviewed_doc_findings(spark, d))
    return a.select(
        "scan_id", "policy_id", "total", "critical", "high", "approved", "rejected", "pending",
        _i("compliance_score").alias("compliance_score"), "finding_id", "data_type", "severity", "location",
        "policy_clause_id", "finding_status", "fix_tool", "approved_by",
    )


def q_policy_of(spark, d):
    f = enriched_doc_findings(spark, d)
    return f.select("finding_id", "policy_clause_id", policy_of(F.col("policy_clause_id")).alias("policy"))


def q_available_policies(spark, d):
    return report.available_policies(enriched_doc_findings(spark, d))


def q_filter_findings(spark, d):
    f = report.filter_findings(enriched_doc_findings(spark, d), "HIGH", ["GDPR"])
    return f.select("finding_id", "severity", "policy_clause_id")


def q_files_with_findings(spark, d):
    src = doc_sources(spark, d)
    return report.files_with_findings(src, doc_findings(spark, d)).select("file_name", "scan_id")


def q_annotate_lines(spark, d):
    a = report.annotate_lines(doc_sources(spark, d), enriched_doc_findings(spark, d))
    return a.select("file_name", _i("line_no").alias("line_no"), F.sha2("text", 256).alias("text_sha256"), "finding_id", "data_type", "severity")


def q_annotate_columns(spark, d):
    c = table(spark, d, "customer")
    cols = spark.createDataFrame([("customer", i, n) for i, n in enumerate(c.columns)], "file_name string, col_pos int, column_name string")
    f = column_findings(spark, d, ["customer"])
    return report.annotate_columns(cols, f).select("file_name", _i("col_pos").alias("col_pos"), "column_name", "finding_id", "data_type")


def q_scan_detail(spark, d):
    f = enriched_doc_findings(spark, d)
    return report.scan_detail(scans(spark, d), f, doc_sources(spark, d)).select(
        "scan_id", "policy_id", "status", _i("compliance_score").alias("compliance_score"), "file_name",
        F.sha2("content", 256).alias("content_sha256"), "n_findings",
    )


def q_permanent_fix(spark, d):
    f = enriched_doc_findings(spark, d)
    return f.select("finding_id", permanent_fix_advice(F.col("data_type"), F.col("fix_tool")).alias("advice"))


# ---------------------------------------------------------------- rows-only


def q_normalize_response(spark, d):
    """Offline reasoner answers (JSON text) parsed back through the model
    response normaliser."""
    f = enrich.enrich(doc_findings(spark, d), clause_idx(spark), reasoner=enrich.offline_reasoner)
    return f.select("finding_id", "severity", "policy_clause_id", "fix_tool", fix_args_text(F.col("fix_args")).alias("fix_args"))


def q_stream_scan(spark, d):
    from ..streaming.scan import stream_scan_table

    return stream_scan_table(spark, f"{d.rstrip('/')}/documents.parquet").select(
        "finding_id", "scan_id", "data_type", "location"
    )


def q_running_score(spark, d):
    from ..streaming.scan import running_score_table

    return running_score_table(spark, f"{d.rstrip('/')}/documents.parquet")


QUERIES: dict[str, Query] = {
    name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_") and callable(fn)
}
ROWS_ONLY: set[str] = set()
