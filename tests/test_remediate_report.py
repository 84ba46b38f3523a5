import datetime as dt

from pyspark.sql import functions as F

from redline.functions.remediate import anonymize, line_count, mask, redact_lines
from redline.operators import remediate, report


def test_mask_vectors(spark):
    vals = ["john@gmail.com", "John", "@x", "", None]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(mask(F.col("v"))).collect()]
    assert got == ["j***@gmail.com", "J***", "@***", "", None]
    full = [r[0] for r in df.select(mask(F.col("v"), "FULL")).collect()]
    assert full == ["***", "***", "***", "", None]
    again = [r[0] for r in df.select(mask(mask(F.col("v")))).collect()]
    assert again == got  # partial mask is idempotent


def test_anonymize_vectors(spark):
    df = spark.createDataFrame([("john@gmail.com",), ("John",), ("",)], "v string")
    got = [tuple(r) for r in df.select(anonymize(F.col("v")), anonymize(F.col("v"), "s1")).collect()]
    assert got == [
        ("anon_142d78e466ca", "anon_8f6a884cc90e"),
        ("anon_a8cfcd748320", "anon_d87b23e884d3"),
        ("", ""),
    ]


def test_anonymize_keeps_join_cardinality(spark):
    a = spark.range(50).select((F.col("id") % 7).cast("string").alias("k"))
    b = spark.range(7).select(F.col("id").cast("string").alias("k"))
    raw = a.join(b, "k").count()
    anon = a.select(anonymize(F.col("k")).alias("k")).join(b.select(anonymize(F.col("k")).alias("k")), "k").count()
    assert raw == anon == 50


def test_redact_lines_keeps_lines_and_crlf(spark):
    text = "a\r\n    secret = 1\r\nb\n\tlog(x)"
    df = spark.createDataFrame([(text,)], "c string")
    notes = F.create_map(F.lit(2), F.lit("// [REDACTED by t: Contains SECRET]"), F.lit(4), F.lit("// [REDACTED by t]"))
    out = df.select(redact_lines(F.col("c"), notes).alias("o"), line_count(F.col("c")).alias("n")).first()
    assert out.o == "a\r\n    // [REDACTED by t: Contains SECRET]\r\nb\n\t// [REDACTED by t]"
    assert out.o.count("\n") + 1 == out.n


def _findings(spark, rows):
    schema = (
        "finding_id string, scan_id string, data_type string, severity string, location string, fix_tool string, "
        "fix_args map<string,string>, status string, approved_by string, approved_at timestamp, line_no int, rule_ord int"
    )
    return spark.createDataFrame(rows, schema)


def test_fix_plan_fold_and_outcomes(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [
        ("f1", "s", "NAME", "MEDIUM", "c.csv:column=name", "ANONYMIZE_COLUMN", {"column": "name"}, "APPROVED", "u", t(1), None, None),
        ("f2", "s", "NAME", "MEDIUM", "c.csv:column=name", "MASK_COLUMN", {"column": "NAME"}, "APPROVED", "u", t(2), None, None),
        ("f3", "s", "SSN", "CRITICAL", "c.csv:column=ssn", "DROP_COLUMN", {}, "APPROVED", "u", t(3), None, None),
        ("f4", "s", "SSN", "CRITICAL", "c.csv:column=ssn", "MASK_COLUMN", {}, "APPROVED", "u", t(4), None, None),
        ("f5", "s", "EMAIL", "HIGH", "c.csv:column=missing", "MASK_COLUMN", {}, "APPROVED", "u", t(5), None, None),
        ("f6", "s", "EMAIL", "HIGH", "other.csv:column=email", "MASK_COLUMN", {}, "APPROVED", "u", t(6), None, None),
        ("f7", "s", "EMAIL", "HIGH", "c.csv:column=email", "BURN", {}, "APPROVED", "u", t(7), None, None),
        ("f8", "s", "EMAIL", "HIGH", "c.csv:column=email", None, {}, "APPROVED", "u", t(8), None, None),
        ("f9", "s", "EMAIL", "HIGH", "c.csv:column=email", "MASK_COLUMN", {"style": "full"}, "APPROVED", "u", t(9), None, None),
    ]
    data = spark.createDataFrame([("John", "123", "a@b.io"), ("", "456", None)], "name string, ssn string, email string")
    files = spark.createDataFrame([("c.csv", data.columns)], "file_name string, columns array<string>")
    plan = remediate.fix_plan(_findings(spark, rows), files)
    det = {r.finding_id: (r.applied, r.detail) for r in plan.collect()}
    assert det["f1"] == (True, "Applied ANONYMIZE_COLUMN to column 'name' in c.csv.")
    assert det["f3"][0] is True
    assert det["f4"] == (False, "Column 'ssn' was not found in c.csv.")  # dropped before
    assert det["f5"] == (False, "Column 'missing' was not found in c.csv.")
    assert det["f6"] == (False, "File 'other.csv' was not found for this scan.")
    assert det["f7"] == (False, "Unknown fix tool 'BURN'.")
    assert det["f8"] == (False, "No fix tool was proposed for this finding.")
    out = remediate.apply_column_fixes(data, "c.csv", plan)
    assert out.columns == ["name", "email"]
    got = [tuple(r) for r in out.collect()]
    # anonymize then mask -> 'a***'; blanks and NULL kept; full mask on email
    assert got == [("a***", "***"), ("", None)]


def test_approve_reject(spark):
    rows = [
        ("f1", "s", "EMAIL", "HIGH", "x:1", "MASK_COLUMN", {}, "PENDING_REVIEW", None, None, 1, 1),
        ("f2", "s", "SSN", "CRITICAL", "x:2", "DROP_COLUMN", {}, "APPROVED", "first", dt.datetime(2024, 1, 1), 2, 3),
        ("f3", "s", "IP", "MEDIUM", "x:3", "ANONYMIZE_COLUMN", {}, "APPROVED", "first", None, 3, 5),
        ("f4", "s", "IP", "MEDIUM", "x:4", "ANONYMIZE_COLUMN", {}, "PENDING_REVIEW", None, None, 4, 5),
    ]
    f = _findings(spark, rows)
    d = spark.createDataFrame(
        [("f1", "APPROVE", None, None), ("f2", "APPROVE", "second", None), ("f3", "REJECT", None, None)],
        "finding_id string, action string, approved_by string, decided_at timestamp",
    )
    got = {r.finding_id: (r.status, r.approved_by) for r in remediate.approve(f, d).collect()}
    assert got == {
        "f1": ("APPROVED", "system"),
        "f2": ("APPROVED", "first"),
        "f3": ("REJECTED", "first"),
        "f4": ("PENDING_REVIEW", None),
    }
    high = {r.finding_id: r.status for r in remediate.approve_all_high(f, "bulk").collect()}
    assert high == {"f1": "APPROVED", "f2": "APPROVED", "f3": "APPROVED", "f4": "PENDING_REVIEW"}


def test_fixes_apply_in_approval_order(spark):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    kinds = {"m": ("MASK_COLUMN", {}), "f": ("MASK_COLUMN", {"style": "full"}), "a": ("ANONYMIZE_COLUMN", {}), "s": ("ANONYMIZE_COLUMN", {"salt": "z"})}

    def cleaned(ops, value="John"):
        rows = [(f"f{i:04d}", "s", "NAME", "MEDIUM", "c.csv:column=name", kinds[k][0], kinds[k][1], "APPROVED", "u", t(i), None, None) for i, k in enumerate(ops)]
        other = [("g", "other", "NAME", "MEDIUM", "c.csv:column=name", "DROP_COLUMN", {}, "APPROVED", "u", t(0), None, None)]
        files = spark.createDataFrame([("s", "c.csv", ["name"]), ("other", "c.csv", ["name"])], "scan_id string, file_name string, columns array<string>")
        plan = remediate.fix_plan(_findings(spark, rows + other), files)
        return remediate.apply_column_fixes(spark.createDataFrame([(value,)], "name string"), "c.csv", plan, scan_id="s").first()[0]

    import hashlib

    def expect(ops, v="John"):
        for k in ops:
            if k == "f":
                v = "***"
            elif k == "m":
                v = v[0] + "***" + (v[v.index("@") :] if "@" in v[1:] else "")
            else:
                v = "anon_" + hashlib.sha256((("z" if k == "s" else "") + v).encode()).hexdigest()[:12]
        return v

    for ops in ("mam", "amas", "fma", "a" * 10, "saas", "a" * 1000):
        assert cleaned(ops) == expect(ops), ops


def test_first_approval_is_kept(spark):
    rows = [(f"f{i}", "s", "EMAIL", "HIGH", "x:1", "MASK_COLUMN", {}, "PENDING_REVIEW", None, None, 1, 1) for i in range(3)]
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    decisions = [
        ("f0", "APPROVE", "alice", t(1)), ("f0", "APPROVE", "bob", t(2)),
        ("f1", "APPROVE", "alice", t(1)), ("f1", "REJECT", "eve", t(2)), ("f1", "approve", "bob", t(3)), ("f1", "APPROVE", "carl", t(4)),
        ("f2", "APPROVE", "alice", t(1)), ("f2", "REJECT", "eve", t(2)),
    ]
    d = spark.createDataFrame(decisions, "finding_id string, action string, approved_by string, decided_at timestamp")
    got = {r.finding_id: (r.status, r.approved_by, r.approved_at) for r in remediate.approve(_findings(spark, rows), d).collect()}
    assert got == {"f0": ("APPROVED", "alice", t(1)), "f1": ("APPROVED", "bob", t(3)), "f2": ("REJECTED", "alice", t(1))}


def test_scores_and_summary(spark):
    # the mock dashboard's findings: residual score 12 = 100 - (14 + 26 + 14 + 8 + 26)
    sev = ["HIGH", "CRITICAL", "HIGH", "MEDIUM", "CRITICAL"]
    rows = [(f"f{i}", "s", "X", s, "x:1", None, {}, "PENDING_REVIEW", None, None, 1, 1) for i, s in enumerate(sev)]
    f = _findings(spark, rows)
    assert report.residual_score(f).first().residual_score == 12
    c = report.compliance_score(f).first()
    assert (c.critical, c.high, c.compliance_score) == (2, 2, 40)
    scans = spark.createDataFrame([("s",), ("empty",)], "scan_id string")
    got = {r.scan_id: r.compliance_score for r in report.compliance_score(f, scans).collect()}
    assert got == {"s": 40, "empty": 100}
    b = {r.scan_id: (r.compliance_band, r.residual_band) for r in report.scores_with_bands(f).collect()}
    assert b == {"s": ("High risk", "High risk")}
    sc = report.severity_counts(f).first()
    assert (sc.critical, sc.high, sc.medium, sc.low, sc.total) == (2, 2, 1, 0, 5)


def test_parse_fix_args(spark):
    from redline.functions.remediate import parse_fix_args

    vals = ['{"Column": "Email", "style": "full", "n": 5, "column": "ssn"}', "[1, 2]", "not json", None, '{"a": {"b": 1}}']
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(parse_fix_args(F.col("v"))).collect()]
    assert got[0] == {"style": "full", "n": "5", "column": "ssn"}
    assert got[1] == {} and got[2] == {} and got[3] == {}
    assert got[4] == {"a": '{"b":1}'}


def test_status_views_and_policy_summary(spark):
    from redline.functions.report import finding_status_view, scan_status_view, source_type
    from redline.sources.policies import load_policy_clauses

    df = spark.createDataFrame([("DONE", "APPROVED", "a.CSV:column=x"), ("ERROR", "rejected", "b.cs:3"), ("SCANNING", "PENDING_REVIEW", "c.json"), (None, None, None)], "s string, f string, l string")
    got = [tuple(r) for r in df.select(scan_status_view(F.col("s")), finding_status_view(F.col("f")), source_type(F.col("l"))).collect()]
    assert got == [("done", "approved", "dataset"), ("done", "rejected", "code"), ("running", "pending", "dataset"), ("pending", "pending", "code")]
    ps = [tuple(r) for r in report.policy_summary(load_policy_clauses(spark)).collect()]
    assert ps == [("GDPR", "EU General Data Protection Regulation", 7), ("HIPAA", "US Health Insurance Portability and Accountability Act", 7)]


def test_persist_and_export(spark, scratch):
    import json
    import os

    from redline.operators.detect_text import scan_text
    from redline.sources.tables import export_report, persist_findings, read_findings

    src = spark.createDataFrame([("1", "a.txt", "mail a@b.io", None, "s1"), ("2", "b.txt", "ip 10.0.0.1", None, "s2")], "source_id string, file_name string, content string, language string, scan_id string")
    f = scan_text(src)
    path = os.path.join(scratch, "findings")
    persist_findings(f, path)
    assert sorted(os.listdir(path))[:2] == ["_SUCCESS", "scan_id=s1"] or "scan_id=s1" in os.listdir(path)
    assert read_findings(spark, path, "s2").count() == 1
    persist_findings(f.where("scan_id = 's1'"), path)  # replaces only scan s1
    assert read_findings(spark, path).count() == 2
    out = os.path.join(scratch, "report")
    export_report(report.audit_report(spark.createDataFrame([("s1", "ALL")], "scan_id string, policy_id string"), f), out)
    lines = [l for p in os.listdir(out) if p.startswith("part-") for l in open(os.path.join(out, p))]
    assert len(lines) == 1 and json.loads(lines[0])["scan_id"] == "s1"
