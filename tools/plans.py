"""Print the physical plan trees of the headline queries (PLANS.md)."""

from __future__ import annotations

import io
import os
import sys
from contextlib import redirect_stdout

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def tree(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    head = text.split("\n\n\n")[0]
    scans = [l for l in text.splitlines() if l.startswith(("PushedFilters", "ReadSchema"))]
    return head.strip() + "\n" + "\n".join(scans)


def main() -> None:
    from pyspark.sql import functions as F

    from redline.functions.remediate import anonymize, mask
    from redline.operators import detect_columns, detect_text, remediate, report
    from redline.plans import catalog
    from redline.session import local_session

    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session()
    c = catalog.table(spark, d, "customer")
    _, plan = catalog._customer_plan(spark, d)
    items = [
        ("text scan (documents → findings)", detect_text.scan_text(catalog.doc_sources(spark, d))),
        ("column scan (customer)", detect_columns.scan_table(c, "customer", "c_custkey")),
        ("scan → cite → enrich", catalog.enriched_doc_findings(spark, d)),
        ("mask + anonymize (customer)", c.select("c_custkey", mask(F.col("c_name")), anonymize(F.col("c_name")))),
        ("cleaned copy of customer (approved fixes)", remediate.apply_column_fixes(c, "customer", plan)),
        ("audit trail (scans ⋈ findings)", report.audit_report(catalog.scans(spark, d), catalog.enriched_doc_findings(spark, d))),
        ("scan detail (files, counts, content)", report.scan_detail(catalog.scans(spark, d), catalog.enriched_doc_findings(spark, d), catalog.doc_sources(spark, d))),
        ("report (compliance per scan)", report.compliance_score(catalog.enriched_doc_findings(spark, d), catalog.scans(spark, d))),
    ]
    print("# Physical plans of the headline queries\n")
    print(f"`python tools/plans.py {d}` (Spark {spark.version}, AQE on; final plans may change at run time).\n")
    for title, df in items:
        print(f"## {title}\n\n```\n{tree(df)}\n```\n")


if __name__ == "__main__":
    main()
