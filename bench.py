"""Headline benchmark: prints ONE JSON line.

Queries (whole tables of ``$BENCH_SF_DIR``, default /root/testdata/sf0.1):
text_scan (documents → findings), column_scan (customer), scan_cite_enrich
(documents → findings → clause → reasoning), mask_anonymize (customer) and
report (compliance per scan + audit trail).  Each result is fully computed
through the ``noop`` sink; the time is the median of ``$BENCH_REPEATS``
(default 3) runs after one warm-up run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))

    from pyspark.sql import functions as F

    from redline.operators import detect_columns, detect_text, report
    from redline.functions.remediate import anonymize, mask
    from redline.plans import catalog
    from redline.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2, app="redline-bench")

    def text_scan():
        return detect_text.scan_text(catalog.doc_sources(spark, sf_dir))

    def column_scan():
        c = catalog.table(spark, sf_dir, "customer")
        return detect_columns.scan_table(c, "customer", "c_custkey")

    def scan_cite_enrich():
        return catalog.enriched_doc_findings(spark, sf_dir)

    def mask_anonymize():
        c = catalog.table(spark, sf_dir, "customer")
        return c.select(
            "c_custkey",
            mask(F.col("c_name")).alias("c_name_masked"),
            anonymize(F.col("c_name")).alias("c_name_anon"),
            anonymize(F.col("c_custkey").cast("string"), "s1").alias("c_custkey_anon"),
        )

    def report_q():
        f = catalog.reviewed_doc_findings(spark, sf_dir)
        return report.audit_report(catalog.scans(spark, sf_dir), f)

    qs = {
        "text_scan": text_scan,
        "column_scan": column_scan,
        "scan_cite_enrich": scan_cite_enrich,
        "mask_anonymize": mask_anonymize,
        "report": report_q,
    }
    times: dict[str, float] = {}
    for name, build in qs.items():
        runs = []
        for i in range(repeats + 1):
            t0 = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            if i > 0:
                runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    docs_rows = catalog.table(spark, sf_dir, "documents").count()
    cust_rows = catalog.table(spark, sf_dir, "customer").count()
    input_rows = {
        "text_scan": docs_rows,
        "column_scan": cust_rows,
        "scan_cite_enrich": docs_rows,
        "mask_anonymize": cust_rows,
        "report": docs_rows,
    }
    rows_per_sec = {k: round(input_rows[k] / v, 1) for k, v in times.items() if v}
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_total_wall",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
                "cores": int(cpus),
                "spark": spark.version,
                "input_rows_per_sec": rows_per_sec,
                "repeats": repeats,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
