import importlib.util
import os

from pyspark.sql import functions as F

from samples import CONFIG_CS, CUSTOMERS_CSV, ROOT, SF_CHECK, SF_SMALL
from redline.operators.detect_text import scan_text
from redline.plans import catalog
from redline.sources.files import read_sources
from redline.sources.tables import read_csv_table, read_json_table, write_csv_table, write_json_table
from redline.streaming.scan import running_score_table, stream_scan_table


def test_read_sources_folder(spark, scratch):
    os.makedirs(os.path.join(scratch, "sub"))
    open(os.path.join(scratch, "customers.csv"), "w").write(CUSTOMERS_CSV)
    open(os.path.join(scratch, "sub", "config.CS"), "w").write(CONFIG_CS)
    src = {r.file_name: r for r in read_sources(spark, scratch).collect()}
    assert set(src) == {"customers.csv", "sub/config.CS"}
    assert src["customers.csv"].language == "csv" and src["sub/config.CS"].language == "csharp"
    assert src["customers.csv"].content == CUSTOMERS_CSV
    assert read_sources(spark, os.path.join(scratch, "missing")).count() == 0


def test_csv_json_tables_round_trip(spark, scratch):
    p = os.path.join(scratch, "t.csv")
    open(p, "w").write('name,Name,note\n"Doe, J","x","say ""hi""\nthere"\nshort\n')
    t = read_csv_table(spark, p)
    assert t.columns == ["name", "Name_1", "note"]
    rows = [tuple(r) for r in t.collect()]
    assert rows == [("Doe, J", "x", 'say "hi"\nthere'), ("short", None, None)]
    out = os.path.join(scratch, "out_csv")
    write_csv_table(t, out)
    back = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(out)
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)
    j = os.path.join(scratch, "t.json")
    open(j, "w").write('[{"a": "x", "b": 1.50, "c": {"d": [1]}}, {"a": null, "e": true}]')
    jt = read_json_table(spark, j)
    got = {c: [r[c] for r in jt.collect()] for c in jt.columns}
    assert got["a"] == ["x", ""] and got["e"] == ["", "true"]
    write_json_table(jt, os.path.join(scratch, "out_json"))
    assert spark.read.json(os.path.join(scratch, "out_json")).count() == 2


def test_stream_equals_batch(spark):
    path = f"{SF_SMALL}/documents.parquet"
    streamed = stream_scan_table(spark, path).select("finding_id").collect()
    batch = catalog.doc_findings(spark, SF_SMALL).select("finding_id").collect()
    assert sorted(r[0] for r in streamed) == sorted(r[0] for r in batch)
    scores = {r.scan_id: (r.critical, r.high, r.total) for r in running_score_table(spark, path).collect()}
    from redline.functions.reason import default_severity

    f = catalog.doc_findings(spark, SF_SMALL).withColumn("sev", default_severity(F.col("data_type")))
    exp = {
        r.scan_id: (r.c, r.h, r.t)
        for r in f.groupBy("scan_id").agg(
            F.count(F.when(F.col("sev") == "CRITICAL", 1)).alias("c"),
            F.count(F.when(F.col("sev") == "HIGH", 1)).alias("h"),
            F.count(F.lit(1)).alias("t"),
        ).collect()
    }
    assert scores == exp


def _entry():
    spec = importlib.util.spec_from_file_location("entry", os.path.join(ROOT, "__spark_entry__.py"))
    e = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(e)
    return e


def test_entry_contract(spark):
    e = _entry()
    df = e.entry(spark)
    assert df.columns == ["scan_id", "total", "critical", "high", "medium", "compliance_score"]
    assert df.count() >= 0
    qs, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(qs)
    assert set(catalog.QUERIES) - set(sql) == catalog.ROWS_ONLY


def test_oracle_matches_on_small_sample(spark):
    """A handful of queries against DuckDB on the smallest tables."""
    import duckdb

    e = _entry()
    con = duckdb.connect()
    for t in ["documents", "customer", "pages"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_CHECK}/{t}.parquet')")
    for k in ["scan_text_findings", "scan_pages", "mask_partial", "anonymize"]:
        sp = sorted(tuple(str(x) for x in r) for r in e.queries()[k](spark, SF_CHECK).select(*sorted(e.queries()[k](spark, SF_CHECK).columns)).collect())
        dk = con.execute(e.oracle_sql()[k]).fetchdf()
        dk = dk[sorted(dk.columns)]
        dd = sorted(tuple(str(x) for x in r) for r in dk.itertuples(index=False))
        assert sp == dd, k


def test_read_sources_names_and_unreadable(spark, scratch):
    from redline.sources.files import unreadable_sources

    for folder in ("a", "b"):
        os.makedirs(os.path.join(scratch, folder))
        open(os.path.join(scratch, folder, "x.txt"), "w").write("mail a@b.io")
    open(os.path.join(scratch, "big.txt"), "w").write("x" * 50_000 + "\n5 z@y.io")
    for path in (scratch, f"file://{scratch}/"):
        src = read_sources(spark, path).withColumn("scan_id", F.lit("s"))
        found = scan_text(src).collect()
        assert sorted(r.location for r in found) == ["a/x.txt:1", "b/x.txt:1", "big.txt:2"]
        assert len({r.finding_id for r in found}) == 3
        assert unreadable_sources(spark, path).count() == 0
    one = read_sources(spark, os.path.join(scratch, "a", "x.txt")).first()
    assert one.file_name == "x.txt"


def test_json_table_roots_and_mixed_elements(spark, scratch):
    def table(text, **kw):
        p = os.path.join(scratch, f"t{abs(hash(text))}.json")
        open(p, "w").write(text)
        return read_json_table(spark, p, **kw)

    t = table('[{"z":1,"a":"x"},5,{"b":null}]')
    assert t.columns == ["z", "a", "b"]
    assert sorted(tuple(r) for r in t.collect()) == [("", "", ""), ("1", "x", "")]
    for bad in ('{"z":1}', "not json", "", "7"):
        assert table(bad).columns == []
    lines = table('{"k":1}\n{"m":"x","k":{"q":[1]}}\n', lines=True)
    assert lines.columns == ["k", "m"] and sorted(tuple(r) for r in lines.collect()) == [("1", ""), ('{"q":[1]}', "x")]


def test_csv_cells_beyond_the_header_are_kept(spark, scratch):
    p = os.path.join(scratch, "wide.csv")
    open(p, "w").write('a,b\n1,2,3\n4\n"x, y","li\nne",5,6\n')
    t = read_csv_table(spark, p)
    assert t.columns == ["a", "b", "column_3", "column_4"]
    assert [tuple(r) for r in t.collect()] == [("1", "2", "3", None), ("4", None, None, None), ("x, y", "li\nne", "5", "6")]


def test_scans_with_equal_file_names_stay_apart(spark):
    from redline.operators import remediate, report
    from redline.plans.scan import csv_cells, route_detectors

    rows = [
        ("1", "c.csv", 'k,email\r\n"1\n0",a@b.io\r\n', "csv", "A"),
        ("2", "c.csv", "town,k\nRome,2", "csv", "B"),
        ("3", "c.json", '[{"k":"1"},3,{"email":"q@r.io"}]', "json", "A"),
        ("4", "c.json", '{"email":"s@t.io"}', "json", "B"),
        ("5", "n.py", "call 10.1.2.3 now", "python", "A"),
        ("6", "n.py", "nothing here", "python", "B"),
    ]
    src = spark.createDataFrame(rows, "source_id string, file_name string, content string, language string, scan_id string")
    cells = {(r.scan_id, r.column_name, r.value) for r in csv_cells(src.where("file_name = 'c.csv'")).collect()}
    assert cells == {("A", "k", "1\n0"), ("A", "email", "a@b.io"), ("B", "town", "Rome"), ("B", "k", "2")}
    both = route_detectors(src)
    apart = [route_detectors(src.where(F.col("scan_id") == s)) for s in "AB"]
    key = lambda df: sorted((r.finding_id, r.scan_id, r.data_type, r.snippet) for r in df.collect())
    assert key(both) == sorted(key(apart[0]) + key(apart[1]))
    assert {(r.scan_id, r.location) for r in both.where("column_name is not null").collect()} == {("A", "c.csv:column=email"), ("A", "c.json:column=email")}
    assert {(r.scan_id, r.file_name) for r in report.files_with_findings(src, both).collect()} == {("A", "c.csv"), ("A", "c.json"), ("A", "n.py"), ("B", "c.json")}
    found = both.where("file_name = 'n.py'").withColumn("fix_tool", F.lit("REDACT_CODE_LINE")).withColumn("approved_at", F.lit(None).cast("timestamp"))
    plan = remediate.fix_plan(found, src.select("scan_id", "file_name", F.lit(None).cast("array<string>").alias("columns")))
    fixed = {(r.scan_id, r.file_name): r.content for r in remediate.apply_line_redactions(src, plan).collect()}
    assert fixed["B", "n.py"] == "nothing here" and "REDACTED" in fixed["A", "n.py"]


def test_scan_stream_equals_batch(spark, mock_sources, scratch):
    from redline.plans.scan import scan
    from redline.sources.policies import load_policy_clauses
    from redline.streaming.scan import scan_states, start_scan_stream

    landing = f"{scratch}/landing"
    src = mock_sources.withColumn("scan_id", F.lit("s1"))
    src.coalesce(1).write.parquet(landing)
    clauses = load_policy_clauses(spark)
    stream = spark.readStream.schema(src.schema).parquet(f"file://{landing}")
    start_scan_stream(stream, clauses, f"{scratch}/run").awaitTermination()
    want = sorted((r.finding_id, r.policy_clause_id, r.severity) for r in scan(src, clauses).collect())
    got = sorted((r.finding_id, r.policy_clause_id, r.severity) for r in spark.read.parquet(f"{scratch}/run/findings").collect())
    assert got == want
    assert [tuple(r) for r in scan_states(spark, f"{scratch}/run").collect()] == [("s1", "DONE", None)]
    states = spark.read.parquet(f"{scratch}/run/lifecycle").orderBy("step").collect()
    assert [r.status for r in states] == ["PENDING", "SCANNING", "DONE"]

    def broken(df):
        raise RuntimeError("the model is away")

    q = start_scan_stream(stream, clauses, f"{scratch}/bad", reasoner=broken)
    try:
        q.awaitTermination()
        raise AssertionError("the failure was swallowed")
    except Exception as exc:
        assert "the model is away" in str(exc)
    assert scan_states(spark, f"{scratch}/bad").first().status == "ERROR"


def test_whole_scan_on_mock_files(spark, mock_sources):
    from redline.plans.scan import scan
    from redline.sources.policies import load_policy_clauses

    scans = spark.createDataFrame([("s1", "gdpr")], "scan_id string, policy_id string")
    f = scan(mock_sources.withColumn("scan_id", F.lit("s1")), load_policy_clauses(spark), scans=scans)
    rows = f.collect()
    assert all(r.status == "PENDING_REVIEW" and r.policy_clause_id.startswith("GDPR") for r in rows)
    by_loc = {(r.location, r.detected_by): (r.data_type, r.severity, r.fix_tool) for r in rows}
    assert by_loc[("customers.csv:column=ssn", "AZURE")] == ("SSN", "CRITICAL", "DROP_COLUMN")
    assert by_loc[("customers.csv:column=email", "AZURE")] == ("EMAIL", "HIGH", "MASK_COLUMN")
    assert by_loc[("patients.csv:column=diagnosis", "KEYWORD")] == ("DIAGNOSIS", "MEDIUM", "ANONYMIZE_COLUMN")
    assert by_loc[("auth.cs:8", "ROSLYN")] == ("EMAIL", "HIGH", "REDACT_CODE_LINE")
    assert by_loc[("config.cs:5", "ROSLYN")] == ("API_KEY", "CRITICAL", "REDACT_CODE_LINE")


def test_file_landing_stream_equals_batch(spark, scratch):
    from redline.streaming.scan import start_file_stream_scan

    landing = os.path.join(scratch, "landing")
    os.makedirs(landing)
    open(os.path.join(landing, "customers.csv"), "w").write(CUSTOMERS_CSV)
    open(os.path.join(landing, "config.cs"), "w").write(CONFIG_CS + "\\nkey = 192.168.1.254\\n")
    out, ck = os.path.join(scratch, "out"), os.path.join(scratch, "ck")
    start_file_stream_scan(spark, landing, out, ck, scan_id="s").awaitTermination()
    streamed = sorted(r.finding_id for r in spark.read.parquet(out).collect())
    batch_src = read_sources(spark, landing).withColumn("scan_id", F.lit("s"))
    batch = sorted(r.finding_id for r in scan_text(batch_src).collect())
    assert streamed == batch and len(batch) == 7


def test_read_sources_binary_file(spark, scratch):
    open(os.path.join(scratch, "a.txt"), "w").write("mail a@b.io")
    open(os.path.join(scratch, "b.xlsx"), "wb").write(b"PK\x03\x04\xff\xfe\x80 x@y.io \xc3\x28")
    src = read_sources(spark, scratch)
    got = {r.file_name: r.content for r in src.collect()}
    assert got["a.txt"] == "mail a@b.io" and "�" in got["b.xlsx"]
    assert sorted(r.file_name for r in scan_text(src.withColumn("scan_id", F.lit("s"))).collect()) == ["a.txt", "b.xlsx"]
