"""Inputs that caps, stack depth or block sizes could break."""

import pytest
from pyspark.sql import functions as F

from redline.operators import detect_code
from redline.operators.retrieve import clause_index, retrieve_top1
from redline.plans.scan import csv_cells

SOURCES = "source_id string, file_name string, content string, language string, scan_id string"


def test_long_literals_and_arguments(spark):
    big = "x\\\\n" * 250_000
    code = "\n".join([
        f'password = "{big}";',
        f'log.LogInfo("{big}", user.Email);',
        "log.LogInfo(" + "(" * 20 + "user.Email" + ")" * 20 + ");",
        "log.LogInfo(" + "a + " * 200_000 + "user.Email);",
        "log.LogInfo(" + "(" * 50_000,
    ])
    src = spark.createDataFrame([("1", "a.cs", code, "csharp", "s")], SOURCES)
    got = sorted((r.line_no, r.data_type) for r in detect_code.scan_code(src).collect())
    assert [n for n, _ in got] == [1, 2, 3, 4]


def test_comments_and_verbatim_strings_are_no_code(spark):
    code = '/* log.LogInfo(user.Email)\n log.LogInfo(user.Email) */\nvar t = @"\nlog.LogInfo(user.Email)";\nvar u = "/*";\nlog.LogInfo(user.Email);\n// */'
    src = spark.createDataFrame([("1", "a.cs", code, "csharp", "s")], SOURCES)
    assert [r.line_no for r in detect_code.scan_code(src).collect()] == [6]


def test_long_csv_records(spark):
    text = "a,b\n" + '"' + "q,\n" * 300_000 + '",2\n' + "x," * 3
    src = spark.createDataFrame([("1", "a.csv", text, "csv", "s")], SOURCES)
    got = {(r.row_key, r.col_pos): (r.column_name, len(r.value)) for r in csv_cells(src).collect()}
    assert got[1, 0] == ("a", 900_000) and got[1, 1] == ("b", 1) and got[2, 3] == ("", 0)


@pytest.mark.parametrize("missing", [False, True])
def test_retrieval_does_not_depend_on_the_block_size(spark, missing):
    n = 60
    clauses = spark.range(n).select(
        F.when(F.col("id") % 2 == 0, "GDPR").otherwise("HIPAA").alias("policy_name"),
        F.col("id").cast("int").alias("clause_ord"),
        F.format_string("c%02d", "id").alias("clause_id"),
        F.concat(F.lit("word"), F.col("id")).alias("title"),
        F.concat(F.lit("text of word"), (F.col("id") * 7) % n).alias("clause_text"),
        F.array().cast("array<string>").alias("example_violations"),
    )
    vectors = clauses.select("policy_name", "clause_id", F.array((F.col("clause_ord") * 13 % 31).cast("float"), (F.col("clause_ord") % 7 + 1).cast("float")).alias("embedding"))
    if missing:  # one clause of one policy has no vector
        vectors = vectors.where("clause_id <> 'c10'")
    index = clause_index(clauses, vectors).cache()
    found = spark.range(40).select(
        F.col("id").cast("string").alias("finding_id"), F.concat(F.lit("about word"), F.col("id")).alias("query"),
        F.array((F.col("id") % 5).cast("float"), (F.col("id") % 3 + 1).cast("float")).alias("v"),
        F.element_at(F.array(F.lit("gdpr"), F.lit("HIPAA"), F.lit(None).cast("string")), (F.col("id") % 3 + 1).cast("int")).alias("pol"),
    )
    answers = [
        sorted((r.finding_id, r.match.clause_id, round(r.match.score, 6)) for r in retrieve_top1(found, index, query_vec=F.col("v"), policy=F.col("pol"), block_size=b).collect())
        for b in (1, 3, 512)
    ]
    assert answers[0] == answers[1] == answers[2] and len(answers[0]) == 40


def test_remote_value_detector_falls_back_to_the_name(spark):
    from redline.hooks import pandas_entities
    from redline.operators.detect_columns import scan_table

    def detect(text):
        if "boom" in text:
            raise RuntimeError("away")
        return [("x", "Person", 0.9)] * text.count("Ann") + [("y", "Email", 0.1)] * 9

    df = spark.createDataFrame([(1, "Ann", "boom", "q"), (2, "Ann", "z", "r")], "id long, who string, email string, note string")
    got = {r.column_name: (r.data_type, r.detected_by) for r in scan_table(df, "t", "id", entities=pandas_entities(detect)).collect()}
    assert set(got) == {"who", "email"} and got["email"] == ("EMAIL", "KEYWORD") and got["who"][1] == "AZURE"


def test_plugged_detectors_and_embedder_take_part_in_a_scan(spark, mock_sources):
    from redline.hooks import pandas_embedder
    from redline.operators.detect_text import scan_text
    from redline.plans.scan import scan
    from redline.functions.text import TextRule
    from redline.sources.policies import load_policy_clauses

    clauses = load_policy_clauses(spark)
    towns = lambda sources: scan_text(sources, rules=[TextRule(50, "TOWN", r"\bLima\b")])
    src = mock_sources.withColumn("scan_id", F.lit("s"))
    embedder = pandas_embedder(lambda texts: [[1.0, float(len(t) % 7)] for t in texts])
    plain = scan(src, clauses, detectors={"towns": towns}).collect()
    vectors = scan(src, clauses, detectors={"towns": towns}, embedder=embedder).collect()
    assert [r.location for r in plain if r.data_type == "TOWN"] == ["customers.csv:3"]
    assert len(plain) == len(vectors) and {r.finding_id: r.policy_clause_id for r in plain} != {r.finding_id: r.policy_clause_id for r in vectors}
