import json

import pytest
from pyspark.sql import functions as F

from redline.functions.policy import content_hash, cosine_similarity, decode_embedding, encode_embedding, tokenize
from redline.functions.reason import (
    default_fix_args,
    default_fix_tool,
    deterministic_reasoning,
    location_column,
    location_line,
    normalize_model_response,
)
from redline.operators import retrieve
from redline.sources.policies import load_policy_clauses


@pytest.fixture(scope="module")
def clauses(spark):
    return load_policy_clauses(spark).cache()


def test_policy_corpus(spark, clauses):
    counts = {r.policy_name: r["count"] for r in clauses.groupBy("policy_name").count().collect()}
    assert counts == {"GDPR": 7, "HIPAA": 7}


def test_content_hashes(spark, clauses):
    idx = retrieve.clause_index(clauses)
    got = {r.clause_id: r.content_hash for r in idx.collect()}
    assert got["GDPR-Art5-1a"] == "57617A52"
    assert got["GDPR-Art5-1c"] == "9EF72AC1"
    assert got["GDPR-Art9-1"] == "F53EED5B"
    assert got["HIPAA-164.514-b2"] == "B9BA3C81"


CASES = [
    ("EMAIL", "customers.csv:column=email", "AZURE", "jane.doe@example.com", "GDPR-Art5-1c", "HIPAA-164.514-b2-i-A"),
    ("SSN", "customers.csv:column=ssn", "AZURE", "123-45-6789", "GDPR-Art5-1a", "HIPAA-164.514-b2-i-A"),
    ("NAME", "customers.csv:column=name", "KEYWORD", "John Smith", "GDPR-Art5-1a", "HIPAA-164.514-b2-i-A"),
    ("DIAGNOSIS", "patients.csv:column=diagnosis", "KEYWORD", "Diabetes Type 2", "GDPR-Art9-1", "HIPAA-164.514-b2-i-A"),
    ("MEDICAL_RECORD", "patients.csv:column=patient_id", "KEYWORD", "P001", "HIPAA-164.514-b2-i-A", "HIPAA-164.514-b2-i-A"),
    ("CREDIT_CARD", "pay.csv:column=cardnumber", "AZURE", "4111111111111111", "GDPR-Art5-1f", "HIPAA-164.514-b2-i-A"),
]


@pytest.mark.parametrize("block_size", [512, 3])
def test_keyword_top1_golden(spark, clauses, block_size):
    from redline.operators.enrich import cite

    rows = [(str(i), t, loc, det, snip) for i, (t, loc, det, snip, _a, _h) in enumerate(CASES)]
    f = spark.createDataFrame(rows, "finding_id string, data_type string, location string, detected_by string, snippet string")
    idx = retrieve.clause_index(clauses)
    from redline.functions.policy import build_query

    q = build_query(F.col("data_type"), F.col("location"), F.col("detected_by"), F.col("snippet"))
    all_ = retrieve.retrieve_top1(f.withColumn("query", q), idx, block_size=block_size)
    hip = retrieve.retrieve_top1(f.withColumn("query", q), idx, policy=F.lit("hipaa"), block_size=block_size)
    got_all = {r.finding_id: r.match.clause_id for r in all_.collect()}
    got_hip = {r.finding_id: r.match.clause_id for r in hip.collect()}
    for i, (*_x, exp_all, exp_hip) in enumerate(CASES):
        assert got_all[str(i)] == exp_all
        assert got_hip[str(i)] == exp_hip
    none = retrieve.retrieve_top1(f.withColumn("query", q), idx, policy=F.lit("SECRETS")).collect()
    assert all(r.match is None for r in none)


def test_tokenize_and_cosine(spark):
    df = spark.createDataFrame([("The EMAIL, e-mail; the (PII) data/x_y ab",)], "t string")
    toks = sorted(df.select(tokenize(F.col("t"))).first()[0])
    assert toks == ["data", "email", "mail", "pii", "the"]
    v = spark.createDataFrame([([1.0, 0.0, 2.0], [2.0, 0.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    r = v.select(cosine_similarity(F.col("a"), F.col("b")), cosine_similarity(F.col("a"), F.col("z"))).first()
    assert r[0] == pytest.approx(1.0) and r[1] == 0.0


def test_embedding_codec(spark):
    df = spark.createDataFrame([("H1", [0.5, -1.25])], "h string, v array<float>")
    enc = df.select(encode_embedding(F.col("h"), F.col("v")).alias("s")).first().s
    assert enc == "H1|0.5,-1.25"
    chk = spark.createDataFrame([(enc, "H1"), (enc, "H2"), ("H1|x,1", "H1"), ("", "H1"), ("H1|", "H1")], "s string, h string")
    got = [r[0] for r in chk.select(decode_embedding(F.col("s"), F.col("h"))).collect()]
    assert got == [[0.5, -1.25], None, None, None, None]


def test_clause_refresh(spark, clauses):
    idx0, c0 = retrieve.refresh_clause_index(None, clauses, embedder=_fake_embedder)
    assert c0.first().asDict() == {"reused": 0, "embedded": 14}
    old = idx0.select("policy_name", "clause_id", "title", "clause_text", "stored_embedding")
    changed = clauses.withColumn("clause_text", F.when(F.col("clause_id") == "GDPR-Art9-1", F.lit("changed")).otherwise(F.col("clause_text")))
    idx1, c1 = retrieve.refresh_clause_index(old, changed, embedder=_fake_embedder)
    assert c1.first().asDict() == {"reused": 13, "embedded": 1}
    assert idx1.count() == 14


def _fake_embedder(df):
    return df.withColumn("embedding", F.array(F.length("text").cast("float"), F.lit(1.0).cast("float")))


def _norm(spark, raw, dtype="EMAIL", loc="customers.csv:column=email", det="AZURE"):
    df = spark.createDataFrame([(raw, dtype, loc, det)], "raw string, t string, l string, d string")
    r = df.select(normalize_model_response(F.col("raw"), F.col("t"), F.col("l"), F.col("d"), F.lit("GDPR-Art5-1c")).alias("r")).first().r
    return None if r is None else r.asDict()


def test_model_response_cases(spark):
    clean = json.dumps({"is_violation": True, "severity": "low", "fix_tool": "drop_column",
                        "fix_args": {"column": "email", "n": 5}, "policy_clause_id": "X-1", "explanation": "why"})
    r = _norm(spark, clean)
    assert r["severity"] == "LOW" and r["fix_tool"] == "DROP_COLUMN" and r["policy_clause_id"] == "X-1"
    assert r["fix_args"] == {"column": "email", "n": "5"}
    assert _norm(spark, "```json\n" + clean + "\n```")["explanation"] == "why"
    assert _norm(spark, "Sure! " + clean + " Hope this helps.")["fix_tool"] == "DROP_COLUMN"
    bad = _norm(spark, '{"severity": "SEVERE", "fix_tool": "BURN"}')
    assert bad["severity"] == "HIGH" and bad["fix_tool"] == "MASK_COLUMN" and bad["is_violation"] is True
    assert bad["policy_clause_id"] == "GDPR-Art5-1c" and bad["explanation"] == "EMAIL detected; review against GDPR-Art5-1c."
    assert bad["fix_args"] == {"column": "email", "style": "partial"}
    assert _norm(spark, '{"is_violation": "true"}')["is_violation"] is True
    assert _norm(spark, '{"is_violation": "no"}')["is_violation"] is False
    assert _norm(spark, '{"severity": 5}')["severity"] == "HIGH"
    assert _norm(spark, '{"is_violation": tru') is None
    assert _norm(spark, "") is None
    assert _norm(spark, "no json here") is None


def test_defaults_and_locations(spark):
    rows = [
        ("SSN", "customers.csv:column=ssn", "AZURE"),
        ("EMAIL", "src/auth.cs:16", "ROSLYN"),
        ("EMAIL", "notes.txt:3", "REGEX"),
        ("DIAGNOSIS", "p.csv:column=first name", "KEYWORD"),
        (None, "x", "REGEX"),
    ]
    df = spark.createDataFrame(rows, "t string, l string, d string")
    tool = default_fix_tool(F.col("t"), F.col("d"), F.col("l"))
    out = df.select(
        tool.alias("tool"), default_fix_args(F.col("t"), F.col("l"), tool).alias("args"),
        location_line(F.col("l")).alias("line"), location_column(F.col("l"), "reasoner").alias("cr"),
        location_column(F.col("l"), "applier").alias("ca"),
    ).collect()
    assert [(r.tool, r.args, r.line) for r in out] == [
        ("DROP_COLUMN", {"column": "ssn"}, None),
        ("REDACT_CODE_LINE", {"reason": "Contains EMAIL", "line": "16"}, 16),
        ("MASK_COLUMN", {"column": "email", "style": "partial"}, 3),
        ("ANONYMIZE_COLUMN", {"column": "first"}, None),
        ("ANONYMIZE_COLUMN", {"column": "value"}, None),
    ]
    assert (out[3].cr, out[3].ca) == ("first", "first name")
    r = df.limit(1).select(deterministic_reasoning(F.col("t"), F.col("l"), F.col("d"), F.lit("GDPR-Art5-1c"), F.lit("Data minimisation")).alias("r")).first().r
    assert r.explanation == "SSN detected at customers.csv:column=ssn; this implicates GDPR-Art5-1c (Data minimisation)."
    assert r.severity == "CRITICAL" and r.is_violation is True
