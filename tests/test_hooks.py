import json

import pandas as pd
from pyspark.sql import functions as F

from redline.hooks import pandas_embedder, pandas_reasoner, register_detector, run_detectors
from redline.operators import enrich, retrieve
from redline.operators.detect_text import scan_text
from redline.sources.policies import load_policy_clauses

VOCAB = ["email", "name", "health", "record", "secure", "breach", "minim", "consent"]


def _embed(texts):
    # toy embedder: counts of a few stems (stands in for a remote model)
    return [[float(t.lower().count(v)) for v in VOCAB] for t in texts]


def test_embedder_drives_cosine_retrieval(spark):
    clauses = load_policy_clauses(spark)
    embed = pandas_embedder(_embed, text_col="text")
    idx0 = retrieve.clause_index(clauses)
    vecs = embed(idx0.select("policy_name", "clause_id", F.col("search_text").alias("text"))).select(
        "policy_name", "clause_id", "embedding"
    )
    idx = retrieve.clause_index(clauses, embeddings=vecs)
    q = spark.createDataFrame([("f1", "health record of the patient"), ("f2", "zzz")], "finding_id string, query string")
    qv = embed(q.withColumn("text", F.col("query"))).drop("text")
    got = {r.finding_id: r.match for r in retrieve.retrieve_top1(qv, idx, query_vec=F.col("embedding")).collect()}
    # cosine path: the best clause has the highest cosine with the query vector
    scores = {}
    for r in idx.collect():
        a, b = [float(x) for x in _embed(["health record of the patient"])[0]], list(r.embedding)
        num = sum(x * y for x, y in zip(a, b))
        den = (sum(x * x for x in a) ** 0.5) * (sum(y * y for y in b) ** 0.5)
        scores[(r.policy_name, r.clause_ord, r.clause_id)] = num / den if den else 0.0
    best = sorted(scores.items(), key=lambda kv: (-kv[1], kv[0][0], kv[0][1]))[0]
    assert got["f1"].clause_id == best[0][2]
    assert abs(got["f1"].score - best[1]) < 1e-9
    # a zero query vector scores 0 everywhere: the first clause in corpus order still cites
    assert got["f2"].clause_id == "GDPR-Art5-1a" and got["f2"].score == 0.0


def test_reasoner_hook_and_fallback(spark):
    src = spark.createDataFrame([("1", "a.txt", "mail a@b.io\nip 10.0.0.1", None)], "source_id string, file_name string, content string, language string")
    f = scan_text(src, scan_id="s")
    idx = retrieve.clause_index(load_policy_clauses(spark))

    def answer(pdf: pd.DataFrame):
        out = []
        for dt in pdf["data_type"]:
            if dt == "EMAIL":
                out.append("Here you go: " + json.dumps({"severity": "LOW", "fix_tool": "DROP_COLUMN", "explanation": "ok"}))
            else:
                out.append("cannot answer")
        return out

    r = {x.data_type: x for x in enrich.enrich(f, idx, reasoner=pandas_reasoner(answer)).collect()}
    assert (r["EMAIL"].severity, r["EMAIL"].fix_tool, r["EMAIL"].explanation) == ("LOW", "DROP_COLUMN", "ok")
    # no valid answer -> deterministic result
    assert r["IP"].severity == "MEDIUM" and r["IP"].explanation.startswith("IP detected at a.txt:2; this implicates ")


def test_detector_registry(spark):
    src = spark.createDataFrame([("1", "a.txt", "mail a@b.io", None)], "source_id string, file_name string, content string, language string")
    register_detector("text", lambda s: scan_text(s, scan_id="s"))
    out = run_detectors(src)
    assert out.count() == 1
