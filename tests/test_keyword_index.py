"""The inverted index gives the same best clause as scoring every clause."""

import random

import pytest
from pyspark.sql import functions as F

from redline.operators.keyword_index import keyword_index, retrieve_keywords
from redline.operators.retrieve import clause_index, retrieve_top1

CLAUSES = "policy_name string, clause_ord int, clause_id string, title string, clause_text string, example_violations array<string>"


@pytest.mark.parametrize("prefixes", [(), (1,), (2, 6)])
def test_equals_scoring_every_clause(spark, prefixes):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(40)]
    weights = [40 / (i + 1) for i in range(40)]  # some tokens in nearly every clause
    text = lambda n: " ".join(rng.choices(words, weights, k=n))
    rows = [(f"P{i % 3}", i // 3 % 50, f"c{i:03}", f"t{i}", text(rng.randrange(1, 25)), []) for i in range(240)]
    rows += [("P1", 0, "c001", "t1", rows[1][4], []), ("Empty", 0, "z", None, None, None)]
    index = clause_index(spark.createDataFrame(rows, CLAUSES))
    asked = [(f"q{i}", text(rng.randrange(0, 9)) + (" nowhere" if i % 4 == 0 else ""), rng.choice([None, None, "p0", "P1", "p2", "none", "EMPTY"])) for i in range(120)]
    asked += [("same", "nowhere else", None), ("none", None, "P2"), (None, "word0 word1", None)]
    queries = spark.createDataFrame(asked, "finding_id string, query string, policy string").withColumn("match_", F.lit(1))
    best = lambda df: {r.finding_id: r.match and (r.match.policy_name, r.match.clause_id, r.match.clause_text, round(r.match.score, 12)) for r in df.collect()}
    got = best(retrieve_keywords(queries, index, policy=F.col("policy"), prefixes=prefixes))
    assert len(got) == len(asked)
    want = best(retrieve_top1(queries, index, policy=F.col("policy")))
    assert {k: (v, got[k]) for k, v in want.items() if got[k] != v} == {}


def test_no_clauses_and_no_queries(spark):
    none = clause_index(spark.createDataFrame([], CLAUSES))
    queries = spark.createDataFrame([("a", "word")], "finding_id string, query string")
    assert [tuple(r) for r in retrieve_keywords(queries, none).collect()] == [("a", "word", None)]
    assert retrieve_keywords(queries.limit(0), none).count() == 0


def test_postings_are_built_without_a_shuffle(spark):
    """Clauses, postings and counts are files: a step reads the columns it needs."""
    rows = [("P", i, f"c{i}", "t", f"word{i % 3} text", []) for i in range(30)]
    clauses, postings, counts = keyword_index(clause_index(spark.createDataFrame(rows, CLAUSES)))
    assert all(df.inputFiles() for df in (clauses, postings, counts))
    assert sorted(postings.columns) == ["cid", "token"] and postings.count() == clauses.select(F.explode("tokens")).count()
    assert {r.token: r.df for r in counts.collect()}["word1"] == 10
