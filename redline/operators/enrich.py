"""Cite and reason: query → best clause → reasoning → updated finding.

One narrow chain of projections plus the retrieval join (a broadcast of
the clause blocks); no shuffle of the findings for a normal policy corpus.
A reasoner hook may add ``raw_1``/``raw_2`` answer columns; the first valid
one wins, else the deterministic result is used.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.policy import build_query, resolve_policy_name
from ..functions.reason import deterministic_reasoning, normalize_model_response
from .retrieve import clause_index, retrieve_top1

Embedder = Callable[[DataFrame], DataFrame]
Reasoner = Callable[[DataFrame], DataFrame]


def finding_query(df: DataFrame) -> Column:
    return build_query(F.col("data_type"), F.col("location"), F.col("detected_by"), F.col("snippet"))


def attach_scan_policy(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """Add the scan's ``policy_id`` to each finding (left join on scan_id)."""
    return findings.join(scans.select("scan_id", F.col("policy_id").alias("scan_policy_id")), "scan_id", "left")


def embedded_index(clauses: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """The clause index, with the embedder's vectors if there is one."""
    idx = clause_index(clauses)
    if embedder is None:
        return idx
    vectors = embedder(idx.select("policy_name", "clause_id", F.col("search_text").alias("text")))
    return clause_index(clauses, vectors)


def cite(findings: DataFrame, clause_idx: DataFrame, policy_id: Column | None = None, embedder: Embedder | None = None) -> DataFrame:
    """Findings with ``match`` = best clause under the scan's policy; with an
    ``embedder`` each finding's query gets a vector (only id and query text
    pass through the hook)."""
    pol = resolve_policy_name(policy_id) if policy_id is not None else None
    if embedder is None:
        return retrieve_top1(findings, clause_idx, key="finding_id", query=finding_query(findings), policy=pol)
    queries = embedder(findings.select("finding_id", finding_query(findings).alias("text")).distinct())
    asked = findings.join(queries.select("finding_id", F.col("embedding").cast("array<float>").alias("_query_vec")), "finding_id", "left")
    return retrieve_top1(asked, clause_idx, key="finding_id", query=finding_query(asked), query_vec=F.col("_query_vec"), policy=pol).drop("_query_vec")


def enrich(
    findings: DataFrame,
    clause_idx: DataFrame,
    policy_id: Column | None = None,
    reasoner: Reasoner | None = None,
    embedder: Embedder | None = None,
) -> DataFrame:
    """Severity, citation, explanation and proposed fix for every finding;
    status is reset to PENDING_REVIEW.  ``is_violation = false`` does not
    drop a finding."""
    cols = findings.columns
    cited = cite(findings, clause_idx, policy_id, embedder)
    m = F.col("match")
    det = deterministic_reasoning(
        F.col("data_type"), F.col("location"), F.col("detected_by"), m["clause_id"], m["title"], F.col("policy_clause_id")
    )
    if reasoner is not None:
        answered = reasoner(cited)
        fallback_cid = F.coalesce(m["clause_id"], F.col("policy_clause_id"))
        attempts = [
            normalize_model_response(F.col(c), F.col("data_type"), F.col("location"), F.col("detected_by"), fallback_cid)
            for c in ("raw_1", "raw_2")
            if c in answered.columns
        ]
        result = F.coalesce(*attempts, det)
        cited = answered
    else:
        result = det
    r = F.col("_r")
    with_r = cited.withColumn("_r", result)
    updated = {
        "severity": r["severity"],
        "policy_clause_id": r["policy_clause_id"],
        "policy_clause_text": F.coalesce(m["clause_text"], F.col("policy_clause_text")),
        "explanation": r["explanation"],
        "fix_tool": r["fix_tool"],
        "fix_args": r["fix_args"],
        "status": F.lit("PENDING_REVIEW"),
    }
    return with_r.select(*[updated[c].alias(c) if c in updated else F.col(c) for c in cols])


def offline_reasoner(df: DataFrame) -> DataFrame:
    """A reasoner that answers every finding with the deterministic result
    rendered as JSON text (what a well-behaved model would return)."""
    m = F.col("match")
    det = deterministic_reasoning(
        F.col("data_type"), F.col("location"), F.col("detected_by"), m["clause_id"], m["title"], F.col("policy_clause_id")
    )
    return df.withColumn("raw_1", F.to_json(det))

