"""Policy retrieval: the best clause per finding (top-1).

Exact top-1 has to look at every candidate clause of a finding.  Candidates
are cut into blocks of at most ``block_size`` clauses, each block one row
holding an array; findings meet the blocks through an equi-join on the
block number (one output row per finding and block, never one per
finding-clause pair), score the block with higher-order functions, and
blocks are merged with a ``min`` over ``(-score, policy, position)``.

* One block (the usual policy corpus): a broadcast hash join, no shuffle,
  no aggregation.
* More blocks: the block side is broadcast while its size, measured before
  planning, stays under ``broadcast_bytes``; otherwise both sides shuffle on
  the block number.  The merge is a partial/final aggregation by finding.

Scores: keyword overlap by default; cosine when the finding carries a query
vector and every candidate has one (first candidate in corpus order wins
ties, a zero score still cites, no candidate -> NULL).
"""

from __future__ import annotations

import math
import weakref

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.policy import clause_search_text, content_hash, cosine_similarity, keyword_hits, tokenize

DEFAULT_BLOCK_SIZE = 512
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024

MATCH_TYPE = "struct<clause_id:string,title:string,clause_text:string,policy_name:string,score:double>"


def clause_index(clauses: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
    """Clauses with search text, tokens, content hash and (optional) vector.

    ``embeddings`` (policy_name, clause_id, embedding) comes from an embedder
    hook or a refreshed index; without it every vector is NULL.
    """
    idx = clauses.select(
        "*",
        clause_search_text(F.col("title"), F.col("clause_text"), F.col("example_violations")).alias(
            "search_text"
        ),
    )
    idx = idx.select("*", tokenize(F.col("search_text")).alias("tokens"), content_hash(F.col("search_text")).alias("content_hash"))
    if embeddings is not None:
        idx = idx.join(embeddings.select("policy_name", "clause_id", "embedding"), ["policy_name", "clause_id"], "left")
    elif "embedding" not in idx.columns:
        idx = idx.withColumn("embedding", F.lit(None).cast("array<float>"))
    return idx


def _block_rows(index: DataFrame, n_blocks: int) -> DataFrame:
    cand = F.struct(
        F.col("policy_name"),
        F.col("clause_ord"),
        F.col("clause_id"),
        F.col("title"),
        F.col("clause_text"),
        F.col("tokens"),
        F.col("embedding"),
    )
    blk = F.pmod(F.xxhash64("policy_name", "clause_id"), F.lit(n_blocks)).cast("int")
    blocks = index.select(blk.alias("_blk"), cand.alias("c")).groupBy("_blk").agg(F.collect_list("c").alias("_cands"))
    # the policies that have a clause without a vector: one value
    missing = index.agg(F.collect_set(F.when(F.col("embedding").isNull(), F.lower("policy_name"))).alias("_missing"))
    return blocks.withColumn("_missing", missing.scalar())


def _best_in_block(cands: Column, missing: Column, q_tokens: Column, q_vec: Column, policy: Column) -> Column:
    """``struct<neg_score, policy_name, clause_ord, clause_id, title, clause_text>``
    of the best candidate of one block, NULL when the policy leaves none."""
    eligible = F.filter(
        cands, lambda c: policy.isNull() | (F.lower(c["policy_name"]) == F.lower(policy))
    )
    # decided over all candidates of the policy, in whichever block they are
    all_embedded = F.when(policy.isNull(), F.size(missing) == 0).otherwise(~F.array_contains(missing, F.lower(policy)))
    use_cos = q_vec.isNotNull() & all_embedded
    n_q = F.size(q_tokens)

    def score(c: Column) -> Column:
        kw = F.when(n_q == 0, F.lit(0.0)).otherwise(keyword_hits(q_tokens, c["tokens"]) / n_q)
        return F.when(use_cos, cosine_similarity(q_vec, c["embedding"])).otherwise(kw)

    scored = F.transform(
        eligible,
        lambda c: F.struct(
            (-score(c)).alias("neg_score"),
            c["policy_name"].alias("policy_name"),
            c["clause_ord"].alias("clause_ord"),
            c["clause_id"].alias("clause_id"),
            c["title"].alias("title"),
            c["clause_text"].alias("clause_text"),
        ),
    )
    return F.when(F.size(scored) > 0, F.array_min(scored))


def retrieve_top1(
    findings: DataFrame,
    clauses_index: DataFrame,
    key: str = "finding_id",
    query: Column | None = None,
    query_vec: Column | None = None,
    policy: Column | None = None,
    out: str = "match",
    block_size: int = DEFAULT_BLOCK_SIZE,
    broadcast_bytes: int = DEFAULT_BROADCAST_BYTES,
) -> DataFrame:
    """Add ``out`` = best clause struct (``clause_id, title, clause_text,
    policy_name, score``) to every finding row.

    ``query`` is the text to tokenise (a column of ``findings``),
    ``query_vec`` an optional vector, ``policy`` an optional policy-name
    filter per row (NULL = all).  Every input row is kept.  ``key`` names the
    finding; the result does not depend on ``block_size``.
    """
    q_text = query if query is not None else F.col("query")
    q_vec = query_vec if query_vec is not None else F.lit(None).cast("array<float>")
    pol = policy if policy is not None else F.lit(None).cast("string")

    stats = _stats(clauses_index)
    n_cands, cand_bytes = stats
    n_blocks = max(1, math.ceil(n_cands / block_size))
    blocks = _block_rows(clauses_index, n_blocks)
    return _retrieve(findings, blocks, n_blocks, cand_bytes, key, q_text, q_vec, pol, out, broadcast_bytes)


_STATS: "weakref.WeakKeyDictionary[DataFrame, tuple[int, int]]" = weakref.WeakKeyDictionary()


def _stats(clauses_index: DataFrame) -> tuple[int, int]:
    """Number of candidates and their approximate size in bytes (one small
    aggregate over the clause corpus, remembered per index DataFrame)."""
    hit = _STATS.get(clauses_index)
    if hit is not None:
        return hit
    stats = clauses_index.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(
            F.sum(
                F.length("clause_text")
                + F.length("title")
                + F.length("clause_id")
                + F.coalesce(F.size("embedding"), F.lit(0)) * 4
                + F.aggregate(F.col("tokens"), F.lit(0), lambda acc, t: acc + F.length(t) + 8)
                + 64
            ),
            F.lit(0),
        ).alias("bytes"),
    ).first()
    result = (int(stats["n"]), int(stats["bytes"]))
    _STATS[clauses_index] = result
    return result


def _retrieve(findings, blocks, n_blocks, cand_bytes, key, q_text, q_vec, pol, out, broadcast_bytes):
    prepared = findings.select(
        "*",
        tokenize(q_text).alias("_qt"),
        q_vec.alias("_qv"),
        pol.alias("_pol"),
    )
    # one row per finding and block; a generator (not a literal) keeps the
    # join an equi-join on the block id even for a single block
    base_cols = list(findings.columns)
    if n_blocks > 1:  # only what scoring needs is multiplied
        prepared = prepared.select(F.col(f"`{key}`").alias("_key"), "_qt", "_qv", "_pol").dropDuplicates(["_key"])
    fan = prepared.withColumn("_blk", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    blocks = F.broadcast(blocks) if cand_bytes <= broadcast_bytes else blocks
    joined = fan.join(blocks, "_blk", "left")
    best = _best_in_block(
        F.coalesce(F.col("_cands"), F.array().cast(blocks.schema["_cands"].dataType)),
        F.coalesce(F.col("_missing"), F.array().cast("array<string>")),
        F.col("_qt"),
        F.col("_qv"),
        F.col("_pol"),
    )
    if n_blocks > 1:
        winners = joined.select("_key", best.alias("_best")).groupBy("_key").agg(F.min("_best").alias("_best"))
        scored = findings.join(winners, findings[key].eqNullSafe(winners["_key"]), "left")
    else:
        scored = joined.select(*[F.col(f"`{c}`") for c in base_cols], best.alias("_best"))
    b = F.col("_best")
    match = F.when(
        b.isNotNull(),
        F.struct(
            b["clause_id"].alias("clause_id"),
            b["title"].alias("title"),
            b["clause_text"].alias("clause_text"),
            b["policy_name"].alias("policy_name"),
            (-b["neg_score"]).alias("score"),
        ),
    )
    return scored.select(*[F.col(f"`{c}`") for c in base_cols], match.alias(out))


def refresh_clause_index(
    old: DataFrame | None,
    clauses: DataFrame,
    embedder=None,
) -> tuple[DataFrame, DataFrame]:
    """Upsert the clause index by (policy, clause id).

    ``old``: ``(policy_name, clause_id, title, clause_text, stored_embedding)``
    where ``stored_embedding`` is ``"{hash}|f0,f1,..."``.  New clauses are
    inserted, existing ones get the new title and text, clauses only in
    ``old`` are kept.  A stored vector is reused when its hash equals the
    content hash of the new search text; otherwise the clause is embedded by
    ``embedder`` (a DataFrame hook adding ``embedding`` for ``text``), or
    keeps no vector when there is none.  Returns the index and one row of
    counts (``reused``, ``embedded``).
    """
    from ..functions.policy import decode_embedding, encode_embedding

    new = clause_index(clauses).drop("embedding")
    if old is None:
        old = clauses.sparkSession.createDataFrame(
            [], "policy_name string, clause_id string, title string, clause_text string, stored_embedding string"
        )
    o = old.select(
        F.col("policy_name").alias("o_policy"), F.col("clause_id").alias("o_clause"),
        F.col("title").alias("o_title"), F.col("clause_text").alias("o_text"), "stored_embedding",
    )
    j = new.join(o, (F.upper(new["policy_name"]) == F.upper(o["o_policy"])) & (new["clause_id"] == o["o_clause"]), "full_outer")
    j = j.withColumn("cached", F.when(F.col("clause_id").isNotNull(), decode_embedding(F.col("stored_embedding"), F.col("content_hash"))))
    is_new_side = F.col("clause_id").isNotNull()
    stale = j.where(~is_new_side).select(
        F.col("o_policy").alias("policy_name"), F.col("o_clause").alias("clause_id"), F.col("o_title").alias("title"),
        F.col("o_text").alias("clause_text"), F.lit(None).cast("array<float>").alias("embedding"),
        "stored_embedding", F.lit("kept").alias("action"),
    )
    current = j.where(is_new_side)
    reuse = current.where(F.col("cached").isNotNull())
    todo = current.where(F.col("cached").isNull())
    base_cols = ["policy_name", "clause_id", "title", "clause_text"]
    reused = reuse.select(*base_cols, F.col("cached").alias("embedding"), "stored_embedding", F.lit("reused").alias("action"))
    if embedder is not None:
        emb = embedder(todo.select(*base_cols, "content_hash", F.col("search_text").alias("text")))
        embedded = emb.select(
            *base_cols, F.col("embedding").cast("array<float>").alias("embedding"),
            encode_embedding(F.col("content_hash"), F.col("embedding")).alias("stored_embedding"),
            F.lit("embedded").alias("action"),
        )
    else:
        embedded = todo.select(
            *base_cols, F.lit(None).cast("array<float>").alias("embedding"), "stored_embedding",
            F.lit("unembedded").alias("action"),
        )
    index = reused.unionByName(embedded).unionByName(stale)
    counts = index.agg(
        F.count(F.when(F.col("action") == "reused", 1)).cast("bigint").alias("reused"),
        F.count(F.when(F.col("action") == "embedded", 1)).cast("bigint").alias("embedded"),
    )
    return index, counts
