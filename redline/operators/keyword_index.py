"""Keyword retrieval over a large clause corpus: an inverted index, exact top-1.

``retrieve_top1`` scores every clause of a query's policy, which is right for
a policy corpus and not for millions of clauses.  Here a query meets only the
clauses that share one of its rare tokens.

A clause with at least ``h`` of a query's ``m`` known tokens holds one of its
``m - h + 1`` rarest ones, whichever they are.  So the clauses of the first few
postings are scored exactly; the best of them has ``h`` hits, and all clauses
that could reach as many are those of the ``m - h + 1`` rarest tokens.  That
list grows shorter with every step of ``prefixes``; the last step makes the
answer exact, ties included.  A frequent token's postings are read only by
queries without a better answer from rarer ones.

Clauses, postings and what the queries ask are tables in the shared folder: a
step reads the columns that it needs, and the planner knows the sizes, so that
few queries are broadcast to postings and clauses, which then do not move.
With many, postings shuffle by token, pairs by clause (to score) and by query
(partial ``min``).  No pair is made for a query and a clause without a rare
token in common; no list of a token or a clause is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.policy import tokenize
from ..session import stored

#: Rarest tokens looked up at first, before the bound decides.
PREFIXES = (2, 6)


def keyword_index(clauses_index: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The clauses with a number (``cid``, tokens, policy, order, id), their
    postings (token, ``cid``) and the tokens' number of clauses (token, ``df``),
    written to the checkpoint folder."""
    text = F.xxhash64("title", "clause_text")
    clauses = stored(
        clauses_index.select(
            F.monotonically_increasing_id().alias("cid"), "policy_name", "clause_ord", "clause_id", "title", "clause_text", text.alias("text_hash"), "tokens"
        ),
        "clauses",
    )
    postings = stored(clauses.select(F.explode("tokens").alias("token"), "cid"), "postings")
    return clauses, postings, stored(postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "token-counts")


def retrieve_keywords(
    queries: DataFrame,
    clauses_index: DataFrame,
    key: str = "finding_id",
    query: Column | None = None,
    policy: Column | None = None,
    out: str = "match",
    prefixes: tuple[int, ...] = PREFIXES,
) -> DataFrame:
    """Add ``out`` = the best clause (``clause_id, title, clause_text, policy_name,
    score``) to every row, as ``retrieve_top1`` gives it by keywords.

    ``policy``: a policy-name filter per row (NULL = all).  ``key`` names a row.
    A query without a hit gets the first clause of its policy, with score 0;
    without a clause in its policy NULL.  Clauses that agree in policy, order
    and id are told apart by a digest of their texts.
    """
    clauses, postings, counts = keyword_index(clauses_index)
    pol = F.lower(policy) if policy is not None else F.lit(None).cast("string")
    asked = stored(
        queries.select(
            F.col(f"`{key}`").alias("q_key"), tokenize(query if query is not None else F.col("query")).alias("q_tokens"), pol.alias("q_policy")
        )
        .dropDuplicates(["q_key"])
        .withColumn("qid", F.monotonically_increasing_id()),  # a null key is a query, too
        "asked",
    )
    ranked = asked.select("qid", "q_policy", F.explode("q_tokens").alias("token")).join(counts, "token")
    ranked = stored(ranked.groupBy("qid", "q_policy").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("rare")), "ranked")  # one query's tokens

    who = F.struct("policy_name", "clause_ord", "clause_id", "text_hash", "cid")
    scored: DataFrame | None = None
    for step in [*prefixes, None]:
        wanted = ranked.join(scored.select("qid", "hits"), "qid", "left") if scored is not None else ranked.withColumn("hits", F.lit(None).cast("int"))
        # the rarest tokens that a clause with as many hits as the best so far must share
        bound = F.size("rare") - F.coalesce("hits", F.lit(0)) + 1
        n = F.least(F.size("rare"), bound if step is None else F.least(bound, F.lit(step)))
        first = wanted.select("qid", "q_policy", F.explode(F.slice("rare", F.lit(1), n)).alias("r")).select("qid", "q_policy", F.col("r.token").alias("token"))
        first = stored(first, "rare-tokens")
        pairs = stored(postings.join(first, "token").select("qid", "q_policy", "cid").distinct(), "pairs")
        met = pairs.join(clauses.select("cid", "policy_name", "clause_ord", "clause_id", "text_hash", "tokens"), "cid")
        met = met.where(F.col("q_policy").isNull() | (F.lower("policy_name") == F.col("q_policy")))
        met = met.join(asked.select("qid", "q_tokens"), "qid")
        hits = F.size(F.array_intersect("q_tokens", "tokens"))
        best = met.select("qid", F.struct((-hits).alias("neg"), who.alias("who")).alias("best")).groupBy("qid").agg(F.min("best").alias("best"))
        scored = stored(best.select("qid", (-F.col("best.neg")).alias("hits"), F.col("best.who.cid").alias("cid")), "scored")

    # without a hit, the first clause of the policy
    firsts = clauses.groupBy(F.lower("policy_name").alias("of")).agg(F.min(who).alias("who"))
    every = clauses.agg(F.min(who)["cid"].alias("any_cid"))  # one row
    answers = (
        asked.join(scored, "qid", "left")
        .join(firsts.select("of", F.col("who.cid").alias("of_cid")), F.col("q_policy") == F.col("of"), "left")
        .select(
            "q_key", F.coalesce("cid", F.when(F.col("q_policy").isNull(), every.scalar()).otherwise(F.col("of_cid"))).alias("cid"),
            F.when(F.size("q_tokens") == 0, F.lit(0.0)).otherwise(F.coalesce("hits", F.lit(0)) / F.size("q_tokens")).alias("score"),
        )
    )
    answers = stored(answers, "answers")
    cited = clauses.select("cid", "clause_id", "title", "clause_text", "policy_name").join(answers.select("cid"), "cid", "left_semi")
    found = answers.join(cited, "cid", "left")
    match = F.when(F.col("cid").isNotNull(), F.struct("clause_id", "title", "clause_text", "policy_name", "score"))
    found = found.select("q_key", match.alias("_match"))
    return queries.join(found, queries[key].eqNullSafe(found["q_key"]), "left").select(
        *[queries[f"`{c}`"] for c in queries.columns], F.col("_match").alias(out)
    )
