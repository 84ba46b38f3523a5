"""Column functions for policy-clause retrieval."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R

# Regex class of the token separators listed in rules.TOKEN_SEPARATORS.
TOKEN_SPLIT = "[ \\t\\n\\r.,;:()\"'/_-]+"


def clause_search_text(title: Column, clause_text: Column, examples: Column) -> Column:
    """``"{title}. {text} {examples joined by space}"``."""
    return F.concat(
        F.coalesce(title, F.lit("")),
        F.lit(". "),
        F.coalesce(clause_text, F.lit("")),
        F.lit(" "),
        F.array_join(F.coalesce(examples, F.array().cast("array<string>")), " "),
    )


def tokenize(text: Column) -> Column:
    """Distinct lower-cased tokens longer than two characters."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_SPLIT, -1)
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) >= R.TOKEN_MIN_LENGTH))


def keyword_hits(query_tokens: Column, clause_tokens: Column) -> Column:
    """Number of distinct query tokens present in the clause."""
    return F.size(F.array_intersect(query_tokens, clause_tokens))


def keyword_score(query_tokens: Column, clause_tokens: Column) -> Column:
    """Share of distinct query tokens present in the clause (0 if none)."""
    n = F.size(query_tokens)
    return F.when(n == 0, F.lit(0.0)).otherwise(keyword_hits(query_tokens, clause_tokens) / n)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine over the common prefix; float products summed in double; 0 on
    a zero norm."""
    n = F.least(F.size(a), F.size(b))
    a2 = F.slice(a, 1, n)
    b2 = F.slice(b, 1, n)
    zero = F.lit(0.0).cast("double")

    def total(arr: Column) -> Column:
        return F.aggregate(arr, zero, lambda acc, v: acc + v)

    dot = total(F.zip_with(a2, b2, lambda x, y: (x * y).cast("double")))
    ma = total(F.transform(a2, lambda x: (x * x).cast("double")))
    mb = total(F.transform(b2, lambda x: (x * x).cast("double")))
    return F.when((n <= 0) | (ma == 0) | (mb == 0), zero).otherwise(dot / (F.sqrt(ma) * F.sqrt(mb)))


def build_query(data_type: Column, location: Column, detected_by: Column, snippet: Column) -> Column:
    """Retrieval query sentence for a finding."""
    c = lambda x: F.coalesce(x, F.lit(""))
    return F.concat(
        c(data_type), F.lit(" personal data found at "), c(location),
        F.lit(". Detected by "), c(detected_by), F.lit(". Snippet: "), c(snippet),
    )


def resolve_policy_name(policy_id: Column) -> Column:
    """Policy name a scan's policy id points to (substring rules), or NULL
    for all policies."""
    up = F.upper(F.coalesce(policy_id, F.lit("")))
    expr = None
    for needle, name in R.POLICY_NAME_HINTS:
        cond = F.instr(up, needle) > 0
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(None).cast("string"))


def content_hash(text: Column) -> Column:
    """First 8 upper-case hex characters of SHA-256 of the text."""
    return F.upper(F.substring(F.sha2(text, 256), 1, R.CONTENT_HASH_HEX_CHARS))


def encode_embedding(hash_: Column, vec: Column) -> Column:
    """``"{hash}|f0,f1,..."``."""
    return F.concat(hash_, F.lit("|"), F.array_join(F.transform(vec, lambda x: x.cast("string")), ","))


def decode_embedding(stored: Column, expected_hash: Column) -> Column:
    """Vector of a stored embedding; NULL when blank, malformed, of another
    hash, without parts, or with any part that is not a float."""
    sep = F.instr(stored, "|")
    head = F.when(sep > 1, F.substring_index(stored, "|", 1))
    tail = F.when(sep > 1, F.substring(stored, sep + 1, F.length(stored)))
    parts = F.filter(F.split(tail, ",", -1), lambda p: p != "")
    vec = F.transform(parts, lambda p: p.try_cast("float"))
    ok = (
        F.coalesce(F.trim(stored), F.lit("")) != ""
    ) & (head == expected_hash) & (F.size(parts) > 0) & ~F.exists(vec, lambda x: x.isNull())
    return F.when(ok, vec)


def policy_of(clause_id: Column) -> Column:
    """Policy label of a clause id by its prefix before '-'."""
    prefix = F.upper(F.split(F.coalesce(clause_id, F.lit("")), "-", -1)[0])
    return (
        F.when(prefix.isin(*R.CLAUSE_PREFIX_HIPAA), F.lit("HIPAA"))
        .when(prefix.isin(*R.CLAUSE_PREFIX_SECRETS), F.lit("Secrets"))
        .otherwise(F.lit("GDPR"))
    )


def policy_description(policy_name: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in R.POLICY_DESCRIPTIONS.items() for x in kv])
    return m[F.upper(policy_name)]
