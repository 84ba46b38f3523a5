"""The queries of this package: one per operator, over its whole table, and
the pipeline.  SQL cannot express most of them over the same columns (CRCs,
tokenizers, sketches, trained models); those are tested against brute force
in ``tests/llm``.  DuckDB SQL is given where it can: exact de-duplication and
the Merkle manifest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, chunk_bpe, exact_dedup, fingerprints, html_extract, line_dedup, merkle, packing, prob_minhash, secret_scan, sharding, toxicity, whitening
from .common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight contiguous shards of near equal bytes."""
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=8)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later copies of line runs of 50 words or more."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_chars", F.col("line_stats.lines").alias("n_lines"), F.col("line_stats.deleted").alias("n_deleted"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, their edited texts and the likenesses."""
    return fingerprints.fingerprint_versions(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity_score.score").alias("score"),
        F.col("toxicity_score.predicted").alias("predicted"), F.col("toxicity_score.spans").alias("spans"),
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded, as digests."""
    return chunk_bpe.encode_decode(table(spark, sf_dir, "documents"), outputs=False)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of equal texts."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate secret of the documents with the forest's verdict."""
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", F.sha2("code", 256).alias("code_sha256"), "score", "is_secret")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates."""
    return prob_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    added = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text")
    )
    return chat_format.read_back(chat_format.format_conversations(turns.unionByName(added)))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the four leading whitening directions."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and check in the Merkle manifest."""
    return merkle.document_manifest(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sharding, op2_line_dedup, op3_fingerprints, op4_packing, op5_toxicity, op6_bpe, op7_exact_dedup, op8_secrets,
        op9_near_dedup, op10_chat_format, op11_whitening, op12_html_extract, op13_merkle, pipeline,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op7_exact_dedup": r"""
        WITH n AS (
          SELECT doc_id, length(coalesce(text, '')) AS c, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents
        ), k AS (
          SELECT doc_id, t, first_value(doc_id) OVER (PARTITION BY t ORDER BY c DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM k
    """,
    # The CRC is the bitwise one: each byte is XORed in, then shifted eight times.
    "op13_merkle": r"""
        WITH RECURSIVE f AS (
          SELECT doc_id, source, CASE WHEN doc_id IS NULL THEN NULL ELSE (xor(list_reduce(
              list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: list_concat([ascii(ch)::BIGINT], [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
              lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295) % 5) = 0 END AS hit,
            concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
              coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-')) AS head, text,
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered
          FROM documents
        ), h AS (
          SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
            CASE WHEN hit AND text IS NOT NULL THEN sha256(head || strlen(lowered) || ':' || lowered) END AS tampered FROM f
        ), leaves AS (
          SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS m FROM h
        ), nodes AS (
          SELECT tree, 0 AS lvl, idx, m, leaf AS digest FROM leaves
          UNION ALL
          SELECT tree, lvl + 1, idx // 16, any_value((m + 15) // 16), sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE m > 1 GROUP BY tree, lvl, idx // 16
        ), tops AS (
          SELECT -1::BIGINT AS tree, 0 AS lvl, tree AS idx, count(*) OVER () AS m, digest FROM nodes WHERE m = 1
          UNION ALL
          SELECT tree, lvl + 1, idx // 16, any_value((m + 15) // 16), sha256(string_agg(digest, '' ORDER BY idx)) FROM tops WHERE m > 1 GROUP BY tree, lvl, idx // 16
        ), every AS (
          SELECT * FROM nodes UNION ALL SELECT * FROM tops
        ), sides AS (
          SELECT a.tree, a.lvl, a.idx, a.m, a.digest, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS r
          FROM every a JOIN every b ON a.tree = b.tree AND a.lvl = b.lvl AND a.idx // 16 = b.idx // 16 GROUP BY ALL
        ), climb AS (
          SELECT doc_id, leaf, tree AS home, tree, 0 AS lvl, idx, coalesce(tampered, leaf) AS folded, '' AS proof, FALSE AS done FROM leaves
          UNION ALL
          SELECT c.doc_id, c.leaf, c.home, CASE WHEN s.m = 1 THEN -1 ELSE c.tree END, CASE WHEN s.m = 1 THEN 0 ELSE c.lvl + 1 END, CASE WHEN s.m = 1 THEN c.home ELSE c.idx // 16 END,
            CASE WHEN s.m = 1 THEN c.folded ELSE sha256(s.l || c.folded || s.r) END, c.proof || s.l || s.r, s.m = 1 AND c.tree = -1
          FROM climb c JOIN sides s ON c.tree = s.tree AND c.lvl = s.lvl AND c.idx = s.idx WHERE NOT c.done
        ), roots AS (SELECT digest AS root FROM tops WHERE m = 1)
        SELECT c.doc_id, c.leaf, n.digest AS subroot, root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = root AS verified
        FROM climb c JOIN nodes n ON n.tree = c.home AND n.m = 1, roots WHERE c.done
    """,
}
