"""The corpus pipeline: toxicity, line de-duplication, near-duplicate removal,
secret masking and packing.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet to the shared folder and read again as the next stage's
``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redline.llm import line_dedup, packing, prob_minhash, secret_scan, toxicity
from redline.llm.common import shared_table, table


def _unused(docs: DataFrame) -> str:
    """A column name that ``docs`` does not have."""
    return "x" * (1 + max(map(len, docs.columns)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the rejection threshold."""
    out = _unused(docs)
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), out=out)
    return scored.where(F.col(f"{out}.predicted") == 0).drop(out)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; one of which nothing is
    left but had text goes."""
    stats = _unused(docs)
    cut = line_dedup.dedup_lines(docs, stats=stats)
    emptied = (F.col(f"{stats}.deleted") > 0) & (F.col(f"{stats}.deleted") == F.col(f"{stats}.lines"))
    return cut.where(~emptied).drop(stats)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the smallest id."""
    return prob_minhash.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked."""
    return secret_scan.mask_secrets(docs, shared_table(secret_scan.scan_secrets(docs), "secrets"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Trained models, sketches and tokenizers are not SQL; tests hold the rows
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that packing makes of what the other stages keep."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
