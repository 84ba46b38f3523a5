"""Policy clause corpus: each ``*.json`` file is one policy (name = upper
file stem) holding an array of clause objects with case-insensitive keys.

The shipped files in ``redline/policies`` are fixed values: the texts of the
clauses must equal the reference's."""

from __future__ import annotations

import importlib.resources
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CLAUSES

BUILTIN_POLICY_DIR = os.path.join(os.path.dirname(os.path.dirname(__file__)), "policies")


def _shipped(spark: SparkSession) -> DataFrame:
    """The shipped policy files as rows; executors need not have the package
    at the same path."""
    folder = importlib.resources.files(__package__.rpartition(".")[0]).joinpath("policies")
    rows = [(f.name, f.read_text(encoding="utf-8")) for f in sorted(folder.iterdir(), key=lambda f: f.name) if f.name.endswith(".json")]
    return spark.createDataFrame(rows, "file_name string, content string")


def load_policy_clauses(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``clauses(policy_name, clause_ord, clause_id, title, clause_text,
    example_violations)``.

    An entry is skipped when its id or text is blank; the title defaults to
    the id and the examples to ``[]``; a file that does not parse as an
    array of objects contributes nothing.
    """
    try:
        raw = _shipped(spark) if path is None else (
            spark.read.option("pathGlobFilter", "*.json")
            .text(path, wholetext=True)
            .select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("content"))
        )
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            return spark.createDataFrame([], CLAUSES)
        raise
    entries = F.from_json(F.col("content"), "array<map<string,string>>")
    exploded = raw.select(
        F.upper(F.regexp_replace(F.col("file_name"), r"\.[^.]*$", "")).alias("policy_name"),
        F.posexplode(F.coalesce(entries, F.array().cast("array<map<string,string>>"))).alias("pos", "e"),
    ).select(
        "policy_name",
        "pos",
        F.transform_keys(F.col("e"), lambda k, v: F.lower(k)).alias("e"),
    )
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    cid = F.col("e")["id"]
    text = F.col("e")["clausetext"]
    return exploded.where(~blank(cid) & ~blank(text)).select(
        "policy_name",
        (F.col("pos") + 1).cast("int").alias("clause_ord"),
        cid.alias("clause_id"),
        F.coalesce(F.col("e")["title"], cid).alias("title"),
        text.alias("clause_text"),
        F.coalesce(
            F.from_json(F.col("e")["exampleviolations"], "array<string>"), F.array().cast("array<string>")
        ).alias("example_violations"),
    )
