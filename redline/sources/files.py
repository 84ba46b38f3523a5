"""Sources: files read whole, or any text table, as ``sources`` rows.

``sources(source_id string, file_name string, content string, language string)``
is the input of every detector.  One row per file or per record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..session import qualified_path


def file_extension(file_name: Column) -> Column:
    """Lower-cased extension including the dot ('' when none)."""
    base = F.regexp_extract(file_name, r"([^/\\]*)$", 1)
    return F.lower(F.regexp_extract(base, r"(\.[^.]*)$", 1))


def guess_language(file_name: Column) -> Column:
    """Language hint from the file extension (case-folded), else NULL."""
    ext = file_extension(file_name)
    expr = None
    for suffix, lang in R.LANGUAGE_BY_EXTENSION:
        expr = F.when(ext == suffix, F.lit(lang)) if expr is None else expr.when(ext == suffix, F.lit(lang))
    return expr.otherwise(F.lit(None).cast("string"))


def as_sources(
    df: DataFrame,
    id_col: str,
    content_col: str,
    name_prefix: str = "",
    name_suffix: str = "",
    language: Column | None = None,
    scan_col: str | None = None,
) -> DataFrame:
    """Adapt any table with an id and a text column to ``sources``.

    ``file_name`` is ``name_prefix + id + name_suffix``; the language is the
    given column or the hint guessed from the name.  With ``scan_col`` the
    rows also carry ``scan_id`` (which scan they belong to).
    """
    file_name = F.concat(F.lit(name_prefix), F.col(id_col).cast("string"), F.lit(name_suffix))
    lang = language if language is not None else guess_language(file_name)
    return df.select(
        F.col(id_col).cast("string").alias("source_id"),
        file_name.alias("file_name"),
        F.col(content_col).cast("string").alias("content"),
        lang.cast("string").alias("language"),
        *([F.col(scan_col).cast("string").alias("scan_id")] if scan_col else []),
    )


def _listing(spark: SparkSession, path: str, corrupt: bool, pattern: str | None = None) -> DataFrame | None:
    """The files under ``path`` with their name relative to it (the base name
    if ``path`` is one file), or None if there is no such folder."""
    try:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", str(corrupt).lower())
        files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    except Exception as exc:  # missing folder -> empty table
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            return None
        raise
    root = qualified_path(spark, path).rstrip("/") + "/"
    relative = F.when(F.col("path").startswith(root), F.substring(F.col("path"), F.lit(len(root) + 1), F.length("path"))).otherwise(
        F.regexp_extract(F.col("path"), r"([^/]*)$", 1)
    )
    return files.select("path", "length", relative.alias("file_name"), "content")


def read_sources(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Every file under ``path`` read whole as one text row (UTF-8;
    undecodable bytes become U+FFFD).

    ``file_name`` is the path relative to ``path``, so equal names in two
    folders stay apart.  No file is left out for its size; one that Spark
    cannot read gives no row here and one in ``unreadable_sources``.  A
    missing folder gives an empty result.  ``pattern``: of the files' names.
    """
    from ..schemas import SOURCES

    files = _listing(spark, path, corrupt=True, pattern=pattern)
    if files is None:
        return spark.createDataFrame([], SOURCES)
    return files.select(
        F.sha2(F.col("path"), 256).substr(1, 16).alias("source_id"),
        "file_name",
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
        guess_language(F.col("file_name")).alias("language"),
    )


def unreadable_sources(spark: SparkSession, path: str) -> DataFrame:
    """The files under ``path`` that were not scanned: ``source_id,
    file_name, length, reason``.  The listing (which opens no file) without
    the files whose contents could be read."""
    files = _listing(spark, path, corrupt=True)
    if files is None:
        return spark.createDataFrame([], "source_id string, file_name string, length bigint, reason string")
    read = files.where(F.col("content").isNotNull()).select("path")
    return files.drop("content").join(read, "path", "left_anti").select(
        F.sha2(F.col("path"), 256).substr(1, 16).alias("source_id"), "file_name", "length", F.lit("unreadable").alias("reason")
    )
