"""Dataset files and the engine's own tables.

* ``read_csv_table`` / ``read_json_table``: a dataset file as an all-string
  DataFrame (header row / key union), the input of the column scan.
* ``write_csv_table`` / ``write_json_table``: cleaned copies (never in place).
* ``persist_findings`` / ``read_findings``: the findings table, partitioned by
  ``scan_id`` so one scan is one folder ("cascade delete" = drop it).
* ``export_report``: one JSON line per audit-report row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CLAUSES, FINDINGS, SCANS
from ..session import stored


def _column_names(cells: list[str | None], width: int) -> list[str]:
    """Names of the header's cells, then of the positions beyond it; a repeated
    name gets its position as suffix."""
    seen: set[str] = set()
    names = []
    for i in range(max(len(cells), width)):
        n = (cells[i] or "") if i < len(cells) else f"column_{i + 1}"
        names.append(n if n.lower() not in seen else f"{n}_{i}")
        seen.add(n.lower())
    return names


def read_csv_table(spark: SparkSession, path: str, ordered: bool = True, parts: bool = False) -> DataFrame:
    """CSV with a header row; every cell a string (no type inference).

    Files are read by splits (``sources.splits``), so quoted line breaks need no
    task that holds a file.  The header names come from the first record (of
    the first file by name; every file has one); a repeated name gets its
    position as suffix.  Short rows are padded with NULL, an empty cell without
    quotes is NULL.  Cells beyond the header are kept in further columns named
    by position (``column_3``).  A file that is no CSV (a stray quote, one never
    closed) gives no rows; without any other there are no columns.  ``ordered``:
    rows in the order of the files (a sort; False for large files).  ``parts``:
    the files of a folder are one text (``sources.splits``).
    """
    from pyspark.sql import types as T

    from .splits import _sound, csv_cells_of, csv_records

    # cut into records once, for the header, the width and the rows
    rows, files = _sound(stored(csv_records(spark, path, parts=parts), "csv-records"))
    head = files.orderBy("file_").select(csv_cells_of(F.col("first_text")).alias("cells")).first()
    if head is None:
        return spark.createDataFrame([], T.StructType([]))
    most = rows.agg(F.max(F.size(csv_cells_of(F.col("text"))))).first()[0]
    names = _column_names(head["cells"], most)
    if ordered:
        rows = rows.orderBy("file_name", "row_key")
    rows = rows.where("row_key > first_key").select(csv_cells_of(F.col("text"), F.lit(None).cast("string")).alias("cells"))
    return rows.select(*[F.try_element_at("cells", F.lit(i + 1)).alias(n) for i, n in enumerate(names)])


#: Key names that a JSON table may have as columns.
MAX_KEYS = 10_000


def read_json_table(spark: SparkSession, path: str, lines: bool = False, max_keys: int = MAX_KEYS, ordered: bool = True, parts: bool = False) -> DataFrame:
    """JSON files holding a top-level array of objects (with ``lines``: one
    object a line), as an all-string table: columns in first-seen order,
    non-string values keep their JSON text, missing and null values become
    ''.  An array is read by splits (``sources.splits``).  Elements that are no
    objects are skipped; another root, or a text that is no JSON, gives no rows,
    and without any other file no columns.  More than ``max_keys`` key names
    are an error: objects keyed by data are no table (``plans.scan.object_cells``
    gives them as long-form cells).  ``ordered``: rows in the order of the files
    (a sort; False for large files).  ``parts``: the files of a folder are one
    text (``sources.splits``)."""
    from .splits import json_objects, pieces

    if lines:
        text = F.trim("value")
        objects = pieces(spark, path, "\n", parts=parts).where(text.startswith("{")).select("file_name", F.struct("block", "id").alias("rec"), F.from_json(text, "map<string,string>").alias("object"))
    else:
        objects = stored(json_objects(spark, path, parts=parts).select("file_name", "rec", "object"), "json-objects")  # parsed once, for the keys and the rows
    # the names of the keys, in order of first sight: a schema, not rows
    keys = objects.select("file_name", "rec", F.posexplode(F.map_keys("object")).alias("pos", "name"))
    keys = keys.groupBy("file_name", "name", "pos").agg(F.min("rec").alias("rec"))  # by hash: no sort of all keys
    found = keys.groupBy("name").agg(F.min(F.struct("file_name", "rec", "pos")).alias("at")).orderBy("at").limit(max_keys + 1).collect()
    if len(found) > max_keys:
        raise ValueError(f"more than {max_keys} key names")
    if ordered:
        objects = objects.orderBy("file_name", "rec")
    return objects.select(*[F.coalesce(F.col("object")[r["name"]], F.lit("")).alias(r["name"]) for r in found])


def write_csv_table(df: DataFrame, path: str) -> None:
    """Header + rows, every value as text (white space at its ends kept),
    quotes escaped by doubling."""
    df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]).write.mode("overwrite").option(
        "header", "true"
    ).options(escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)


def write_json_table(df: DataFrame, path: str) -> None:
    """JSON Lines of string→string objects (NULL written as '')."""
    df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns]).write.mode(
        "overwrite"
    ).json(path)


def persist_findings(findings: DataFrame, path: str) -> None:
    """Write findings partitioned by scan; only the scans present are
    replaced (dynamic partition overwrite).  ``rebalance`` gathers small scans
    into few files and lets AQE split a scan that holds many findings."""
    rows = findings.select(*FINDINGS.fieldNames()).hint("rebalance", "scan_id")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_id").parquet(path)


def persist_scans(scans: DataFrame, path: str) -> None:
    """Write the scans table (one row a scan; missing columns are null)."""
    rows = scans.select(*[
        (F.col(f.name) if f.name in scans.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCANS.fields
    ])
    rows.write.mode("overwrite").parquet(path)


def persist_clauses(clauses: DataFrame, path: str) -> None:
    """Write the clause table, one folder a policy; only the policies present
    are replaced."""
    rows = clauses.select(*CLAUSES.fieldNames())
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("policy_name").parquet(path)


def read_findings(spark: SparkSession, path: str, scan_id: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("scan_id") == scan_id) if scan_id is not None else df


def export_report(report: DataFrame, path: str) -> None:
    """One JSON document per audit-report row (JSON Lines)."""
    report.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in report.columns])).alias("value")).write.mode(
        "overwrite"
    ).text(path)
