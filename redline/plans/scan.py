"""The whole scan: route every source to its detectors, then cite and reason.

``sources → scan_text ∪ code rules (C# only) ∪ column scan (CSV/JSON
sources and given tables) → enrich → findings``.  Results of the detectors
are unioned without de-duplication, so a CSV file gets both line and column
findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import hooks
from ..functions import rules as R
from ..functions.code import is_csharp
from ..functions.columns import is_dataset, is_json_dataset
from ..operators import detect_code, detect_columns, detect_text, enrich
from ..operators.detect_code import with_scan_id
from ..schemas import FINDING_COLUMNS
from ..sources import splits
from ..sources.files import guess_language, read_sources
from ..sources.splits import csv_cells_of, csv_text_records

def csv_records(content: Column) -> Column:
    """The records of a CSV text, each an array of cells: quoted fields may
    hold commas, line breaks and doubled quotes; blank lines are left out; a
    text that is no CSV (a stray quote, one never closed) has none."""
    return F.transform(csv_text_records(content), lambda x: csv_cells_of(x))


def csv_cells(sources: DataFrame) -> DataFrame:
    """Cells of CSV sources, with their scan: header row = column names, every
    cell a string, ragged rows kept (a cell beyond the header has an empty
    column name)."""
    rows = sources.select("scan_id", "file_name", csv_records(F.col("content")).alias("records"))
    rows = rows.select("scan_id", "file_name", F.try_element_at("records", F.lit(1)).alias("header"), F.posexplode("records").alias("row_no", "cells"))
    cells = rows.where("row_no > 0").select("scan_id", "file_name", "row_no", "header", F.posexplode("cells").alias("col_pos", "value"))
    return cells.select(
        "scan_id", F.col("file_name").alias("dataset"), F.col("row_no").cast("bigint").alias("row_key"), F.col("col_pos").cast("int"),
        F.coalesce(F.try_element_at("header", F.col("col_pos") + 1), F.lit("")).alias("column_name"), "value",
    )


def json_objects(sources: DataFrame) -> DataFrame:
    """The objects of a JSON text's top-level array, in order, as maps of
    strings: ``scan_id, file_name, rec, object``."""
    elems = sources.select(
        "scan_id", "file_name",
        F.posexplode(F.coalesce(F.from_json(F.col("content"), "array<string>"), F.array().cast("array<string>"))).alias("rec", "el"),
    )
    return elems.where(F.ltrim("el").startswith("{")).select("scan_id", "file_name", "rec", F.from_json(F.col("el"), "map<string,string>").alias("object"))


def json_cells(sources: DataFrame) -> DataFrame:
    """Cells of JSON sources holding a top-level array, with their scan:
    columns are the union of the objects' keys in first-seen order, other
    elements are skipped, another root gives none, non-string values are kept
    as JSON text, null as ''."""
    return object_cells(json_objects(sources))


def object_cells(objects: DataFrame) -> DataFrame:
    """Cells of JSON objects (``scan_id, file_name, rec, object``)."""
    kv = objects.select(
        "scan_id", "file_name", "rec", F.posexplode(F.map_entries("object")).alias("kpos", "e")
    ).select("scan_id", "file_name", "rec", "kpos", F.col("e.key").alias("column_name"), F.col("e.value").alias("value"))
    first_seen = kv.groupBy("scan_id", "file_name", "column_name").agg(F.min(F.struct("rec", "kpos")).alias("first"))
    order = first_seen.withColumn(
        "col_pos", (F.dense_rank().over(Window.partitionBy("scan_id", "file_name").orderBy("first")) - 1).cast("int")
    ).select("scan_id", "file_name", "column_name", "col_pos")  # a file's key names
    return kv.join(order, ["scan_id", "file_name", "column_name"]).select(
        "scan_id", F.col("file_name").alias("dataset"), F.col("rec").cast("bigint").alias("row_key"), "col_pos",
        "column_name", F.coalesce(F.col("value"), F.lit("")).alias("value"),
    )


def route_detectors(
    sources: DataFrame,
    datasets: dict[str, tuple[DataFrame, str | list[str]]] | None = None,
    scan_id: str | None = None,
    detectors: dict[str, hooks.Detector] | None = None,
    entities: hooks.EntityHook | None = None,
) -> DataFrame:
    """Detection findings of a scan: regex on every source, code rules on C#
    sources, column scan on CSV/JSON sources and on the given tables, and the
    given (else the registered) plug-in detectors on every source.

    ``entities`` is a value detector over sample texts (see ``hooks``); where
    it fails for a column, that column is classified by its name."""
    src = with_scan_id(sources, scan_id)
    parts = [detect_text.scan_text(src)]
    code_src = src.where(is_csharp(F.col("file_name"), F.col("language")))
    parts.append(detect_code.scan_code(code_src))
    ds = src.where(is_dataset(F.col("file_name"), F.col("language")))
    js = is_json_dataset(F.col("file_name"), F.col("language"))
    for cells in (csv_cells(ds.where(~js)), json_cells(ds.where(js))):
        parts.append(detect_columns.scan_columns(cells, entities=entities))
    for name, (df, order_by) in (datasets or {}).items():
        sid = scan_id if scan_id is not None else name
        parts.append(detect_columns.scan_table(df, name, order_by, scan_id=sid, entities=entities))
    plugged = hooks.run_detectors(src, detectors)
    names = parts[0].columns
    if plugged is not None:  # in front: one that raises ends the run before the others' tasks
        parts.insert(0, plugged.select(*FINDING_COLUMNS))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*names)


def scan_files(spark: SparkSession, path: str, scan_id: str = "scan", detectors: dict[str, hooks.Detector] | None = None) -> DataFrame:
    """Detection findings of the files under ``path``, of any size: those that
    ``route_detectors`` gives of the files read whole.

    Text rules take the files' lines by splits, the column scan takes CSV
    records and JSON elements by splits; only C# sources (and every source, if
    there are plug-in detectors) are read whole.  A file whose lines cannot be
    read fails the scan."""
    parts = [detect_text.scan_lines(splits.numbered_lines(spark, path).withColumn("scan_id", F.lit(scan_id)))]
    for pattern, cells in (("*.[cC][sS][vV]", splits.csv_cells), ("*.[jJ][sS][oO][nN]", lambda *a: object_cells(splits.json_objects(*a)))):
        parts.append(detect_columns.scan_columns(cells(spark, path, scan_id, pattern)))
    whole = read_sources(spark, path, None if hooks.registered_detectors() or detectors else "*.[cC][sS]").withColumn("scan_id", F.lit(scan_id))
    parts.append(detect_code.scan_code(whole.where(is_csharp(F.col("file_name"), guess_language(F.col("file_name"))))))
    plugged = hooks.run_detectors(whole, detectors)
    if plugged is not None:
        parts.append(plugged.select(*FINDING_COLUMNS))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def validate_policy_requests(requests: DataFrame, clauses: DataFrame) -> DataFrame:
    """Requests whose policy id is neither ``ALL`` (any case) nor an existing
    policy (case-insensitive): the ones to reject."""
    names = clauses.select(F.lower(F.col("policy_name")).alias("_p")).distinct()
    cand = requests.where(F.upper(F.coalesce(F.col("policy_id"), F.lit(""))) != R.ALL_POLICIES)
    return cand.join(names, F.lower(cand["policy_id"]) == names["_p"], "left_anti")


def scan(
    sources: DataFrame,
    clauses: DataFrame,
    datasets: dict[str, tuple[DataFrame, str | list[str]]] | None = None,
    scans: DataFrame | None = None,
    reasoner=None,
    embedder: hooks.Embedder | None = None,
    detectors: dict[str, hooks.Detector] | None = None,
    entities: hooks.EntityHook | None = None,
) -> DataFrame:
    """Detect, cite and reason: the findings table of one or many scans.  With
    an ``embedder`` clauses and queries get vectors and retrieval is by
    cosine."""
    found = route_detectors(sources, datasets, detectors=detectors, entities=entities)
    idx = enrich.embedded_index(clauses, embedder)
    if scans is not None:
        found = enrich.attach_scan_policy(found, scans)
        return enrich.enrich(found, idx, policy_id=F.col("scan_policy_id"), reasoner=reasoner, embedder=embedder).drop("scan_policy_id")
    return enrich.enrich(found, idx, reasoner=reasoner, embedder=embedder)
