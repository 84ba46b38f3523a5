"""Code rules over a code corpus (no shuffle).

* ``sensitive_literal_assignment``: ``name = "literal"`` (or ``+=``) where the
  name is sensitive; ``this.name = "x"`` is caught through its last member.
* ``pii_in_logging`` / ``pii_in_http_call``: a member call ``x.Method(args)``
  whose method is a logging call (``Log*``, ``Console.Write*``) or one of the
  HTTP client methods, with at least one argument holding a sensitive
  identifier; one finding per call, also for calls inside the arguments of
  another one (lambdas, handlers, nested calls).

Literals are a text rule per line.  Calls come from one linear pass over a
source's tokens (``functions/calls.py``): nesting has no text expression, so
this is Arrow code in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calls
from ..functions import rules as R
from ..functions.code import LITERAL_ASSIGNMENT, classify_identifier, is_http_call, is_logging_call
from ..functions.text import split_lines, trim_ws
from ..schemas import detection_finding
from ..session import ship_package

RULE_LOGGING = 101
RULE_HTTP = 102
RULE_LITERAL = 103


def with_scan_id(sources: DataFrame, scan_id: str | None) -> DataFrame:
    """Sources with a ``scan_id`` column: the given literal, else the
    column already present, else ``'scan'``."""
    if scan_id is not None or "scan_id" not in sources.columns:
        return sources.withColumn("scan_id", F.lit(scan_id or "scan"))
    return sources


def _lines(sources: DataFrame, prefilter: str | None) -> DataFrame:
    return sources.where(F.col("content").isNotNull()).select(
        "scan_id", "file_name", F.explode(split_lines(F.col("content"), prefilter)).alias("l")
    ).select("scan_id", "file_name", F.col("l.line_no").alias("line_no"), F.col("l.line").alias("line"))


def _finding(dtype: Column, rule_ord: Column, match_ord: Column, created_at):
    return detection_finding(
        scan_id=F.col("scan_id"),
        data_type=dtype,
        location=F.concat(F.col("file_name"), F.lit(":"), F.col("line_no").cast("string")),
        file_name=F.col("file_name"),
        line_no=F.col("line_no"),
        column_name=F.lit(None).cast("string"),
        rule_ord=rule_ord,
        match_ord=match_ord,
        snippet=trim_ws(F.col("line")),
        detected_by=F.lit(R.DETECTED_BY_CODE),
        created_at=created_at,
    )


def literal_assignments(sources: DataFrame) -> DataFrame:
    """Every ``name = "literal"`` in every line with its classification:
    ``(file_name, line_no, line, match_ord, identifier, data_type)``."""
    lines = _lines(with_scan_id(sources, None), r'=\s*@?"')
    names = F.regexp_extract_all(F.col("line"), F.lit(LITERAL_ASSIGNMENT), 1)
    return lines.select(
        "scan_id", "file_name", "line_no", "line", F.posexplode(names).alias("pos", "identifier")
    ).select(
        "scan_id",
        "file_name",
        "line_no",
        "line",
        (F.col("pos") + 1).cast("int").alias("match_ord"),
        "identifier",
        classify_identifier(F.col("identifier")).alias("data_type"),
    )


def sensitive_literal_assignment(
    sources: DataFrame, scan_id: str | None = None, created_at: Column | None = None
) -> DataFrame:
    hits = literal_assignments(with_scan_id(sources, scan_id)).where(F.col("data_type").isNotNull())
    return hits.select(*_finding(F.col("data_type"), F.lit(RULE_LITERAL), F.col("match_ord"), created_at))


CALLS = "scan_id string, file_name string, line_no int, line string, call_ord int, receiver string, method string, data_type string"


def _calls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in CALLS.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
    for b in batches:
        for scan_id, file_name, content in zip(*(b.column(i).to_pylist() for i in range(3))):
            lines = content.split("\n")
            rows = [
                (scan_id, file_name, line, lines[line - 1].rstrip("\r"), i + 1, receiver, method, found)
                for i, (line, receiver, method, found) in enumerate(calls.member_calls(content))
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def member_calls(sources: DataFrame) -> DataFrame:
    """Member calls with arguments of every source: ``(scan_id, file_name,
    line_no, line, call_ord, receiver, method, data_type)``, the data type of
    the first sensitive name in the arguments.  A call may span lines and nest
    to any depth; an outer call comes before those in its arguments."""
    src = with_scan_id(sources, None).where(F.col("content").rlike(r"\.\s*[A-Za-z_@][A-Za-z0-9_]*\s*[(<]"))
    ship_package(src.sparkSession)
    rows = src.select(F.col("scan_id").cast("string").alias("scan_id"), "file_name", "content")
    return rows.mapInArrow(_calls, CALLS)


def sensitive_calls(
    sources: DataFrame, scan_id: str | None = None, created_at: Column | None = None
) -> DataFrame:
    """``pii_in_logging`` and ``pii_in_http_call`` findings."""
    found = member_calls(with_scan_id(sources, scan_id)).where(F.col("data_type").isNotNull())
    logging = is_logging_call(F.col("receiver"), F.col("method"))
    http = is_http_call(F.col("method"))
    flagged = found.where(F.coalesce(logging, F.lit(False)) | http).withColumn(
        "kind", F.when(logging, F.lit(RULE_LOGGING)).otherwise(F.lit(RULE_HTTP))
    )
    return flagged.select(*_finding(F.col("data_type"), F.col("kind"), F.col("call_ord"), created_at))


def scan_code(sources: DataFrame, scan_id: str | None = None, created_at: Column | None = None) -> DataFrame:
    """All code-rule findings of the given (C#) sources."""
    return sensitive_calls(sources, scan_id, created_at).unionByName(
        sensitive_literal_assignment(sources, scan_id, created_at)
    )
