"""Continuous scanning with Structured Streaming.

* ``start_stream_scan`` (landed table rows) and ``start_file_stream_scan``
  (landed files, each read whole): → ``scan_text`` (stateless, append) →
  Parquet sink with a checkpoint in the shared checkpoint folder.
  Exactly-once through the file sink's log.
* ``start_scan_stream``: every micro-batch goes through the whole scan (all
  detectors, citation, reasoning) in ``foreachBatch``; its findings and its
  lifecycle rows (PENDING, SCANNING, then DONE or ERROR, one row a scan) are
  written to the folder of the batch id, so a batch that runs again replaces
  what it wrote.  A scan that fails gets an ERROR row with its message, the
  others of the batch go on (``scan_apart``).  A failure that is no scan's
  (a hook that cannot be built, a batch without one scan that passes) leaves
  ERROR rows and stops the query; its offset is not committed, so a restart
  runs it again.  ``streaming.lifecycle`` follows scans over batches.
* ``start_running_score``: per-scan CRITICAL/HIGH counts and the compliance
  score in update mode, written by batch id in the same way (new totals of the
  changed scans).  ``latest_scores`` reads the newest total per scan.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.reason import default_severity
from ..functions.report import compliance_from_counts
from ..hooks import run_detectors
from ..operators.detect_text import scan_text
from ..session import checkpoint_path, is_folder
from ..sources.files import as_sources

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Stream of ``documents`` rows from a landing folder; a path naming a
    single file (in whichever store) streams that file's folder filtered to
    its name."""
    reader = spark.readStream.schema(DOC_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
    if path.endswith(".parquet") and not is_folder(spark, path):
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def start_stream_scan(
    spark: SparkSession, path: str, out_dir: str, ckpt_dir: str, available_now: bool = True, max_files_per_trigger: int = 1
) -> StreamingQuery:
    src = as_sources(documents_stream(spark, path, max_files_per_trigger), "doc_id", "text", "documents/", scan_col="source")
    findings = scan_text(src).drop("fix_args")
    w = findings.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", ckpt_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.outputMode("append").start()


def file_sources_stream(spark: SparkSession, landing_dir: str, scan_id: str = "stream", max_files_per_trigger: int = 100) -> DataFrame:
    """Stream of newly landed files, each read whole as one ``sources`` row
    (name from the file metadata, language guessed from the extension)."""
    from ..sources.files import guess_language

    raw = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(landing_dir, wholetext=True)
    name = F.col("_metadata.file_name")
    return raw.select(
        F.sha2(F.col("_metadata.file_path"), 256).substr(1, 16).alias("source_id"),
        name.alias("file_name"),
        F.col("value").alias("content"),
        guess_language(name).alias("language"),
        F.lit(scan_id).alias("scan_id"),
    )


def start_file_stream_scan(
    spark: SparkSession, landing_dir: str, out_dir: str, ckpt_dir: str, scan_id: str = "stream", available_now: bool = True
) -> StreamingQuery:
    """Text-rule scan of files as they land in ``landing_dir`` (append)."""
    findings = scan_text(file_sources_stream(spark, landing_dir, scan_id)).drop("fix_args")
    w = findings.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", ckpt_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.outputMode("append").start()


def stream_scan_table(spark: SparkSession, path: str) -> DataFrame:
    """Run the stream scan to completion over what is there and read the
    sink back."""
    run = checkpoint_path(spark, f"stream-scan-{uuid.uuid4().hex[:12]}")
    q = start_stream_scan(spark, path, f"{run}/out", f"{run}/ckpt")
    q.awaitTermination()
    return spark.read.parquet(f"{run}/out")


def _score_updates(findings: DataFrame) -> DataFrame:
    sev = default_severity(F.col("data_type"))
    return findings.groupBy("scan_id").agg(
        F.count(F.when(sev == "CRITICAL", 1)).cast("bigint").alias("critical"),
        F.count(F.when(sev == "HIGH", 1)).cast("bigint").alias("high"),
        F.count(F.lit(1)).cast("bigint").alias("total"),
    )


def start_running_score(spark: SparkSession, path: str, run_dir: str, available_now: bool = True, max_files_per_trigger: int = 1) -> StreamingQuery:
    src = as_sources(documents_stream(spark, path, max_files_per_trigger), "doc_id", "text", "documents/", scan_col="source")
    updates = _score_updates(scan_text(src))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("scan_id", "critical", "high", "total", compliance_from_counts(F.col("critical"), F.col("high")).alias("compliance_score"))
        rows.write.mode("overwrite").parquet(f"{run_dir}/scores/batch_id={batch_id}")

    w = updates.writeStream.outputMode("update").foreachBatch(write_batch).option("checkpointLocation", f"{run_dir}/ckpt")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()


def failure_message(exc: Exception) -> str:
    """What went wrong, in a line: the last error named in the text (that of the
    Python worker, if it raised), else its first line."""
    text = str(exc)
    named = re.findall(r"^(?:\w+\.)*(\w*(?:Error|Exception): [^\n]+)", text, re.M)
    line = named[-1] if named else (text.strip().splitlines() or [type(exc).__name__])[0]
    return re.sub(r"^\[[A-Z_.]+\] | SQLSTATE: \w+$", "", line)[:2000]


#: Halvings of a batch to find the scans that fail (by the hash of their ids).
HALVINGS = 48


def failing_scans(sources: DataFrame, run: Callable[[DataFrame], None]) -> DataFrame | None:
    """The scans of ``sources`` for which ``run`` fails in its execution, with
    their ``error_message`` (None: no scan).  All are tried together, then,
    where they fail, either half of them, down to single scans.  A plan that
    cannot be built raises: it concerns all scans."""
    spark = sources.sparkSession
    failed: list[tuple[int, int, str]] = []
    todo = [(0, 0)]  # the scans whose hash has this value in its lowest ``bits`` bits
    while todo:
        bits, value = todo.pop()
        part = sources.where(F.pmod(F.xxhash64("scan_id"), F.lit(1 << bits)) == value) if bits else sources
        several = part.select("scan_id").distinct().limit(2).count()
        if not several:
            continue
        try:
            run(part)
        except (PySparkException, Py4JJavaError) as exc:
            if isinstance(exc, AnalysisException):
                raise
            if several == 1 or bits == HALVINGS:
                failed.append((bits, value, failure_message(exc)))
            else:
                todo += [(bits + 1, value), (bits + 1, value + (1 << bits))]
    if not failed:
        return None
    cases = spark.createDataFrame(failed, "bits int, value long, error_message string")  # a row a failure
    on = F.pmod(F.xxhash64("scan_id"), F.pow(F.lit(2), F.col("bits")).cast("long")) == F.col("value")
    return sources.select("scan_id").distinct().join(F.broadcast(cases), on).select("scan_id", "error_message")


def scan_apart(
    sources: DataFrame, write: Callable[[DataFrame], None], cut: Callable[[DataFrame], DataFrame], probe: Callable[[DataFrame], None] | None = None
) -> DataFrame | None:
    """Scan all scans of ``sources`` but those that fail; these are returned with
    their ``error_message`` (None: no scan failed).

    ``write`` scans and writes what it is given, in the place of what it wrote
    before.  If it fails in its execution, the failing scans are looked for with
    ``probe`` (the plug-in detectors alone), or with ``write`` itself where that
    finds none, and the others, a copy made by ``cut`` (the optimiser may move a
    detector's filter before theirs), are scanned again.  If no scan is left of
    several, the failure is not a scan's and is raised.
    """
    several = sources.select("scan_id").distinct().limit(2).count() > 1
    errors, rest = None, sources
    for run in ([probe] if probe else []) + [write, None]:
        try:
            write(rest)
            return errors
        except (PySparkException, Py4JJavaError) as exc:
            if run is None or isinstance(exc, AnalysisException):
                raise
            found = failing_scans(rest, run)
            if found is None:
                continue
            rest = cut(rest.join(found, "scan_id", "left_anti"))
            errors = found if errors is None else errors.unionByName(found)
            if several and rest.isEmpty():
                raise


def start_scan_stream(
    sources: DataFrame,
    clauses: DataFrame,
    run_dir: str,
    scans: DataFrame | None = None,
    available_now: bool = True,
    **hooks,
) -> StreamingQuery:
    """The whole scan over a stream of ``sources`` rows (with ``scan_id``):
    findings in ``run_dir/findings``, lifecycle rows in ``run_dir/lifecycle``,
    events of ``streaming.lifecycle`` in ``run_dir/events``.  ``hooks`` are those
    of ``plans.scan.scan``."""
    from ..plans.scan import scan

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # the batch is read by several detectors: one copy in the shared folder
        landed = f"{run_dir}/landed/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(landed)
        batch = spark.read.schema(batch.schema).parquet(landed)
        counted = batch.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n_files"))

        def mark(step: int, status: str | None, errors: DataFrame | None = None, message: str | None = None) -> None:
            rows = counted.withColumn("error_message", F.lit(message).cast("string"))
            if errors is not None:
                rows = counted.join(errors, "scan_id", "left")
            status_ = F.lit(status) if status else F.when(F.col("error_message").isNull(), "DONE").otherwise("ERROR")
            rows = rows.select("scan_id", "n_files", F.lit(step).alias("step"), status_.alias("status"), "error_message", F.current_timestamp().alias("at"))
            path = f"{run_dir}/lifecycle/batch_id={batch_id}/step_no={step}"
            rows.write.mode("overwrite").parquet(path)
            if step == 3:
                kind = F.when(F.col("status") == "DONE", "scanned").otherwise("failed")
                events = spark.read.schema(rows.schema).parquet(path).select("scan_id", kind.alias("kind"), "n_files", F.col("error_message").alias("message"), "at")
                events.coalesce(1).write.mode("overwrite").parquet(f"{run_dir}/events/batch_id={batch_id}")

        def write(part: DataFrame) -> None:
            found = scan(part, clauses, scans=scans, **hooks)
            found.write.mode("overwrite").parquet(f"{run_dir}/findings/batch_id={batch_id}")

        def cut(part: DataFrame) -> DataFrame:
            path = f"{landed}-{uuid.uuid4().hex}"
            part.write.parquet(path)
            return spark.read.schema(part.schema).parquet(path)

        def probe(part: DataFrame) -> None:
            plugged = run_detectors(part, hooks.get("detectors"))
            if plugged is not None:
                plugged.write.format("noop").mode("overwrite").save()

        mark(1, "PENDING")
        mark(2, "SCANNING")
        try:
            errors = scan_apart(batch, write, cut, probe)
        except Exception as exc:
            mark(3, "ERROR", message=failure_message(exc))
            raise
        mark(3, None, errors)

    w = sources.writeStream.foreachBatch(write_batch).option("checkpointLocation", f"{run_dir}/ckpt")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()


def scan_states(spark: SparkSession, run_dir: str) -> DataFrame:
    """The newest lifecycle state of every scan."""
    rows = spark.read.option("basePath", f"{run_dir}/lifecycle").parquet(f"{run_dir}/lifecycle")
    last = rows.groupBy("scan_id").agg(F.max_by(F.struct("status", "error_message"), F.struct("batch_id", "step")).alias("v"))
    return last.select("scan_id", "v.status", "v.error_message")


def latest_scores(spark: SparkSession, run_dir: str) -> DataFrame:
    """Newest totals per scan from the upsert log (partial aggregation)."""
    s = spark.read.parquet(f"{run_dir}/scores")
    cols = ["critical", "high", "total", "compliance_score"]
    last = s.groupBy("scan_id").agg(F.max_by(F.struct(*cols), F.col("batch_id")).alias("v"))
    return last.select("scan_id", *[F.col(f"v.{c}").alias(c) for c in cols])


def running_score_table(spark: SparkSession, path: str) -> DataFrame:
    run = checkpoint_path(spark, f"running-score-{uuid.uuid4().hex[:12]}")
    q = start_running_score(spark, path, run)
    q.awaitTermination()
    return latest_scores(spark, run)
