"""Scans of a stream: a failing one stays alone, states follow events and time."""

import datetime as dt

import duckdb
import pandas as pd
from pyspark.sql import functions as F
from samples import SF_SMALL

from redline.operators.detect_text import scan_text
from redline.plans import derived
from redline.plans.scan import route_detectors
from redline.schemas import FINDINGS
from redline.sources.policies import load_policy_clauses
from redline.streaming import lifecycle
from redline.streaming.scan import failure_message, scan_states, start_scan_stream

SOURCES = "source_id string, file_name string, content string, language string, scan_id string"


def raising_detector(bad):
    """A pandas plug-in that finds nothing and raises on texts with ``bad``."""

    def run(batches):
        for frame in batches:
            if frame["content"].str.contains(bad).any():
                raise ValueError(f"cannot read {bad}")
            yield pd.DataFrame(columns=FINDINGS.fieldNames())

    return lambda sources: sources.mapInPandas(run, FINDINGS)


def test_a_failing_scan_leaves_the_others_alone(spark, scratch):
    rows = [(str(i), f"f{i}.txt", f"mail a{i}@b.io" + (" poison" if i % 6 == 4 else ""), None, f"s{i % 6}") for i in range(12)]
    src = spark.createDataFrame(rows, SOURCES)
    src.coalesce(1).write.parquet(f"{scratch}/landing")
    stream = spark.readStream.schema(src.schema).parquet(f"file://{scratch}/landing")
    start_scan_stream(stream, load_policy_clauses(spark), f"{scratch}/run", detectors={"p": raising_detector("poison")}).awaitTermination()
    states = {r.scan_id: (r.status, r.error_message) for r in scan_states(spark, f"{scratch}/run").collect()}
    assert states == {f"s{i}": ("ERROR", "ValueError: cannot read poison") if i == 4 else ("DONE", None) for i in range(6)}
    found = spark.read.parquet(f"{scratch}/run/findings").collect()
    assert sorted(r.file_name for r in found) == sorted(f"f{i}.txt" for i in range(12) if i % 6 != 4)
    events = {(r.scan_id, r.kind, r.n_files) for r in spark.read.parquet(f"{scratch}/run/events").collect()}
    assert events == {(f"s{i}", "failed" if i == 4 else "scanned", 2) for i in range(6)}


def test_failure_messages():
    assert failure_message(Exception("  File x\nTraceback\nbuiltins.ValueError: a\n b\nRuntimeError: b c\n more")) == "RuntimeError: b c"
    assert failure_message(Exception("[USER_RAISED_EXCEPTION] X is bad SQLSTATE: P0001\nmore")) == "X is bad"
    assert failure_message(KeyError()) == "KeyError"


def test_states_follow_events_and_time(spark, scratch):
    t0 = dt.datetime(2030, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    batches = [
        [("done", "request", 2, None, at(0)), ("slow", "request", 2, None, at(0)), ("bad", "request", 1, None, at(0)), ("asked", "request", 1, None, at(0))],
        [("done", "scanned", 1, None, at(10)), ("slow", "scanned", 1, None, at(10)), ("bad", "failed", 1, "broken", at(11)), ("unasked", "scanned", 5, None, at(12))],
        [("done", "scanned", 1, None, at(30)), ("bad", "scanned", 1, None, at(31)), ("empty", "request", 0, None, at(40))],
        [(None, "clock", None, None, at(65))],  # "asked" is over, "slow" is not
        [("slow", "scanned", 1, None, at(66)), ("asked", "scanned", 1, None, at(67))],
        [(None, "clock", None, None, at(300))],
    ]
    run = f"{scratch}/run"
    for rows in batches:
        lifecycle.write_events(spark.createDataFrame(rows, lifecycle.EVENTS), run)
        lifecycle.start_lifecycle(spark, run, timeout=dt.timedelta(seconds=60), keep=dt.timedelta(days=1)).awaitTermination()
    got = {r.scan_id: (r.status, r.error_message) for r in lifecycle.states(spark, run).collect()}
    assert got == {
        "done": ("DONE", None), "slow": ("DONE", None), "bad": ("ERROR", "broken"), "empty": ("DONE", None),
        "asked": ("ERROR", "no progress for 60 s in PENDING"), "unasked": ("ERROR", "no progress for 60 s in SCANNING"),
    }
    steps = spark.read.parquet(f"{run}/states").where("scan_id = 'slow'").orderBy("step").collect()
    assert [(r.step, r.status) for r in steps] == [(1, "PENDING"), (2, "SCANNING"), (3, "DONE")]


def test_lifecycle_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    want = con.sql(f"SELECT scan_id, status, error_message FROM ({derived.oracle_sql()['scan_lifecycle']})").fetchall()
    got = [tuple(r) for r in derived.scan_lifecycle(spark, SF_SMALL).select("scan_id", "status", "error_message").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_plug_ins_come_first(spark):
    """The tasks of a raising plug-in run before those of the whole scan."""
    src = spark.createDataFrame([("1", "f.txt", "mail a@b.io", None, "s"), ("2", "g.txt", "mail c@d.io", None, "s")], SOURCES)
    plug = lambda sources: scan_text(sources).withColumn("detected_by", F.lit("P"))
    found = route_detectors(src, detectors={"p": plug})
    assert [r.detected_by == "P" for r in found.collect()] == [True, True, False, False]
    assert found.columns == route_detectors(src, detectors={}).columns
