"""The states of scans as a stateful stream.

Events: ``scan_id, kind, n_files, message, at``.  A ``request`` names the number
of files of a scan, ``scanned`` how many were scanned in a batch, ``failed`` why
the scan failed; a ``clock`` row (of no scan) only moves the time on.

    request → PENDING → scanned → SCANNING → all files scanned → DONE
    failed → ERROR with its message;  no progress for ``timeout`` → ERROR

``DONE`` and ``ERROR`` are final.  State is one small row a scan, kept by
``transformWithState``; a timer in event time ends scans without progress,
another forgets final ones after ``keep``.  Events that come later than the
watermark (``delay``) are dropped, as the file sinks of the scans write them in
order.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..session import ship_package

EVENTS = "scan_id string, kind string, n_files long, message string, at timestamp"
STATES = "scan_id string, step long, status string, error_message string, at timestamp"
_STATE = "status string, expected long, seen long, step long"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FINAL = ("DONE", "ERROR")
_ORDER = {"request": 0, "scanned": 1, "failed": 2}


class Lifecycle(StatefulProcessor):
    def __init__(self, timeout_s: float, keep_s: float):
        self.timeout_ms, self.keep_ms, self.timeout_s = int(timeout_s * 1000), int(keep_s * 1000), timeout_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", _STATE)

    def _timer(self, at_ms: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        if key[0] is None:  # the clock
            return
        frame = frame.assign(order=frame["kind"].map(_ORDER)).dropna(subset=["order"]).sort_values(["at", "order"])
        status, expected, seen, step = self.state.get() if self.state.exists() else (None, None, 0, 0)
        out, last = [], None
        for kind, n, message, at in zip(frame["kind"], frame["n_files"], frame["message"], frame["at"]):
            if status in _FINAL:
                break
            n, new, why = 0 if pd.isna(n) else int(n), status, None
            if kind == "request":
                expected, new = n, status or "PENDING"
            elif kind == "scanned":
                seen, new = seen + n, "SCANNING"
            else:
                new, why = "ERROR", message
            path = [new] if new != status else []
            if new != "ERROR" and expected is not None and seen >= expected:
                path.append("DONE")
            for status in path:
                step += 1
                out.append((key[0], step, status, why, at))
            last = at
        if last is not None:
            self.state.update((status, expected, seen, step))
            last_ms = int(pd.Timestamp(last).timestamp() * 1000)
            self._timer(last_ms + (self.keep_ms if status in _FINAL else self.timeout_ms))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in STATES.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        status, expected, seen, step = self.state.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if status in _FINAL:
            self.state.clear()
            return
        self.state.update(("ERROR", expected, seen, step + 1))
        self.handle.registerTimer(at + self.keep_ms)
        why = f"no progress for {self.timeout_s:g} s in {status}"
        yield pd.DataFrame([(key[0], step + 1, "ERROR", why, pd.Timestamp(at, unit="ms"))], columns=[c.split()[0] for c in STATES.split(", ")])

    def close(self) -> None:
        pass


def lifecycle(events: DataFrame, timeout: timedelta, keep: timedelta = timedelta(days=7), delay: timedelta = timedelta(0)) -> DataFrame:
    """The state changes (``STATES``) that a stream of ``EVENTS`` makes."""
    spark = events.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)  # transformWithState needs it
    rows = events.select("scan_id", "kind", "n_files", "message", "at").withWatermark("at", f"{delay.total_seconds():g} seconds")
    return rows.groupBy("scan_id").transformWithStateInPandas(Lifecycle(timeout.total_seconds(), keep.total_seconds()), STATES, "Update", "EventTime")


def write_events(events: DataFrame, run_dir: str) -> None:
    """Append events of ``EVENTS`` (requests, clock) to those of a run."""
    names = [c.split()[0] for c in EVENTS.split(", ")]
    events.select(*names).coalesce(1).write.mode("append").parquet(f"{run_dir}/events/by=caller")


def start_lifecycle(
    spark: SparkSession, run_dir: str, timeout: timedelta = timedelta(hours=1), keep: timedelta = timedelta(days=7),
    delay: timedelta = timedelta(0), available_now: bool = True,
) -> StreamingQuery:
    """Follow the events of a run (those of ``start_scan_stream`` and of
    ``write_events``) and write the state changes to ``run_dir/states``, by
    batch id: a batch that runs again replaces what it wrote."""
    events = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(f"{run_dir}/events")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{run_dir}/states/batch_id={batch_id}")

    w = lifecycle(events, timeout, keep, delay).writeStream.foreachBatch(write).outputMode("update")
    w = w.option("checkpointLocation", f"{run_dir}/lifecycle-ckpt")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()


def states(spark: SparkSession, run_dir: str) -> DataFrame:
    """The newest state of every scan: ``scan_id, status, error_message``."""
    rows = spark.read.schema(STATES).parquet(f"{run_dir}/states")
    last = rows.groupBy("scan_id").agg(F.max_by(F.struct("status", "error_message"), "step").alias("v"))
    return last.select("scan_id", "v.status", "v.error_message")
