"""Helpers shared by the operators of this package."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_path

#: Rows that a task handles at once in the Arrow operators.
SLICE_ROWS = 256

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that
    functions pickled by reference import there wherever the job runs."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="redline-py-"), f"{root.name}.zip")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    Path(path).write_bytes(data.getvalue())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder named by
    ``spark.checkpoint.dir`` and read it back.  Cuts the lineage: later stages
    and retries after a lost executor read the files."""
    path = f"{checkpoint_path(df.sparkSession, 'llm')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: Column | str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def slices(batches: Iterator, rows: int = SLICE_ROWS) -> Iterator:
    """Arrow record batches cut into slices of at most ``rows`` rows."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def sized_slices(batches: Iterator, column: int, size: int) -> Iterator:
    """Arrow record batches cut into slices whose strings in ``column`` have
    ``size`` bytes or little more; a slice has one row at least."""
    for b in batches:
        lengths = pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        upto, at = np.cumsum(lengths, dtype=np.int64), 0
        while at < b.num_rows:
            done = int(upto[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(upto, done + size, "right")))
            yield b.slice(at, to - at)
            at = to
