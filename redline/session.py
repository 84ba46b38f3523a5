"""Spark session helpers.

The library never builds its own cluster configuration: jobs take the
session they are given.  ``local_session`` is for tests, benches and the
driver smoke check only.
"""

from __future__ import annotations

import math
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "redline") -> SparkSession:
    """A local session with AQE on and the UI off (tests and benches)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names a shared folder and is used as is; without
    it the job fails.  Only on a ``local`` master a scratch folder is created
    and set when it is unset (tests).
    """
    current = spark.conf.get(CHECKPOINT_CONF, None)
    if not current:
        master = spark.conf.get("spark.master", "")
        if master and not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that driver and executors share")
        current = tempfile.mkdtemp(prefix="redline-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set(CHECKPOINT_CONF, current)
    try:
        sc = spark.sparkContext
    except Exception:  # a Connect session has no SparkContext to configure
        return current
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder (for written tables and
    streaming checkpoints)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def qualified_path(spark: SparkSession, path: str) -> str:
    """``path`` as Spark's file listing spells it (scheme and all)."""
    hadoop, fs = _file_system(spark, path)
    return fs.makeQualified(hadoop).toString()


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is a folder in whichever store it names."""
    hadoop, fs = _file_system(spark, path)
    return bool(fs.exists(hadoop) and fs.getFileStatus(hadoop).isDirectory())


def spread_for_cpu(df: DataFrame) -> DataFrame:
    """Round-robin ``df`` over the cluster's cores when its scan gives fewer
    partitions than that (few large files or row groups).  At scale the file
    scan already yields many splits and nothing is added.  Call it after the
    cheap filters, so only candidate rows move."""
    if df.isStreaming:
        return df
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        splits = df.rdd.getNumPartitions()
    except Exception:  # no RDD view (e.g. a Connect session): leave as is
        return df
    if splits < cores:
        return df.repartition(cores)
    return df


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage, so
    several consumers read the result instead of recomputing it (and a lost
    executor does not send the job back to the source scan)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes that a task reads at least when there are far more splits than cores.
TASK_BYTES = 16 * 1024 * 1024


def gathered(scan: DataFrame) -> DataFrame:
    """Splits of a file scan far smaller than ``TASK_BYTES`` share tasks; each
    stays a split."""
    spark, n = scan.sparkSession, scan.rdd.getNumPartitions()
    size = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get("spark.sql.files.maxPartitionBytes").strip().lower())
    total = n * (int(size[1]) << 10 * " kmgtp".index(size[2] or " "))
    tasks = max(4 * spark.sparkContext.defaultParallelism, math.ceil(total / TASK_BYTES))
    return scan.coalesce(tasks) if n > tasks else scan


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read back:
    as ``materialize``, for tables of which later steps read some columns only
    (the planner knows their size)."""
    path = checkpoint_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return gathered(df.sparkSession.read.schema(df.schema).parquet(path))


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application: functions of
    its modules that run in tasks are imported there."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="redline-py-"), f"{root.name}.zip")  # read by the driver alone
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
