import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]
# Python workers import functions pickled from the library and the tests
os.environ["PYTHONPATH"] = os.pathsep.join(
    [ROOT, os.path.dirname(os.path.abspath(__file__))] + [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    ckpt = tempfile.mkdtemp(prefix="redline-test-ckpt-")
    s = (
        SparkSession.builder.master("local[*]")
        .appName("redline-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", ckpt)
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from redline.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture
def scratch():
    return tempfile.mkdtemp(prefix="redline-test-")


@pytest.fixture
def mock_sources(spark):
    from samples import AUTH_CS, CONFIG_CS, CUSTOMERS_CSV, PATIENTS_CSV

    rows = [
        ("1", "customers.csv", CUSTOMERS_CSV, "csv"),
        ("2", "patients.csv", PATIENTS_CSV, "csv"),
        ("3", "auth.cs", AUTH_CS, "csharp"),
        ("4", "config.cs", CONFIG_CS, "csharp"),
    ]
    return spark.createDataFrame(rows, "source_id string, file_name string, content string, language string")
