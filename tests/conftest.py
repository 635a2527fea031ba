import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .appName("specflow-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


@pytest.fixture
def lines(spark):
    """Text lines as a numbered line frame."""

    def make(*rows, header=None):
        data = [(None, i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame(data, "_file string, _seq bigint, _raw string")

    return make


@pytest.fixture
def records(spark):
    """One-row record frame from field values."""
    from specflow.operators.records import from_columns

    def make(spec, *rows):
        names = [f.name for f in spec.fields]
        data = [tuple(r.get(n) for n in names) + (i,) for i, r in enumerate(rows)]
        frame = spark.createDataFrame(data, ", ".join(f"`{n}` string" for n in names) + ", k bigint")
        return from_columns(frame, spec, seq="k")

    return make
