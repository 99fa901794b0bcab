import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from checks.compare import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session("8")
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


@pytest.fixture
def one(spark):
    """Evaluate Columns on a single row."""

    def evaluate(*columns):
        row = spark.range(1).select(*columns).first()
        return row[0] if len(columns) == 1 else tuple(row)

    return evaluate


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="session")
def as_rows():
    return rows
