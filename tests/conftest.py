import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from tidewatch.session import local_session

    return local_session("4", 4)


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture
def logs_of(spark):
    """Table of (line_no, ingest_ts, line) from a list of lines."""

    def make(lines):
        rows = [(i, line) for i, line in enumerate(lines)]
        df = spark.createDataFrame(rows, "line_no bigint, line string")
        return df.selectExpr("line_no", "timestamp_ntz '2024-03-02 07:08:09' as ingest_ts", "line")

    return make
