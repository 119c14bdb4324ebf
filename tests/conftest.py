import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from checks.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(8)


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def column_of(spark):
    """Apply a column function to a list of strings, keeping their order."""
    from pyspark.sql import functions as F

    def apply(function, values):
        df = spark.createDataFrame(list(enumerate(values)), "i long, x string")
        rows = df.select("i", function(F.col("x")).alias("y")).collect()
        return [r.y for r in sorted(rows, key=lambda r: r.i)]

    return apply
