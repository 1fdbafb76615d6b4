import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from habitscope.session import tune  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return tune(session)


@pytest.fixture(scope="session")
def folder():
    return FOLDER


def table(frame, *order):
    """Rows as sorted tuples with doubles rounded."""
    order = order or tuple(frame.columns)
    rows = [
        tuple(round(v, 8) if isinstance(v, float) else v for v in row) for row in frame.select(*order).collect()
    ]
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))
