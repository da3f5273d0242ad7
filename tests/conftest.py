import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from qacorpus.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Apply a column function to texts: values(fn, ["a", None]) -> list."""
    from pyspark.sql import functions as F

    def run(fn, texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        return [r["x"] for r in df.select("i", fn(F.col("t")).alias("x")).orderBy("i").collect()]

    return run


@pytest.fixture
def pairs(spark):
    """Apply a two-column function to (question, answer) rows."""
    from pyspark.sql import functions as F

    def run(fn, rows):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, q string, a string")
        return [r["x"] for r in df.select("i", fn(F.col("q"), F.col("a")).alias("x")).orderBy("i").collect()]

    return run
