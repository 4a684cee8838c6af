import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from callgrain.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def eval_col(spark):
    """Values of a column function over a list of texts, in order."""

    def run(fn, texts):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        return [r["v"] for r in df.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]

    return run
