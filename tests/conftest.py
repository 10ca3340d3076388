import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loomsift.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", "loomsift-tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def apply(spark):
    """Apply a column function to one text or a list of texts."""
    from pyspark.sql import functions as F

    def run(fn, *texts):
        rows = [(i, t) for i, t in enumerate(texts)]
        out = spark.createDataFrame(rows, "i int, t string").select("i", fn(F.col("t")).alias("o")).orderBy("i").collect()
        return out[0].o if len(texts) == 1 else [r.o for r in out]
    return run
