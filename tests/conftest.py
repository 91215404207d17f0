import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark():
    from refaudit.session import build_session
    s = build_session("tests", "local[8]", spark_ui_enabled="false", spark_sql_shuffle_partitions="4", spark_driver_memory="8g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def each(spark):
    """each(expr, *values): the column expression applied to every string."""
    from pyspark.sql import functions as F

    def run(expr, *values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, a string")
        return [r[1] for r in df.select("i", expr(F.col("a"))).orderBy("i").collect()]
    return run
