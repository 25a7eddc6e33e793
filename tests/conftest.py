import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from signalsieve.session import local_session

    session = local_session(8, shuffle_partitions=4)
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def values(spark):
    """values(fn, inputs): fn applied to a string column holding the inputs, in order."""
    from pyspark.sql import functions as F

    def run(fn, inputs):
        rows = spark.createDataFrame(list(enumerate(inputs)), "i int, x string")
        return [r.y for r in rows.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]

    return run
