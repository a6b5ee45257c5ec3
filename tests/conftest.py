import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from flowlane.session import DEFAULT_CONF
    b = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8")
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    # Tests run locally: the checkpoint folder is unset, so give it a fresh one.
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="flowlane-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def obs001(spark):
    from flowlane.sources.tables import observations
    return observations(spark, SF001)


@pytest.fixture
def tmpdir_path():
    return tempfile.mkdtemp(prefix="flowlane-test-")
