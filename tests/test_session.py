import pytest

from tablekeep.plans import settled
from tablekeep.session import scratch_dir


class Session:
    def __init__(self, **conf):
        self.conf = {key.replace("_", "."): value for key, value in conf.items()}


def test_scratch_lies_in_the_shared_folder():
    session = Session(spark_master="yarn", spark_checkpoint_dir="hdfs://x/shared/")
    first, second = scratch_dir(session, "a"), scratch_dir(session, "a")
    assert first.startswith("hdfs://x/shared/a-") and first != second


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(Session(spark_master="yarn"), "a")
    assert scratch_dir(Session(spark_master="local[2]"), "a").startswith("/tmp/run-")


def test_settled_tables_are_small_to_the_planner(spark):
    assert "parquet" in settled.settle(spark.range(3), "x")._jdf.queryExecution().optimizedPlan().toString()
    rows = spark.createDataFrame([(1,)], "id long")
    assert "parquet" in settled.settle(rows, "x")._jdf.queryExecution().optimizedPlan().toString()
