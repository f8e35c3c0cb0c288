from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from pathloom.operators.joins import fits_broadcast
from pathloom.session import shared_dir


def session(master, folder=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda p: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: folder), sparkContext=context)


@pytest.mark.parametrize("master", ["yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://x"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError):
        shared_dir(session(master))
    assert shared_dir(session(master, "s3://b/c/")) == "s3://b/c"


def test_sizes_are_counted_where_the_rows_are(spark):
    df = spark.range(1000).withColumn("a", F.array_repeat(F.lit("x" * 100), 10))
    assert fits_broadcast(df) and not fits_broadcast(df, 999)
    assert not fits_broadcast(spark.range(70_000).withColumn("b", F.repeat(F.lit("y"), 1000).cast("binary")))
