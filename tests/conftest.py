import os
import sys

import numpy as np
import pytest
from pyspark.sql import SparkSession

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def blobs(spark):
    """Two Gaussian clouds, 200 rare rows against 3,200."""
    rng = np.random.default_rng(5)
    rare, usual = rng.normal(2.2, 1.0, (200, 2)), rng.normal(0.0, 1.0, (3200, 2))
    rows = [(i, int(i < 200), [float(x) for x in v]) for i, v in enumerate(np.vstack([rare, usual]))]
    return spark.createDataFrame(rows, "id long, label int, features array<double>").repartition(4).cache()
