import math

import numpy as np
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equipoise.functions.vectors import dimension, feature_summary, min_max, min_max_scale, min_max_unscale, standard_deviation


def test_scale_round_trip_constant_nan_sparse(spark):
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("features", VectorUDT())])
    rows = [(0, Vectors.dense(1.0, 5.0, float("nan"))), (1, Vectors.sparse(3, {1: 5.0})), (2, Vectors.dense(3.0, 5.0, 4.0))]
    df = spark.createDataFrame(rows, schema)
    assert dimension(df, "features") == 3
    bounds = min_max(df, "features")
    assert bounds == ([0.0, 5.0, 0.0], [3.0, 5.0, 4.0])
    scaled = {r["id"]: r["features"].toArray() for r in min_max_scale(df, "features").collect()}
    assert np.allclose(scaled[2], [1.0, 0.5, 1.0]) and math.isnan(scaled[0][2]) and scaled[1][1] == 0.5
    back = {r["id"]: r["features"].toArray() for r in min_max_unscale(min_max_scale(df, "features"), "features", bounds).collect()}
    assert np.allclose(back[0][:2], [1.0, 5.0]) and math.isnan(back[0][2]) and np.allclose(back[1], [0, 5, 0])


def test_columns_and_arrays_agree(spark):
    df = spark.range(50).select("id", (F.col("id") % 7).alias("a"), (F.col("id") * 0.5).alias("b"))
    packed = df.select("id", F.array(F.col("a").cast("double"), "b").alias("features"))
    assert min_max(df, ["a", "b"]) == min_max(packed, "features")
    assert np.allclose(standard_deviation(df, ["a", "b"]), [r["sd"] for r in feature_summary(packed, "features").orderBy("j").collect()])
    scaled = min_max_scale(df, ["a", "b"])
    assert scaled.columns == df.columns and scaled.agg(F.max("b")).first()[0] == 1.0
