"""Put separately trained trees together as Spark's own ensemble models.

Spark has no Python call for this, so the model objects are built on the JVM side
from the trees' own handles; no rows and no tree data pass through Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel
from pyspark.ml.util import Identifiable
from pyspark.sql import SparkSession


class _Uid(Identifiable):
    """Source of Spark-style unique ids."""


def _array(java_class: object, items: Sequence[object]) -> object:
    out = SparkSession.active().sparkContext._gateway.new_array(java_class, len(items))
    for i, item in enumerate(items):
        out[i] = item
    return out


def forest(members: Sequence[RandomForestClassificationModel], num_features: int) -> RandomForestClassificationModel:
    """One forest of all the members' trees; its raw score is the sum of theirs."""
    ml = SparkSession.active().sparkContext._jvm.org.apache.spark.ml.classification
    trees = [t._java_obj for m in members for t in m.trees]
    built = ml.RandomForestClassificationModel(_array(ml.DecisionTreeClassificationModel, trees), num_features, 2)
    model = RandomForestClassificationModel(built)
    model._resetUid(built.uid())
    model._set(numTrees=len(trees))
    model._transfer_params_to_java()
    return model


def _weighted(java_model: object, trees: Sequence[DecisionTreeRegressionModel], weights: Sequence[float]) -> object:
    spark = SparkSession.active().sparkContext
    tree_class = spark._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    doubles = spark._gateway.new_array(spark._jvm.double, len(weights))
    for i, w in enumerate(weights):
        doubles[i] = float(w)
    return java_model(_Uid().uid, _array(tree_class, [t._java_obj for t in trees]), doubles)


def boosted_classifier(trees: Sequence[DecisionTreeRegressionModel], weights: Sequence[float]) -> GBTClassificationModel:
    jvm = SparkSession.active().sparkContext._jvm
    built = _weighted(jvm.org.apache.spark.ml.classification.GBTClassificationModel, trees, weights)
    model = GBTClassificationModel(built)
    model._resetUid(built.uid())
    return model


def boosted_margin(trees: Sequence[DecisionTreeRegressionModel], weights: Sequence[float]) -> GBTRegressionModel:
    """The weighted sum of the trees as one scoring function."""
    jvm = SparkSession.active().sparkContext._jvm
    built = _weighted(jvm.org.apache.spark.ml.regression.GBTRegressionModel, trees, weights)
    model = GBTRegressionModel(built)
    model._resetUid(built.uid())
    return model
