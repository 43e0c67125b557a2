"""Gradient boosting that rebalances the rows of every round.

The margin of a row is a function of the trees so far, so the loop keeps no chain
of updated tables: each ``checkpointInterval`` rounds the margin of the whole
ensemble is folded into a freshly cached table computed from the training rows,
and the rounds in between add the newest trees in one scoring call.  A lost
executor recomputes its rows from the input with a single ensemble score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.param import TypeConverters
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equipoise.functions.losses import log_loss, pseudo_residual, signed_label, weighted_mean
from equipoise.functions.randomness import derive_seed, uniform
from equipoise.functions.vectors import as_vector
from equipoise.operators.assemble import boosted_classifier, boosted_margin
from equipoise.operators.ensemble import drawn_copies
from equipoise.operators.params import LabelledRows, param
from equipoise.operators.plain import SummedModel
from equipoise.operators.profile import ClassProfile, class_profile
from equipoise.sources.session import training_table


_MARGINS = 1_000_000  # running margins held at once


def residual_profile(rows: DataFrame, residual: str) -> ClassProfile:
    """The rarest and the commonest pseudo-residual value (ties by value); two rows reach the driver."""
    cells = rows.groupBy(residual).count().select(F.struct("count", residual).alias("c"))
    r = cells.agg(F.min("c").alias("low"), F.max("c").alias("high")).first()
    ends = [(r["low"][residual], r["low"]["count"]), (r["high"][residual], r["high"]["count"])]
    return ClassProfile(tuple((float(c), int(n)) for c, n in ends), sum(n for _, n in ends), 2)


class RebalancedGBTClassifier(Estimator, LabelledRows, DefaultParamsReadable, DefaultParamsWritable):
    """Binary boosting with log-loss; the first tree sees all rows, later trees a resampled table.

    ``resampling`` is none, rus, ros or balance.  ``balanceOn="class"`` (default) balances the 0/1 classes with a new
    draw per round; ``"residual"`` treats each pseudo-residual value as a class, with one draw for all rounds: rus
    trims the commonest value, ros repeats the rarest, balance keeps only those two values.
    """

    resampling = param("resampling", "none, rus, ros or balance", TypeConverters.toString)
    percSampling = param("percSampling", "percentage of under- or over-sampling, 0 balances", TypeConverters.toFloat)
    balanceOn = param("balanceOn", "class or residual", TypeConverters.toString)
    weightCol = param("weightCol", "instance weight column", TypeConverters.toString)
    validationIndicatorCol = param("validationIndicatorCol", "true marks validation rows", TypeConverters.toString)
    validationTol = param("validationTol", "early-stopping tolerance", TypeConverters.toFloat)
    maxIter = param("maxIter", "number of trees", TypeConverters.toInt)
    stepSize = param("stepSize", "weight of every tree after the first", TypeConverters.toFloat)
    subsamplingRate = param("subsamplingRate", "share of rows per round", TypeConverters.toFloat)
    maxDepth = param("maxDepth", "maximum tree depth", TypeConverters.toInt)
    maxBins = param("maxBins", "maximum feature bins", TypeConverters.toInt)
    minInstancesPerNode = param("minInstancesPerNode", "minimum rows per child", TypeConverters.toInt)
    minWeightFractionPerNode = param("minWeightFractionPerNode", "minimum weight share per child", TypeConverters.toFloat)
    minInfoGain = param("minInfoGain", "minimum gain of a split", TypeConverters.toFloat)
    maxMemoryInMB = param("maxMemoryInMB", "histogram memory", TypeConverters.toInt)
    cacheNodeIds = param("cacheNodeIds", "cache node ids per row", TypeConverters.toBoolean)
    checkpointInterval = param("checkpointInterval", "rounds between fresh margin tables", TypeConverters.toInt)
    featureSubsetStrategy = param("featureSubsetStrategy", "features tried per split", TypeConverters.toString)
    partitions = param("partitions", "partitions of the training table, 0 leaves them as they are", TypeConverters.toInt)
    lossType = param("lossType", "logistic", TypeConverters.toString)
    plain = param("plain", "fit to a model that sums its trees, without the JVM gateway", TypeConverters.toBoolean)

    def __init__(self, **kwargs: Any) -> None:
        super().__init__()
        self._setDefault(
            resampling="rus", percSampling=0.0, balanceOn="class", validationTol=0.01, maxIter=20, stepSize=0.1,
            subsamplingRate=1.0, maxDepth=5, maxBins=32, minInstancesPerNode=1, minWeightFractionPerNode=0.0,
            minInfoGain=0.0, maxMemoryInMB=256, cacheNodeIds=False, checkpointInterval=10, featureSubsetStrategy="all",
            lossType="logistic", partitions=0, plain=False,
        )
        self._set(**kwargs)

    def _learner(self, round_: int) -> DecisionTreeRegressor | RandomForestRegressor:
        v = self.value
        shared = dict(
            labelCol="_target", featuresCol="features", weightCol="_weight", maxDepth=v("maxDepth"), maxBins=v("maxBins"),
            minInstancesPerNode=v("minInstancesPerNode"), minWeightFractionPerNode=v("minWeightFractionPerNode"),
            minInfoGain=v("minInfoGain"), maxMemoryInMB=v("maxMemoryInMB"), cacheNodeIds=v("cacheNodeIds"),
            checkpointInterval=v("checkpointInterval"), seed=derive_seed(self.getSeed(), "tree", round_),
        )
        if v("featureSubsetStrategy") == "all":
            return DecisionTreeRegressor(**shared)
        return RandomForestRegressor(numTrees=1, bootstrap=False, featureSubsetStrategy=v("featureSubsetStrategy"), **shared)

    def _grow(self, rows: DataFrame, round_: int) -> DecisionTreeRegressionModel:
        rate = self.value("subsamplingRate")
        if rate < 1:
            rows = rows.filter(uniform(self.getKeyCols(), self.draw_seed(), f"subsample{round_}") < rate)
        rows = rows.select("features", "_target", "_weight").persist()
        try:
            model = self._learner(round_).fit(rows)
        finally:
            rows.unpersist()
        return model if isinstance(model, DecisionTreeRegressionModel) else model.trees[0]

    def _rebalance(self, rows: DataFrame, round_: int, classes: ClassProfile) -> DataFrame:
        """Turn the resampler's draw into the rows' ``_weight``."""
        v = self.value
        how, on_class = v("resampling"), v("balanceOn") == "class"
        seed = derive_seed(self.draw_seed(), "round", round_ if on_class else 0)
        if how == "none":
            return rows
        rows, u = rows.withColumn("_u", uniform(self.getKeyCols(), seed, "boost")), F.col("_u")
        if on_class:
            copies = drawn_copies(u, F.col("_y"), classes, how, v("percSampling"), seed)
        else:
            cells = residual_profile(rows, "_target")
            if how == "balance":
                rows = rows.filter(F.col("_target").isin(cells.minority, cells.majority))
            copies = drawn_copies(u, F.col("_target"), cells, how, v("percSampling"), seed)
            if how == "ros":  # only the rarest value grows
                copies = F.when(F.col("_target") == cells.minority, copies).otherwise(1)
        drawn = rows.withColumn("_copies", copies.cast("double"))
        if how != "ros":
            drawn = drawn.filter(F.col("_copies") > 0)
        return drawn.withColumn("_weight", F.col("_weight") * F.col("_copies"))

    def _fit(self, dataset: DataFrame) -> GBTClassificationModel | SummedModel:
        v = self.value
        if v("lossType") != "logistic":
            raise ValueError("only the logistic loss is supported")
        if v("balanceOn") not in ("class", "residual"):
            raise ValueError("balanceOn is class or residual")
        if v("maxIter") < 1:
            raise ValueError("maxIter must be positive")
        validate = self.isDefined(self.validationIndicatorCol)
        weight = F.col(v("weightCol")).cast("double") if self.isDefined(self.weightCol) else F.lit(1.0)
        table = dataset.select(
            *self.getKeyCols(),
            signed_label(F.col(v("labelCol"))).alias("_y"),
            weight.alias("_weight"),
            as_vector(dataset, v("featuresCol")).alias("features"),
            (F.col(v("validationIndicatorCol")) if validate else F.lit(False)).alias("_held_out"),
        )
        with training_table(table, self.getKeyCols(), v("partitions")) as base:
            margins = [base.withColumn("_margin", F.lit(0.0))]
            try:
                trees, weights = self._boost(base, margins, validate)
            finally:
                margins[-1].unpersist()
        if v("plain"):
            return SummedModel(trees, weights, "margin").setFeaturesCol(v("featuresCol"))
        out = boosted_classifier(trees, weights).setFeaturesCol(v("featuresCol"))
        return out._set(labelCol=v("labelCol"))

    def _boost(
        self, base: DataFrame, margins: list[DataFrame], validate: bool
    ) -> tuple[list[DecisionTreeRegressionModel], list[float]]:
        v = self.value
        classes = class_profile(base.filter(~F.col("_held_out")), "_y").require_binary("rebalanced boosting")
        if {c for c, _ in classes.classes} != {-1.0, 1.0}:
            raise ValueError("labels must be 0 and 1")
        trees: list[DecisionTreeRegressionModel] = []
        weights: list[float] = []
        folded, best, best_size = 0, float("inf"), 1

        def state() -> DataFrame:
            if folded == len(trees):
                return margins[-1]
            newest = self._scored(margins[-1], trees[folded:], weights[folded:], "_new")
            return newest.withColumn("_margin", F.col("_margin") + F.col("_new")).drop("_new")

        for round_ in range(v("maxIter")):
            train = state().filter(~F.col("_held_out"))
            if round_ == 0:
                target = train.withColumn("_target", F.col("_y"))
            else:
                target = train.withColumn("_target", pseudo_residual(F.col("_y"), F.col("_margin")))
                target = self._rebalance(target, round_, classes)
            trees.append(self._grow(target, round_))
            weights.append(1.0 if round_ == 0 else v("stepSize"))
            if validate:
                error = self._error(state().filter(F.col("_held_out")))
                if round_ == 0 or error < best and best - error >= v("validationTol") * max(error, 0.01):
                    best, best_size = error, len(trees)
                elif best - error < v("validationTol") * max(error, 0.01):
                    break
            if len(trees) - folded >= v("checkpointInterval") > 0:
                margins.append(self._scored(base, trees, weights, "_margin").persist())
                margins.pop(0).unpersist()
                folded = len(trees)
        keep = best_size if validate else len(trees)
        return trees[:keep], weights[:keep]

    def _scored(self, rows: DataFrame, trees: list[DecisionTreeRegressionModel], weights: list[float], out: str) -> DataFrame:
        """The weighted sum of the trees as a column."""
        if not self.value("plain"):
            return boosted_margin(trees, weights).setFeaturesCol("features").setPredictionCol(out).transform(rows)
        scored, total, names = SummedModel(trees, weights, "margin").score(rows)
        return scored.withColumn(out, total).drop(*names)

    @staticmethod
    def _error(rows: DataFrame) -> float:
        return rows.agg(weighted_mean(log_loss(F.col("_y"), F.col("_margin")), F.col("_weight")).alias("e")).first()["e"]


def evaluate_each_iteration(
    scores: DataFrame, y: str, tree_scores: str, tree_weights: list[float], weight: str | None = None
) -> DataFrame:
    """Weighted log-loss of the first i trees, for every i, from an array column of per-tree scores.

    One pass, whose work per row grows with the number of trees: a batch adds up its running margins side by side, and
    sends the sums of its losses, one row per iteration.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    steps = np.array(tree_weights, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mass = np.zeros(len(steps)), 0.0
        for batch in batches:
            n = max(1, _MARGINS // max(1, len(steps)))
            for i in range(0, batch.num_rows, n):
                part = batch.slice(i, n)
                y_, w_ = (part.column(c).to_numpy(zero_copy_only=False) for c in ("_y", "_w"))
                margins = np.cumsum(part.column("_s").flatten().to_numpy(zero_copy_only=False).reshape(len(y_), -1) * steps, axis=1)
                total += w_ @ (2.0 * np.logaddexp(0.0, -2.0 * y_[:, None] * margins))  # the log-loss of losses.log_loss
                mass += w_.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, len(steps) + 1, dtype=np.int32)), pa.array(total), pa.array(np.full(len(steps), mass))], ["iteration", "loss", "mass"])

    rows = scores.select(F.col(y).cast("double").alias("_y"), w.alias("_w"), F.col(tree_scores).cast("array<double>").alias("_s"))
    sums = rows.mapInArrow(run, "iteration int, loss double, mass double").groupBy("iteration")
    return sums.agg((F.sum("loss") / F.nullif(F.sum("mass"), F.lit(0.0))).alias("error"))
