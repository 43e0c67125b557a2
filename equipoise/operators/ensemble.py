"""Bagging whose members each see a rebalanced bootstrap.

A member's sample is its bootstrap with an integer count per row: how often the
resampler took it.  The counts become instance weights of the member's trees, so an
over-sampled member holds no more rows than the others.  The table is cached once;
members are column expressions on it and are trained side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.param import TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equipoise.functions.randomness import derive_seed, poisson, uniform
from equipoise.functions.vectors import as_vector, dimension
from equipoise.operators.assemble import forest
from equipoise.operators.params import LabelledRows, param
from equipoise.operators.plain import SummedModel
from equipoise.operators.profile import ClassProfile, class_profile
from equipoise.operators.resample import random_balance_sizes
from equipoise.operators.sampling import balanced_fraction, repeat_rows
from equipoise.sources.session import training_table

_MEMBERS_PER_SCAN = 20


def drawn_copies(u: Column, label: Column, profile: ClassProfile, how: str, perc: float, seed: int) -> Column:
    """How often one row (or one copy of it) with draw ``u`` is taken by the resampler ``how``."""
    majority = label == F.lit(profile.majority)
    if how == "none":
        return F.lit(1)
    if how == "rus":
        fraction = balanced_fraction(profile.minority_size, profile.majority_size, perc)
        return F.when(majority, (u < fraction).cast("int")).otherwise(1)
    if how == "ros":
        rate = balanced_fraction(profile.majority_size - profile.minority_size, profile.minority_size, perc)
        return F.when(majority, F.lit(1)).otherwise(F.lit(1) + poisson(u, rate))
    if how == "balance":
        new_min, new_maj = random_balance_sizes(profile, seed)
        if new_maj == profile.majority_size:
            return F.lit(1)
        f_min, f_maj = new_min / profile.minority_size, new_maj / profile.majority_size
        if f_min > 1:
            return F.when(majority, (u < f_maj).cast("int")).otherwise(poisson(u, f_min))
        return F.when(majority, poisson(u, f_maj)).otherwise((u < f_min).cast("int"))
    raise ValueError(f"unknown resampling {how!r}")


class RebalancedBaggingClassifier(Estimator, LabelledRows, DefaultParamsReadable, DefaultParamsWritable):
    """Soft-voting forest over rebalanced bootstraps; fits to Spark's own forest model, or to a
    :class:`~equipoise.operators.plain.SummedModel` with ``plain=True``.

    ``resampling`` is none, rus, ros or balance; ``perc`` is the percentage of rus (kept) or ros (added), 0 balances.
    ``memberBootstrap=True`` also lets each member's forest bootstrap its sample a second time.
    Labels are 0/1.
    """

    resampling = param("resampling", "none, rus, ros or balance", TypeConverters.toString)
    perc = param("perc", "percentage of under- or over-sampling, 0 balances the classes", TypeConverters.toFloat)
    numResamples = param("numResamples", "number of resampled members", TypeConverters.toInt)
    numTrees = param("numTrees", "trees per member", TypeConverters.toInt)
    subsamplingRate = param("subsamplingRate", "bootstrap rate", TypeConverters.toFloat)
    maxDepth = param("maxDepth", "maximum tree depth", TypeConverters.toInt)
    maxBins = param("maxBins", "maximum feature bins", TypeConverters.toInt)
    minInstancesPerNode = param("minInstancesPerNode", "minimum rows per child", TypeConverters.toInt)
    minInfoGain = param("minInfoGain", "minimum gain of a split", TypeConverters.toFloat)
    maxMemoryInMB = param("maxMemoryInMB", "histogram memory", TypeConverters.toInt)
    cacheNodeIds = param("cacheNodeIds", "cache node ids per row", TypeConverters.toBoolean)
    checkpointInterval = param("checkpointInterval", "checkpoint interval of cached node ids", TypeConverters.toInt)
    featureSubsetStrategy = param("featureSubsetStrategy", "features tried per split", TypeConverters.toString)
    memberBootstrap = param("memberBootstrap", "bootstrap again inside each member", TypeConverters.toBoolean)
    partitions = param("partitions", "partitions of the training table, 0 leaves them as they are", TypeConverters.toInt)
    parallelism = param("parallelism", "members trained at the same time", TypeConverters.toInt)
    plain = param("plain", "fit to a model that sums its members, without the JVM gateway", TypeConverters.toBoolean)

    def __init__(self, **kwargs: Any) -> None:
        super().__init__()
        self._setDefault(
            resampling="rus", perc=0.0, numResamples=100, numTrees=1, subsamplingRate=1.0, maxDepth=5, maxBins=32,
            minInstancesPerNode=1, minInfoGain=0.0, maxMemoryInMB=256, cacheNodeIds=False, checkpointInterval=10,
            featureSubsetStrategy="auto", memberBootstrap=False, parallelism=4, partitions=0, plain=False,
        )
        self._set(**kwargs)
        self.resampler: Callable[[DataFrame, int], DataFrame] | None = None

    def setResampler(self, resampler: Callable[[DataFrame, int], DataFrame] | None) -> RebalancedBaggingClassifier:
        """Any resampling in place of ``resampling``: gets a member's bootstrap (key columns, label, features as a vector,
        ``_copy`` numbering a row's repeats) and a seed, and returns rows with at least label and features. An estimator with one cannot be saved."""
        self.resampler = resampler
        return self

    def write(self) -> MLWriter:
        if self.resampler:
            raise ValueError("a resampler given as a function cannot be saved: call setResampler(None) first, and again after loading")
        return super().write()

    def _fit(self, dataset: DataFrame) -> RandomForestClassificationModel | SummedModel:
        key, v = self.getKeyCols(), self.value
        label = {"ml_attr": {"type": "nominal", "name": "label", "vals": ["0", "1"]}}
        table = dataset.select(
            *key,
            F.col(v("labelCol")).cast("double").alias("label", metadata=label),
            as_vector(dataset, v("featuresCol")).alias("features"),
        )
        with training_table(table, key, v("partitions")) as rows:
            class_profile(rows, "label").require_binary("a rebalanced ensemble")
            size = dimension(rows, "features")
            bootstraps = self.bootstrap_profiles(rows)
            train = inheritable_thread_target(dataset.sparkSession)(lambda m: self._train_member(rows, m, bootstraps[m]))
            pool = ThreadPool(min(v("parallelism"), v("numResamples")))
            try:
                models = pool.map(train, range(v("numResamples")), chunksize=1)
            finally:
                pool.close()
        if v("plain"):
            return SummedModel(models).setFeaturesCol(v("featuresCol"))
        out = forest(models, size).setFeaturesCol(v("featuresCol"))
        return out._set(labelCol=v("labelCol"))

    def _bootstrap_draw(self, member: int) -> Column:
        return uniform(self.getKeyCols(), self.draw_seed(), f"bootstrap{member}")

    def bootstrap_profiles(self, rows: DataFrame) -> list[tuple[ClassProfile, list[float]]]:
        """Class sizes of every member's bootstrap, many members per scan, and the classes it lost."""
        total = self.value("numResamples")
        out = []
        for start in range(0, total, _MEMBERS_PER_SCAN):
            members = range(start, min(total, start + _MEMBERS_PER_SCAN))
            drawn = rows.select("label", *[self._bootstrap_draw(m).alias(f"u{m}") for m in members])
            sums = [F.sum(poisson(F.col(f"u{m}"), self.value("subsamplingRate"))).alias(f"n{m}") for m in members]
            counts = drawn.groupBy("label").agg(F.count("*").alias("rows"), *sums).collect()
            for m in members:
                lost = [r["label"] for r in counts if not r[f"n{m}"]]
                sizes = [(r["label"], int(r[f"n{m}"] or r["rows"])) for r in counts]
                out.append((ClassProfile.of(sizes), lost))
        return out

    def member_sample(self, rows: DataFrame, member: int, bootstrap: tuple[ClassProfile, list[float]]) -> DataFrame:
        """A member's rebalanced bootstrap: the rows it drew, with how often the resampler took each as ``_weight``."""
        profile, lost = bootstrap
        key, seed, how = self.getKeyCols(), self.draw_seed(), self.value("resampling")
        count = poisson(F.col("_u"), self.value("subsamplingRate"))
        for c in lost:  # a bootstrap that lost a class takes that class whole
            count = F.when(F.col("label") == c, F.lit(1)).otherwise(count)
        rate = self.value("subsamplingRate")
        boot = repeat_rows(rows.withColumn("_u", self._bootstrap_draw(member)), count, "_i", first=0, key=key, rate=rate)
        if self.resampler:
            drawn = self.resampler(boot.drop("_u").withColumnRenamed("_i", "_copy"), derive_seed(seed, "resampler", member))
            return drawn.withColumn("_weight", F.lit(1.0))
        boot = boot.withColumn("_u", uniform([*key, "_i"], seed, f"resample{member}"))
        draw = derive_seed(seed, "balance", member)
        copies = drawn_copies(F.col("_u"), F.col("label"), profile, how, self.value("perc"), draw)
        out = boot.withColumn("_weight", copies.cast("double")).drop("_u", "_i")
        return out if how in ("none", "ros") else out.filter(F.col("_weight") > 0)

    def _train_member(
        self, rows: DataFrame, member: int, bootstrap: tuple[ClassProfile, list[float]]
    ) -> RandomForestClassificationModel:
        v = self.value
        learner = RandomForestClassifier(
            labelCol="label", featuresCol="features", numTrees=v("numTrees"), subsamplingRate=1.0,
            bootstrap=v("memberBootstrap"), maxDepth=v("maxDepth"), maxBins=v("maxBins"),
            minInstancesPerNode=v("minInstancesPerNode"), minInfoGain=v("minInfoGain"), maxMemoryInMB=v("maxMemoryInMB"),
            cacheNodeIds=v("cacheNodeIds"), checkpointInterval=v("checkpointInterval"),
            featureSubsetStrategy=v("featureSubsetStrategy"), seed=derive_seed(self.getSeed(), "member", member),
        )
        sample = self.member_sample(rows, member, bootstrap)
        if v("minInstancesPerNode") > 1 and not self.resampler:  # the minimum counts rows, so copies must be rows
            profile, how = bootstrap[0], v("resampling")
            gap = balanced_fraction(profile.majority_size - profile.minority_size, profile.minority_size, v("perc"))
            growth = {"ros": 1 + gap, "balance": profile.size / profile.minority_size}.get(how, 1.0)
            sample = repeat_rows(sample, F.col("_weight"), key=self.getKeyCols(), rate=growth)
        else:
            learner.setWeightCol("_weight")
        sample = sample.select("label", "features", "_weight").persist()
        try:
            return learner.fit(sample)
        finally:
            sample.unpersist()


def soft_vote(
    scores: DataFrame, key: Sequence[str], classes: Sequence[int] = (0, 1), score: str = "score", klass: str = "class"
) -> DataFrame:
    """Sum member scores per row and class, normalise, and predict the best class (ties: the first class).

    ``scores`` is long: (key…, class, score), one row per member and class.  One shuffle, partially aggregated.
    """
    per_class = [F.sum(F.when(F.col(klass) == c, F.col(score)).otherwise(0.0)) for c in classes]
    out = scores.groupBy(*key).agg(F.array(*per_class).alias("_raw"))
    best = F.array_max("_raw")
    return out.select(
        *key,
        F.get(F.lit(list(classes)), F.array_position("_raw", best).cast("int") - 1).alias("prediction"),
        (best / F.aggregate("_raw", F.lit(0.0), lambda a, x: a + x)).alias("probability"),
    )
