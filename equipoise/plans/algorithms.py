"""The grid of resampling and learning combinations, by name.

``<resampling>_<algorithm>`` resamples before training: none, ros, rus, smote, rose
with bag, rf, gbt, wbag, wrf, wgbt.  ``<algorithm>_<resampling>`` resamples inside:
imbbag, imbgbt with ros, rus, ranbal.
"""

from __future__ import annotations

from typing import Any

from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier

from equipoise.operators.boost import RebalancedGBTClassifier
from equipoise.operators.ensemble import RebalancedBaggingClassifier
from equipoise.operators.stages import NoResampler, RandomOversampler, RandomUndersampler, Rose, Smote
from equipoise.plans.evaluate import Experiment

# The names of the grid.
BEFORE = ("none", "ros", "rus", "smote", "rose")
LEARNERS = ("bag", "rf", "gbt", "wbag", "wrf", "wgbt")
INSIDE = ("ros", "rus", "ranbal")
REBALANCING = ("imbbag", "imbgbt")


def grid() -> list[str]:
    return [f"{r}_{a}" for r in BEFORE for a in LEARNERS] + [f"{a}_{r}" for a in REBALANCING for r in INSIDE]


def _learner(name: str, seed: int, size: int, depth: int) -> Estimator:
    shared: dict[str, Any] = {"labelCol": "label_index", "featuresCol": "features", "maxDepth": depth, "seed": seed}
    if name.startswith("w"):
        shared["weightCol"] = "weight"
    kind = name.removeprefix("w")
    if kind == "gbt":
        return GBTClassifier(maxIter=size, **shared)
    strategy = "all" if kind == "bag" else "auto"
    return RandomForestClassifier(numTrees=size, featureSubsetStrategy=strategy, **shared)


def experiment(name: str, key: list[str], size: int = 100, depth: int = 5) -> Experiment:
    """``size`` is the number of trees, members or boosting rounds."""
    first, _, second = name.partition("_")
    if first in BEFORE and second in LEARNERS:
        stages = {
            "none": NoResampler,
            "ros": lambda **kw: RandomOversampler(percOver=0.0, **kw),
            "rus": lambda **kw: RandomUndersampler(percUnder=0.0, **kw),
            "smote": lambda **kw: Smote(percOver=0.0, **kw),
            "rose": Rose,
        }
        return Experiment(
            name,
            classifier=lambda seed: _learner(second, seed, size, depth),
            resample=lambda seed: stages[first](keyCols=key, labelCol="label", seed=seed),
            weighted=second.startswith("w"),
        )
    if first in REBALANCING and second in INSIDE:
        how = "balance" if second == "ranbal" else second
        shared: dict[str, Any] = {"keyCols": key, "labelCol": "label_index", "resampling": how, "maxDepth": depth}
        if first == "imbbag":
            return Experiment(name, lambda seed: RebalancedBaggingClassifier(numResamples=size, seed=seed, **shared))
        return Experiment(name, lambda seed: RebalancedGBTClassifier(maxIter=size, seed=seed, **shared))
    raise ValueError(f"unknown algorithm {name!r}; known: {', '.join(grid())}")
