"""Pipeline stages: the resamplers as Transformers, nearest neighbours as an Estimator.

Stages save and load like Spark's own.  A resampler changes the number of rows, so
use it on training tables only.
"""

from __future__ import annotations

import math
from typing import Any

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from equipoise.operators.knn import NeighbourIndex, build_index, estimate_tau, nest_neighbours, search_index
from equipoise.operators.params import LabelledRows, param
from equipoise.operators.resample import random_balance, random_oversample, random_undersample
from equipoise.operators.synth import rose, smote

_INT, _FLOAT, _BOOL, _TEXT = TypeConverters.toInt, TypeConverters.toFloat, TypeConverters.toBoolean, TypeConverters.toString


class _Stage(LabelledRows, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    def _rows(self) -> dict[str, Any]:
        return {"key": self.getKeyCols(), "label": self.value("labelCol"), "seed": self.draw_seed()}


class NoResampler(_Stage):
    """Identity."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset


class RandomUndersampler(_Stage):
    percUnder = param("percUnder", "percentage of the majority kept, 0 balances the classes", _FLOAT)
    mode = param("mode", "hash or exact", _TEXT)

    def __init__(self, **kwargs: Any) -> None:
        super().__init__()
        self._setDefault(percUnder=50.0, mode="hash")
        self._set(**kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return random_undersample(dataset, **self._rows(), perc_under=self.value("percUnder"), mode=self.value("mode"))


class RandomOversampler(_Stage):
    percOver = param("percOver", "percentage of minority copies added, 0 balances the classes", _FLOAT)
    mode = param("mode", "hash or exact", _TEXT)

    def __init__(self, **kwargs: Any) -> None:
        super().__init__()
        self._setDefault(percOver=100.0, mode="hash")
        self._set(**kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return random_oversample(dataset, **self._rows(), perc_over=self.value("percOver"), mode=self.value("mode"))


class RandomBalancer(_Stage):
    mode = param("mode", "hash or exact", _TEXT)

    def __init__(self, **kwargs: Any) -> None:
        super().__init__()
        self._setDefault(mode="hash")
        self._set(**kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return random_balance(dataset, **self._rows(), mode=self.value("mode"))


class Smote(_Stage):
    k = param("k", "neighbours, at least 3", lambda x: _at_least(_INT(x), 3))
    percOver = param("percOver", "percentage of synthetic rows, 0 balances the classes", _FLOAT)
    toMajo = param("toMajo", "grow the majority instead", _BOOL)
    includeSelf = param("includeSelf", "a row may be its own neighbour", _BOOL)

    def __init__(self, **kwargs: Any) -> None:
        super().__init__()
        self._setDefault(k=5, percOver=100.0, toMajo=False, includeSelf=False)
        self._set(**kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return smote(
            dataset,
            **self._rows(),
            features=self.value("featuresCol"),
            k=self.value("k"),
            perc_over=self.value("percOver"),
            to_majority=self.value("toMajo"),
            include_self=self.value("includeSelf"),
        )


class Rose(_Stage):
    minoProb = param("minoProb", "share of minority rows in the result, in (0, 1]", _FLOAT)
    shrinkFactor = param("shrinkFactor", "noise multiplier, above 0", _FLOAT)
    keepOrigSamples = param("keepOrigSamples", "keep the original rows and add copies", _BOOL)
    majoRUS = param("majoRUS", "under-sample the majority instead of copying it", _BOOL)
    keepMajoSize = param("keepMajoSize", "make both classes as large as the majority", _BOOL)

    def __init__(self, **kwargs: Any) -> None:
        super().__init__()
        self._setDefault(minoProb=0.5, shrinkFactor=1.0, keepOrigSamples=False, majoRUS=False, keepMajoSize=False)
        self._set(**kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return rose(
            dataset,
            **self._rows(),
            features=self.value("featuresCol"),
            mino_prob=self.value("minoProb"),
            shrink=self.value("shrinkFactor"),
            keep_orig=self.value("keepOrigSamples"),
            majo_rus=self.value("majoRUS"),
            keep_majo_size=self.value("keepMajoSize"),
        )


class NearestNeighbors(LabelledRows, Estimator):
    """k nearest rows of the fitted table; ``bufferSize`` of -1 is exact, 0 or more routes approximately,
    and ``estimateBuffer=True`` derives the buffer from the data."""

    k = param("k", "neighbours", _INT)
    maxDistance = param("maxDistance", "inclusive radius", _FLOAT)
    neighborsCol = param("neighborsCol", "output column", _TEXT)
    distanceCol = param("distanceCol", "distance output column, empty for none", _TEXT)
    auxCols = param("auxCols", "columns returned per neighbour", TypeConverters.toListString)
    bufferSize = param("bufferSize", "routing buffer, -1 for exact search", _FLOAT)
    estimateBuffer = param("estimateBuffer", "estimate the routing buffer", _BOOL)
    pivots = param("pivots", "number of regions, 0 chooses by table size", _INT)

    def __init__(self, **kwargs: Any) -> None:
        super().__init__()
        self._setDefault(
            k=5, maxDistance=math.inf, neighborsCol="neighbors", distanceCol="", bufferSize=-1.0, estimateBuffer=False, pivots=0
        )
        self._set(**kwargs)

    def _fit(self, dataset: DataFrame) -> NearestNeighborsModel:
        v, key = self.value, self.getKeyCols()
        tau = None
        if v("estimateBuffer"):
            tau = estimate_tau(dataset, key, v("featuresCol"), self.draw_seed())
        elif v("bufferSize") >= 0:
            tau = v("bufferSize")
        aux = v("auxCols") if self.isDefined(self.auxCols) else key
        index = build_index(dataset, key, v("featuresCol"), v("k"), aux, v("pivots") or None, self.draw_seed())
        return NearestNeighborsModel(index, self, aux, tau)


class NearestNeighborsModel(Model):
    """Searches the index built by the fit; any number of tables can be transformed."""

    def __init__(self, index: NeighbourIndex, settings: NearestNeighbors, aux: list[str], buffer: float | None) -> None:
        super().__init__()
        self.index, self.settings, self.aux, self.buffer = index, settings, aux, buffer

    def _transform(self, dataset: DataFrame) -> DataFrame:
        v, key = self.settings.value, self.settings.getKeyCols()
        pairs = search_index(dataset, self.index, key, v("featuresCol"), v("k"), v("maxDistance"), tau=self.buffer)
        return nest_neighbours(dataset, pairs, key, key, self.aux, v("neighborsCol"), v("distanceCol") or None)


def _at_least(value: int, low: int) -> int:
    if value < low:
        raise TypeError(f"must be at least {low}")
    return value
