"""Params shared by the resampling stages and classifiers."""

from __future__ import annotations

from typing import Any

from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasSeed

from equipoise.functions.randomness import FastSeed


class HasKeyCols(Params):
    """Columns that identify a row; all randomness is a function of them and the seed."""

    keyCols: Param = Param(Params._dummy(), "keyCols", "unique row key", TypeConverters.toListString)

    def getKeyCols(self) -> list[str]:
        return self.getOrDefault(self.keyCols)


class LabelledRows(HasKeyCols, HasLabelCol, HasFeaturesCol, HasSeed):
    """Key, label, features and seed, with keyword construction and chainable setting."""

    generator: Param = Param(
        Params._dummy(), "generator", "xxhash64 (fast) or md5 (reproducible outside Spark)", TypeConverters.toString
    )

    def __init__(self, **kwargs: Any) -> None:
        super().__init__()
        self._setDefault(seed=0, generator="xxhash64")
        self._set(**kwargs)

    def setParams(self, **kwargs: Any) -> LabelledRows:
        return self._set(**kwargs)

    def draw_seed(self) -> int:
        """The seed in the kind that selects the generator."""
        return FastSeed(self.getSeed()) if self.value("generator") == "xxhash64" else self.getSeed()

    def value(self, name: str) -> Any:
        return self.getOrDefault(self.getParam(name))


def param(name: str, doc: str, convert: Any) -> Param:
    return Param(Params._dummy(), name, doc, convert)
