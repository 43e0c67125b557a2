"""Ensembles as plain PySpark models: members are kept as they are, and a row's score is the sum of theirs.

Nothing here needs the JVM gateway, so these models also work where there is none.  They score as the assembled ones of
:mod:`equipoise.operators.assemble`, with one call per member.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol
from pyspark.ml.regression import DecisionTreeRegressionModel
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equipoise.operators.params import param

#: Members by what they give: votes of forests are added up, margins of regression trees are weighted.
MEMBERS = {"vote": RandomForestClassificationModel, "margin": DecisionTreeRegressionModel}


class SummedModel(Model, HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, MLWritable, MLReadable):
    """The sum of its members' raw predictions, normalised to probabilities.

    ``kind`` is ``vote`` (forests; ties go to class 0) or ``margin`` (regression trees with weights; the raw prediction is
    (-margin, margin) and class 1 needs a margin above 0).
    """

    kind = param("kind", "vote or margin", TypeConverters.toString)
    weights = param("weights", "weight of each member", TypeConverters.toListFloat)

    def __init__(self, members: Sequence[Any] = (), weights: Sequence[float] | None = None, kind: str = "vote") -> None:
        super().__init__()
        if kind not in MEMBERS:
            raise ValueError(f"kind is one of {list(MEMBERS)}")
        self.members = list(members)
        self._setDefault(featuresCol="features", predictionCol="prediction", probabilityCol="probability", rawPredictionCol="rawPrediction")
        self._set(kind=kind, weights=[1.0] * len(self.members) if weights is None else list(weights))

    def setFeaturesCol(self, value: str) -> SummedModel:
        return self._set(featuresCol=value)

    def setPredictionCol(self, value: str) -> SummedModel:
        return self._set(predictionCol=value)

    @property
    def trees(self) -> list[Any]:
        """The single trees, as the assembled models give them."""
        return [t for m in self.members for t in m.trees] if self.getOrDefault(self.kind) == "vote" else self.members

    @property
    def treeWeights(self) -> list[float]:
        return [1.0] * len(self.trees) if self.getOrDefault(self.kind) == "vote" else self.getOrDefault(self.weights)

    def score(self, dataset: DataFrame) -> tuple[DataFrame, Column, list[str]]:
        """``dataset`` with every member's column, their (weighted) sum, and the names of those columns."""
        out, names, total = dataset, [], F.lit(0.0)
        vote = self.getOrDefault(self.kind) == "vote"
        if vote:
            total = F.array(F.lit(0.0), F.lit(0.0))
        for i, (member, weight) in enumerate(zip(self.members, self.getOrDefault(self.weights), strict=True)):
            names.append(f"{self.uid}_{i}")
            member = member.copy().setFeaturesCol(self.getFeaturesCol())
            if vote:
                member = member.setRawPredictionCol(names[-1]).setPredictionCol("").setProbabilityCol("")
                total = F.zip_with(total, vector_to_array(F.col(names[-1])), lambda a, b: a + b)
            else:
                member = member.setPredictionCol(names[-1])
                total = total + F.lit(weight) * F.col(names[-1])
            out = member.transform(out)
        return out, total, names

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out, total, names = self.score(dataset)
        raw, made = f"{self.uid}_raw", f"{self.uid}_made"
        if self.getOrDefault(self.kind) == "vote":
            out = out.withColumn(raw, total)
            mass = F.get(raw, F.lit(0)) + F.get(raw, F.lit(1))
            out = out.withColumn(made, F.transform(raw, lambda x: F.when(mass == 0, F.lit(0.0)).otherwise(x / mass)))
            prediction = F.when(F.get(raw, F.lit(1)) > F.get(raw, F.lit(0)), 1.0).otherwise(0.0)
        else:
            out = out.withColumn(raw, total)
            margin, one = F.col(raw), F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * F.col(raw)))
            out = out.withColumn(made, F.array(F.lit(1.0) - one, one))
            prediction = F.when(margin > 0, 1.0).otherwise(0.0)
        arrays = F.col(raw) if self.getOrDefault(self.kind) == "vote" else F.array(-F.col(raw), F.col(raw))
        columns = {
            self.getRawPredictionCol(): array_to_vector(arrays),
            self.getProbabilityCol(): array_to_vector(F.col(made)),
            self.getPredictionCol(): prediction,
        }
        return out.withColumns({c: v for c, v in columns.items() if c}).drop(raw, made, *names)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    """Metadata with the number of members, and each member in a folder of its own."""

    def __init__(self, instance: SummedModel) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, {"members": len(self.instance.members)})
        for i, member in enumerate(self.instance.members):
            member.write().save(f"{path}/members/{i:05d}")


class _Reader(MLReader):
    def __init__(self, cls: type[SummedModel]) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> SummedModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        params = metadata["paramMap"] if isinstance(metadata["paramMap"], dict) else json.loads(metadata["paramMap"])
        members = [MEMBERS[params["kind"]].load(f"{path}/members/{i:05d}") for i in range(metadata["members"])]
        model = self.cls(members, params["weights"], params["kind"])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
