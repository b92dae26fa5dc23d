"""Forests as an estimator and a model of pyspark.ml, which can stand in a Pipeline and be written and read."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forest import Forest
from .grow import Growth

#: Of the table of nodes; a reader takes no other.
VERSION = 1


class _ForestParams(Params):
    target = Param(Params._dummy(), "target", "column to predict: numbers or text", TypeConverters.toString)
    caseId = Param(Params._dummy(), "caseId", "column with each case's number", TypeConverters.toString)
    numeric = Param(Params._dummy(), "numeric", "columns of numbers", TypeConverters.toListString)
    categorical = Param(Params._dummy(), "categorical", "columns of categories", TypeConverters.toListString)
    nTrees = Param(Params._dummy(), "nTrees", "number of trees", TypeConverters.toInt)
    growth = Param(Params._dummy(), "growth", "JSON of the fields of Growth, empty for the defaults of Forest", TypeConverters.toString)
    bag = Param(Params._dummy(), "bag", "kind of bag", TypeConverters.toString)
    boost = Param(Params._dummy(), "boost", "empty, gbt or ada", TypeConverters.toString)
    rate = Param(Params._dummy(), "rate", "learning rate of gradient boosting", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of all draws", TypeConverters.toInt)
    predictionCol = Param(Params._dummy(), "predictionCol", "column of predictions, null where no tree votes", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(numeric=[], categorical=[], nTrees=10, growth="", bag="bootstrap", boost="", rate=0.1, seed=1, predictionCol="prediction")

    def _forest(self) -> Forest:
        v = lambda name: self.getOrDefault(getattr(self, name))
        how = Growth(**json.loads(v("growth"))) if v("growth") else None
        return Forest(v("target"), v("caseId"), v("numeric"), v("categorical"), v("nTrees"), how, None, v("bag"), v("boost") or None, v("rate"), v("seed"))


class DecisionForest(Estimator, _ForestParams, DefaultParamsReadable, DefaultParamsWritable):
    """``growth`` may be a Growth or its JSON."""

    @keyword_only
    def __init__(self, *, target=None, caseId=None, numeric=None, categorical=None, nTrees=None, growth=None, bag=None, boost=None, rate=None, seed=None, predictionCol=None):
        super().__init__()
        given = {k: v for k, v in self._input_kwargs.items() if v is not None}
        if isinstance(given.get("growth"), Growth):
            given["growth"] = json.dumps(asdict(given["growth"]))
        self._set(**given)

    def _fit(self, dataset: DataFrame) -> DecisionForestModel:
        forest = self._forest().fit(dataset)
        return self._copyValues(DecisionForestModel(forest.nodes, forest.classes, forest.intercept))


class DecisionForestModel(Model, _ForestParams, MLReadable, MLWritable):
    """Adds ``predictionCol`` to a table with the features."""

    def __init__(self, nodes: DataFrame, classes: tuple[str, ...] = (), intercept: float = 0.0):
        super().__init__()
        self.nodes, self.classes, self.intercept = nodes, tuple(classes), intercept

    def forest(self) -> Forest:
        out = self._forest()
        out.nodes, out.classes, out.intercept = self.nodes, self.classes, self.intercept
        return out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        found = self.forest().predict(dataset).select(F.col("case_id").alias("_forest_case"), F.col("pred").alias(self.getOrDefault(self.predictionCol)))
        return dataset.join(found, dataset[self.getOrDefault(self.caseId)].cast("long") == F.col("_forest_case"), "left").drop("_forest_case")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: DecisionForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        extra = {"nodesVersion": VERSION, "classes": list(self.model.classes), "intercept": self.model.intercept}
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata=extra)
        self.model.nodes.write.parquet(f"{path}/nodes")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> DecisionForestModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        if meta["nodesVersion"] != VERSION:
            raise ValueError(f"nodes of version {meta['nodesVersion']}, known is {VERSION}")
        model = self.cls(self.sparkSession.read.parquet(f"{path}/nodes"), tuple(meta["classes"]), meta["intercept"])
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model
