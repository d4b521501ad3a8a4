"""The fitted corrections as stages of pyspark.ml pipelines: fitted, chained, saved and loaded like any other.

    Pipeline(stages=[RobustMADScaler(features=FEATS), TVNWhitener(features=FEATS, treatment="treatment")]).fit(df)

What a model has learnt (numbers of features, or a matrix of features) is one JSON parameter, so that it is saved with the stage."""

from __future__ import annotations

import json

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from phenogrid.operators import batch, scale


class _Shared(Params, DefaultParamsReadable, DefaultParamsWritable):
    features = Param(Params._dummy(), "features", "columns that are corrected", TypeConverters.toListString)
    treatment = Param(Params._dummy(), "treatment", "column that names the treatment", TypeConverters.toString)
    control = Param(Params._dummy(), "control", "value of the controls", TypeConverters.toString)
    batches = Param(Params._dummy(), "batches", "column that names the batch", TypeConverters.toString)
    epsilon = Param(Params._dummy(), "epsilon", "added to divisors or variances", TypeConverters.toFloat)
    weight = Param(Params._dummy(), "weight", "ridge of the covariances", TypeConverters.toFloat)
    learnt = Param(Params._dummy(), "learnt", "what was fitted, as JSON", TypeConverters.toString)

    def _given(self, name: str):
        return self.getOrDefault(self.getParam(name))

    @keyword_only
    def __init__(self, **kw):
        super().__init__()
        self._setDefault(control="ctrl", treatment="treatment", batches="batch", epsilon=0.0, weight=1.0)
        self._set(**kw)


class RobustMADScaler(_Shared, Estimator):
    """Median and scaled MAD of all rows."""

    def _fit(self, df: DataFrame) -> RobustMADModel:
        fitted = scale.RobustMAD(self._given("features"), self._given("epsilon")).fit(df)
        return RobustMADModel(features=list(fitted.feats), epsilon=fitted.epsilon, learnt=json.dumps({"median": fitted.median, "mad": fitted.mad}))


class RobustMADModel(_Shared, Model):
    def _transform(self, df: DataFrame) -> DataFrame:
        held = json.loads(self._given("learnt"))
        return scale.RobustMAD(self._given("features"), self._given("epsilon"), held["median"], held["mad"]).transform(df)


class TVNWhitener(_Shared, Estimator):
    """Whitening by the controls."""

    def _fit(self, df: DataFrame) -> TVNModel:
        fitted = batch.TVN(self._given("features"), self._given("treatment"), self._given("control"), epsilon=self._given("epsilon") or 1e-5).fit(df)
        return TVNModel(features=list(fitted.feats), learnt=json.dumps({"mean": fitted.mean.tolist(), "matrix": fitted.matrix.tolist()}))


class TVNModel(_Shared, Model):
    def _transform(self, df: DataFrame) -> DataFrame:
        held = json.loads(self._given("learnt"))
        return batch.project(df, self._given("features"), np.array(held["matrix"]), np.array(held["mean"]))


class CORALAligner(_Shared, Estimator):
    """Alignment of batches by the covariances of their controls. Batches are named by text."""

    def _fit(self, df: DataFrame) -> CORALModel:
        fitted = batch.CORAL(self._given("features"), self._given("batches"), self._given("treatment"), self._given("control"), weight=self._given("weight")).fit(df)
        return CORALModel(features=list(fitted.feats), batches=fitted.batch_key, learnt=json.dumps({str(k): m.tolist() for k, m in fitted.matrices.items()}))


class CORALModel(_Shared, Model):
    def _transform(self, df: DataFrame) -> DataFrame:
        held = {k: np.array(m) for k, m in json.loads(self._given("learnt")).items()}
        key = self._given("batches")
        kinds = {"int": int, "bigint": int, "smallint": int, "tinyint": int}
        named = kinds.get(df.schema[key].dataType.simpleString(), str)
        return batch.CORAL(self._given("features"), key, self._given("treatment"), matrices={named(k): m for k, m in held.items()}).transform(df)
