"""The price model as a ``pyspark.ml`` Estimator and Model, for Pipeline and CrossValidator.

``PriceRidge`` fits ``model.fit`` on its input columns; ``PriceRidgeModel`` adds the
prediction column. Both have Params and are written and read as ML stages, also within a pipeline.

Rows without an input or a price take no part in the fit; without an input they
get a null prediction. Without ``alpha`` the penalty is chosen by 5-fold
cross-validation over ``alphas``, with the folds of ``foldCol`` where the table has that
column, else by a hash of the row's inputs and price.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasPredictionCol
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable,
                             MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abode.operators import model as M


class _PriceParams(HasInputCols, HasLabelCol, HasPredictionCol):
    degree = Param(Params._dummy(), "degree", "degree of the polynomial terms", TypeConverters.toInt)
    alpha = Param(Params._dummy(), "alpha", "penalty; unset: chosen from alphas", TypeConverters.toFloat)
    alphas = Param(Params._dummy(), "alphas", "penalties to choose from", TypeConverters.toListFloat)
    foldCol = Param(Params._dummy(), "foldCol", "column of the cross-validation folds", TypeConverters.toString)

    def _defaults(self) -> None:
        self._setDefault(inputCols=list(M.INPUTS), labelCol="price", predictionCol="prediction", degree=5,
                         alphas=[float(a) for a in M.ALPHAS], foldCol="fold")


class PriceRidge(Estimator, _PriceParams, DefaultParamsReadable, DefaultParamsWritable):
    """Polynomial ridge regression of the price."""

    def __init__(self, **params) -> None:
        super().__init__()
        self._defaults()
        self._set(**params)

    def setParams(self, **params) -> "PriceRidge":
        return self._set(**params)

    def _fit(self, dataset: DataFrame) -> "PriceRidgeModel":
        inputs, label, fold = self.getInputCols(), self.getLabelCol(), self.getOrDefault("foldCol")
        folds = F.col(fold) if fold in dataset.columns else F.pmod(F.xxhash64(*inputs, label), F.lit(5))
        train = dataset.select(*inputs, F.col(label), folds.cast("int").alias("fold"))
        alpha = self.getOrDefault("alpha") if self.isDefined("alpha") else None
        fitted = M.fit(train, inputs, self.getOrDefault("degree"), self.getOrDefault("alphas"), label, alpha)
        return self._copyValues(PriceRidgeModel(fitted))


class PriceRidgeModel(Model, _PriceParams, MLReadable, MLWritable):
    """A fitted price model: ``ridge`` holds the coefficients and the cross-validation table."""

    def __init__(self, ridge: M.RidgeModel | None = None) -> None:
        super().__init__()
        self._defaults()
        self.ridge = ridge

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.ridge.transform(dataset, self.getPredictionCol())

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    """The stage's metadata, and beside it the fitted model as JSON."""

    def __init__(self, stage: PriceRidgeModel) -> None:
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage.ridge.save(self.sparkSession, f"{path}/ridge")


class _Reader(MLReader):
    def __init__(self, cls: type[PriceRidgeModel]) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> PriceRidgeModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.cls(M.RidgeModel.load(self.sparkSession, f"{path}/ridge"))
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        return stage
