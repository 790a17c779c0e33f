"""K4: the feature encoders and the logistic fit as ``pyspark.ml`` stages.

``Pipeline(stages=[MeanTargetEncoder(...), CyclicFeatures(...), MinMaxColumns(...),
WeightedLogistic(...)]).fit(train)`` gives a ``PipelineModel`` that is saved and loaded like
any other. A fitted map or range is a DataFrame; it is stored as Parquet beside the
stage's parameters, so a loaded model transforms in another session without refitting.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable,
                             MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame, SparkSession

from . import features as FT
from . import model as M


class _Columns(Params):
    cols = Param(Params._dummy(), "cols", "columns to encode", TypeConverters.toListString)
    label = Param(Params._dummy(), "label", "label column", TypeConverters.toString)

    def _given(self, kwargs: dict):
        return self._set(**{k: v for k, v in kwargs.items() if v is not None})


class _TableWriter(MLWriter):
    """Parameters as the library writes them, fitted tables as Parquet below them."""

    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, SparkSession.getActiveSession())
        for name, table in self.instance._tables().items():
            table.write.parquet(f"{path}/{name}")


class _TableReader(MLReader):
    def __init__(self, kind):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        spark = SparkSession.getActiveSession()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        tables = {n: spark.read.parquet(f"{path}/{n}") for n in self.kind._names}
        out = self.kind(**tables)
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        return out


class _TableModel(Model, _Columns, MLWritable, MLReadable):
    """A fitted stage whose state is DataFrames, named in ``_names``."""
    _names: tuple[str, ...] = ()

    def __init__(self, **tables: DataFrame):
        super().__init__()
        self._state = tables

    def _tables(self) -> dict[str, DataFrame]:
        return self._state

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)


class MeanTargetEncoder(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Each category's mean label; unseen categories become NULL."""

    @keyword_only
    def __init__(self, *, cols=None, label=None):
        super().__init__()
        self._given(self._input_kwargs)

    def _fit(self, dataset: DataFrame):
        cols = self.getOrDefault(self.cols)
        fitted = FT.MeanEncoder(cols).fit(dataset, self.getOrDefault(self.label))
        return MeanTargetEncoderModel(mapping=fitted.mapping)._set(cols=cols)


class MeanTargetEncoderModel(_TableModel):
    _names = ("mapping",)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return FT.MeanEncoderModel(self.getOrDefault(self.cols), self._state["mapping"]).transform(dataset)


class CyclicFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """``sin_<name>`` and ``cos_<name>`` of a column with a period."""
    col = Param(Params._dummy(), "col", "column", TypeConverters.toString)
    period = Param(Params._dummy(), "period", "length of a cycle", TypeConverters.toFloat)
    name = Param(Params._dummy(), "name", "suffix of the new columns", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, col=None, period=None, name=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return FT.cyclic(dataset, *[self.getOrDefault(p) for p in (self.col, self.period, self.name)])


class MinMaxColumns(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Columns scaled to their range in fitting."""

    @keyword_only
    def __init__(self, *, cols=None):
        super().__init__()
        self._given(self._input_kwargs)

    def _fit(self, dataset: DataFrame):
        cols = self.getOrDefault(self.cols)
        return MinMaxColumnsModel(stats=FT.min_max_fit(dataset, cols).stats.checkpoint(eager=True))._set(cols=cols)


class MinMaxColumnsModel(_TableModel):
    _names = ("stats",)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return FT.MinMaxModel(self.getOrDefault(self.cols), self._state["stats"]).transform(dataset)


class WeightedLogistic(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """I16: balanced L2 logistic regression on dense columns."""
    C = Param(Params._dummy(), "C", "inverse of the penalty", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, cols=None, label=None, C=None):
        super().__init__()
        self._given(self._input_kwargs)

    def _fit(self, dataset: DataFrame):
        cols, label = self.getOrDefault(self.cols), self.getOrDefault(self.label)
        fitted = M.fit_logistic(FT.balanced_weights(dataset, label), cols, label, self.getOrDefault(self.C))
        rows = [(i, c, float(v)) for i, (c, v) in enumerate(zip([*cols, ""], [*fitted.coefficients, fitted.intercept]))]
        table = dataset.sparkSession.createDataFrame(rows, "place int, name string, coef double")
        return WeightedLogisticModel(coefficients=table)._set(cols=cols)


class WeightedLogisticModel(_TableModel):
    _names = ("coefficients",)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        # One row per column of the model and one for the intercept.
        coefs = [r["coef"] for r in self._state["coefficients"].orderBy("place").collect()]
        return M.score(M.LinearModel(coefs[:-1], coefs[-1]), dataset, self.getOrDefault(self.cols))


def reference_stages(label: str = "revision", C: float | None = None) -> list:
    """The reference's feature set as stages, with a logistic fit behind it if ``C`` is given."""
    stages = [MeanTargetEncoder(cols=FT.CATEGORICAL, label=label),
              CyclicFeatures(col="day_listed", period=float(FT.DAY_PERIOD), name="day"),
              CyclicFeatures(col="week_listed", period=float(FT.WEEK_PERIOD), name="week"), MinMaxColumns(cols=FT.SCALED)]
    return stages + ([WeightedLogistic(cols=FT.EXTENDED, label=label, C=C)] if C else [])
