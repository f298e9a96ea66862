"""Fitted parts of the QC models as pipeline stages: they fit, save, load, and transform tables and streams apart from the fit."""

from __future__ import annotations

from typing import Any

from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.numeric import finite, ratio
from assayer.functions.quantiles import exact_quantiles


class _Writer(MLWriter):
    def __init__(self, model: FittedModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"state": self.model.state})
        for name, rows in self.model.tables(self.sparkSession).items():
            rows.write.parquet(f"{path}/{name}")


class _Reader(MLReader):
    def __init__(self, kind: type[FittedModel]) -> None:
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> FittedModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.kind(metadata["state"])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.read_tables(self.sparkSession, path)
        return model


class FittedModel(Model, MLWritable, MLReadable):
    """A model whose state is a dict of plain values, saved with its parameters, and tables if a model has more."""

    def __init__(self, state: dict[str, Any] | None = None) -> None:
        super().__init__()
        self.state = state or {}

    def tables(self, spark) -> dict[str, DataFrame]:
        return {}

    def read_tables(self, spark, path: str) -> None:
        pass

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class SavedEstimator(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """An estimator that is saved by its parameters."""


def number(c: str) -> Column:
    """A feature as a finite double."""
    return finite(F.col(c).cast("double"))


class MedianImputer(SavedEstimator, HasInputCols):
    """Missing and infinite values of each column take its median over the fitted table, or 0 where it has no value at all."""

    def __init__(self, columns: list[str] | None = None) -> None:
        super().__init__()
        self._set(inputCols=columns or [])

    def _fit(self, dataset: DataFrame) -> MedianImputerModel:
        columns = self.getInputCols()
        rows = dataset.select(*[number(c).alias(c) for c in columns])
        found = exact_quantiles(rows, columns, [0.5])[0].first()
        middle = {c: found[c][0] if found is not None and found[c] is not None else 0.0 for c in columns}
        return self._copyValues(MedianImputerModel({"medians": middle}))


class MedianImputerModel(FittedModel, HasInputCols):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({c: F.coalesce(number(c), F.lit(float(self.state["medians"][c]))) for c in self.getInputCols()})


class Standardiser(SavedEstimator, HasInputCols):
    """Mean 0 and population deviation 1 by the fitted table's moments; a column without spread becomes 0. Adds <column>_z."""

    def __init__(self, columns: list[str] | None = None) -> None:
        super().__init__()
        self._set(inputCols=columns or [])

    def _fit(self, dataset: DataFrame) -> StandardiserModel:
        columns = self.getInputCols()
        row = dataset.agg(*[x for c in columns for x in (F.avg(number(c)).alias(f"m_{c}"), F.stddev_pop(number(c)).alias(f"s_{c}"))]).first()
        return self._copyValues(StandardiserModel({"moments": {c: [row[f"m_{c}"], row[f"s_{c}"]] for c in columns}}))


class StandardiserModel(FittedModel, HasInputCols):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        def scaled(c: str) -> Column:
            mean, spread = (F.lit(x).cast("double") for x in self.state["moments"][c])
            return F.when(number(c).isNotNull(), F.coalesce(ratio(number(c) - mean, spread), F.lit(0.0)))

        return dataset.withColumns({f"{c}_z": scaled(c) for c in self.getInputCols()})
