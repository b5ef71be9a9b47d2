"""The detector as stages of a Spark ML pipeline, with parameters, writers and readers."""

from __future__ import annotations

import dataclasses
import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame

from tidewatch.plans.detector import Detector, DetectorConfig, DetectorModel


class _DetectorParams(Params):
    """``options`` of the detector as JSON, and the columns that the stage reads."""

    options = Param(Params._dummy(), "options", "options of the detector, as a JSON object", TypeConverters.toString)
    lineCol = Param(Params._dummy(), "lineCol", "column of the raw line", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "column of the unique line number", TypeConverters.toString)
    timeCol = Param(Params._dummy(), "timeCol", "column of the arrival time, '' for the current time", TypeConverters.toString)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(options="{}", lineCol="line", idCol="line_no", timeCol="ingest_ts")

    def config(self) -> DetectorConfig:
        """The detector's options; unknown ones are an error."""
        given = json.loads(self.getOrDefault(self.options))
        return DetectorConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})

    def setOptions(self, **options):
        return self._set(options=json.dumps(options, sort_keys=True))

    def _lines(self, df: DataFrame) -> DataFrame:
        names = {"idCol": "line_no", "lineCol": "line", "timeCol": "ingest_ts"}
        given = {self.getOrDefault(p): name for p, name in names.items() if self.getOrDefault(p)}
        missing = [c for c in given if c not in df.columns]
        if missing:
            raise ValueError(f"input lacks the columns {missing}")
        return df.selectExpr(*[f"`{c}` as {name}" for c, name in given.items()])


class LogAnomalyDetector(Estimator, _DetectorParams, MLReadable, MLWritable):
    """Fits templates, scaler and model on lines; ``setOptions`` takes the fields of ``DetectorConfig``."""

    @keyword_only
    def __init__(self, *, options: str = "{}", lineCol: str = "line", idCol: str = "line_no", timeCol: str = "ingest_ts"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "LogAnomalyModel":
        model = Detector(self.config()).fit(self._lines(df))
        return self._copyValues(LogAnomalyModel(model))

    def write(self) -> MLWriter:
        return DefaultParamsWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return DefaultParamsReader(cls)


class LogAnomalyModel(Model, _DetectorParams, MLReadable, MLWritable):
    """A fitted detector; ``transform`` gives one record for each line."""

    def __init__(self, detector: DetectorModel | None = None):
        super().__init__()
        self.detector = detector

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.detector.transform(self._lines(df))

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader(cls)


class _ModelWriter(MLWriter):
    def __init__(self, instance: LogAnomalyModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        self.instance.detector.save(f"{path}/detector")
        config = dataclasses.asdict(self.instance.detector.config)
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"config": config})


class _ModelReader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> LogAnomalyModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(DetectorModel.load(self.sparkSession, f"{path}/detector"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
