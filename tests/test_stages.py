"""The detector as a stage of a Spark ML pipeline."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer

from tidewatch.plans.detector import Detector
from tidewatch.plans.stages import LogAnomalyDetector, LogAnomalyModel
from tidewatch.session import scratch_path
from tidewatch.sources.access_logs import access_logs

SMALL = dict(n_trees=10, tree_samples=64, similarity=0.6)


def rows(df):
    return sorted((r.line_no, r.anomaly, round(r.score, 12), r.reason) for r in df.collect())


def test_pipeline_survives_storage(spark, sf_dir):
    logs = access_logs(spark, sf_dir).withColumnsRenamed({"line": "text", "line_no": "id"})
    stage = LogAnomalyDetector(lineCol="text", idCol="id").setOptions(**SMALL)
    keep = SQLTransformer(statement="select line_no, anomaly, score, reason from __THIS__ where score is not null")
    fitted = Pipeline(stages=[stage, keep]).fit(logs)
    found = rows(fitted.transform(logs))
    plain = Detector(**SMALL).fit(access_logs(spark, sf_dir)).transform(access_logs(spark, sf_dir))
    assert found == rows(plain)
    path = scratch_path(spark, "pipeline")
    fitted.write().save(path)
    again = PipelineModel.load(path)
    assert isinstance(again.stages[0], LogAnomalyModel) and again.stages[0].uid == fitted.stages[0].uid
    assert rows(again.transform(logs)) == found
    with pytest.raises(Exception, match="already exists"):
        fitted.write().save(path)
    fitted.write().overwrite().save(path)


def test_estimator_survives_storage_and_checks_its_input(spark, sf_dir):
    stage = LogAnomalyDetector(timeCol="").setOptions(model="pca", features=["path_length", "status_code_category"])
    path = scratch_path(spark, "stage")
    stage.save(path)
    again = LogAnomalyDetector.load(path)
    assert again.config() == stage.config() and again.getOrDefault("timeCol") == ""
    assert again.config().features == ("path_length", "status_code_category")
    with pytest.raises(ValueError, match="lacks"):
        again.fit(spark.createDataFrame([(1,)], "line_no int"))
    with pytest.raises(TypeError):
        LogAnomalyDetector().setOptions(no_such_option=1).fit(access_logs(spark, sf_dir))
    copied = stage.copy({stage.lineCol: "other"})
    assert copied.getOrDefault("lineCol") == "other" and stage.getOrDefault("lineCol") == "line"
