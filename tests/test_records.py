"""Records of the lines that a detector was fitted on, parsed once for both."""

import pytest

from tidewatch.plans import detector as plans
from tidewatch.plans import queries
from tidewatch.plans.detector import Detector
from tidewatch.sources.access_logs import access_logs


def by_line(records):
    return {r.line_no: (r.anomaly, r.model, r.reason, r.parsed_log, round(r.score, 9)) for r in records.collect()}


def test_equal_those_of_transform(spark, sf_dir):
    lines = access_logs(spark, sf_dir)
    model = Detector(model="pca").fit(lines, records=True)
    found = by_line(model.fitted_records())
    assert found == by_line(model.transform(lines)) and len(found) == lines.count()
    # rows of unreadable lines get records, but teach nothing
    assert model.training[1] < lines.count()
    plain = Detector(model="pca").fit(lines)
    assert plain.state == model.state and plain.fitted.threshold == pytest.approx(model.fitted.threshold)
    with pytest.raises(ValueError, match="records=True"):
        plain.fitted_records()
    with pytest.raises(ValueError, match="sample"):
        Detector(max_samples=10).fit(lines, records=True)


def test_query_parses_once(spark, sf_dir, monkeypatch):
    calls, plain = [], plans.parse_logs
    monkeypatch.setattr(queries, "_FITTED", {})
    monkeypatch.setattr(plans, "parse_logs", lambda *a: calls.append(1) or plain(*a))
    found = queries.QUERIES["recon_score_pca"](spark, sf_dir)
    assert len(calls) == 1 and found.count() == access_logs(spark, sf_dir).count()
