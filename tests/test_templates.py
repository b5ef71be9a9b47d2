"""Counts of the tokens of a bucket's places."""

from tidewatch.operators.templates import WILDCARD, _place_kinds


def test_kinds_of_tokens_are_counted_without_a_sort(spark):
    rows = [("b", ["a", WILDCARD, "x"]), ("b", ["a", WILDCARD, "y"]), ("b", ["a", WILDCARD, WILDCARD]), ("c", ["a"])]
    kinds = _place_kinds(spark.createDataFrame(rows, "bucket string, tokens array<string>"))
    assert "SortAggregate" not in kinds._jdf.queryExecution().executedPlan().toString()
    found = sorted((r.bucket, r.place, r.kinds, r.wild) for r in kinds.collect())
    assert found == [("b", 0, 1, False), ("b", 1, 1, True), ("b", 2, 3, True), ("c", 0, 1, False)]
