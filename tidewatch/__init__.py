"""Spark-native access-log analytics and anomaly detection."""

import sys

from pyspark import cloudpickle

# Python workers receive the package's functions with the task, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from tidewatch.operators.features import extract_features  # noqa: E402
from tidewatch.operators.parse import parse_logs  # noqa: E402
from tidewatch.plans.detector import Detector, DetectorModel  # noqa: E402
from tidewatch.sources.text import scan_lines, write_lines  # noqa: E402

__all__ = [
    "Detector",
    "DetectorModel",
    "extract_features",
    "parse_logs",
    "scan_lines",
    "write_lines",
]
