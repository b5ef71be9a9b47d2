"""An address's rows of a micro-batch go through arrays: most addresses have few, and frames cost more."""

import pandas as pd

from tidewatch.streaming.ip_stats import _statistics


class State:
    exists, get = True, ([0], 2)

    def update(self, value):
        self.value = value


def test_statistics_of_an_address_sort_no_frame(monkeypatch):
    rows = [(9, 120, "/b", False), (8, 120, "/a", False), (7, 60, "/c", False), (6, 180, "/b", False)]
    rows = [(n, s * 1_000_000, p, d) for n, s, p, d in [*rows, (0, 0, "/b", True), (0, 0, "/c", True)]]
    both = pd.DataFrame(rows, columns=["line_no", "event_us", "path", "_debut"])
    for name in ("sort_values", "loc"):
        monkeypatch.setattr(pd.DataFrame, name, None)
    state = State()
    (found,) = _statistics(2, 3)(("a",), iter([both]), state)
    assert found["line_no"].tolist() == [7, 8, 9, 6]
    assert found["ip_path_diversity"].tolist() == [3, 3, 4, 4]
    assert found["ip_frequency"].tolist() == [2, 2, 3, 3]
    assert found["ip_request_rate"].tolist() == [2.0, 2.0, 3.0, 3.0]
    assert state.value == ([120_000_000, 120_000_000, 180_000_000], 4)
