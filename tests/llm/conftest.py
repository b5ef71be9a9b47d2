import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import pytest


def texts():
    """Hard texts for every operator: null, empty, blank, odd characters, ties and long ones."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    return [
        (1, "the quick brown fox jumps over the lazy dog near the old river bank today"),
        (2, "the quick brown fox jumps over the lazy dog near the old river bank today"),
        (3, None),
        (4, ""),
        (5, " \t\n\x0b\x0c\r"),
        (6, "one two"),
        (7, "ünï çödé 日本語 🎉🎉 <|endoftext|> Σίσυφος İstanbul\x1c\x00"),
        (8, long),
        (8, long),
        (9, "a.b@c.de 10.0.0.1 +1 (555) 123-4567 4111 1111 1111 1111 released under the MIT License"),
        (None, "the quick brown fox jumps over the lazy dog near the old river bank today"),
        (None, None),
    ]


@pytest.fixture
def hard(spark):
    """The hard texts with other columns that are named like results or helpers of operators."""
    rows = [(i, t, 7, "x", [1], 2.5) for i, t in texts()]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, n_words int, spans string, ids array<int>, score double"
    ).repartition(3)


@pytest.fixture
def nothing(hard):
    return hard.limit(0)
