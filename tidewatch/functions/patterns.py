"""Many text patterns at once: one automaton over the bytes of a batch of lines."""

from __future__ import annotations

from collections import deque
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns from which the automaton is used instead of one search for each.
MANY = 64


class PatternTable:
    """All patterns as one automaton whose fail links are flattened into a transition table.

    A batch of texts is read position by position: one look-up moves the states of all texts that
    are that long, so the work depends on the bytes of the texts and not on the number of patterns.
    """

    def __init__(self, patterns: tuple[str, ...]):
        self.patterns = patterns
        raw = [p.lower().encode() for p in patterns]
        # bytes that occur in no pattern share one column
        used = sorted({b for r in raw for b in r})
        self.columns = np.zeros(256, np.int64)
        self.columns[used] = np.arange(1, len(used) + 1)
        children: list[dict[int, int]] = [{}]
        own: list[list[int]] = [[]]
        for k, r in enumerate(raw):
            at = 0
            for b in self.columns[list(r)].tolist() if r else []:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    own.append([])
                at = children[at][b]
            own[at].append(k)
        size = len(children)
        self.table = np.zeros((size, len(used) + 1), np.int32)
        self.ends: list[np.ndarray] = [np.array(own[0], np.int64)] * size
        fail = np.zeros(size, np.int64)
        queue = deque([0])
        while queue:
            at = queue.popleft()
            if at:
                self.table[at] = self.table[fail[at]]
                self.ends[at] = np.array(sorted({*own[at], *self.ends[fail[at]].tolist()}), np.int64)
            for b, child in children[at].items():
                fail[child] = self.table[at, b] if at else 0
                queue.append(child)
            for b, child in children[at].items():
                self.table[at, b] = child
        self.stops = np.array([len(e) > 0 for e in self.ends])

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, pattern) pairs, in order, of the patterns that occur in each text."""
        sizes = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-sizes, kind="stable")
        data = self.columns[np.frombuffer(b"".join(texts), np.uint8)]
        start = (np.cumsum(sizes) - sizes)[order]
        state = np.zeros(len(texts), np.int64)
        found: set[tuple[int, int]] = set()
        if len(self.ends[0]):
            found |= {(row, 0) for row in range(len(texts))}
        longest = np.sort(sizes)
        for at in range(int(sizes.max(initial=0))):
            active = len(texts) - int(np.searchsorted(longest, at, "right"))
            state[:active] = self.table[state[:active], data[start[:active] + at]]
            ended = np.flatnonzero(self.stops[state[:active]])
            found.update(zip(order[ended].tolist(), state[ended].tolist()))
        pairs = {(row, k) for row, s in found for k in self.ends[s].tolist()}
        both = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]


@lru_cache(maxsize=8)
def _table(patterns: tuple[str, ...]) -> PatternTable:
    return PatternTable(patterns)


def _bytes(texts: pd.Series) -> list[bytes]:
    return [("" if t is None else t).encode() for t in texts]


def count_patterns(path: Column, raw: Column, patterns) -> Column:
    """How many patterns occur in the path or the raw line, ignoring case."""
    patterns = tuple(patterns)

    @F.pandas_udf("int")
    def counted(one: pd.Series, two: pd.Series) -> pd.Series:
        table = _table(patterns)
        hits = np.concatenate([np.stack(table.find(_bytes(x))) for x in (one, two)], axis=1)
        rows = np.unique(hits, axis=1)[0]
        return pd.Series(np.bincount(rows, minlength=len(one)).astype("int32"))

    return counted(F.lower(path), F.lower(raw))


def first_pattern(text: Column, patterns) -> Column:
    """First pattern in list order that occurs in the text, else null."""
    patterns = tuple(patterns)

    @F.pandas_udf("string")
    def first(texts: pd.Series) -> pd.Series:
        rows, which = _table(patterns).find(_bytes(texts))
        out = np.full(len(texts), None, object)
        for row, k in zip(rows[::-1].tolist(), which[::-1].tolist()):
            out[row] = patterns[k]
        return pd.Series(out)

    return first(F.lower(text))
