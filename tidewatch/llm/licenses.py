"""License scan by template markup.

A template is running text with ``<<optional>> ... <<end>>`` around words that may be left out and
``<<words a-b>>`` where any a to b words may stand (a holder's name, a year). It is compiled into an
automaton over words; a place of a text is accepted if all mandatory words match exactly. A run of
mandatory words that every accepted text holds is looked for first, and the automaton starts only
at the places from which that run can be reached. Subsets of states are built when they are first
met and kept as a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from tidewatch.llm.common import alnum_words, map_text, worker_cache

# Phrases and the labels they give.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wording of public licenses and of the usual statements that name them.
TEMPLATES = {
    "gpl-statement": (
        "<<optional>> this <<words 1-3>> is <<end>> licensed under the <<optional>> terms of the <<end>>"
        " gnu general public license <<optional>> version <<words 1-1>> <<end>>"
    ),
    "apache-2.0-statement": (
        "licensed under the <<optional>> terms of the <<end>> apache license version 2 0"
    ),
    "mit-statement": "<<optional>> this <<words 1-3>> is <<end>> <<words 1-1>> under the mit license",
    "cc-by-statement": (
        "licensed under <<optional>> a <<end>> <<optional>> the <<end>> cc by"
        " <<optional>> sa <<end>> <<words 1-1>> 0"
    ),
    "cc-by-nc-statement": (
        "licensed under <<optional>> a <<end>> <<optional>> the <<end>> cc by nc"
        " <<optional>> sa <<end>> <<optional>> nd <<end>> <<words 1-1>> 0"
    ),
    "gpl-notice": (
        "this <<words 1-4>> is free software you can redistribute it and or modify it under the terms"
        " of the gnu general public license as published by the free software foundation either"
        " version <<words 1-2>> of the license or <<optional>> at your option <<end>> any later version"
    ),
    "apache-2.0-notice": (
        "licensed under the apache license version 2 0 the license you may not use this file except in"
        " compliance with the license you may obtain a copy of the license at"
        " <<optional>> http <<end>> <<optional>> https <<end>> www apache org licenses license 2 0"
    ),
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software"
        " and associated documentation files the software to deal in the software without restriction"
        " including without limitation the rights to use copy modify merge publish distribute"
        " sublicense and or sell copies of the software and to permit persons to whom the software is"
        " furnished to do so subject to the following conditions the above copyright notice and this"
        " permission notice <<optional>> including the next paragraph <<end>> shall be included in all"
        " copies or substantial portions of the software"
    ),
    "isc-text": (
        "permission to use copy modify and or distribute this software for any purpose with or without"
        " fee is hereby granted provided that the above copyright notice and this permission notice"
        " appear in all copies"
    ),
    "bsd-text": (
        "redistribution and use in source and binary forms with or without modification are permitted"
        " provided that the following conditions are met <<words 0-1>> redistributions of source code"
        " must retain the above copyright notice this list of conditions and the following disclaimer"
        " <<words 0-1>> redistributions in binary form must reproduce the above copyright notice this"
        " list of conditions and the following disclaimer in the documentation and or other materials"
        " provided with the distribution"
    ),
}

_MARKUP = re.compile(r"<<(optional|end|words (\d+)-(\d+))>>|(\S+)")


class Template:
    """Automaton of one template. Edges are (word or None for any word, following state)."""

    def __init__(self, label: str, text: str):
        self.label = label
        self.edges: list[list[tuple[bytes | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        open_, run, runs, depth, longest = [], [], [], 0, 0
        state = before = 0
        for m in _MARKUP.finditer(text):
            if m[4]:
                state = self._edge(state, m[4].encode())
                if not depth:
                    if not run:
                        before = longest
                    run.append(m[4].encode())
                longest += 1
                continue
            runs.append((run, before))
            run = []
            if m[1] == "optional":
                open_.append(state)
                depth += 1
            elif m[1] == "end":
                self.free[open_.pop()].append(state)
                depth -= 1
            else:
                least, most = int(m[2]), int(m[3])
                ends = []
                for k in range(most):
                    if k >= least:
                        ends.append(state)
                    state = self._edge(state, None)
                longest += most
                for e in ends:
                    self.free[e].append(state)
        runs.append((run, before))
        self.final = state
        # the longest run that every accepted text holds, and the words that can stand before it
        anchor, self.before = max(runs, key=lambda r: len(r[0]))
        if not anchor:
            raise ValueError(f"{label}: a template needs a mandatory word outside optional parts")
        self.anchor = b" " + b" ".join(anchor) + b" "
        self.known = {w for e in self.edges for w, _ in e if w}
        self.begin = self._closed({0})
        self.table: dict = {}

    def _edge(self, state: int, word: bytes | None) -> int:
        self.edges.append([])
        self.free.append([])
        self.edges[state].append((word, len(self.edges) - 1))
        return len(self.edges) - 1

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, done = list(states), set(states)
        while todo:
            for following in self.free[todo.pop()]:
                if following not in done:
                    done.add(following)
                    todo.append(following)
        return frozenset(done)

    def _next(self, states: frozenset[int], word: bytes) -> frozenset[int]:
        key = (states, word if word in self.known else None)
        found = self.table.get(key)
        if found is None:
            reached = {t for s in states for w, t in self.edges[s] if w is None or w == word}
            found = self.table[key] = self._closed(reached)
        return found

    def longest(self, words: list[bytes], start: int) -> int:
        """End of the longest accepted run of words from ``start``; ``start`` if there is none."""
        states, end = self.begin, start
        for place in range(start, len(words)):
            states = self._next(states, words[place])
            if not states:
                break
            if self.final in states:
                end = place + 1
        return end

    def matches(self, joined: bytes, words: list[bytes]) -> list[tuple[int, int]]:
        """Non-overlapping accepted runs, from the left."""
        out, tried, counted, at_word = [], -1, 0, 0
        at = joined.find(self.anchor)
        while at >= 0:
            at_word += joined.count(b" ", counted, at)
            counted = at
            for start in range(max(tried + 1, at_word - self.before), at_word + 1):
                if out and start < out[-1][1]:
                    continue
                end = self.longest(words, start)
                if end > start:
                    out.append((start, end))
            tried = max(tried, at_word)
            at = joined.find(self.anchor, at + 1)
        return out


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.templates = [Template(k, v) for k, v in templates.items()]
        self.base = [(f" {k} ".encode(), v) for k, v in BASE.items()]

    def scan(self, text: bytes) -> tuple:
        words = alnum_words(text)
        joined = b" " + b" ".join(words) + b" "
        places, base = [], set()
        for phrase, label in self.base:
            at, counted, word = joined.find(phrase), 0, 0
            while at >= 0:
                base.add(label)
                word += joined.count(b" ", counted, at)
                counted = at
                places.append(word)
                at = joined.find(phrase, at + 1)
        found = [
            (t.label, start, end)
            for t in self.templates
            if t.anchor in joined
            for start, end in t.matches(joined, words)
        ]
        labels = base | {label for label, _, _ in found}
        return (
            len(words),
            len(places),
            min(places, default=None),
            max(places, default=None),
            ",".join(sorted(base)),
            ",".join(sorted(labels)),
            1.0 if found else 0.5 if base else 0.0,
            [{"label": a, "start": b, "end": c} for a, b, c in found],
        )


FIELDS = [
    StructField("n_words", LongType()),
    StructField("n_base", LongType()),
    StructField("first_word", LongType()),
    StructField("last_word", LongType()),
    StructField("base_labels", StringType()),
    StructField("labels", StringType()),
    StructField("score", DoubleType()),
    StructField(
        "matches",
        ArrayType(
            StructType(
                [
                    StructField("label", StringType()),
                    StructField("start", IntegerType()),
                    StructField("end", IntegerType()),
                ]
            )
        ),
    ),
]


def scan(df: DataFrame, text: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """Add license labels and places to every whole text.

    ``matches`` holds the accepted runs of words by template. ``score`` is 1 if a template accepts a
    run, 0.5 if only a base phrase occurs and 0 else. Null and empty texts have no words, empty
    labels and no places; rows are independent of each other, so repeated rows repeat the result.
    Columns of ``df`` named like a result are replaced.
    """
    wanted = dict(TEMPLATES if templates is None else templates)

    def make():
        own = worker_cache(f"licenses:{hash(tuple(wanted.items()))}", lambda: Scanner(wanted))
        return lambda texts: list(zip(*map(own.scan, texts)))

    return map_text(df, text, FIELDS, make)
