"""Benchmark text in documents, found with an FM-index of each training shard.

A shard is a slice of documents inside a task. Its words become numbers by the words of the test
phrases; all others, and words whose neighbours never stand beside them in a test phrase, become
one separator that no phrase holds. What is left is indexed: a suffix array by prefix doubling, its
Burrows-Wheeler transform as a wavelet matrix with rank counts, and every ``SAMPLE``-th position.
Backward search runs all test phrases at once; places are found by stepping to the nearest sampled
position; spans that touch are merged. The shards' indexes live only inside their tasks, so a lost
executor costs its own slices and nothing else.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tidewatch.llm.common import Stash, alnum_words, fresh, map_text, sliced, utf8

WINDOW = 10
SAMPLE = 8
# Words of test items that are shipped to the tasks at once; more items are searched in blocks.
BLOCK_WORDS = 2_000_000


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; only groups that still tie are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    keys = text[order]
    first = np.ones(n, bool)
    first[1:] = keys[1:] != keys[:-1]
    heads = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = heads
    tied = ~(first & np.append(first[1:], True))
    step = 1
    while tied.any():
        places = np.flatnonzero(tied)
        own = order[places]
        behind = own + step
        second = np.where(behind < n, rank[np.minimum(behind, n - 1)], -1)
        group = heads[places]
        resort = np.lexsort((second, group))
        own, second = own[resort], second[resort]
        order[places] = own
        new = np.ones(len(places), bool)
        new[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))
        heads[places] = places[head]
        rank[own] = heads[places]
        last = np.append(new[1:], True)
        tied[places[new & last]] = False
        step *= 2
    return order


class WaveletMatrix:
    """Rank of any symbol in a sequence, one bit of the symbol a level."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for bit in range(bits - 1, -1, -1):
            ones = (values >> bit & 1).astype(bool)
            before = np.concatenate([[0], np.cumsum(ones, dtype=np.int32)]).astype(np.int32)
            self.levels.append((bit, before, len(values) - int(before[-1])))
            values = np.concatenate([values[~ones], values[ones]])

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        low = np.zeros_like(places)
        for bit, before, zeros in self.levels:
            one = (symbols >> bit & 1).astype(bool)
            places = np.where(one, zeros + before[places], places - before[places])
            low = np.where(one, zeros + before[low], low - before[low])
        return places - low

    def symbol(self, places: np.ndarray) -> np.ndarray:
        found = np.zeros_like(places)
        for bit, before, zeros in self.levels:
            one = before[places + 1] > before[places]
            found |= one.astype(found.dtype) << bit
            places = np.where(one, zeros + before[places], places - before[places])
        return found


class FmIndex:
    def __init__(self, text: np.ndarray, symbols: int):
        text = np.append(text, 0)  # the end; separators are 1
        order = suffix_array(text)
        self.n = len(text)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        bits = max(1, int(symbols).bit_length())
        self.wavelet = WaveletMatrix(text[order - 1], bits)
        sampled = order % SAMPLE == 0
        self.sample_rank = np.concatenate([[0], np.cumsum(sampled)])
        self.sampled, self.samples = sampled, order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of each row of ``phrases`` by backward search; -1 pads a row on its left."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        for column in phrases.T[::-1]:
            live = np.flatnonzero((high > low) & (column >= 0))
            if not len(live):
                continue
            c = column[live]
            low[live] = self.before[c] + self.wavelet.rank(c, low[live])
            high[live] = self.before[c] + self.wavelet.rank(c, high[live])
        return low, high

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks: step back to a sampled position and count the steps."""
        out = np.zeros(len(places), np.int64)
        live, at, steps = np.arange(len(places)), places.astype(np.int64), 0
        while len(live):
            hit = self.sampled[at]
            out[live[hit]] = self.samples[self.sample_rank[at[hit]]] + steps
            live, at = live[~hit], at[~hit]
            c = self.wavelet.symbol(at)
            at = self.before[c] + self.wavelet.rank(c, at)
            steps += 1
        return out % self.n


class Phrases:
    """Distinct windows of the test items as rows of word numbers, and the items of each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.words: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            numbers = [self.words.setdefault(w, len(self.words) + 2) for w in alnum_words(text)]
            if not numbers:
                continue
            for start in range(max(1, len(numbers) - window + 1)):
                owners.setdefault(tuple(numbers[start : start + window]), set()).add(name)
        self.symbols = len(self.words) + 2
        self.owners = [sorted(v) for v in owners.values()]
        self.lengths = np.array([len(k) for k in owners], np.int64)
        self.rows = np.full((len(owners), window), -1, np.int64)
        for row, k in zip(self.rows, owners):
            row[window - len(k) :] = k
        pairs = {a * self.symbols + b for k in owners for a, b in zip(k, k[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.single = np.array(sorted({k[0] for k in owners if len(k) == 1}), np.int64)
        self.hashed = np.zeros(1 << 22, bool)
        self.hashed[self.pairs & (1 << 22) - 1] = True

    def holds(self, pairs: np.ndarray) -> np.ndarray:
        out = self.hashed[pairs & (1 << 22) - 1]
        some = np.flatnonzero(out)
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, pairs[some]), len(self.pairs) - 1)
            out[some] = self.pairs[at] == pairs[some]
        return out


class Shard:
    """The documents of one slice, searched together."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases

    def find(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each text its number of words, merged hit spans in words, and items found."""
        p = self.phrases
        number = p.words.get
        split = [alnum_words(t) for t in texts]
        sizes = np.array([len(w) for w in split], np.int64)
        # one separator after every document
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        text = np.ones(starts[-1], np.int64)
        for words, at in zip(split, starts):
            text[at : at + len(words)] = [number(w, 1) for w in words]
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        if len(p.owners) and len(text):
            begin, which = self._hits(text)
            doc = np.searchsorted(starts, begin, "right") - 1
            order = np.lexsort((begin, doc))
            for d, b, w in zip(doc[order].tolist(), begin[order].tolist(), which[order].tolist()):
                b -= int(starts[d])
                e = b + int(p.lengths[w])
                own = spans[d]
                if own and b <= own[-1][1]:
                    own[-1] = (own[-1][0], max(e, own[-1][1]))
                else:
                    own.append((b, e))
                items[d].update(p.owners[w])
        return [(int(n), s, sorted(i)) for n, s, i in zip(sizes, spans, items)]

    def _hits(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = self.phrases
        beside = p.holds(text[:-1] * p.symbols + text[1:])
        wanted = np.zeros(len(text), bool)
        wanted[:-1] |= beside
        wanted[1:] |= beside
        if len(p.single):
            wanted |= np.isin(text, p.single)
        kept = np.flatnonzero(wanted)
        if not len(kept):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # words that stay, and one separator wherever something between them went
        gap = np.append(np.diff(kept) > 1, True)
        place = np.arange(len(kept)) + np.concatenate([[0], np.cumsum(gap)[:-1]])
        reduced = np.ones(int(place[-1]) + 2, np.int64)
        reduced[place] = text[kept]
        origin = np.zeros(len(reduced), np.int64)
        origin[place] = kept
        index = FmIndex(reduced, p.symbols)
        low, high = index.search(p.rows)
        count = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(count)), count)
        ranks = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return origin[index.locate(ranks + low[which])], which


_SPANS = ArrayType(
    StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])
)


def blocks(benchmark: DataFrame, item_id: str, text: str, most_words: int):
    """Lists of (item, text) of at most ``most_words`` words, or one item if it is longer.

    Items are read partition by partition, so the driver holds one block at a time.
    """
    held, words = [], 0
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t"))
    for row in rows.toLocalIterator():
        raw = (row.t or "").encode()
        n = len(alnum_words(raw))
        if held and words + n > most_words:
            yield held
            held, words = [], 0
        held.append((row.i, raw))
        words += n
    yield held


def _finder(spark, block: list, window: int):
    """Makes, inside a task, the function from texts to what ``Shard.find`` tells of them."""
    shipped = spark.sparkContext.broadcast([(str(i), t) for i, t in block if i is not None])
    return lambda: Shard(Phrases(shipped.value, window)).find


def _search(rows: DataFrame, text: str, block: list, window: int) -> DataFrame:
    """Add n_words, spans and items of one block of test items."""
    fields = [
        StructField("n_words", LongType()),
        StructField("spans", _SPANS),
        StructField("items", ArrayType(StringType())),
    ]
    finder = _finder(rows.sparkSession, block, window)

    def make():
        find_in = finder()

        def work(texts):
            found = find_in(texts)
            return (
                [f[0] for f in found],
                [[{"start": a, "end": b} for a, b in f[1]] for f in found],
                [f[2] for f in found],
            )

        return work

    return map_text(rows, text, fields, make)


def find(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Add n_words, spans (merged, in words) and items to every document.

    Null and empty texts have no words and no hits, items without words match nothing, a null
    item_id is never reported, rows are judged one by one, so repeated ones repeat the result, and
    an empty benchmark hits nothing. Columns of ``df`` with these names are replaced.
    """

    parts = blocks(benchmark, item_id, item_text, block_words)
    one, more = next(parts), next(parts, None)
    if more is None:
        return _search(df, text, one, window)
    # more test text than one block: number the rows, search block by block, merge by row
    stash = Stash(df.sparkSession, "decontaminate")
    key = fresh(df, "_row")
    rows = stash.keep(df.withColumn(key, F.monotonically_increasing_id()), "rows")
    found = None
    while one is not None:
        hits = _search(rows.select(key, text), text, one, window).drop(text)
        hits = stash.keep(hits, "hits")
        found = hits if found is None else found.unionByName(hits)
        one, more = more, next(parts, None)
    merged = found.groupBy(key).agg(
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    joined = F.aggregate(
        F.array_sort("spans"),
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["start"].alias("start"),
                        F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    kept = [c for c in rows.columns if c not in ("n_words", "spans", "items")]
    return (
        rows.select(*[f"`{c}`" for c in kept])
        .join(merged.withColumn("spans", joined), key)
        .drop(key)
    )


def remove(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of ``spans`` and what stands between the words of one span."""
    if not spans:
        return text
    places = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", text)]
    out, at = [], 0
    for start, end in spans:
        out.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*out, text[at:]])


def _cut(batch: pa.RecordBatch, at: int, texts: list[bytes], found: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    """``batch`` with the spans cut out of its text column ``at``, without rows that were nothing else."""
    out = [remove(raw, spans) for raw, spans in zip(texts, found)]
    keep = [not spans or bool(alnum_words(left)) for left, spans in zip(out, found)]
    new = pa.array(out, pa.binary()).cast(pa.string())
    columns = list(batch.columns)
    columns[at] = pc.if_else(columns[at].is_valid(), new, pa.scalar(None, pa.string()))
    return pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(keep, pa.bool_()))


def clean(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``df`` with the hit words cut out of its texts.

    Texts without a hit stay as they are, null ones too. A text that has no word left was benchmark
    text as a whole; its row goes. ``df`` must not have columns n_words, spans or items. Where one
    block holds the test items, a slice is searched and cut in one pass, by one Python worker a core.
    """
    schema, names = df.schema, df.columns
    at = names.index(text)
    parts = blocks(benchmark, item_id, item_text, block_words)
    one, more = next(parts), next(parts, None)
    if more is None:
        finder = _finder(df.sparkSession, one, window)

        def search_and_cut(batches):
            find_in = finder()
            for batch in sliced(batches, text):
                texts = utf8(batch.column(at))
                yield _cut(batch, at, texts, [spans for _, spans, _ in find_in(texts)])

        return df.mapInArrow(search_and_cut, schema)
    found = find(df, benchmark, text, item_id, item_text, window, block_words)

    def cut(batches):
        for batch in sliced(batches, text):
            spans = [[(s["start"], s["end"]) for s in own] for own in batch.column(len(names)).to_pylist()]
            yield _cut(batch.select(names), at, utf8(batch.column(at)), spans)

    return found.select(*names, "spans").mapInArrow(cut, schema)
