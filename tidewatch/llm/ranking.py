"""Ranked lexical search by presence masks.

A first pass counts the corpus (documents with terms, all terms, documents of each query term) and
stores for every document the query terms that it holds. A second pass goes over the stored rows
block by block: for each item the documents of a block are grouped by the mask of the item's terms
that they hold, built by bitmap operations on the places of each term. No document of a group can
score more than the best contributions of its terms in the block allow, so groups are evaluated by
descending bound until the item's worst kept score beats the next bound. A task keeps the best
documents of each item over all its blocks; the best of all tasks are merged at the end.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import Stash, alnum_words, sliced, utf8

TOP = 50
# Constants of the score, as percent: weight of the document length against the mean length.
LENGTH_PERCENT = 50
GAIN = 1_000_000_000
# Words of items that are searched for at once; more items are searched block by block.
ITEM_WORDS = 1_000_000
# Terms of documents that a task groups at once.
BLOCK_TERMS = 1 << 20
# Parts in which the winners of the tasks are merged before the last merge of an item.
PARTS = 64


class Items:
    """Items of one search: their distinct terms as numbers, shipped to the tasks."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.numbers: dict[bytes, int] = {}
        self.keys, self.terms = [], []
        for key, text in rows:
            own = sorted({self.numbers.setdefault(w, len(self.numbers)) for w in alnum_words(text)})
            if own:
                self.keys.append(key)
                self.terms.append(np.array(own, np.int64))


def item_blocks(items: DataFrame, most_words: int) -> Iterator[list[tuple[int, bytes]]]:
    """Lists of (key, text) of at most ``most_words`` words, or one item if it is longer."""
    held, words = [], 0
    for row in items.toLocalIterator():
        raw = (row["text"] or "").encode()
        n = len(alnum_words(raw))
        if held and words + n > most_words:
            yield held
            held, words = [], 0
        held.append((row["key"], raw))
        words += n
    yield held


def indexed(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id, n (terms of the text), and the query terms in it: term numbers and their counts."""
    shipped = docs.sparkSession.sparkContext.broadcast(items.numbers)

    def run(batches):
        numbers = shipped.value
        for batch in sliced(batches, "text"):
            sizes, terms, counts, ends = [], [], [], [0]
            for text in utf8(batch.column(1)):
                words = alnum_words(text)
                found = Counter(filter(None.__ne__, map(numbers.get, words)))
                sizes.append(len(words))
                terms.extend(found)
                counts.extend(found.values())
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
                ],
                names=["doc_id", "n", "terms", "counts"],
            )

    return docs.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, counts array<bigint>")


def weights(stored: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents with terms, all their terms, and the weight of every query term.

    The driver holds one number for each query term, of at most ``ITEM_WORDS``.
    """
    total = stored.filter("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    held = np.zeros(size, np.int64)
    for row in stored.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        held[row["term"]] = row["count"]
    docs = total["docs"]
    found = [math.floor(1000 * math.log((2 * docs + 2) / (2 * int(n) + 1))) for n in held]
    return docs, total["terms"] or 0, np.array(found, np.int64)


class Ranking:
    """The best documents of each item among the blocks seen so far."""

    def __init__(self, items: Items, weight: np.ndarray, docs: int, terms: int, top: int):
        self.items, self.weight, self.docs, self.total, self.top = items, weight, docs, terms, top
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in items.keys]
        self.evaluated = 0

    def add(self, ids: np.ndarray, missing: np.ndarray, n: np.ndarray, rows: np.ndarray, terms: np.ndarray, counts: np.ndarray):
        """A block: ids and sizes of documents; (row, term, count) of every query term in them."""
        if not len(terms):
            return
        share = np.array([(LENGTH_PERCENT * int(x) * self.docs) // self.total for x in n], np.int64)
        m = 100 - LENGTH_PERCENT + share
        gain = self.weight[terms] * ((GAIN * counts) // (1000 * counts + 20 * m[rows]))
        # places of a term in the block, as slices of one array
        order = np.argsort(terms, kind="stable")
        rows, gain, terms = rows[order], gain[order], terms[order]
        starts = np.flatnonzero(np.append(True, terms[1:] != terms[:-1]))
        ends = np.append(starts[1:], len(terms))
        highest = np.maximum.reduceat(gain, starts)
        place = {int(t): k for k, t in enumerate(terms[starts])}
        for which, own in enumerate(self.items.terms):
            held = [place[t] for t in own.tolist() if t in place]
            if held:
                self._item(which, [(rows[starts[k] : ends[k]], gain[starts[k] : ends[k]]) for k in held], highest[held], ids, missing)

    def _item(self, which: int, lists: list, highest: np.ndarray, ids: np.ndarray, missing: np.ndarray):
        """Group the block's documents by the mask of the item's terms and evaluate the masks."""
        masks = np.zeros((len(ids), (len(lists) + 63) // 64), np.uint64)
        for k, (rows, _) in enumerate(lists):
            masks[rows, k // 64] |= np.uint64(1) << np.uint64(k % 64)
        matched = np.flatnonzero(masks.any(axis=1))
        if masks.shape[1] == 1:
            kinds, group = np.unique(masks[matched, 0], return_inverse=True)
            kinds = kinds[:, None]
        else:
            kinds, group = np.unique(masks[matched], axis=0, return_inverse=True)
        bits = np.unpackbits(np.ascontiguousarray(kinds).view(np.uint8), axis=1, bitorder="little")
        bound = bits[:, : len(lists)].astype(np.int64) @ highest
        by_bound = np.argsort(-bound, kind="stable")
        members = matched[np.argsort(group.ravel(), kind="stable")]
        sizes = np.bincount(group.ravel(), minlength=len(kinds))
        first = np.cumsum(sizes) - sizes
        at = 0
        while at < len(by_bound):
            scores = self.best[which][0]
            floor = scores[-1] if len(scores) == self.top else 0
            # all masks that could still hold a kept document, a few documents at a time
            upto, taken = at, 0
            while upto < len(by_bound) and bound[by_bound[upto]] >= max(floor, 1) and taken < 4 * self.top:
                taken += sizes[by_bound[upto]]
                upto += 1
            if upto == at:
                return
            some = np.concatenate([members[first[g] : first[g] + sizes[g]] for g in by_bound[at:upto]])
            self._evaluate(which, np.sort(some), lists, ids, missing)
            at = upto

    def _evaluate(self, which: int, some: np.ndarray, lists: list, ids: np.ndarray, missing: np.ndarray):
        self.evaluated += len(some)
        score = np.zeros(len(some), np.int64)
        for rows, gain in lists:
            at = np.searchsorted(rows, some)
            at[at == len(rows)] = 0
            there = rows[at] == some
            score[there] += gain[at[there]]
        one = score > 0
        old = self.best[which]
        scores = np.concatenate([old[0], score[one]])
        docs = np.concatenate([old[1], ids[some[one]]])
        none = np.concatenate([old[2], missing[some[one]]])
        kept = np.lexsort((docs, none, -scores))[: self.top]
        self.best[which] = scores[kept], docs[kept], none[kept]


def ranked(stored: DataFrame, items: Items, docs: int, terms: int, weight: np.ndarray, top: int) -> DataFrame:
    """The best documents of each item in each task: key, doc_id, score, part."""
    shipped = stored.sparkSession.sparkContext.broadcast((items, weight))

    def run(batches):
        own, weight_ = shipped.value
        ranking = Ranking(own, weight_, docs, terms, top)
        for batch in batches:
            ends = batch.column(2).offsets.to_numpy().astype(np.int64)
            start = 0
            while start < batch.num_rows:
                end = int(np.searchsorted(ends, ends[start] + BLOCK_TERMS, "right")) - 1
                end = min(max(end, start + 1), batch.num_rows)
                part = slice(ends[start], ends[end])
                ids = batch.column(0).slice(start, end - start)
                ranking.add(
                    ids.fill_null(0).to_numpy(zero_copy_only=False),
                    ids.is_null().to_numpy(zero_copy_only=False),
                    batch.column(1).slice(start, end - start).to_numpy(zero_copy_only=False),
                    np.repeat(np.arange(end - start), np.diff(ends[start : end + 1])),
                    batch.column(2).values.to_numpy()[part].astype(np.int64),
                    batch.column(3).values.to_numpy()[part],
                )
                start = end
        for key, (scores, ids, none) in zip(own.keys, ranking.best):
            if len(scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(scores), pa.int64()), pa.array(ids, mask=none), pa.array(scores)],
                    names=["key", "doc_id", "score"],
                )

    found = stored.filter(F.size("terms") > 0).mapInArrow(run, "key bigint, doc_id bigint, score bigint")
    return found.withColumn("part", F.spark_partition_id() % PARTS)


def search(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    top: int = TOP,
    item_words: int = ITEM_WORDS,
) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` highest-scoring documents of each item.

    Documents are ranked by score, then by doc_id; those without doc_id come after all others of
    their score. Null texts and texts without terms match nothing and count nowhere. Repeated rows
    of documents are documents of their own, repeated rows of items are items of their own. Items
    without terms, without a match, and empty tables give no rows. Only the named columns are read,
    so other columns may have any names.
    """
    spark = docs.sparkSession
    stash = Stash(spark, "ranking")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    asked = stash.keep(
        items.select(F.monotonically_increasing_id().alias("key"), F.col(item_id).alias("item_id"), F.col(item_text).alias("text")),
        "items",
    )
    best = None
    for block in item_blocks(asked.select("key", "text"), item_words):
        own = Items(block)
        stored = stash.keep(indexed(rows, own), "terms")
        total, terms, weight = weights(stored, len(own.numbers))
        found = stash.keep(ranked(stored, own, total, terms, weight, top), "best")
        stash.drop(stored)
        best = found if best is None else best.unionByName(found)
    order = [F.desc("score"), F.col("doc_id").isNull(), "doc_id"]
    for keys in (["key", "part"], ["key"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        best = best.withColumn("rank", place).filter(F.col("rank") <= top)
    return best.join(asked.select("key", "item_id"), "key").select("item_id", "rank", "doc_id", "score")
