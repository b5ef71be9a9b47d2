"""Sets of word shingles, and the prefixes by which similar sets find each other."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tidewatch.llm.common import blank_words, sliced, utf8, worker_cache

# Counters of the sketch that orders shingles; 4 bytes each in every worker, whatever the input.
COUNTERS = 1 << 20
# The sketch travels in pieces of this many counters.
PIECE = 1 << 14
BITS = ("b1", "b2", "b3", "b4")
_WORDS = 300_000
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64-bit result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: bytes, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word runs of ``size``; of the whole text if it has fewer."""
    words = blank_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(size, len(codes))
    runs = len(codes) - width + 1
    total = np.full(runs, width, np.uint64)
    for k in range(width):
        total = total * STEP + codes[k : k + runs]
    return np.unique(mix(total))


def map_sets(df: DataFrame, size: int, work, schema: str) -> DataFrame:
    """``work(batches, sets)`` over slices of text; ``sets`` gives the shingles of a text."""

    def run(batches):
        hashes = worker_cache("ngram_words", WordHashes)
        yield from work(sliced(batches, "text"), lambda raw: shingles(raw, size, hashes))

    return df.mapInArrow(run, schema)


def shingle_counts(df: DataFrame, size: int, counters: int) -> np.ndarray:
    """Counts of the shingles of all rows, by the low bits of their hash.

    Every task sends its counters in pieces, which are added one after the other, so a task holds
    one piece; the driver gets the sums alone, ``counters`` of them.
    """
    piece = min(PIECE, counters)
    mask = np.uint64(counters - 1)

    def pieces(k: int, total: np.ndarray) -> pa.RecordBatch:
        packed = zlib.compress(total.astype(np.min_scalar_type(int(total.max()))).tobytes(), 1)
        return pa.RecordBatch.from_arrays([pa.array([k]), pa.array([packed], pa.binary())], names=["k", "v"])

    def unpacked(v: bytes) -> np.ndarray:
        raw = zlib.decompress(v)
        return np.frombuffer(raw, f"<u{len(raw) // piece}").astype(np.int64)

    def count(batches, sets):
        total = np.zeros(counters, np.int64)
        for batch in batches:
            own = np.concatenate([np.zeros(0, np.uint64), *map(sets, utf8(batch.column(0)))])
            total += np.bincount((own & mask).astype(np.int64), minlength=counters)
        parts = total.reshape(-1, piece)
        for k in np.flatnonzero(parts.any(axis=1)).tolist():
            yield pieces(k, parts[k])

    def add(batches):
        at, total = None, None
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != at:
                    if at is not None:
                        yield pieces(at, total)
                    at, total = k, np.zeros(piece, np.int64)
                total += unpacked(v)
        if at is not None:
            yield pieces(at, total)

    sent = map_sets(df.select("text"), size, count, "k bigint, v binary")
    summed = sent.repartition("k").sortWithinPartitions("k").mapInArrow(add, "k bigint, v binary")
    total = np.zeros((counters // piece, piece), np.int64)
    for row in summed.toLocalIterator():
        total[row["k"]] = unpacked(bytes(row["v"]))
    return np.minimum(total.ravel(), np.iinfo(np.uint32).max).astype(np.uint32)


def digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def prefixes(df: DataFrame, size: int, percent: int, counts: np.ndarray) -> DataFrame:
    """One row a document: size of its set, digests of the set and of its prefix, prefix, parities."""
    shipped = df.sparkSession.sparkContext.broadcast(counts)
    mask = np.uint64(len(counts) - 1)
    schema = "doc_id bigint, n bigint, d binary, g binary, prefix array<bigint>, b1 bigint, b2 bigint, b3 bigint, b4 bigint"
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), *[pa.int64()] * 4]
    names = ["doc_id", "n", "d", "g", "prefix", *BITS]

    def run(batches, sets):
        counted = shipped.value
        for batch in batches:
            out = []
            for i, raw in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                own = sets(raw)
                n = len(own)
                if not n:
                    out.append((i, 0, None, None, None, None, None, None, None))
                    continue
                often = counted[(own & mask).astype(np.int64)]
                reach = n - -(-percent * n // 100) + 1
                prefix = own[np.lexsort((own, often))[:reach]]
                parity = np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=256) & 1
                bits = np.packbits(parity.astype(np.uint8)).view("<i8").tolist()
                group = digest(np.append(prefix, np.uint64(n)))
                out.append((i, n, digest(own), group, prefix.view(np.int64), *bits))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return map_sets(df.select("doc_id", "text"), size, run, schema)


def overlap(percent: int, total: str) -> str:
    """Smallest overlap of linked sets whose sizes add up to ``total``."""
    return f"(({percent} * ({total}) + {99 + percent}) div {100 + percent})"


def alike(percent: int) -> str:
    """Sizes and parities that every linked pair of sets has: n, b1.. and o, o1.."""
    apart = " + ".join(f"bit_count({b} ^ o{b[1]})" for b in BITS)
    return f"100 * least(n, o) >= {percent} * greatest(n, o) and {apart} <= n + o - 2 * {overlap(percent, 'n + o')}"


def early_places(percent: int) -> str:
    """Places at which the first common token of linked sets can stand."""
    least = overlap(percent, "n + o")
    return f"100 * least(n, o) >= {percent} * greatest(n, o) and n - i >= {least} and o - j >= {least}"
