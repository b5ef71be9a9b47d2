"""Long repeated byte strings, by run-length indexes over the places where repeats can be.

Equal strings of ``LENGTH`` bytes share the smallest hash of their ``GRAM``-byte pieces, so a hash
seen once in the corpus cannot lie in a repeat. Neighbouring strings with one such anchor form a
segment; only segments whose anchor occurs again leave their task, and numbers alone tell which of
them are equal. The different ones of an anchor are brought together and indexed in chunks: a
Burrows-Wheeler transform in runs with the suffixes at the run heads sampled, and matching
statistics streamed from them (bytes are compared at run heads only; inside a run the statistic of
a place is that of the place before less one). Suffixes linked by statistics of ``LENGTH`` or more begin with one string; all but the
first in corpus order are marked. Anchors with very many different segments are resolved string by
string in an aggregate instead, which gives the same marks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Stash, sliced, utf8

LENGTH = 100
GRAM = 16
# Different segments of one anchor that an index takes (about 1 MB); anchors with more are aggregated.
CROWD = 8000
# Bytes of segments in one index; an anchor's segments are never split over two.
CHUNK = 1 << 18
# Ids of copied texts that may be broadcast; beyond it the join is shuffled.
BROADCAST_COPIES = 750_000
# Bits of a sieve for each value, and the least and the most of all (32 MB for every executor).
SIEVE_SHARE, SIEVE_BITS = 16, (1 << 16, 1 << 28)
# Places hashed at once, so that their hashes stay in a cache.
_BLOCK = 1 << 15
# Bits of one of three numbers that share 63.
_THIRD = 21
_LAST = (1 << _THIRD) - 1
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 16 bytes from every place."""
    x = data.astype(np.uint64)
    for width in (1, 2, 4):
        x = x[:-width] | x[width:] << np.uint64(8 * width)
    return _mixed(_mixed(x[:-8] * _C1) + x[8:] * _C2)


def segments(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Maximal runs of string starts with one anchor: text number, first start, count, hash."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    grams = length - GRAM + 1
    out = []
    for low in range(0, max(0, len(data) - length + 1), _BLOCK):
        part = data[low : low + _BLOCK + length - 1]
        hashes = _gram_hashes(part)
        n = len(part) - length + 1
        # the smallest hash wins, the first of equal ones; low bits carry its place
        best = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
        width = 1
        while 2 * width <= grams:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        if width < grams:
            best = np.minimum(best[: len(best) - (grams - width)], best[grams - width :])
        anchor = (best[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        starts = np.arange(low, low + n)
        own = np.arange(np.searchsorted(ends, low, "right"), np.searchsorted(ends, low + n - 1, "right") + 1)
        owner = np.repeat(own, np.diff(np.minimum(ends[own], low + n), prepend=low))
        valid = starts + length <= ends[owner]
        places = np.flatnonzero(valid)
        if not len(places):
            continue
        own, at = owner[places], anchor[places]
        new = np.ones(len(places), bool)
        new[1:] = (at[1:] != at[:-1]) | (own[1:] != own[:-1])
        heads = np.flatnonzero(new)
        count = np.diff(np.append(heads, len(places)))
        text = own[heads]
        first = starts[places[heads]] - (ends[text] - sizes[text])
        out.append((text, first, count, hashes[at[heads]].view(np.int64)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(c) for c in zip(*out))


class Sieve:
    """Set of 64-bit hashes that tasks test rows against, as two bits for each hash.

    Every hash of the set passes and, rarely, others do. Its size has an upper bound, beyond which
    more others pass; so it may only hold back rows that would not change a result.
    """

    def __init__(self, hashes: DataFrame, most: int):
        """``hashes``: one bigint column of at most about ``most`` values."""
        wanted = 1 << max(1, SIEVE_SHARE * most - 1).bit_length()
        bits = min(max(wanted, SIEVE_BITS[0]), SIEVE_BITS[1])
        value = F.col(hashes.columns[0])
        places = F.explode(F.array(value, F.shiftrightunsigned(value, 32))).alias("at")
        at = F.col("at").bitwiseAND(F.lit(bits - 1))
        words = (
            hashes.select(places)
            .select(F.shiftright(at, 6).cast("int").alias("word"), at.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
            .groupBy("word")
            .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
            .toArrow()
        )
        table = np.zeros(bits // 64, np.uint64)
        table[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
        self.sent, self.bits = hashes.sparkSession.sparkContext.broadcast(table), bits

    def passing(self, hashes: np.ndarray) -> np.ndarray:
        table, last, found = self.sent.value, np.uint64(self.bits - 1), None
        for shift in (0, 32):
            at = hashes.view(np.uint64) >> np.uint64(shift) & last
            hit = table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) != 0
            found = hit if found is None else found & hit
        return found

    def drop(self) -> None:
        self.sent.destroy()


class RunIndex:
    """Run-length index of several byte strings, each closed by an end mark of its own."""

    WIDE = 7  # symbols of nine bits in one 64-bit code
    # smallest codes whose first, second, .. symbol from the end is not empty; codes of the first symbols alone
    _STEPS = 1 << 9 * np.arange(WIDE, dtype=np.int64)
    _FIRST = np.array([(1 << 63) - (1 << 9 * (7 - k)) for k in range(WIDE + 1)], np.int64)

    def __init__(self, parts: list[bytes]):
        sizes = np.array([len(p) for p in parts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        n = int(sizes.sum()) + len(parts)
        symbols = np.zeros(n + self.WIDE, np.int64)
        body = np.ones(n, bool)
        self.marks = self.starts + sizes
        body[self.marks] = False
        symbols[:n][body] = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64) + 1
        self.part = np.repeat(np.arange(len(parts)), sizes + 1)
        self.to_mark = self.marks[self.part] - np.arange(n)
        self.code = np.zeros(n, np.int64)
        for k in range(self.WIDE):
            self.code <<= 9
            self.code |= symbols[k : n + k]
        short = np.flatnonzero(self.to_mark < self.WIDE)
        self.code[short] &= self._FIRST[self.to_mark[short]]
        self.n, self.symbols = n, symbols[:n]
        self.order = self._sorted()
        before = self.order - 1
        last = self.symbols[before]  # the transform; place -1 is the last mark
        self.heads = np.ones(n, bool)
        self.heads[1:] = last[1:] != last[:-1]
        # a mark is a symbol of its own, so two of them never share a run
        self.heads[1:] |= (last[1:] == 0) | (last[:-1] == 0)
        self.runs = np.flatnonzero(self.heads)
        self.run_symbols = last[self.runs]
        self.samples = self.order[self.runs]

    def _sorted(self) -> np.ndarray:
        """Suffix array by prefix doubling from seven symbols on; end marks break all ties."""
        n = self.n
        order = np.argsort(self.code)
        new = np.ones(n, bool)
        new[1:] = np.diff(self.code[order]) != 0
        # what is left of a part before its mark, if short, is one of a kind and stands by part
        short = np.flatnonzero(self.to_mark[order] < self.WIDE)
        order[short] = order[short][np.lexsort((order[short], self.code[order[short]]))]
        new[short] = True
        heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = np.empty(n, np.int64)
        rank[order] = heads
        tied = ~(new & np.append(new[1:], True))
        step = self.WIDE
        while tied.any():
            places = np.flatnonzero(tied)
            own, group = order[places], heads[places]
            second = rank[own + step]  # ties end before their marks, so this stays inside
            if n <= 1 << _THIRD:
                # three numbers in one, so that they are sorted and not their places
                packed = np.sort((group << 2 * _THIRD) | (second << _THIRD) | own)
                own, second = packed & _LAST, packed >> _THIRD & _LAST
            else:
                resort = np.lexsort((second, group))
                own, second = own[resort], second[resort]
            order[places] = own
            fresh = np.ones(len(places), bool)
            fresh[1:] = (np.diff(group) != 0) | (np.diff(second) != 0)
            head = np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
            heads[places] = places[head]
            rank[own] = heads[places]
            tied[places[fresh & np.append(fresh[1:], True)]] = False
            step *= 2
        return order

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffix pairs, up to their marks."""
        most = np.minimum(self.to_mark[a], self.to_mark[b])
        done = np.zeros(len(a), np.int64)
        live = np.flatnonzero(most > 0)
        while len(live):
            x = self.code[a[live] + done[live]] ^ self.code[b[live] + done[live]]
            equal = self.WIDE - np.searchsorted(self._STEPS, x, "right")
            done[live] = np.minimum(done[live] + equal, most[live])
            live = live[(equal == self.WIDE) & (done[live] < most[live])]
        return done

    def statistics(self) -> np.ndarray:
        """For every place, how long it matches the suffix before its own in the order."""
        match = np.zeros(self.n, np.int64)
        known = np.zeros(self.n, bool)
        rows = self.runs[self.runs > 0]
        at = self.order[rows]
        match[at] = self._common(at, self.order[rows - 1])
        known[at] = True
        known[self.order[0]] = True
        # streamed along the text: a place inside a run has one less than the place before it
        source = np.maximum.accumulate(np.where(known, np.arange(self.n), 0))
        return np.maximum(match[source] - (np.arange(self.n) - source), 0)

    def repeats(self, rank: np.ndarray, length: int) -> np.ndarray:
        """Places whose next ``length`` bytes also begin at a place of smaller ``rank``."""
        linked = self.statistics()[self.order] >= length
        group = np.flatnonzero(~linked)
        lowest = np.minimum.reduceat(rank[self.order], group)
        size = np.diff(np.append(group, self.n))
        covered = np.zeros(self.n, bool)
        covered[self.order] = rank[self.order] > np.repeat(lowest, size)
        return covered & (self.to_mark >= length)


def _marked(batches, length: int):
    """Covered runs of the first places of segments, one index for each chunk of whole anchors."""
    names = ["doc", "th", "s", "n"]
    empty = pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4, names=names)

    def settle(rows):
        docs = np.array([r[1] for r in rows], np.int64)
        hashes = np.array([r[2] for r in rows], np.int64)
        firsts = np.array([r[3] for r in rows], np.int64)
        index = RunIndex([r[4] for r in rows])
        inside = np.arange(index.n) - index.starts[index.part]
        at = firsts[index.part] + inside
        # corpus order of every place: document, start; places of one document and start are one
        document = np.unique(docs, return_inverse=True)[1]
        rank = document[index.part] * (at.max() + 1) + at
        hit = index.repeats(rank, length)
        edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        part = index.part[low]
        columns = (docs[part], hashes[part], at[low], high - low)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    held, size, last = [], 0, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row == last:
                continue  # of rows that come twice
            if size >= CHUNK and row[0] != last[0]:
                yield settle(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4])
            last = row
    yield settle(held) if held else empty


def covers(df: DataFrame, doc: str, th: str, text: str, length: int = LENGTH) -> DataFrame:
    """(doc, th, s, n): n string starts from s on that begin a string found earlier.

    ``doc`` orders the documents and ``th``, a hash of the text, tells apart rows that share it.
    """
    stash = Stash(df.sparkSession, "repeats")
    rows = df.select(F.col(doc).alias("doc"), F.col(th).alias("th"), F.col(text).alias("t"))
    # copies of a whole text are covered by the first of them and need no index
    whole = rows.select("doc", "th", F.md5("t").alias("d"), F.octet_length("t").cast("bigint").alias("size"))
    whole = stash.keep(whole.filter(F.col("size") >= length).distinct(), "whole")
    first = whole.groupBy("d").agg(F.min("doc").alias("first"), F.count("*").alias("copies"))
    later = stash.keep(
        whole.join(first.filter("copies > 1"), "d").filter("doc != first").select("doc", "th", "size"), "later"
    )
    copies = later.select("doc", "th", F.lit(0).cast("bigint").alias("s"), (F.col("size") - length + 1).alias("n"))
    ids = later.select("doc", "th")
    few = later.count() <= BROADCAST_COPIES
    single = rows.filter(F.octet_length("t") >= length).join(
        F.broadcast(ids) if few else ids, ["doc", "th"], "left_anti"
    ).select("doc", "th", "t")

    def count(batches):
        for batch in sliced(batches, "t"):
            values, n = np.unique(segments(utf8(batch.column(2)), length)[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], names=["h", "n"])

    repeated = single.mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    repeated = stash.keep(repeated.filter("n > 1").select("h"), "anchors")
    again = Sieve(repeated, repeated.count())

    def cut(batches):
        names = ["h", "doc", "th", "s", "n", "bytes"]
        for batch in sliced(batches, "t"):
            texts = utf8(batch.column(2))
            found = segments(texts, length)
            number, start, n, h = (c[again.passing(found[3])] for c in found)
            owner = pa.array(number)
            parts = [
                texts[k][s : s + c + length - 1]
                for k, s, c in zip(number.tolist(), start.tolist(), n.tolist())
            ]
            columns = [pa.array(h), batch.column(0).take(owner), batch.column(1).take(owner)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(start), pa.array(n), pa.array(parts, pa.binary())], names=names
            )

    shape = "h bigint, doc bigint, th bigint, s bigint, n bigint, bytes binary"
    found = stash.keep(single.mapInArrow(cut, shape).withColumn("c", F.xxhash64("bytes")), "segments")
    # equal segments are one from here on, by numbers alone; their first place stands for them
    numbers = found.select("h", "c", "n", "doc", "s", "th")
    firsts = numbers.groupBy("h", "c", "n").agg(
        F.min(F.struct("doc", "s", "th")).alias("f"), F.count("*").alias("copies")
    )
    firsts = stash.keep(firsts.select("h", "c", "n", "copies", "f.*"), "firsts")
    several = firsts.filter("copies > 1").select("h", "c", "n", F.col("doc").alias("fd"), F.col("s").alias("fs"))
    others = numbers.join(several, ["h", "c", "n"]).filter("doc != fd or s != fs").select("doc", "th", "s", "n")
    others = stash.keep(others, "others")
    shared = firsts.groupBy("h").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    shared = stash.keep(shared, "shared")
    crowds = np.array([r["h"] for r in shared.filter(F.col("kinds") > CROWD).collect()], np.int64)
    place = F.xxhash64("doc", "th", "s").alias("k")
    first = Sieve(firsts.select("h", place).join(shared.select("h"), "h").select("k"), firsts.count())

    def choose(batches):
        # later copies that pass as well are marked as what they are
        for batch in batches:
            chosen = batch.filter(pa.array(first.passing(batch.column(5).to_numpy())))
            crowded = pa.array(np.isin(chosen.column(0).to_numpy(), crowds))
            yield pa.RecordBatch.from_arrays(
                [*chosen.columns[:5], crowded], names=["h", "doc", "th", "s", "bytes", "crowded"]
            )

    mixed = found.select("h", "doc", "th", "s", "bytes", place).mapInArrow(
        choose, "h bigint, doc bigint, th bigint, s bigint, bytes binary, crowded boolean"
    )
    mixed = stash.keep(mixed, "mixed")
    stash.drop(whole, repeated, found, firsts, shared)
    again.drop()
    first.drop()
    count_ = F.octet_length("bytes").cast("bigint") - length + 1
    chunks = mixed.filter("not crowded").select("h", "doc", "th", "s", "bytes")
    marked = (
        chunks.repartition("h").sortWithinPartitions("h", "doc", "s", "th")
        .mapInArrow(lambda batches: _marked(batches, length), "doc bigint, th bigint, s bigint, n bigint")
    )
    strings = mixed.filter("crowded").select(
        "doc", "th", "s", "bytes", F.explode(F.sequence(F.lit(1), count_.cast("int"))).alias("k")
    ).select("doc", "th", (F.col("s") + F.col("k") - 1).alias("s"), F.substring("bytes", F.col("k"), F.lit(length)).alias("w"))
    earliest = strings.groupBy("w").agg(F.min(F.struct("doc", "s")).alias("e"), F.count("*").alias("m"))
    alone = (
        strings.join(earliest.filter("m > 1"), "w")
        .filter((F.col("doc") != F.col("e.doc")) | (F.col("s") != F.col("e.s")))
        .select("doc", "th", "s", F.lit(1).cast("bigint").alias("n"))
    )
    out = stash.keep(copies.unionByName(others).unionByName(marked).unionByName(alone), "covers")
    stash.drop(later, others, mixed)
    return out


def merged(places: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte runs under all strings that begin at the given runs of starts."""
    out: list[list[int]] = []
    for s, n in sorted(places):
        end = s + n - 1 + length
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([s, end])
    return [(a, b) for a, b in out]


def remove(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, removed spans of bytes (start, end) and the kept bytes, for every row.

    Strings are judged on the input and only inside one text. Null texts count as empty; texts under
    ``length`` bytes lose nothing; rows that share a doc_id count as one document, identical ones
    have one result; a null doc_id comes before all others; an empty table gives an empty result.
    Only the two named columns are read.
    """
    lowest = -(1 << 63)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(lowest)).alias("doc"),
        F.xxhash64(whole).alias("th"),
        whole.alias("t"),
    )
    found = covers(rows, "doc", "th", "t", length)
    listed = found.groupBy("doc", "th").agg(F.collect_list(F.struct("s", "n")).alias("places"))
    joined = rows.join(listed, ["doc", "th"], "left").select("doc_id", "t", "places")

    def run(batches):
        names = ["doc_id", "n_bytes", "spans", "kept"]
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in sliced(batches, "t"):
            spans, kept, sizes = [], [], []
            for raw, places in zip(utf8(batch.column(1)), batch.column(2).to_pylist()):
                runs = merged([(p["s"], p["n"]) for p in places or ()], length)
                at, left = 0, []
                for a, b in runs:
                    left.append(raw[at:a])
                    at = b
                spans.append([{"start": a, "end": b} for a, b in runs])
                kept.append(b"".join([*left, raw[at:]]))
                sizes.append(len(raw))
            columns = [pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return joined.mapInArrow(
        run, "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    )


def sha256(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()
