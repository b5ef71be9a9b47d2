"""Token ids in directly addressable codes.

An id is split into bytes, lowest first. Level 0 holds the lowest byte of every id and one bit for
each that says whether the id goes on; level k holds byte k of the ids that go on that far. The
place of an id in the next level is the rank of its bit, which a directory of counts per 512 bits
gives in constant time, so any id is read without its neighbours.

A segment is one binary value of a stored row and holds whole documents in ascending order:

    magic 'DAC1', documents d (u32), ids n (u64), levels k (u32),
    end of each document within the segment (u64 x d),
    then for each level: entries m (u64), bytes (u8 x m), bits (u64 x ceil(m / 64)),
    directory (u32 x (ceil(m / 512) + 1)); all little-endian.

Files are Parquet with one segment a row beside its order, so Spark's commit protocol, any store
that Spark reads and the loss of executors are covered.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import sliced, utf8, worker_cache

MAGIC = b"DAC1"
SEGMENT_IDS = 1 << 18
_BLOCK = 512
_CACHE = 700_000
END_ID = 2
# Printable ASCII but for "<", which may open a special token, and the letters of Latin-1: characters
# that are composed already and have one lower-case character each.
_PLAIN = re.compile("[!-;=-~À-ÖØ-öø-ÿ]+")
# How the vocabulary splits a text, for lower-case plain characters.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
# The character by which the vocabulary writes a byte: itself if it can be shown, else one from U+0100 on.
_BYTES = [chr(b) if b in _SHOWN else chr(256 + sum(x not in _SHOWN for x in range(b))) for b in range(256)]


class Level:
    """Bytes of one level with its continuation bits and rank directory."""

    def __init__(self, values: np.ndarray, bits: np.ndarray, directory: np.ndarray):
        self.values, self.bits, self.directory = values, bits, directory

    @classmethod
    def build(cls, values: np.ndarray, more: np.ndarray) -> Level:
        padded = np.zeros(-(-len(more) // 64) * 64, np.uint8)
        padded[: len(more)] = more
        bits = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.zeros(-(-len(more) // _BLOCK) * _BLOCK, np.uint32)
        ones[: len(more)] = more
        counts = ones.reshape(-1, _BLOCK).sum(axis=1, dtype=np.uint32)
        directory = np.concatenate([[0], np.cumsum(counts)]).astype("<u4")
        return cls(values.astype(np.uint8), bits, directory)

    def goes_on(self, i: int) -> bool:
        return bool(int(self.bits[i >> 6]) >> (i & 63) & 1)

    def rank(self, i: int) -> int:
        """Ones before place ``i``."""
        block = i // _BLOCK
        at, words = int(self.directory[block]), block * (_BLOCK // 64)
        for w in range(words, i >> 6):
            at += int(self.bits[w]).bit_count()
        rest = i & 63
        return at + (int(self.bits[i >> 6]) & (1 << rest) - 1).bit_count() if rest else at

    def ones(self, start: int, end: int) -> np.ndarray:
        low = start >> 6
        raw = np.unpackbits(self.bits[low : -(-end // 64)].view(np.uint8), bitorder="little")
        return raw[start - low * 64 : end - low * 64].astype(bool)


class Segment:
    """Reader of one segment."""

    def __init__(self, ends: np.ndarray, n: int, levels: list[Level]):
        self.ends, self.n, self.levels = ends, n, levels

    @classmethod
    def build(cls, documents: list[np.ndarray]) -> Segment:
        ends = np.cumsum([len(d) for d in documents], dtype=np.uint64)
        rest = np.concatenate(documents).astype(np.uint32) if documents else np.zeros(0, np.uint32)
        n, levels = len(rest), []
        while True:
            high = rest >> np.uint32(8)
            levels.append(Level.build(rest & np.uint32(255), high > 0))
            rest = high[high > 0]
            if not len(rest):
                return cls(ends, n, levels)

    def to_bytes(self) -> bytes:
        out = [MAGIC, struct.pack("<IQI", len(self.ends), self.n, len(self.levels))]
        out.append(self.ends.astype("<u8").tobytes())
        for level in self.levels:
            out.append(struct.pack("<Q", len(level.values)))
            out += [level.values.tobytes(), level.bits.tobytes(), level.directory.tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Segment:
        if raw[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        documents, n, k = struct.unpack_from("<IQI", raw, 4)
        at = 20
        ends = np.frombuffer(raw, "<u8", documents, at)
        at += 8 * documents
        levels = []
        for _ in range(k):
            (m,) = struct.unpack_from("<Q", raw, at)
            at += 8
            parts = []
            for kind, count in (("u1", m), ("<u8", -(-m // 64)), ("<u4", -(-m // _BLOCK) + 1)):
                parts.append(np.frombuffer(raw, kind, count, at))
                at += parts[-1].nbytes
            levels.append(Level(*parts))
        return cls(ends, n, levels)

    def get(self, i: int) -> int:
        """The id at place ``i``; reads one byte for each level it has."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for shift, level in enumerate(self.levels):
            value |= int(level.values[i]) << 8 * shift
            if not level.goes_on(i):
                break
            i = level.rank(i)
        return value

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids of a range; ranks once for each level and reads on from there."""
        out = np.zeros(end - start, np.uint32)
        where = np.arange(end - start)
        for shift, level in enumerate(self.levels):
            if end <= start:
                break
            out[where] |= level.values[start:end].astype(np.uint32) << np.uint32(8 * shift)
            more = level.ones(start, end)
            where = where[more]
            start = level.rank(start)
            end = start + len(where)
        return out

    def document(self, k: int) -> np.ndarray:
        start = int(self.ends[k - 1]) if k else 0
        return self.ids(start, int(self.ends[k]))


class LibraryIds(dict):
    """Ids by the tokenizers library of the runs between ASCII white space, remembered.

    The vocabulary drops white space before it splits a text, so no piece and no special token
    reaches over such a run's ends and a text's ids are those of its runs in order. Runs of plain
    characters, which normalization leaves as they are but for their case, are split here and only
    their distinct pieces go to the library's model; all other runs go through the whole library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.model, self.words = self.library.model, {}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self) > _CACHE:
            self.clear()
            self.words.clear()
        return [b"".join(map(self.__getitem__, t.split())) for t in texts]

    def __missing__(self, run: bytes) -> bytes:
        text = run.decode("utf-8", "replace")
        if _PLAIN.fullmatch(text):
            words = self.words
            ids = b"".join([words.get(w) or self._word(w) for w in _PIECES.findall(text.lower())])
        else:
            found = self.library.encode(text, add_special_tokens=False).ids
            ids = struct.pack(f"<{len(found)}I", *found)
        self[run] = ids
        return ids

    def _word(self, word: str) -> bytes:
        """Ids of a piece of plain characters, by the library's model alone."""
        letters = word if word.isascii() else "".join([_BYTES[b] for b in word.encode()])
        found = self.model.tokenize(letters)
        ids = self.words[word] = struct.pack(f"<{len(found)}I", *[t.id for t in found])
        return ids


def write(
    df: DataFrame, path: str, vocabulary: str, doc_id: str = "doc_id", text: str = "text"
) -> None:
    """Encode every whole text, end it with ``END_ID`` and write segments in ascending doc_id order.

    Null texts are empty documents of one id; null doc_ids come first; rows that share a doc_id
    follow one another in the order of their texts' hashes. A range shuffle gives the order, so no
    task holds more than its share whatever the sources are.
    """
    end = np.array([END_ID], "<u4").tobytes()
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    schema = (
        "part int, place bigint, before bigint, n_docs bigint, n_ids bigint, doc_ids binary,"
        " no_id binary, codes binary"
    )

    def run(batches):
        from pyspark import TaskContext

        own = worker_cache(f"ids:{vocabulary}", lambda: LibraryIds(vocabulary))
        part, place, before = TaskContext.get().partitionId(), 0, 0
        ids, docs, held = [], [], 0

        def segment():
            named = np.array([i or 0 for i in ids], "<i8")
            missing = np.array([i is None for i in ids], np.uint8)
            built = Segment.build(docs)
            row = [part, place, before, len(ids), built.n, named.tobytes(), missing.tobytes()]
            row.append(built.to_bytes())
            names = [c.split()[0] for c in schema.split(", ")]
            kinds = [pa.int32(), *[pa.int64()] * 4, *[pa.binary()] * 3]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

        for batch in sliced(batches, "text"):
            encoded = own.encode(utf8(batch.column(1)))
            for i, raw in zip(batch.column(0).to_pylist(), encoded):
                ids.append(i)
                docs.append(np.frombuffer(raw + end, "<u4"))
                held += len(docs[-1])
                if held >= SEGMENT_IDS:
                    yield segment()
                    before += held
                    ids, docs, held, place = [], [], 0, place + 1
        if ids:
            yield segment()

    ordered.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)


def totals(spark: SparkSession, path: str) -> DataFrame:
    """Ids before each written partition: one row a partition, so few even for a huge table."""
    sums = spark.read.parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    return sums.select("part", before.alias("base"))


def read(spark: SparkSession, path: str, make, schema: str) -> DataFrame:
    """Rows that ``make(doc_id, start, ids)`` gives for every document of the stored segments."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    parsed = _parse_datatype_string(schema)
    segments = spark.read.parquet(path).join(F.broadcast(totals(spark, path)), "part")
    start = F.col("base") + F.col("before")

    def run(batches):
        out = to_arrow_schema(parsed)
        for batch in batches:
            for row in range(batch.num_rows):
                named, missing, codes, at = (batch.column(c)[row].as_py() for c in range(4))
                own, rows = Segment.from_bytes(codes), []
                for k, (i, null) in enumerate(zip(np.frombuffer(named, "<i8").tolist(), missing)):
                    ids = own.document(k)
                    rows.append(make(None if null else i, at, ids))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out
                )

    return segments.select("doc_ids", "no_id", "codes", start.alias("start")).mapInArrow(run, parsed)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids before the document, its ids with the end id, and their crc32."""

    def make(doc_id, start, ids):
        return doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())

    return read(spark, path, make, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
