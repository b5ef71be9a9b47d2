"""Shared helpers: whole-row Arrow maps, worker caches, stored intermediate tables."""

from __future__ import annotations

import gc
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidewatch.session import scratch_path, write_stored

# Text handled at once inside a task, so that word lists stay small beside the Arrow batch.
SLICE_BYTES = 4 << 20
# The same where each row stands alone, so that a slice need not be long.
ROW_SLICE_BYTES = 1 << 20
# An Arrow batch between Spark and a worker. Either side of the pipe holds one or two of them.
BATCH_BYTES = "8MB"

# ASCII tables for bytes.translate: every byte that is no word character becomes a blank.
_UPPER = {c: c + 32 for c in range(65, 91)}
_ALNUM = bytes(
    _UPPER.get(c, c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)
_LOWER = bytes(_UPPER.get(c, c) for c in range(256))


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    return text.translate(_ALNUM).split()


def blank_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of anything but blank and U+0009 to U+000D."""
    return text.translate(_LOWER).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def let(value: Column, body: Callable) -> Column:
    """``body`` of a value that is computed once for a row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def worker_cache(name: str, make: Callable):
    """Value kept by the Python worker process between tasks; a lost worker only rebuilds it.

    A worker keeps one value at a time, so the operators of a pipeline don't add up in its memory.
    """
    holder = sys.modules.setdefault("_tidewatch_worker", types.ModuleType("_tidewatch_worker"))
    kept = holder.__dict__.setdefault("kept", {})
    if name not in kept:
        kept.clear()
        # what the operator before left behind goes back before the new value is made
        gc.collect()
        pa.default_memory_pool().release_unused()
        kept[name] = make()
    return kept[name]


def utf8(column: pa.Array) -> list[bytes]:
    """Values of a string column as UTF-8; null becomes empty."""
    if column.type in (pa.string(), pa.large_string()):
        column = column.cast(pa.binary() if column.type == pa.string() else pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_BYTES`` for long rows, unless the session names a size of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, spark.conf.get(name, BATCH_BYTES))


def sliced(batches: Iterator[pa.RecordBatch], text: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` or ``SLICE_BYTES`` of text, and one row at least."""
    most = SLICE_BYTES if most is None else most
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        # lengths alone: the values of a whole batch are never held beside it
        lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        sizes = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(sizes, sizes[start] + most, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def map_text(df: DataFrame, text: str, fields: list[StructField], make: Callable) -> DataFrame:
    """Add columns computed from a text column; every other column passes through unchanged.

    ``make()`` runs once in a task and returns a function from a list of UTF-8 texts to a list of
    columns, one for each of ``fields``. A field named like a column of ``df`` replaces it.
    """
    bounded_batches(df.sparkSession)
    replaced = {f.name for f in fields}
    names = [c for c in df.columns if c not in replaced]
    kept = [f for f in df.schema.fields if f.name not in replaced]
    schema = StructType([*kept, *fields])
    order = [c for c in df.columns] + [f.name for f in fields if f.name not in df.columns]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        work, out = make(), to_arrow_schema(schema)
        types_ = {f.name: out.field(f.name).type for f in fields}
        for batch in sliced(batches, text, ROW_SLICE_BYTES):
            added = work(utf8(batch.column(batch.schema.get_field_index(text))))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            columns += [
                x if isinstance(x, pa.Array) else pa.array(x, types_[f.name])
                for f, x in zip(fields, added)
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *(f.name for f in fields)])

    return df.mapInArrow(run, schema).select(*[F.col(f"`{c}`") for c in order])


class Stash:
    """Tables of one run in the shared folder, dropped one by one as soon as they are used up."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.made = spark, scratch_path(spark, label), 0

    def keep(self, df: DataFrame, label: str = "t") -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made:03d}-{label}"
        write_stored(df, path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.stash_path = path
        return kept

    def drop(self, *stored: DataFrame) -> None:
        jvm = self.spark._jvm
        for df in stored:
            path = jvm.org.apache.hadoop.fs.Path(df.stash_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
