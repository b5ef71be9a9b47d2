"""Per-address statistics over a stream, with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.operators.ip_stats import MAX_REQUESTS
from tidewatch.session import freeze
from tidewatch.streaming.store import AddressStore


def with_debuts(df: DataFrame) -> DataFrame:
    """Rows of a stream with ``_debut`` false, and a row with ``_debut`` true for each new (ip, path).

    Which paths are new is left to the built-in deduplication, whose state is spread over them.
    """
    fill = [
        F.lit("" if isinstance(f.dataType, T.StringType) else 0).cast(f.dataType).alias(f.name)
        for f in df.schema.fields
        if f.name not in ("ip", "path")
    ]
    debuts = df.select("ip", "path").dropDuplicates(["ip", "path"]).select("ip", "path", *fill)
    return df.withColumn("_debut", F.lit(False)).unionByName(debuts.withColumn("_debut", F.lit(True)))


def write_ip_statistics(df: DataFrame, store: AddressStore, path: str, checkpoint: str, **ip_options):
    """Start a query that writes the statistics of micro-batch k to ``path/batch=k``. Returns it.

    The state lies in ``store``, and a micro-batch goes through the batch operator, so an address
    may fill a micro-batch of any size. The results are those of ``stream_ip_statistics``.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        found = store.statistics(freeze(batch, "batch"), batch_id, **ip_options)
        found.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        with_debuts(df)
        .writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_ip_statistics(
    df: DataFrame, window_minutes: int = 60, max_requests: int = MAX_REQUESTS
) -> DataFrame:
    """The batch statistics, equal to them when time order holds across micro-batches.

    The state of an address is bounded: a path count and the times of its last ``max_requests``
    requests. Rows of a micro-batch are taken in (event time, line number) order, so an address
    costs a task its share of one micro-batch; where that is too much, ``write_ip_statistics``
    splits it.
    """
    both = with_debuts(df)
    output = T.StructType(
        [
            *df.schema.fields,
            T.StructField("ip_frequency", T.LongType()),
            T.StructField("ip_path_diversity", T.LongType()),
            T.StructField("ip_request_rate", T.DoubleType()),
        ]
    )
    return both.groupBy("ip").applyInPandasWithState(
        _statistics(window_minutes, max_requests),
        output,
        "recent array<bigint>, paths bigint",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def _statistics(window_minutes: int, max_requests: int):
    width = window_minutes * 60_000_000

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, paths = state.get if state.exists else ([], 0)
        frames = list(frames)
        both = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
        # arrays, as most addresses have few rows and a frame's operations cost more than those
        debut, path = both["_debut"].to_numpy(dtype=bool), both["path"].to_numpy()
        own = np.flatnonzero(~debut)
        own = own[np.lexsort((both["line_no"].to_numpy()[own], both["event_us"].to_numpy()[own]))]
        rows = both.drop(columns="_debut").take(own).reset_index(drop=True)
        times = np.concatenate([np.asarray(recent, dtype=np.int64), both["event_us"].to_numpy()[own]])
        at = np.arange(len(recent), len(times))
        # times are in order inside a batch; a batch that arrives late only sees an older tail
        ordered = np.maximum.accumulate(times)
        start = np.searchsorted(ordered, times[at] - width, side="right")
        start = np.minimum(np.maximum(start, at - max_requests + 1), at)
        frequency = at - start + 1
        minutes = np.maximum((times[at] - times[start]) / 60_000_000, 1.0)
        debuts, new = set(path[debut]), np.zeros(len(own), np.int64)
        for i, p in enumerate(path[own]):
            if p in debuts:
                debuts.remove(p)
                new[i] = 1
        seen = paths + np.cumsum(new)
        state.update(([int(t) for t in times[-max_requests:]], int(seen[-1])))
        yield rows.assign(
            ip_frequency=frequency,
            ip_path_diversity=seen,
            ip_request_rate=np.where(frequency > 1, frequency / minutes, 0.0),
        )

    return run
