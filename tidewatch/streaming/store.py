"""Versioned tables that streams keep and share: line clusters, and what addresses did last."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.operators.clusters import MEMBER_SCHEMA, cluster_signatures, nearest_clusters
from tidewatch.operators.ip_stats import MAX_REQUESTS, STATISTICS, ip_statistics
from tidewatch.operators.ordering import lookup
from tidewatch.operators.templates import signatures
from tidewatch.session import freeze

_COUNTS = "template_id bigint, n bigint, first_line_no bigint"
_TAIL = "ip string, event_us bigint, line_no bigint, version bigint"
_PATHS = "ip string, paths bigint, version bigint"
_SLICES = "slice timestamp, ip string, requests bigint, late_us bigint"
_WINDOWS = "window_start timestamp, ip string, requests bigint"
_MARKS = "version bigint, newest_us bigint, closed_us bigint"
# Versions after which the state is written as a whole, so that a reader opens few folders.
WHOLE = 32


class Versions:
    """Folders ``version=k`` under ``path``, each written once, from those before it alone.

    The part ``counts`` is written last; its success marker completes a version, so a version that
    a failure cut short is written again and gives the same.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _complete(self, kind: str) -> list[int]:
        """Numbers of the complete folders of a kind, in order."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        numbers = sorted(int(m[1]) for m in map(re.compile(rf"{kind}=(\d+)").fullmatch, names) if m)
        done = lambda n: self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}={n}/counts/_SUCCESS")
        return [n for n in numbers if fs.exists(done(n))]

    def latest(self) -> int:
        """Number of the last complete version, -1 if there is none."""
        return max([-1, *self._complete("version")])

    def _read(self, part: str, schema: str, before: int | None) -> DataFrame:
        below = [n for n in self._complete("version") if before is None or n < before]
        whole = [n for n in self._complete("whole") if before is None or n < before][-1:]
        folders = [f"{self.path}/whole={n}/{part}" for n in whole]
        folders += [f"{self.path}/version={n}/{part}" for n in below if not whole or n > whole[0]]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def _write(self, folder: str, parts: dict[str, DataFrame]) -> None:
        for part in sorted(parts, key=lambda p: p == "counts"):
            parts[part].write.mode("overwrite").parquet(f"{self.path}/{folder}/{part}")


class TemplateStore(Versions):
    """Clusters in versions: those that a version adds (``members``) and the lines that it saw of
    every cluster (``counts``). The id of a cluster never changes.
    """

    def __init__(self, spark: SparkSession, path: str, similarity: float = 0.5, depth: int = 4, max_children: int = 100):
        super().__init__(spark, path)
        self.similarity, self.depth, self.max_children = similarity, depth, max_children

    def members(self, before: int | None = None) -> DataFrame:
        """Clusters of all complete versions, or of those before ``before``."""
        return self._read("members", MEMBER_SCHEMA, before)

    def templates(self, before: int | None = None) -> DataFrame:
        """template_id, template, lines seen and the first of them."""
        counts = self._read("counts", _COUNTS, before).groupBy("template_id").agg(
            F.sum("n").alias("n"), F.min("first_line_no").alias("first_line_no")
        )
        named = self.members(before).select("template_id", "template").distinct()
        return lookup(counts, named, "template_id").select("template_id", "template", "n", "first_line_no")

    def create(self, templates: DataFrame, members: DataFrame) -> "TemplateStore":
        """Write mined clusters as version 0, unless it is there."""
        if 0 not in self._complete("version"):
            self._write("version=0", self._parts(members, templates))
        return self

    def _parts(self, members: DataFrame, counts: DataFrame) -> dict[str, DataFrame]:
        return {
            "members": members.select("bucket", "template_id", "template", "tokens"),
            "counts": counts.select("template_id", "n", "first_line_no"),
        }

    def learn(self, lines: DataFrame, version: int, line: str = "line") -> None:
        """Add version ``version`` from lines: those similar to no earlier cluster are clustered.

        ``lines`` has ``line_no`` and the column ``line``; it is read several times.
        """
        if version in self._complete("version"):
            return
        known = freeze(self.members(version), "known")
        found = freeze(signatures(lines, line), "seen")
        near = freeze(nearest_clusters(found, known, self.similarity), "near")
        top = known.agg(F.coalesce(F.max("template_id"), F.lit(0))).first()[0]
        new = found.join(near.select("signature"), "signature", "left_anti")
        templates, members = cluster_signatures(new, self.similarity, self.depth, self.max_children, top + 1)
        again = lookup(found, near, "signature", "inner").groupBy("template_id").agg(
            F.sum("n").alias("n"), F.min("first_line_no").alias("first_line_no")
        )
        counts = templates.select("template_id", "n", "first_line_no").unionByName(again)
        self._write(f"version={version}", self._parts(members, counts))
        if version and version % WHOLE == 0:
            totals = self.templates(version + 1)
            self._write(f"whole={version}", self._parts(self.members(version + 1), totals))


class AddressStore(Versions):
    """What addresses did last: the times of their last requests (``tail``) and how many paths they
    have asked for (``counts``).

    A version holds the addresses of its micro-batch; the latest version of an address counts.
    Times that have left the look-back window are dropped when the state is written as a whole.
    """

    def __init__(self, spark: SparkSession, path: str, window_minutes: int = 60, max_requests: int = MAX_REQUESTS):
        super().__init__(spark, path)
        self.window_minutes, self.max_requests = window_minutes, max_requests

    def _last(self, part: str, schema: str, before: int | None) -> DataFrame:
        rows = self._read(part, schema, before)
        latest = rows.groupBy("ip").agg(F.max("version").alias("version"))
        return rows.join(latest, ["ip", "version"])

    def statistics(self, both: DataFrame, version: int, **ip_options) -> DataFrame:
        """The three statistics of the rows of a micro-batch, and the state after it as ``version``.

        ``both`` has the rows (``ip``, ``path``, ``event_us``, ``line_no`` and others) with
        ``_debut`` false, and one row with ``_debut`` true for each path that is new to an address.
        The rows follow the address's last ones through the batch operator, which cuts a busy
        address into chunks, so no address has to fit into a task.
        """
        rows = both.filter("not _debut").drop("_debut")
        debuts = freeze(both.filter("_debut").select("ip", "path", F.lit(True).alias("_new")), "debuts")
        met = freeze(rows.select("ip").distinct(), "met")
        tail = lookup(self._last("tail", _TAIL, version), met, "ip", "inner").select("ip", "event_us", "line_no")
        known = lookup(self._last("counts", _PATHS, version), met, "ip", "inner").select("ip", "paths")
        tail, known = freeze(tail, "tail"), freeze(known, "known")
        # paths that are not new count as one, which a row long ago brings in for known addresses
        long_ago = known.select("ip", F.lit(-(1 << 61)).alias("event_us"), F.lit(0).cast("bigint").alias("line_no"))
        before = tail.unionByName(long_ago).withColumn("_path", F.lit(""))
        named = lookup(rows, debuts, ["ip", "path"]).withColumn(
            "_path", F.when(F.col("_new"), F.concat(F.lit("/"), F.coalesce("path", F.lit("")))).otherwise(F.lit(""))
        )
        carried = F.struct(*[F.col(c) for c in rows.columns]).alias("_payload")
        own = named.select("ip", "event_us", "line_no", "_path", carried)
        merged = own.unionByName(before, allowMissingColumns=True).withColumnRenamed("_path", "path")
        found = ip_statistics(merged, self.window_minutes, self.max_requests, **ip_options).filter("_payload is not null")
        seen = F.coalesce("paths", F.lit(0))
        found = lookup(found.select("ip", "_payload", *STATISTICS), known, "ip").withColumn(
            "ip_path_diversity", F.col("ip_path_diversity") + seen - F.when(seen > 0, 1).otherwise(0)
        )
        found = freeze(found.select("_payload.*", *STATISTICS), "statistics")
        if version not in self._complete("version"):
            last = Window.partitionBy("ip").orderBy(F.desc("event_us"), F.desc("line_no"))
            times = rows.select("ip", "event_us", "line_no").unionByName(tail)
            times = times.withColumn("_k", F.row_number().over(last)).filter(F.col("_k") <= self.max_requests).drop("_k")
            added = debuts.groupBy("ip").agg(F.count("*").alias("added"))
            counts = met.join(known, "ip", "left").join(added, "ip", "left").select(
                "ip", (seen + F.coalesce("added", F.lit(0))).alias("paths")
            )
            stamp = F.lit(version).cast("bigint").alias("version")
            self._write(f"version={version}", {"tail": times.select("*", stamp), "counts": counts.select("*", stamp)})
            if version and version % WHOLE == 0:
                self._write(f"whole={version}", self._whole(version + 1))
        return found

    def _whole(self, before: int) -> dict[str, DataFrame]:
        tail, counts = self._last("tail", _TAIL, before), self._last("counts", _PATHS, before)
        newest = tail.agg(F.max("event_us").alias("_newest"))  # one row
        inside = F.col("event_us") > F.col("_newest") - self.window_minutes * 60_000_000
        kept = tail.join(F.broadcast(newest), inside).select("ip", "event_us", "line_no", "version")
        return {"tail": kept, "counts": counts.select("ip", "paths", "version")}


class WindowStore(Versions):
    """Requests of addresses in slices of time that no border of a sliding window cuts.

    Version k has the slices of micro-batch k and, in ``windows``, the windows that the watermark
    closed then: those that end after the watermark of the micro-batch before, up to its own, which
    follows the newest request of earlier micro-batches. A request counts in the windows that were
    open when it came. ``counts`` holds the newest request so far and the end of closed windows.
    """

    def __init__(self, spark: SparkSession, path: str, minutes: int = 60, slide: int = 5, lateness: str = "1 day"):
        super().__init__(spark, path)
        self.minutes, self.slide, self.lateness = minutes, slide, lateness

    def _marks(self, before: int | None = None) -> tuple[int, int]:
        """Newest request and end of closed windows after the versions before ``before``, in microseconds."""
        found = self._read("counts", _MARKS, before).agg(F.max("newest_us"), F.max("closed_us")).first()
        return found[0] or 0, found[1] or 0

    def _watermark(self, newest_us: int, closed_us: int) -> int:
        """The end up to which windows close, whole milliseconds as the engine has them."""
        mark = F.timestamp_micros(F.lit(newest_us // 1000 * 1000)) - F.expr(f"interval {self.lateness}")
        return max(closed_us, self.spark.range(1).select(F.unix_micros(mark)).first()[0])

    def slices(self, before: int | None = None) -> DataFrame:
        return self._read("slices", _SLICES, before)

    def closed(self) -> DataFrame:
        """Windows that have been closed."""
        return self._read("windows", _WINDOWS, None)

    def windows(self, slices: DataFrame, after_us: int | None = None, upto_us: int | None = None) -> DataFrame:
        """window_start, ip, requests of all windows, or of those that end after and up to a time."""
        length = F.expr(f"interval {self.minutes} minutes")
        if upto_us is not None:
            slices = slices.filter((F.col("slice") >= F.timestamp_micros(F.lit(after_us)) - length) & (
                F.col("slice") < F.timestamp_micros(F.lit(upto_us))))
        # placed by address once, as slices; the windows they lie in need no exchange of their own
        span = F.window("slice", f"{self.minutes} minutes", f"{self.slide} minutes").alias("w")
        rows = slices.repartition("ip").select(span, "ip", "requests", "late_us")
        if upto_us is not None:
            end = F.unix_micros("w.end")
            rows = rows.filter((end > after_us) & (end <= upto_us) & (end > F.col("late_us")))
        found = rows.groupBy("w", "ip").agg(F.sum("requests").alias("requests"))
        return found.select(F.col("w.start").alias("window_start"), "ip", "requests")

    def add(self, batch: DataFrame, version: int, closing: bool = True) -> None:
        """Add a micro-batch (``event_ts``, ``ip``) and close the windows whose time has come."""
        if version in self._complete("version"):
            return
        newest, late = self._marks(version)
        mark = self._watermark(newest, late)
        width = math.gcd(self.minutes, self.slide)
        own = F.window("event_ts", f"{width} minutes").alias("w")
        cut = batch.groupBy(own, "ip").agg(F.count("*").alias("requests"), F.max("event_ts").alias("newest"))
        folder = f"{self.path}/version={version}/slices"
        cut.select(
            F.col("w.start").alias("slice"), "ip", "requests", F.lit(late).cast("bigint").alias("late_us"), "newest"
        ).write.mode("overwrite").parquet(folder)
        stored = self.spark.read.schema(f"{_SLICES}, newest timestamp").parquet(folder)
        parts = {}
        if closing:
            # the rows of this micro-batch may still fall into windows that close now
            found = self.slices(version).unionByName(stored.drop("newest"))
            parts["windows"] = self.windows(found, late, mark)
        row = stored.agg(F.max(F.unix_micros("newest")).alias("own_us")).select(
            F.lit(version).cast("bigint").alias("version"),
            F.greatest(F.lit(newest), "own_us").cast("bigint").alias("newest_us"),
            F.lit(mark if closing else late).cast("bigint").alias("closed_us"),
        )
        self._write(f"version={version}", {**parts, "counts": row})

    def close(self) -> None:
        """Close the windows that the newest request so far leaves behind, as a version without requests."""
        version, (newest, late) = self.latest() + 1, self._marks()
        mark = self._watermark(newest, late)
        none = self.spark.createDataFrame([], _SLICES)
        row = self.spark.createDataFrame([(version, newest, mark)], _MARKS).coalesce(1)
        self._write(f"version={version}", {
            "slices": none, "windows": self.windows(self.slices(), late, mark), "counts": row
        })
