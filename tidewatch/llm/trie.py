"""Prefix trie of conversations, with subtree totals by time-forward processing.

A node is a distinct sequence of first turns; (smallest member, depth) names it. A sequence is known
by a polynomial of its turns' digests modulo a prime in two bases: polynomials of neighbouring pieces
combine, so a conversation of any length is hashed in pieces of bounded size.

Totals go from the leaves to the root. Conversations are put into the order of their sequences and
cut into blocks; a shard is a block between two depths. In a shard the nodes come in reverse level
order, sorted by Spark's external sort; each takes the messages of its children from a priority
queue, which spills sorted runs, and sends its totals to its parent. A message whose node is not in
the shard leaves it, summed. The nodes that get such messages make a tree of their own (a shard's
root points to the node that it reports to), far smaller than the first one, as a parent outside the
block is a prefix of its first or last sequence or stands over the cut. It is treated in the same way in wider shards,
until nothing leaves a shard; the sums then go down again as values of the nodes they belong to.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Stash
from tidewatch.operators.ordering import lookup, number_rows

PRIME = (1 << 61) - 1
BASES = (1_152_921_504_606_846_883, 947_362_538_190_427_261)
# Turns whose polynomials are computed one after the other.
PIECE = 1 << 16
# Turns by which sequences are ordered; longer common prefixes only make shards meet more often.
PATH = 16
# Conversations and levels of a shard, and how much wider the shards of the next round are.
BLOCK = 1024
BAND = 1024
WIDER = 64
# Messages that a task holds in memory.
QUEUE = 1 << 18
# Ids that are joined to one text before the digest of a node takes them.
IDS = 1 << 13
EMPTY = hashlib.sha256(b"").hexdigest()


class SpillingQueue:
    """Priority queue of tuples that keeps ``most`` of them in memory and the rest in sorted runs.

    Runs go to one nameless file in the folder that Spark gives its executors for spilling. It
    belongs to the task alone and is gone with it.
    """

    def __init__(self, most: int):
        self.most, self.heap, self.heads, self.file, self.spilled = most, [], [], None, 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.most:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            named = (os.environ.get("SPARK_LOCAL_DIRS") or "").split(",")[0]
            self.file = tempfile.TemporaryFile(dir=named if os.path.isdir(named) else None)
        items, places = sorted(self.heap), []
        for start in range(0, len(items), 4096):
            places.append(self.file.seek(0, os.SEEK_END))
            pickle.dump(items[start : start + 4096], self.file)
        self.heap = []
        run = self._read(places)
        heapq.heappush(self.heads, (next(run), self.spilled, run))
        self.spilled += 1

    def _read(self, places: list[int]):
        for place in places:
            self.file.seek(place)
            yield from pickle.load(self.file)

    def first(self) -> tuple | None:
        if self.heap and (not self.heads or self.heap[0] <= self.heads[0][0]):
            return self.heap[0]
        return self.heads[0][0] if self.heads else None

    def pop(self) -> tuple:
        if self.heap and (not self.heads or self.heap[0] <= self.heads[0][0]):
            return heapq.heappop(self.heap)
        item, number, run = self.heads[0]
        following = next(run, None)
        if following is None:
            heapq.heappop(self.heads)
        else:
            heapq.heapreplace(self.heads, (following, number, run))
        return item


class Shard:
    """Nodes of one shard in reverse level order: messages to parents, and where roots report to."""

    def __init__(self, unit: int, most: int):
        self.unit, self.queue, self.roots = unit, SpillingQueue(most), {}

    def _sum(self, key: tuple) -> list[int]:
        got = [0, 0, 0]
        while (item := self.queue.first()) is not None and item[:2] == key:
            got = [x + y for x, y in zip(got, self.queue.pop()[2:])]
        return got

    def leaving(self, key: tuple | None):
        """Summed messages for nodes before ``key``, which the shard does not have."""
        while (item := self.queue.first()) is not None and (key is None or item[:2] < key):
            yield item[1], -item[0], *self._sum(item[:2])

    def take(self, conv: int, depth: int, up: int | None, up_depth: int, leaves: int, saved: int) -> list[int]:
        """Children, leaves and savings of a node's subtree; tells the parent."""
        children, more, gain = self._sum((-depth, conv))
        leaves, saved = leaves + more, saved + gain
        if up is not None:
            self.queue.push((-up_depth, up, 1, leaves, saved))
        self.roots[conv, depth // self.unit] = None if up is None else (up, up_depth)
        return [children, leaves, saved]

    def exits(self):
        """For each chain of the shard the node outside that its root reports to."""
        known: dict[tuple, tuple | None] = {}
        for key in self.roots:
            seen, at = [], key
            while at not in known:
                seen.append(at)
                to = self.roots[at]
                inside = to and (to[0], to[1] // self.unit)
                if not to or inside not in self.roots:
                    known[at] = to
                    break
                at = inside
            for one in seen:
                known[one] = known[at]
        return known.items()


_SENT = "kind int, block bigint, conv_id bigint, depth bigint, up bigint, up_depth bigint, children bigint, leaves bigint, saved bigint"


def _forward(nodes: DataFrame, unit: int, queue: int, sums: bool) -> DataFrame:
    """One pass over all shards (block, band): what leaves them, or the sums of every node.

    ``unit`` is the number of levels that a chain of one conversation spans in a shard.
    """
    held = ["block", "band", "conv_id", "depth", "up", "up_depth", "children", "leaves", "saved"]
    passed = [c for c in nodes.columns if c not in held]
    ordered = (
        nodes.select(*held, *passed)
        .repartition("block", "band")
        .sortWithinPartitions("block", "band", F.desc("depth"), "conv_id")
    )
    kinds = [f for c in ("conv_id", "depth", "up") for f in ordered.schema if f.name == c]
    added = ["n_children", "n_leaves", "saved_total"]
    schema = (
        ", ".join([*[f"{f.name} bigint" for f in kinds], *[f"{c} bigint" for c in added]]
                  + [f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema if f.name in passed])
        if sums
        else _SENT
    )

    def finished(shard: Shard, block: int):
        for conv, depth, *values in shard.leaving(None):
            yield 0, block, conv, depth, None, None, *values
        for (conv, level), to in shard.exits():
            yield 1, block, conv, level, *(to or (None, None)), None, None, None

    def run(batches):
        shard = at = None
        names = ["kind", "block", "conv_id", "depth", "up", "up_depth", "children", "leaves", "saved"]
        for batch in batches:
            out, found = [], []
            for block, band, conv, depth, up, up_depth, children, leaves, saved in zip(
                *(batch.column(k).to_pylist() for k in range(len(held)))
            ):
                if (block, band) != at:
                    if shard is not None and not sums:
                        out.extend(finished(shard, at[0]))
                    shard, at = Shard(unit, queue), (block, band)
                for gone in shard.leaving((-depth, conv)):
                    if not sums:
                        out.append((0, block, gone[0], gone[1], None, None, *gone[2:]))
                own = shard.take(conv, depth, up, up_depth, leaves, saved)
                found.append((children + own[0], own[1], own[2]))
            if sums and found:
                columns = [batch.column(k) for k in (2, 3, 4)]
                columns += [pa.array(c, pa.int64()) for c in zip(*found)]
                columns += [batch.column(len(held) + k) for k in range(len(passed))]
                yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "depth", "up", *added, *passed])
            if out:
                yield _sent(out, names)
        if shard is not None and not sums:
            yield _sent(list(finished(shard, at[0])), names)

    return ordered.mapInArrow(run, schema)


def _sent(rows: list, names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.int64()] * 8]
    columns = list(zip(*rows)) or [[]] * 9
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def totals(stash: Stash, nodes: DataFrame, band: int, wider: int, queue: int, unit: int = 0) -> DataFrame:
    """Children, leaves and savings of every node's subtree, with the other columns of ``nodes``.

    ``nodes`` has conv_id and depth (the node), up and up_depth (its parent; null for a root), block
    (of its conversation), children, leaves and saved (its own). ``unit`` is 1 for nodes that don't
    stand without gaps in chains of one conversation.
    """
    unit = unit or band
    nodes = nodes.withColumn("band", F.expr(f"depth div {band}"))
    sent = stash.keep(_forward(nodes, unit, queue, False), "sent")
    left = sent.filter("kind = 0").groupBy("conv_id", "depth").agg(
        *[F.sum(c).alias(c) for c in ("children", "leaves", "saved")]
    )
    left = stash.keep(left, "left")
    if not left.isEmpty():
        chains = sent.filter("kind = 1").select("conv_id", F.col("depth").alias("level"), "up", "up_depth", "block")
        roots = left.withColumn("level", F.expr(f"depth div {unit}")).join(chains, ["conv_id", "level"]).drop("level")
        roots = stash.keep(roots.withColumn("block", F.expr(f"block div {wider}")), "roots")
        above = totals(stash, roots, band * wider, wider, queue, 1)
        late = above.select("conv_id", "depth", F.col("n_leaves").alias("_leaves"), F.col("saved_total").alias("_saved"))
        late = late.join(left.select("conv_id", "depth", F.col("children").alias("_children")), ["conv_id", "depth"])
        joined = lookup(nodes, stash.keep(late, "late"), ["conv_id", "depth"])
        for c in ("children", "leaves", "saved"):
            joined = joined.withColumn(c, F.col(c) + F.coalesce(f"_{c}", F.lit(0)))
        nodes = joined.drop("_children", "_leaves", "_saved")
    return stash.keep(_forward(nodes, unit, queue, True), "totals")


def _polynomials(turns: DataFrame, pieces: int) -> DataFrame:
    """conv_id, position and bytes of ordered turns, with two polynomials of the digests from the
    start of the conversation, or of the piece of the table that the turn stands in (``piece``).

    ``before`` counts the conversation's turns in the piece up to the turn, the turn included.
    """
    cut = turns.withColumn("piece", F.expr(f"position div {pieces}"))
    ordered = cut.select("conv_id", "piece", "position", "t1", "t2", "bytes").repartition("piece")
    ordered = ordered.sortWithinPartitions("piece", "position")

    def run(batches):
        at, n, s1, s2 = None, 0, 0, 0
        for batch in batches:
            out = []
            for conv, piece, t1, t2 in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4))):
                if (conv, piece) != at:
                    at, n, s1, s2 = (conv, piece), 0, 0, 0
                r1, r2, n = s1, s2, n + 1
                s1, s2 = (s1 * BASES[0] + t1) % PRIME, (s2 * BASES[1] + t2) % PRIME
                out.append((n, s1, s2, r1, r2))
            if out:
                added = [pa.array(c, pa.int64()) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(3), batch.column(5), *added],
                    names=["conv_id", "piece", "t1", "bytes", "before", "s1", "s2", "r1", "r2"],
                )

    return ordered.mapInArrow(
        run,
        "conv_id bigint, piece bigint, t1 bigint, bytes bigint, before bigint, s1 bigint, s2 bigint, r1 bigint, r2 bigint",
    )


def _sequences(stash: Stash, turns: DataFrame, pieces: int) -> DataFrame:
    """Every turn with its depth and the keys of the sequences that end with it and before it."""
    parts = stash.keep(_polynomials(turns, pieces), "pieces")
    ends = parts.groupBy("conv_id", "piece").agg(F.max(F.struct("before", "s1", "s2")).alias("e")).select("conv_id", "piece", "e.*")
    cut = ends.groupBy("conv_id").agg(F.count("*").alias("size")).filter("size > 1").select("conv_id")

    def carry(conv):
        n, s1, s2 = 0, 0, 0
        rows = []
        conv = conv.sort_values("piece")
        for conv_id, piece, before, e1, e2 in zip(*(conv[c].tolist() for c in ("conv_id", "piece", "before", "s1", "s2"))):
            rows.append((conv_id, piece, n, s1, s2))
            s1 = (s1 * pow(BASES[0], before, PRIME) + e1) % PRIME
            s2 = (s2 * pow(BASES[1], before, PRIME) + e2) % PRIME
            n += before
        import pandas as pd

        return pd.DataFrame(rows, columns=["conv_id", "piece", "n", "c1", "c2"])

    # one row for each piece that a cut conversation reaches into
    carried = ends.join(cut, "conv_id").groupBy("conv_id").applyInPandas(
        carry, "conv_id bigint, piece bigint, n bigint, c1 bigint, c2 bigint"
    )
    joined = lookup(parts, stash.keep(carried, "carried"), ["conv_id", "piece"])
    joined = joined.select("conv_id", "t1", "bytes", "before", "s1", "s2", "r1", "r2", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "c1", "c2")])

    def run(batches):
        for batch in batches:
            out = []
            for before, s1, s2, r1, r2, n, c1, c2 in zip(*(batch.column(k).to_pylist() for k in range(3, 11))):
                if n:
                    p1, p2 = pow(BASES[0], before - 1, PRIME), pow(BASES[1], before - 1, PRIME)
                    r1, r2 = (r1 + c1 * p1) % PRIME, (r2 + c2 * p2) % PRIME
                    s1, s2 = (s1 + c1 * p1 * BASES[0]) % PRIME, (s2 + c2 * p2 * BASES[1]) % PRIME
                out.append((n + before, s1, s2, r1, r2))
            if out:
                added = [pa.array(c, pa.int64()) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k) for k in range(3)), *added], names=["conv_id", "t1", "bytes", "depth", "s1", "s2", "r1", "r2"]
                )

    return joined.mapInArrow(
        run, "conv_id bigint, t1 bigint, bytes bigint, depth bigint, s1 bigint, s2 bigint, r1 bigint, r2 bigint"
    )


def _ends(ends: DataFrame, node: list[str], ids: int) -> DataFrame:
    """Digest of the ids of the conversations that end at each node, in order and comma-joined.

    The ids are joined in parts of ``ids`` positions; the digest, which can only be computed from
    front to back, then takes few texts even at a node where a third of all conversations end.
    """
    placed = number_rows(ends, [*node, "conv_id"], "position")
    parts = placed.withColumn("part", F.expr(f"position div {ids}")).groupBy(*node, "part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    )
    ordered = parts.select(*node, "part", "ids").repartition(*node).sortWithinPartitions(*node, "part")
    names = [*node, "ends_sha256"]

    def run(batches):
        at = digest = None
        for batch in batches:
            out = []
            for *key, ids_ in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4))):
                if key != at:
                    if at is not None:
                        out.append((*at, digest.hexdigest()))
                    at, digest = key, hashlib.sha256(ids_.encode())
                else:
                    digest.update(b"," + ids_.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*at, digest.hexdigest())], names=names)

    return ordered.mapInArrow(run, ", ".join(f"{c} bigint" for c in node) + ", ends_sha256 string")


def _digests(role: str, text: str) -> tuple:
    """Two numbers of 60 bits of a turn; the role's length keeps role and text apart."""
    whole = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    return tuple(F.conv(F.substring(whole, at, 15), 16, 10).cast("bigint") for at in (1, 16))


def _rows(df: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    empty = F.lit("")
    return df.select(
        F.col(conv_id).cast("bigint").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), empty).alias("role"),
        F.coalesce(F.col(text).cast("string"), empty).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    ).filter("conv_id is not null")


_ORDER = ["conv_id", "turn", "role", "text", "row"]


def trie(
    df: DataFrame,
    conversations: DataFrame | None = None,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    block: int = BLOCK,
    band: int = BAND,
    wider: int = WIDER,
    queue: int = QUEUE,
    pieces: int = PIECE,
    ids: int = IDS,
) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node stands for the first ``depth`` turns of conversation ``conv_id``, its smallest member;
    its last turn is that conversation's turn number ``depth``. saved_tokens sums over the subtree
    the bytes of a node's last text times its members but one. ends_sha256 is the SHA-256 of the
    ids of the conversations that end there.

    Turns are ordered by turn (null first), then by role and text; equal rows are turns of their
    own. A null role or text is empty; rows without a conversation are left out. ``conversations``
    (conv_id) adds conversations without turns, which end at the root. No conversation gives no
    node. Only the named columns are read, so other columns may have any names.
    """
    stash = Stash(df.sparkSession, "trie")
    t1, t2 = _digests("role", "text")
    rows = _rows(df, conv_id, turn, role, text).withColumns({"t1": t1, "t2": t2, "bytes": F.octet_length("text").cast("bigint")})
    ordered = number_rows(rows, _ORDER, keep=["conv_id", "t1", "t2", "bytes"])
    turns = stash.keep(_sequences(stash, ordered, pieces), "turns")

    every = turns.select("conv_id")
    if conversations is not None:
        every = every.unionByName(conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).filter("conv_id is not null"))
    path = F.transform(F.array_sort(F.collect_list(F.when(F.col("depth") <= PATH, F.struct("depth", "t1")))), lambda s: s["t1"])
    convs = turns.groupBy("conv_id").agg(path.alias("path"), F.max("depth").alias("length"))
    convs = every.distinct().join(convs, "conv_id", "left").select(
        "conv_id", F.coalesce("path", F.array().cast("array<bigint>")).alias("path"), F.coalesce("length", F.lit(0)).alias("length")
    )
    placed = number_rows(convs, ["path", "conv_id"], "rank", keep=["conv_id", "length"])
    convs = stash.keep(placed.select("conv_id", "length", F.expr(f"rank div {block}").alias("block")), "convs")

    node = ["depth", "k1", "k2"]
    zero = F.lit(0).cast("bigint")
    none = F.lit(None).cast("bigint")
    passed = lookup(turns, convs, "conv_id").select(
        "conv_id", "block", "depth", F.col("s1").alias("k1"), F.col("s2").alias("k2"),
        F.col("r1").alias("p1"), F.col("r2").alias("p2"), "bytes", (F.col("depth") == F.col("length")).alias("last"),
    )
    roots = convs.select(
        "conv_id", "block", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"),
        zero.alias("bytes"), (F.col("length") == 0).alias("last"),
    )
    passed = stash.keep(passed.unionByName(roots), "passed")
    nodes = passed.groupBy(*node).agg(
        F.min(F.struct("conv_id", "block")).alias("top"),
        F.count("*").alias("n_convs"),
        F.count_if("last").alias("n_ends"),
        *[F.min(c).alias(c) for c in ("p1", "p2", "bytes")],
    ).select(*node, "top.*", "n_convs", "n_ends", "p1", "p2", "bytes")
    nodes = stash.keep(nodes, "nodes")
    digests = stash.keep(_ends(passed.filter("last").select(*node, "conv_id"), node, ids), "ends")
    parents = nodes.select(
        F.col("conv_id").alias("up"), F.col("depth").alias("up_depth"), (F.col("depth") + 1).alias("depth"),
        F.col("k1").alias("p1"), F.col("k2").alias("p2"),
    )
    tree = lookup(lookup(nodes, parents, ["depth", "p1", "p2"]), digests, node)
    own = stash.keep(
        tree.select(
            "conv_id", "depth", "block", "up", "up_depth", zero.alias("children"),
            # no member goes on
            (F.col("n_ends") == F.col("n_convs")).cast("bigint").alias("leaves"),
            ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
            "n_convs",
            F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
        ),
        "tree",
    )
    stash.drop(turns, passed, nodes)
    return totals(stash, own, band, wider, queue).select(
        "conv_id", "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved_total").alias("saved_tokens"), "ends_sha256",
    )


def rebuilt(
    df: DataFrame,
    every: int = 5,
    share: int = 9,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, turn, role, text) and ids of conversations that begin like another one.

    Conversation c takes the first h turns of c - c % ``every`` (all if it has fewer, none if it is
    absent) and goes on with its own turns after its first h; h is crc32(c) % ``share``. Turns are
    ordered and nulls treated as in ``trie``; new turns are numbered from 1.
    """
    stash = Stash(df.sparkSession, "rebuilt")
    columns = ["conv_id", "role", "text"]
    rows = stash.keep(number_rows(_rows(df, conv_id, turn, role, text), _ORDER, keep=columns), "rows")
    convs = rows.groupBy("conv_id").agg(F.min("position").alias("first"), F.count("*").alias("size"))
    convs = convs.withColumns({"h": F.crc32(F.col("conv_id").cast("string")) % share, "base": F.col("conv_id") - F.col("conv_id") % every})
    bases = convs.select(F.col("conv_id").alias("base"), F.col("size").alias("there"))
    convs = stash.keep(convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)))), "convs")
    placed = lookup(rows, convs.select("conv_id", "first", "h", "taken"), "conv_id")
    placed = placed.withColumn("turn", F.col("position") - F.col("first") + 1)
    own = placed.filter("turn > h").select("conv_id", (F.col("turn") - F.col("h") + F.col("taken")).alias("turn"), "role", "text")
    heads = placed.filter(f"turn < {share}").select(F.col("conv_id").alias("base"), "turn", "role", "text")
    begun = heads.join(convs.select("conv_id", "base", "h"), "base").filter("turn <= h")
    return own.unionByName(begun.select("conv_id", "turn", "role", "text")), convs.select("conv_id")
