"""Near copies by MinHash: banding, signatures, exact confirmation, alternating stars.

Rows with one shingle set form a class first; its smallest doc_id stands for it, so thousands of
exact copies are one row from then on. Representatives that share a band meet in its bucket. A
bucket is settled by pivots first: its busiest row is compared with every row of another component,
links join components, the pivot leaves, and a bucket whose rows are all in one component is done.
What a pivot settles is settled for good, so no link that joins components is lost. After
``PIVOTS`` rounds the rows of the buckets that are still open meet once more, where they share a
shingle that stands early enough in both sets, rare shingles first: every link has such a shingle,
while sets that differ by edits of their own begin with shingles nobody else has. A pair leaves a
join only if its sizes and its bits allow the similarity; it is then compared by signature, and at
last on its full sets.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Stash, sliced, utf8, worker_cache
from tidewatch.llm.shingling import (
    BITS,
    COUNTERS,
    STEP,
    WordHashes,
    alike,
    early_places,
    mix,
    overlap,
    prefixes,
    shingle_counts,
    shingles,
)

SHINGLE = 5
PERCENT = 85
HASHES = 192
# Probability that two sets at the threshold share no band.
MISS = 3e-7
# Agreement of signatures a pair may fall short of its similarity by: over five deviations.
SLACK = 0.15
PIVOTS = 2
# Ids of candidate documents that may be broadcast; beyond it the join is shuffled.
BROADCAST_IDS = 500_000

_rng = np.random.default_rng(20240917)
_A = _rng.integers(1 << 63, dtype=np.uint64, size=HASHES) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1 << 63, dtype=np.uint64, size=HASHES)


def signature(own: np.ndarray) -> np.ndarray:
    """Minima of all universal hashes ``a * x + b`` over the set."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(own), 1024):
        hashed = np.multiply.outer(_A, own[start : start + 1024])
        hashed += _B[:, None]
        np.minimum(low, hashed.min(axis=1), out=low)
    return low


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows a band: as many rows as let a link at the threshold be missed with ``MISS`` at most."""
    for rows in range(HASHES, 1, -1):
        if (1 - (percent / 100) ** rows) ** (HASHES // rows) <= MISS:
            return HASHES // rows, rows
    return HASHES, 1


def sketches(df: DataFrame, doc_id: str, text: str, size: int, percent: int = PERCENT) -> DataFrame:
    """One row a document: size of its set, digest of the set, band keys, short signature."""
    schema = (
        "doc_id bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>, sig binary,"
        " b1 bigint, b2 bigint, b3 bigint"
    )
    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    bands, height = banding(percent)

    def run(batches):
        hashes = worker_cache("shingle_words", WordHashes)
        band = np.arange(bands, dtype=np.uint64)
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.binary()] + [pa.int64()] * 3
        names = ["doc_id", "n", "d1", "d2", "bands", "sig", "b1", "b2", "b3"]
        for batch in sliced(batches, "text"):
            out = []
            for i, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                own = shingles(t, size, hashes)
                if not len(own):
                    out.append((i, 0, i, None, None, None, None, None, None))  # spread by id, and joins nothing
                    continue
                d1, d2 = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), "<i8")
                low = signature(own)
                key = mix(band + np.uint64(1))
                for column in low[: bands * height].reshape(bands, height).T:
                    key = mix(key * STEP + column)
                short = (mix(low) & np.uint64(0xFFFF)).astype("<u2")
                bits = np.packbits((short & 1).astype(np.uint8)).view("<i8").tolist()
                out.append((i, len(own), int(d1), int(d2), key.view(np.int64), short.tobytes(), *bits))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names
            )

    return rows.mapInArrow(run, schema)


def components(stash: Stash, edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b): large-star and small-star in turn.

    Both steps use the smallest neighbour of each id, which is aggregated before the shuffle, and
    a join that may split a busy id, so a hub's neighbours are never gathered in one place.
    """
    stars = stash.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = stars.select("u", "v").unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stash.keep(large, "large")
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(first, "u")
            .filter("v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(first.select("u", F.col("m").alias("v")))
            .distinct()
        )
        following = stash.keep(small, "stars")
        stash.drop(stars, large)
        stars = following
        # done when every id hangs on one centre and no centre hangs on another
        ends = stars.select(F.col("u").alias("id"), F.lit(1).alias("hangs"), F.lit(0).alias("centre")).unionByName(
            stars.select(F.col("v").alias("id"), F.lit(0).alias("hangs"), F.lit(1).alias("centre"))
        )
        roles = ends.groupBy("id").agg(F.sum("hangs").alias("hangs"), F.max("centre").alias("centre"))
        if roles.filter("hangs > 1 or (hangs > 0 and centre > 0)").isEmpty():
            break
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def _agreeing(pairs: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """Pairs whose signatures agree about as often as linked sets' do."""
    short = sketch.filter("n > 0").select("doc_id", "sig")
    joined = pairs.join(short.toDF("a", "sa"), "a").join(short.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    least = (percent / 100 - SLACK) * HASHES

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, HASHES)
                for c in (2, 3)
            )
            keep = pa.array((one == two).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"]
            )

    return joined.mapInArrow(run, "a bigint, b bigint").distinct()


def _linked(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    joined = (
        pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    )

    def run(batches):
        hashes = worker_cache("shingle_words", WordHashes)
        lately: OrderedDict[bytes, np.ndarray] = OrderedDict()

        def of(text: bytes) -> np.ndarray:
            key = hashlib.blake2b(text, digest_size=16).digest()
            if key not in lately:
                lately[key] = shingles(text, size, hashes)
                if len(lately) > 64:
                    lately.popitem(last=False)
            return lately[key]

        for batch in sliced(batches, "ta"):
            keep = []
            for one, two in zip(utf8(batch.column(2)), utf8(batch.column(3))):
                x, y = of(one), of(two)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"]
            )

    return joined.mapInArrow(run, "a bigint, b bigint").distinct()


def _meeting(stash: Stash, ids: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """Pairs (id, pivot) of ``ids`` (id, component) that share a shingle early enough in both sets.

    Exact: two sets that need ``o`` shingles in common have the first one of them, in any order, at
    a place with at least ``o`` places left in each. The order is that of a count sketch of these
    texts. Components join nothing inside themselves.
    """
    few = ids.count() <= BROADCAST_IDS
    own = texts.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("id"))
    own = stash.keep(own.select("doc_id", "text"), "meeting")
    drawn = stash.keep(prefixes(own, size, percent, shingle_counts(own, size, COUNTERS)), "prefixes")
    tokens = drawn.select(F.col("doc_id").alias("id"), "n", "d", F.posexplode("prefix").alias("i", "token"))
    # a doc_id may have several texts; each has its own places
    tokens = tokens.withColumn("early", F.expr(f"n - i >= {overlap(percent, 'n + n')}")).distinct()
    shared = tokens.groupBy("token").agg(F.count("*").alias("size"), F.max("early").alias("soon")).filter("size > 1 and soon")
    bits = drawn.select(F.col("doc_id").alias("id"), "d", *BITS).distinct().join(ids, "id")
    rows = stash.keep(tokens.join(shared.select("token"), "token").join(bits, ["id", "d"]).drop("d"), "tokens")
    names = {"id": "pivot", "n": "o", "i": "j", "component": "of", "early": "soon", **{b: f"o{b[1]}" for b in BITS}}
    other = rows.filter("early").select(*[F.col(c).alias(names.get(c, c)) for c in rows.columns])
    fits = f"component != of and {early_places(percent)} and {alike(percent)} and (not early or id < pivot)"
    return rows.join(other, "token").filter(F.expr(fits)).select("id", "pivot")


def cluster(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    percent: int = PERCENT,
    size: int = SHINGLE,
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row for every row of ``df``.

    Documents whose sets have a Jaccard similarity of ``percent`` or more are linked; component_id
    is the smallest doc_id that links lead to. Null, empty and blank texts have an empty set and
    link with nothing. Repeated rows are copies of themselves and repeat their result; a row without
    doc_id cannot be named, has no component and is kept; an empty table gives an empty result.
    Only ``doc_id`` and ``text`` are read, so other columns may have any names.
    """
    spark = df.sparkSession
    stash = Stash(spark, "minhash")
    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    sketch = stash.keep(sketches(rows, "doc_id", "text", size, percent), "sketch")
    named = sketch.filter("n > 0 and doc_id is not null")
    classes = stash.keep(
        named.groupBy("d1", "d2").agg(F.min("doc_id").alias("id")), "classes"
    )
    banded = (
        named.select("d1", "d2", F.col("doc_id").alias("id"), "n", "bands")
        .join(classes, ["d1", "d2", "id"])
        .select("id", "n", F.explode("bands").alias("key"))
    )
    crowded = banded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members = stash.keep(banded.join(crowded, "key").distinct(), "members")
    busy = members.groupBy("id").agg(F.sum("size").alias("busy"))
    bits = named.select(F.col("doc_id").alias("id"), "b1", "b2", "b3").dropDuplicates(["id"])
    carried = ["key", "id", "n", "busy", "b1", "b2", "b3"]
    active = stash.keep(
        members.join(busy.join(bits, "id"), "id").select(*carried, F.col("id").alias("component")), "active"
    )
    stash.drop(members)
    wanted = stash.keep(active.select("id").distinct(), "ids")
    few = wanted.count() <= BROADCAST_IDS
    texts = stash.keep(
        rows.join(F.broadcast(wanted) if few else wanted, F.col("doc_id") == F.col("id")).select("doc_id", "text"),
        "texts",
    )
    differing = " + ".join(f"bit_count(b{i} ^ o{i})" for i in (1, 2, 3))
    # one bit of each minimum differs for half the hashes that disagree; six deviations of room
    share = (1 - percent / 100) / 2
    most = round(HASHES * share + 6 * (HASHES * share * (1 - share)) ** 0.5)
    fits = F.expr(
        f"component != of and 100 * least(n, o) >= {percent} * greatest(n, o) and {differing} <= {most}"
    )
    edges = found = None
    other = ("pivot", "o", "of", "o1", "o2", "o3")
    for turn in range(PIVOTS + 1):
        open_ = active.groupBy("key").agg(
            F.max(F.struct("busy", "id", "n", "component", "b1", "b2", "b3")).alias("p"),
            F.min("component").alias("first"),
            F.max("component").alias("last"),
        ).filter("first != last")
        pivots = stash.keep(
            open_.select(
                "key",
                *[F.col(f"p.{c}").alias(o) for c, o in zip(("id", "n", "component", "b1", "b2", "b3"), other)],
            ),
            "pivots",
        )
        if pivots.isEmpty():
            break
        if turn < PIVOTS:
            pairs = active.join(pivots, "key").filter(fits)
        else:
            still = active.join(pivots.select("key"), "key").select("id", "component").distinct()
            pairs = _meeting(stash, stash.keep(still, "still"), texts, percent, size)
        pairs = pairs.select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b")).distinct()
        close = stash.keep(_agreeing(pairs, sketch, percent), "close")
        links = stash.keep(_linked(close, texts, percent, size), "links")
        new = not links.isEmpty()
        if new:
            edges = links if edges is None else edges.unionByName(links)
            found = stash.keep(components(stash, edges), "components")
        if turn == PIVOTS:
            break
        following = active.join(pivots.select("key", "pivot"), "key").filter("id != pivot")
        following = following.select(*carried, "component")
        if new:
            following = (
                following.drop("component")
                .join(found, "id", "left")
                .select(*carried, F.coalesce("component", "id").alias("component"))
            )
        following = stash.keep(following, "active")
        stash.drop(active, pivots, close)
        active = following
    if found is None:
        found = spark.createDataFrame([], "id bigint, component bigint")
    stash.drop(texts, active, wanted)
    of_class = classes.join(found, "id", "left").select("d1", "d2", F.coalesce("component", "id").alias("component"))
    # sets that stand alone need no join: only rows of a class are looked up
    return (
        sketch.select("doc_id", "n", "d1", "d2")
        .join(of_class, ["d1", "d2"], "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
