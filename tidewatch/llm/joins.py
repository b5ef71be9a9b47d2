"""N-gram Jaccard join by grouped prefixes.

Shingles are put into one order, rare ones first by a count sketch of the whole corpus. Documents
of one set form a class; classes whose sets have one size and one prefix form a group, so that a
prefix is indexed once however many classes have it. A group meets another one only at a token that
stands early enough in both: with sizes ``x`` and ``y`` and a needed overlap ``o``, at place
``i`` with ``x - i >= o`` and at ``j`` with ``y - j >= o``. The shorter set so needs the token in
about half of the prefix, which copies with edits of their own fill with shingles nobody else has.
Group pairs are filtered by size, place and a parity bitmap, expanded to their classes, and these
are verified on full sets.

Tokens are settled by pivots first: every group of a token is compared with one of them, links join
components, and pairs inside a component need no comparison any more. All filters are exact, so no
link is lost but those between sets that other links have joined already.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Stash, utf8
from tidewatch.llm.minhash import components
from tidewatch.llm.shingling import BITS, COUNTERS, alike, digest, early_places, map_sets, overlap, prefixes, shingle_counts
from tidewatch.operators.ordering import lookup

SHINGLE = 3
PERCENT = 90
PIVOTS = 2
# Parts that the partners of one set are dealt to.
SALTS = 64
# Ids of sets that may be broadcast; beyond it the join is shuffled.
BROADCAST_IDS = 300_000


def _sets(stash: Stash, texts: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(c, own), the sorted hashes of the set of each class, from (c, d, rows, text), and the stored
    table that it reads.

    A text counts if its set has the digest ``d``, as other texts may have the same doc_id. Only
    classes of several rows can come up more than once, and a task gives each of them once.
    """

    def run(batches, sets):
        done = set()
        for batch in batches:
            found = []
            for c, d, rows, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), utf8(batch.column(3))):
                if c not in done and digest(own := sets(raw)) == d:
                    found.append((c, rows > 1, own.tobytes()))
                    if rows > 1:
                        done.add(c)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["c", "several", "own"])

    every = map_sets(texts.select("c", "d", "rows", "text"), size, run, "c bigint, several boolean, own binary")
    every = stash.keep(every, "sets")
    again = every.filter("several").select("c", "own").dropDuplicates(["c"])
    return every.filter("not several").select("c", "own").unionByName(again), every


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough.

    The set of ``a`` goes ahead of its partners, once for each part that these are dealt to, so a
    busy set is neither copied for each pair nor gathered with all its partners.
    """
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    ahead = dealt.select("a", "part").distinct().join(sets.toDF("a", "own"), "a")
    ahead = ahead.select("a", "part", F.lit(None).cast("bigint").alias("b"), "own")
    partners = dealt.join(sets.toDF("b", "own"), "b").select("a", "part", "b", "own")
    both = ahead.unionByName(partners).repartition("a", "part")
    both = both.sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches):
        mine = np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for one, two, raw in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                values = np.frombuffer(raw, np.uint64)
                if two is None:
                    mine = values
                    continue
                common = len(np.intersect1d(mine, values, assume_unique=True))
                if 100 * common >= percent * (len(mine) + len(values) - common):
                    out.append((one, two))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def _other(df: DataFrame) -> DataFrame:
    """Columns of a row under the names of those of its partner; ``token`` stays."""
    names = {"u": "v", "c": "b", "n": "o", "i": "j", "component": "of", "early": "soon", **{b: f"o{b[1]}" for b in BITS}}
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns])


class _Links:
    """Links found so far and the components that they make."""

    def __init__(self, stash: Stash, rows: DataFrame, classes: DataFrame, percent: int, size: int):
        self.stash, self.rows, self.classes, self.percent, self.size = stash, rows, classes, percent, size
        self.edges = self.found = None

    def verify(self, pairs: DataFrame) -> None:
        """Compare pairs (a, b) of classes on their full sets; links change the components."""
        pairs = self.stash.keep(pairs.distinct(), "pairs")
        if not pairs.isEmpty():
            ids = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
            named = self.stash.keep(self.classes.select("c", "d", "doc_id", "rows").join(ids, "c"), "wanted")
            few = named.count() <= BROADCAST_IDS
            texts = self.rows.join(F.broadcast(named) if few else named, "doc_id")
            sets, stored = _sets(self.stash, texts, self.size)
            links = self.stash.keep(_linked(pairs, sets, self.percent), "links")
            self.stash.drop(stored, named)
            self.add(links)
        self.stash.drop(pairs)

    def add(self, links: DataFrame) -> None:
        if not links.isEmpty():
            self.edges = links if self.edges is None else self.edges.unionByName(links)
            self.found = self.stash.keep(components(self.stash, self.edges), "components")

    def mark(self, df: DataFrame, key: str) -> DataFrame:
        """``df`` with the component of ``key``, which is itself where it has no link."""
        if self.found is None:
            return df.withColumn("component", F.col(key))
        found = self.found.select(F.col("id").alias(key), "component")
        return lookup(df.drop("component"), found, key).withColumn("component", F.coalesce("component", key))


def _units(stash: Stash, classes: DataFrame, links: _Links, percent: int) -> DataFrame:
    """Classes with the unit ``u`` that stands for them in the join.

    The classes of a group that are linked with its first class are one unit with it; every other
    class of the group is a unit of its own. All classes of a unit are in one component.
    """
    heads = classes.groupBy("g").agg(F.min("c").alias("head"), F.count("*").alias("size"))
    heads = stash.keep(heads.filter("size > 1").select("g", "head"), "heads")
    if heads.isEmpty():
        return classes.withColumn("u", F.col("c"))
    grouped = stash.keep(classes.join(heads, "g"), "grouped")
    first = _other(grouped.filter("c = head").select("g", "c", "n", *BITS))
    near = grouped.filter("c != head").join(first, "g").filter(alike(percent))
    links.verify(near.select(F.col("head").alias("a"), F.col("c").alias("b")))
    marked = links.mark(links.mark(classes.join(heads, "g", "left"), "head").withColumnRenamed("component", "main"), "c")
    inside = F.col("head").isNotNull() & (F.col("component") == F.col("main"))
    return marked.withColumn("u", F.when(inside, F.col("head")).otherwise(F.col("c"))).drop("head", "main", "component")


def join(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    percent: int = PERCENT,
    size: int = SHINGLE,
    counters: int = COUNTERS,
) -> DataFrame:
    """doc_id, n_shingles and component_id, one row for every row of ``df``.

    Documents whose sets have a Jaccard similarity of ``percent`` or more are linked; component_id
    is the smallest doc_id that links lead to. Null, empty and blank texts have an empty set and
    link with nothing. Rows that share a doc_id are one document: each has the size of its own set,
    and the links of all of them are its links. A row without doc_id cannot be named: it links
    nothing and has no component. An empty table gives an empty result. Only ``doc_id`` and
    ``text`` are read, so other columns may have any names.
    """
    stash = Stash(df.sparkSession, "joins")
    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    drawn = stash.keep(prefixes(rows, size, percent, shingle_counts(rows, size, counters)), "sketch")
    named = drawn.filter("n > 0 and doc_id is not null")
    classes = named.groupBy("d", "g", "n", *BITS).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"))
    # stored with its number, so that the number stays
    classes = stash.keep(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    links = _Links(stash, rows, classes, percent, size)
    links.add(stash.keep(_same_id(named, classes), "same-id"))
    units = stash.keep(_units(stash, classes, links, percent), "units")

    # the prefix of a group, from any one of its rows; a group goes by 8 bytes here, and should two
    # groups have the same, they only meet more others
    group = F.xxhash64("g").alias("k")
    tokens = named.select("g", "n", "prefix").dropDuplicates(["g"]).select(group, "n", F.posexplode("prefix").alias("i", "token"))
    # the smaller set of a pair has the token at one of its early places
    early = F.expr(f"n - i >= {overlap(percent, 'n + n')}").alias("early")
    tokens = stash.keep(tokens.select("token", "k", F.col("n").cast("int").alias("n"), "i", early), "tokens")
    met = tokens.groupBy("token").agg(F.count("*").alias("size"), F.max("early").alias("soon")).filter("size > 1 and soon")
    met = met.select("token")
    heads = units.filter("u = c").select(group, "u")
    # units of one group meet at each of its tokens
    several = stash.keep(heads.groupBy("k").count().filter("count > 1").select("k"), "several")
    if not several.isEmpty():
        met = met.unionByName(lookup(tokens, several, "k", "inner").filter("early").select("token")).distinct()
    shared = tokens.join(stash.keep(met, "met"), "token")
    active = stash.keep(shared.join(heads, "k").select("token", "u", "n", "i", "early"), "active")
    stash.drop(tokens)

    fits = F.expr(f"component != of and {early_places(percent)}")

    def verify(pairs: DataFrame) -> None:
        """Pairs of units (u, v) to pairs of their classes, which are compared."""
        pairs = stash.keep(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "unit-pairs")
        sides = units.select("u", "c", "n", *BITS)
        both = pairs.join(sides, "u").join(_other(sides), "v").filter(alike(percent))
        links.verify(both.select(F.least("c", "b").alias("a"), F.greatest("c", "b").alias("b")))

    for turn in range(PIVOTS + 1):
        placed = stash.keep(links.mark(active, "u"), "placed")
        stash.drop(active)
        open_ = placed.groupBy("token").agg(
            F.max(F.struct("early", "u", "n", "i", "component")).alias("p"),
            F.min("component").alias("low"),
            F.max("component").alias("high"),
        )
        pivots = stash.keep(open_.filter("low != high and p.early").select("token", "p.*"), "pivots")
        if pivots.isEmpty():
            break
        if turn < PIVOTS:
            verify(placed.join(_other(pivots), "token").filter(fits))
            left = placed.join(pivots.select("token", F.col("u").alias("v")), "token").filter("u != v").drop("v")
            active = stash.keep(left, "active")
        else:
            # the pivot's component is linked among itself already
            main = placed.join(pivots.select("token", F.col("component").alias("main")), "token")
            # parities speak of one class; units of several are left to the comparison of classes
            alone = units.groupBy("u").agg(F.count("*").alias("classes"), *[F.min(b).alias(b) for b in BITS])
            main = main.join(alone.filter("classes = 1").drop("classes"), "u", "left")
            main = stash.keep(main, "left")
            outside = main.filter("component != main").drop("main")
            near = F.expr(f"(early or soon) and (b1 is null or o1 is null or ({alike(percent)}))")
            verify(outside.join(_other(main.drop("main")), "token").filter(near & fits))
        stash.drop(placed)
    return _named(stash, drawn, classes, links)


def _same_id(named: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that share a doc_id."""
    several = named.groupBy("doc_id").agg(F.min("d").alias("first"), F.max("d").alias("last")).filter("first != last")
    rows = named.select("doc_id", "d").join(several.select("doc_id", "first"), "doc_id").select("first", "d").distinct()
    number = classes.select("d", "c")
    one = rows.filter("first != d").join(number.toDF("first", "a"), "first")
    return one.join(number.withColumnRenamed("c", "b"), "d").select("a", "b")


def _named(stash: Stash, drawn: DataFrame, classes: DataFrame, links: _Links) -> DataFrame:
    """Every row of ``drawn`` with the smallest doc_id of its component."""
    smallest = links.mark(classes, "c")
    least = smallest.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.sum("rows").alias("size"))
    several = least.filter("size > 1").select("component", "component_id")
    of_class = stash.keep(lookup(smallest.select("d", "component"), several, "component", "inner").select("d", "component_id"), "of-class")
    component = F.coalesce("component_id", "doc_id")
    return lookup(drawn.select("doc_id", "n", "d"), of_class, "d").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
    )
