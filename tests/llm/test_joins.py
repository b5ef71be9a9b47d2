"""Grouped prefix join, conversation trie and ranked search beside brute force."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from test_search import alnum, blank
from tidewatch.llm import joins, ranking, trie
from tidewatch.llm.common import Stash
from tidewatch.llm.queries import QUERIES

# --- n-gram join -------------------------------------------------------------------------------


def linked(rows, size=3, percent=90):
    """doc_id to (sizes of its sets, smallest doc_id reachable), from all pairs."""
    sets = collections.defaultdict(list)
    for i, text in rows:
        words = blank(text)
        last = max(1, len(words) - size + 1) if words else 0
        sets[i].append(frozenset(tuple(words[k : k + size]) for k in range(last)))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (sorted(len(s) for s in own), find(i)) for i, own in sets.items()}


def answers(found):
    out = collections.defaultdict(lambda: ([], set()))
    for r in found:
        out[r.doc_id][0].append(r.n_shingles)
        out[r.doc_id][1].add(r.component_id)
    assert all(len(c) == 1 for _, c in out.values())
    return {i: (sorted(n), c.pop()) for i, (n, c) in out.items()}


def near_rows(spark, sf_dir, copies=150):
    rng = random.Random(7)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    base = [t for _, t in rows if t and 60 < len(t.split()) < 400][:5]
    for k in range(copies):
        words = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
            words[rng.randrange(len(words))] = f"zz{rng.randrange(30)}"
        rows.append((10_000 + k, rng.choice([" ", "\n", " \t"]).join(words)))
    return rows + [(20_000, "a b"), (20_001, "A  b"), (20_002, "b a"), (20_003, None), (20_004, " ")]


@pytest.mark.parametrize("counters, pivots", [(1 << 22, 2), (64, 0)])
def test_join_equals_brute_force(spark, sf_dir, monkeypatch, counters, pivots):
    monkeypatch.setattr(joins, "PIVOTS", pivots)
    rows = near_rows(spark, sf_dir)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert answers(joins.join(df, counters=counters).collect()) == linked(rows)


def test_groups_of_several_classes(spark, monkeypatch):
    # sets of words: one size and one prefix of rare words, and frequent words that differ
    rare, often = [f"r{i}" for i in range(7)], [f"f{i}" for i in range(200)]
    rows = [(1000 + k, " ".join(often[i : i + 40])) for k, i in enumerate(list(range(0, 161, 10)) * 12)]
    rows += [(k, " ".join([*rare, *often[:53], often[100 + k]])) for k in range(1, 6)]  # linked with each other
    rows += [(k, " ".join([*rare, *often[80:133], often[140 + k]])) for k in range(20, 24)]  # the same, but not with those
    rows += [(30, " ".join([*rare, *often[146:200]]))]  # linked with nobody
    sizes, units = [], joins._units

    def seen(stash, classes, links, percent):
        found = units(stash, classes, links, percent)
        sizes.extend(r["count"] for r in found.groupBy("u").count().collect())
        sizes.append(classes.groupBy("g").count().agg(F.max("count")).first()[0])
        return found

    monkeypatch.setattr(joins, "_units", seen)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = answers(joins.join(df, size=1, counters=1 << 16).collect())
    assert found == linked(rows, size=1)
    assert sizes[-1] == 10 and sorted(sizes[:-1])[-2:] in ([1, 4], [1, 5])
    assert {found[k][1] for k in range(1, 6)} == {1} and {found[k][1] for k in range(20, 24)} == {20}


def test_rows_that_share_a_doc_id_are_one_document(spark):
    rows = [(50, "one two three four"), (50, "five six seven eight"), (40, "ONE two three four"), (60, "five six seven eight")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = answers(joins.join(df, counters=1 << 12).collect())
    assert found == linked(rows) and found[60][1] == found[50][1] == 40


def test_join_of_hard_rows(spark, hard, nothing):
    found = joins.join(hard).collect()
    assert collections.Counter(r.doc_id for r in found) == collections.Counter(r.doc_id for r in hard.collect())
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9, None: None}
    assert {r.doc_id: r.n_shingles for r in found}[6] == 1
    assert joins.join(nothing).count() == 0


def test_needed_overlap_loses_no_pair(spark):
    rows = [(n, o, c) for n in range(1, 40) for o in range(1, n + 1) for c in range(o + 1)]
    df = spark.createDataFrame(rows, "n bigint, o bigint, c bigint")
    least = joins.overlap(90, "n + o")
    assert df.filter(f"(100 * c >= 90 * (n + o - c)) != (c >= {least})").isEmpty()


# --- conversation trie -------------------------------------------------------------------------


def rebuilt(rows):
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    whole = {c: [(r, x) for _, r, x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in whole.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        out[c] = whole.get(base, [])[:h] + turns[h:]
    return out


def nodes(whole):
    members = collections.defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    leaves, saved, children = collections.Counter(), collections.Counter(), collections.Counter()
    inner = {k[:-1] for k in members if k}
    for k, m in members.items():
        gain = (len(m) - 1) * len(k[-1][1].encode()) if k else 0
        if k:
            children[k[:-1]] += 1
        for d in range(len(k) + 1):
            saved[k[:d]] += gain
            leaves[k[:d]] += k not in inner
    out = set()
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(k))))
        up = min(members[k[:-1]]) if k else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.add((min(m), len(k), up, len(m), children[k], leaves[k], saved[k], digest))
    return out


def odd_conversations():
    rng = random.Random(1)
    rows = [(None, 1, "a", "b"), (-7, None, None, None), (-7, 0, "u", "x"), (-5, 1, "u", "é"), (3, 0, "u", "")]
    for c in range(1000, 1090):  # many shared beginnings, ties, missing turns
        for t in range(rng.randrange(14)):
            rows.append((c, rng.choice([None, t, t]), "u", rng.choice("ab")))
    # long ones that part late, and repeated rows
    rows += [(2000, t, "u", str(t % 3)) for t in range(400)] + [(2001, t, "u", str(t % 3)) for t in range(380)]
    rows += [(2005, t, "u", str(t % 3) if t < 300 else "z") for t in range(330)]
    return rows + rows[1:9]


SMALL = dict(block=3, band=2, wider=2, queue=3, pieces=50, ids=3)


@pytest.mark.parametrize("options", [{}, SMALL])
def test_trie_equals_brute_force(spark, options):
    rows = odd_conversations()
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    df = df.withColumns({"depth": F.lit("d"), "up": F.lit(1), "block": F.lit(None)})
    turns, conversations = trie.rebuilt(df)
    found = trie.trie(turns, conversations, **options).collect()
    got = {tuple(r) for r in found}
    assert len(got) == len(found) and got == nodes(rebuilt(rows))


def test_trie_of_plain_conversations(spark):
    rows = [(1, 0, "u", "hi"), (1, 1, "a", "yo"), (2, 0, "u", "hi"), (2, 1, "a", "no"), (3, 0, "uh", "i")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = {(r.conv_id, r.depth): r for r in trie.trie(df).collect()}
    # a role and a text are kept apart, and conversations of one beginning share its node
    assert set(found) == {(1, 0), (1, 1), (1, 2), (2, 2), (3, 1)}
    assert (found[1, 0].n_children, found[1, 0].n_leaves, found[1, 0].saved_tokens) == (2, 3, 2)
    assert (found[1, 1].n_convs, found[2, 2].parent_conv_id, found[1, 1].ends_sha256) == (2, 1, trie.EMPTY)
    nobody = trie.trie(df.limit(0))
    assert nobody.count() == 0
    turns, conversations = trie.rebuilt(df.limit(0))
    assert trie.trie(turns, conversations).columns == nobody.columns and conversations.count() == 0


def test_queue_spills_and_gives_all_back_in_order():
    rng = random.Random(2)
    queue, model, out = trie.SpillingQueue(10), [], []
    for _ in range(6000):
        if model and rng.random() < 0.45:
            item = queue.pop()
            assert item == min(model)
            model.remove(item)
            out.append(item)
        else:
            item = (rng.randrange(50), rng.randrange(5), 1)
            queue.push(item)
            model.append(item)
        assert len(queue.heap) <= 10
    assert queue.spilled > 10
    while queue.first() is not None:
        out.append(queue.pop())
    assert len(out) == len(set(enumerate(out))) and sorted(out[-len(model) :]) == sorted(model)


def test_totals_go_through_several_rounds(spark):
    # a chain of 60 nodes with a leaf at each, cut into shards of two levels
    rows = [(0, d, None if d == 0 else 0, d - 1, 0, 0, int(d == 59), 1) for d in range(60)]
    rows += [(d + 100, d + 1, 0, d, (d + 100) // 3, 0, 1, 10) for d in range(59)]
    df = spark.createDataFrame(
        rows, "conv_id bigint, depth bigint, up bigint, up_depth bigint, block bigint, children bigint, leaves bigint, saved bigint"
    )
    found = {(r.conv_id, r.depth): r for r in trie.totals(Stash(spark, "t"), df, 2, 2, 4).collect()}
    for d in range(60):
        r = found[0, d]
        assert (r.n_children, r.n_leaves, r.saved_total) == (2 if d < 59 else 0, 60 - d, 60 - d + 10 * (59 - d))


def test_trie_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = QUERIES["op11_forward_trie"](spark, sf_dir).collect()
    assert {tuple(r) for r in found} == nodes(rebuilt(rows)) and len(found) == len(set(found))


# --- ranked search -----------------------------------------------------------------------------


def best(documents, items, top=50):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    docs = [(i, collections.Counter(alnum(t))) for i, t in documents]
    n_docs, terms = sum(1 for _, c in docs if c), sum(c.total() for _, c in docs)
    held = collections.Counter()
    for _, c in docs:
        held.update(c.keys())
    out = []
    for item, text in items:
        scores = []
        for i, c in docs:
            m = 100 - 50 + (50 * c.total() * n_docs) // max(terms, 1)
            score = 0
            for term in set(alnum(text)):
                if c[term]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[term] + 1)))
                    score += weight * ((10**9 * c[term]) // (1000 * c[term] + 20 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0))
        for rank, (score, none, i) in enumerate(sorted(scores)[:top], 1):
            out.append((item, rank, None if none else i, -score))
    return sorted(out, key=str)


@pytest.mark.parametrize("words", [1_000_000, 20])
def test_ranking_equals_brute_force(spark, hard, nothing, monkeypatch, words):
    monkeypatch.setattr(ranking, "BLOCK_TERMS", 40)
    rng = random.Random(9)
    letters = [f"t{i}" for i in range(90)] + ["Dé"]
    draw = lambda most: ", ".join(rng.choices(letters, k=rng.randint(0, most)))
    documents = [(k, draw(60)) for k in range(150)]
    documents += [documents[3], documents[3], (None, documents[4][1]), (900, None), (901, "-"), (902, documents[4][1].upper())]
    items = [(1, "t1 t2 t3"), (1, "t4"), (2, None), (3, "?"), (None, "t5 T6 t5"), (4, "zz"), (5, " ".join(letters)), (6, draw(30))]
    asked = spark.createDataFrame(items, "item_id bigint, text string").withColumn("key", F.lit("k"))
    df = spark.createDataFrame(documents, "doc_id bigint, text string").repartition(5)
    found = ranking.search(df.withColumn("rank", F.lit(0)), asked, top=7, item_words=words).collect()
    assert sorted([tuple(r) for r in found], key=str) == best(documents, items, 7)
    odd = [(r.doc_id, r.text) for r in hard.collect()]
    own = [(1, "the fox W5 w996"), (2, "日本語 license")]
    found = ranking.search(hard, spark.createDataFrame(own, "item_id bigint, text string")).collect()
    assert sorted([tuple(r) for r in found], key=str) == best(odd, own)
    assert ranking.search(nothing, asked).count() == 0 and ranking.search(df, asked.limit(0)).count() == 0


def test_masks_that_cannot_win_are_not_evaluated():
    import numpy as np

    items = ranking.Items([(0, b"a b")])
    found = ranking.Ranking(items, np.array([5, 500]), 4000, 40_000, 3)
    n = 2000
    rows = np.concatenate([np.arange(n), np.arange(0, n, 100)])
    terms = np.concatenate([np.zeros(n, np.int64), np.ones(n // 100, np.int64)])
    ids = np.arange(n)
    found.add(ids, np.zeros(n, bool), np.full(n, 10), rows, terms, np.ones(len(rows), np.int64))
    assert found.best[0][1].tolist() == [0, 100, 200] and found.evaluated == n // 100


def test_ranking_query(spark, sf_dir):
    documents = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = QUERIES["op12_mask_ranking"](spark, sf_dir).collect()
    assert sorted([tuple(r) for r in found], key=str) == best(documents, items)
