"""Similarity clusters of lines: mining, the index of places, matching, the store that streams share."""

import dataclasses
import random
import shutil

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import clusters as cl
from tidewatch.operators.templates import WILDCARD
from tidewatch.plans.detector import Detector, DetectorModel
from tidewatch.session import scratch_path
from tidewatch.streaming import jobs
from tidewatch.streaming import store as store_module
from tidewatch.streaming.store import TemplateStore


def table(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "line_no bigint, line string")


def templates(spark, lines, **options):
    found = cl.mine_clusters(table(spark, lines), "line", **options)[0].orderBy("template_id").collect()
    return [(r.template_id, r.template, r.n, r.first_line_no) for r in found]


NAMES = [f"{a}{b}" for a in "klmnopqrst" for b in "aeiou"]


def two_families():
    rng = random.Random(1)
    lines = []
    for _ in range(80):
        who, what = rng.choice(NAMES), rng.choice(NAMES)
        lines.append(rng.choice([f"user {who} logged in from {what}", f"user {who} deleted file {what} today"]))
    return ["user zz logged in from yy", "user zz deleted file yy today", *lines]


def test_two_families_of_one_bucket_are_two_templates(spark):
    lines = two_families()
    first = sum("logged" in x for x in lines)
    found = templates(spark, lines)
    assert found == [
        (1, "user <*> logged in from <*>", first, 0),
        (2, "user <*> deleted file <*> today", len(lines) - first, 1),
    ]


def test_clusters_do_not_depend_on_partitions_or_order(spark):
    lines = two_families() + ["", " ", "one", "a b c d", "1 2 3", "4 5 6", "1 2 x", "x 1 2"]
    df = table(spark, lines)
    one = sorted(map(tuple, cl.mine_clusters(df.coalesce(1), "line")[0].collect()))
    many = sorted(map(tuple, cl.mine_clusters(df.orderBy(F.rand(3)).repartition(7), "line")[0].collect()))
    assert one == many and sum(r[2] for r in one) == len(lines) - 2


def agreeing(tokens, template):
    return sum(a == b != WILDCARD for a, b in zip(tokens, template))


def noisy_lines(n=300):
    rng = random.Random(4)
    verbs, ends = ["get", "put", "drop", "scan"], ["ok now", "failed with code", "still here"]
    lines = []
    for _ in range(n):
        words = ["job", rng.choice(NAMES), rng.choice(verbs), "on", rng.choice(NAMES), *rng.choice(ends).split(), rng.choice(NAMES)]
        if rng.random() < 0.2:
            words[rng.randrange(len(words))] = rng.choice(NAMES)
        lines.append(" ".join(words))
    return lines


def test_every_line_is_similar_to_its_cluster(spark):
    lines = noisy_lines()
    for similarity in (0.4, 0.5, 0.75, 1.0):
        _, members = cl.mine_clusters(table(spark, lines), "line", similarity=similarity)
        matched = cl.match_clusters(table(spark, lines), members, "line", similarity).collect()
        assert len(matched) == len(lines)
        for r in matched:
            tokens, template = r.line.split(), r.template.split()
            assert len(tokens) == len(template) and agreeing(tokens, template) >= similarity * len(tokens) - 1e-9


def test_matching_equals_comparison_with_every_cluster(spark):
    lines = noisy_lines()
    _, members = cl.mine_clusters(table(spark, lines[:150]), "line")
    held = [(r.template_id, r.tokens) for r in members.collect()]
    new = lines[150:] + ["job la get on sa ok now ra", "job x y z", "nothing like it", "", "job a b c d e f g"]
    for r in cl.match_clusters(table(spark, new), members, "line").collect():
        tokens = r.line.split()
        near = []
        for i, template in held:
            if len(template) == len(tokens) and template[0] in (tokens[:1] or [""])[0:1] + [WILDCARD]:
                n = agreeing(tokens, template)
                if 2 * n >= len(tokens) or tokens == template:
                    near.append((-n, i))
        assert r.template_id == (min(near)[1] if near else -1)
        assert (r.template == "") == (r.template_id == -1)


def test_lines_of_masked_places_only_are_one_cluster(spark):
    assert templates(spark, ["1 2 3", "44 5 6", "7 8 9"]) == [(1, "<*> <*> <*>", 3, 0)]
    _, members = cl.mine_clusters(table(spark, ["1 2 3"]), "line", first_id=9)
    found = cl.match_clusters(table(spark, ["5 5 5", "5 5", "a b c"]), members, "line").orderBy("line_no").collect()
    assert [r.template_id for r in found] == [9, -1, -1]


def test_empty_tables_and_clashing_columns(spark):
    nothing = table(spark, []).withColumns({"signature": F.lit(1), "template": F.lit("t"), "tokens": F.lit("x")})
    found, members = cl.mine_clusters(table(spark, ["", "  "]), "line")
    assert found.count() == 0 and members.count() == 0
    matched = cl.match_clusters(table(spark, ["a b", ""]), members, "line")
    assert [r.template_id for r in matched.collect()] == [-1, -1]
    assert cl.match_clusters(nothing.drop("signature", "tokens"), members, "line").count() == 0


def test_many_leading_tokens_share_a_bucket(spark):
    lines = [f"{n} started at noon" for n in NAMES]
    assert len(templates(spark, lines, max_children=100)) == len(NAMES)
    assert templates(spark, lines, max_children=10) == [(1, "<*> started at noon", len(lines), 0)]
    assert templates(spark, lines, depth=3) == [(1, "<*> started at noon", len(lines), 0)]


# --- store and streams -------------------------------------------------------------------------


def stored(store, before=None):
    return [tuple(r) for r in store.templates(before).orderBy("template_id").collect()]


def test_versions_continue_ids_and_counts(spark):
    store = TemplateStore(spark, scratch_path(spark, "store"))
    assert store.latest() == -1 and stored(store) == []
    store.learn(table(spark, ["user a logged in", "user b logged in", "disk full"]), 1)
    store.learn(table(spark, ["user c logged in", "cpu hot now", "", "disk full"]), 2)
    store.learn(table(spark, []), 3)
    first = [(1, "user <*> logged in", 2, 0), (2, "disk full", 1, 2)]
    assert stored(store, 2) == first and store.latest() == 3
    both = [(1, "user <*> logged in", 3, 0), (2, "disk full", 2, 2), (3, "cpu hot now", 1, 1)]
    assert stored(store) == both
    store.learn(table(spark, ["something else entirely"]), 2)  # a version that is there stays as it is
    assert stored(store) == both


def test_whole_versions_equal_their_parts(spark, monkeypatch):
    monkeypatch.setattr(store_module, "WHOLE", 2)
    store = TemplateStore(spark, scratch_path(spark, "store"))
    for version in range(5):
        store.learn(table(spark, [f"{w} started again" for w in "abcde"[: version + 1]]), version)
    assert store._complete("whole") == [2, 4]
    for before in range(1, 6):
        # version v saw a, b, .. up to its own letter; a letter is new in the version of its place
        wanted = [(k + 1, f"{w} started again", before - k, k) for k, w in enumerate("abcde"[:before])]
        assert stored(store, before) == wanted


def in_batches(spark, batches):
    path = scratch_path(spark, "source")
    schema = "line_no bigint, ingest_ts timestamp_ntz, line string"
    at = 0
    for lines in batches:
        rows = spark.createDataFrame([(at + i, x) for i, x in enumerate(lines)], "line_no bigint, line string")
        rows = rows.selectExpr("line_no", "timestamp_ntz '2024-03-02 07:08:09' as ingest_ts", "line")
        rows.coalesce(1).write.mode("append").parquet(path)
        at += len(lines)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture(scope="module")
def fitted(spark):
    lines = [f'10.0.0.{i % 7} - - [02/Mar/2024:10:{i % 60:02d}:00 +0000] "GET /a/{i % 5} HTTP/1.1" 200 {i}' for i in range(300)]
    rows = table(spark, lines).selectExpr("line_no", "timestamp_ntz '2024-03-02 07:08:09' as ingest_ts", "line")
    return Detector(mining="similarity", n_trees=5, tree_samples=64).fit(rows)


NEW = ["kernel: disk sda failed hard", "kernel: disk sdb failed hard"]


def test_a_new_line_has_its_id_in_the_next_batch(spark, fitted):
    old = '10.0.0.1 - - [02/Mar/2024:12:00:00 +0000] "GET /a/1 HTTP/1.1" 200 7'
    store = TemplateStore(spark, scratch_path(spark, "store")).create(fitted.templates, fitted.members)
    path, state = scratch_path(spark, "records"), scratch_path(spark, "state")
    known = store.members(1).agg(F.max("template_id")).first()[0]
    source = in_batches(spark, [[old, NEW[0]], [old, NEW[1]], [NEW[0]]])
    jobs.stream_detect_learning(fitted, source, store, path, state).awaitTermination()
    ids = {r.line_no: r.template_id for r in spark.read.parquet(f"{path}/batch=*").select("line_no", "parsed_log.template_id").collect()}
    assert ids[0] == ids[2] and 1 <= ids[0] <= known
    assert ids[1] == -1 and ids[3] == ids[4] == known + 1
    # started again, the query finds nothing new and the store is as it was
    before = stored(store)
    jobs.stream_detect_learning(fitted, source, store, path, state).awaitTermination()
    assert stored(store) == before
    # a version that a failure left without its marker is written again with the same ids
    shutil.rmtree(f"{store.path}/version=1/counts")
    assert store.latest() == 3 and 1 not in store._complete("version")
    store.learn(table(spark, [old, NEW[0]]), 1)
    assert stored(store) == before


def test_two_streams_share_a_store(spark, fitted):
    store = TemplateStore(spark, scratch_path(spark, "store")).create(fitted.templates, fitted.members)
    path, state = scratch_path(spark, "records"), scratch_path(spark, "state")
    score = lambda: jobs.stream_detect_learning(fitted, source, store, path, state, learn=False).awaitTermination()
    source = in_batches(spark, [[NEW[0]]])
    score()
    jobs.learn_clusters(in_batches(spark, [NEW]), store, scratch_path(spark, "learner")).awaitTermination()
    # the first batch took the store as it was; a repeated one would take the same
    noted = spark.read.parquet(f"{path}/_versions/batch=0").first()[0]
    first = spark.read.parquet(f"{path}/batch=0").select("parsed_log.template_id").first()[0]
    assert (noted, first) == (1, -1)
    path, state = scratch_path(spark, "records"), scratch_path(spark, "state")
    score()
    assert spark.read.parquet(f"{path}/batch=0").select("parsed_log.template_id").first()[0] > 0


def test_detector_with_similarity_survives_storage(spark, fitted):
    path = scratch_path(spark, "model")
    fitted.save(path)
    again = DetectorModel.load(spark, path)
    lines = table(spark, NEW).selectExpr("line_no", "timestamp_ntz '2024-03-02 07:08:09' as ingest_ts", "line")
    one, two = (m.transform(lines).select("line_no", "score", "parsed_log.template_id").collect() for m in (fitted, again))
    assert sorted(one) == sorted(two) and {r.template_id for r in one} == {-1}
    with pytest.raises(ValueError):
        Detector(mining="guess")
    with pytest.raises(ValueError):
        jobs.stream_detect_learning(DetectorModel(dataclasses.replace(fitted.config, mining="buckets"), {}, *[None] * 4), lines, None, "", "")


def test_places_carry_no_text(spark, monkeypatch):
    """Rows of single places hold numbers; a line's text is neither sent nor stored once for each of them,
    nor beside its tokens."""
    lines = [(i, " ".join(f"{'abcdefg'[(i * j) % 7]}{'uvw'[j % 3]}" for j in range(60))) for i in range(1, 30)]
    found = spark.createDataFrame(lines, "line_no bigint, line string")
    stored, joined = [], []
    keep, join = cl.freeze, cl.lookup
    monkeypatch.setattr(cl, "freeze", lambda df, label="table": stored.append(df.columns) or keep(df, label))
    monkeypatch.setattr(cl, "lookup", lambda rows, *rest: joined.append(rows) or join(rows, *rest))
    _, members = cl.mine_clusters(found, "line")
    near = cl.nearest_clusters(cl.signatures(found, "line"), members)
    assert near.count() == 7
    assert not any({"signature", "tokens"} <= set(columns) for columns in stored)
    assert all(rows.count() <= 2 * 7 for rows in joined if "signature" in rows.columns)


def test_group_names_stay_short(spark, monkeypatch):
    """The name of a part does not grow with the rounds of cutting."""
    lines = [(i, " ".join(f"{chr(97 + (i >> (j % 9)) % 2)}{chr(97 + j % 26)}" for j in range(40))) for i in range(1, 60)]
    longest, cut = [], cl._cut

    def watched(rows, similarity):
        longest.append(rows.selectExpr("max(length(group))").first()[0])
        return cut(rows, similarity)

    monkeypatch.setattr(cl, "_cut", watched)
    cl.mine_clusters(spark.createDataFrame(lines, "line_no bigint, line string"), "line", similarity=0.9)
    assert len(longest) > 1 and max(longest) <= 32


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_places_are_counted_by_hash(spark):
    rows = spark.createDataFrame(
        [("g", "a b <*>"), ("g", "a c <*>"), ("g", "a d  <*>"), ("h", "x")], "group string, signature string"
    )
    found = cl._places(rows)
    assert "SortAggregate" not in physical(found)
    got = {(r.group, r.place): (r.kinds, r.wild) for r in found.collect()}
    assert got == {("g", 0): (1, False), ("g", 1): (3, False), ("g", 2): (1, True), ("h", 0): (1, False)}


def test_lines_and_clusters_are_compared_once_and_by_all_cores(spark, monkeypatch):
    """A pair's texts are split once, no list of a cluster's places is gathered, and ties go to the smallest id."""
    plans, inner = {}, cl.freeze
    monkeypatch.setattr(cl, "freeze", lambda df, label="table": plans.update({label: physical(df)}) or inner(df, label))
    held = [(f"4\x01{t[0]}", i, t) for i, t in enumerate(["a b c d", "a x c d", "a b c z", "b b c d"], 5)]
    members = spark.createDataFrame([(b, i, t, t.split(" ")) for b, i, t in held], cl.MEMBER_SCHEMA)
    lines = spark.createDataFrame([("a b c q",), ("a q c d",), ("a q q q",), ("b b  c d",)], "signature string")
    near = {r.signature: (r.template_id, r.template) for r in cl.nearest_clusters(lines, members).collect()}
    assert near == {"a b c q": (5, "a b c d"), "a q c d": (5, "a b c d"), "b b  c d": (8, "b b c d")}
    assert "collect_list" not in plans["index"] and "Window" in plans["index"]
    assert "SortAggregate" not in plans["best"] and plans["best"].count("split(signature") == 2  # for buckets, for pairs
    assert "REPARTITION_BY_NUM" in plans["best"]
