"""Templates, models, persistence, streams and text files."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import reconstruction
from tidewatch.operators import templates as tp
from tidewatch.operators.iforest import Forest, IsolationForestModel, average_path, fit_iforest, grow_trees, tree_samples
from tidewatch.operators.ip_stats import ip_statistics
from tidewatch.operators.ordering import number_rows
from tidewatch.operators.parse import parse_logs
from tidewatch.operators.reconstruction import Adam, Network, ReconstructionModel, fit_reconstruction
from tidewatch.operators.scaling import fit_scaler, scale
from tidewatch.plans.detector import Detector, DetectorConfig, DetectorModel
from tidewatch.session import scratch_path
from tidewatch.sources.access_logs import access_logs
from tidewatch.sources.text import scan_lines, stream_lines, write_lines
from tidewatch.streaming import jobs
from tidewatch.streaming.ip_stats import stream_ip_statistics


# --- templates ---------------------------------------------------------------------------------


def lines_table(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "line_no bigint, line string")


def test_templates_merge_similar_signatures(spark):
    lines = ["user alice logged in", "user bob logged in", "disk full", "", "user carol logged in", "disk 7 full"]
    templates, members = tp.mine_templates(lines_table(spark, lines), "line")
    found = [tuple(r) for r in templates.orderBy("template_id").collect()]
    assert found == [(1, "user <*> logged in", 3, 0), (2, "disk full", 1, 2), (3, "disk <*> full", 1, 5)]
    assigned = tp.match_templates(lines_table(spark, [*lines, "user dave logged in"]), members, "line")
    ids = [r["template_id"] for r in assigned.orderBy("line_no").collect()]
    assert ids == [1, 1, 2, -1, 1, 3, 1]
    other = tp.match_templates(lines_table(spark, ["user dave was here once", "user dave ran away", "disk"]), members, "line")
    assert [r["template_id"] for r in other.orderBy("line_no").collect()] == [-1, -1, -1]
    known = tp.template_signatures(lines_table(spark, lines), "line").withColumnRenamed("template", "signature")
    unseen = tp.unseen_templates(lines_table(spark, ["brand new text", "disk full"]), known, "line")
    assert [r["signature"] for r in unseen.collect()] == ["brand new text"]


def test_templates_do_not_depend_on_other_buckets_or_more_lines(spark):
    lines = ["get a from x ok", "get b from y ok", "put a from x ok"]
    more = [*lines, "get a from y ok", "get b from x ok", "stop", "del a", "del b", "get a from x", "zzz a b c d e f"]
    one = {r["template"] for r in tp.mine_templates(lines_table(spark, lines), "line")[0].collect()}
    many = {r["template"] for r in tp.mine_templates(lines_table(spark, more), "line")[0].collect()}
    assert one == {"get <*> from <*> ok", "put a from x ok"} and one <= many


def test_varied_places_are_wildcards_in_a_bucket_of_many_templates(spark):
    names = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(300)]
    lines = [f"get {a} from {names[i % 4]} ok" for i, a in enumerate(names)]
    templates, members = tp.mine_templates(lines_table(spark, lines), "line", similarity=0.9)
    found = {r["template"]: r["n"] for r in templates.collect()}
    assert sum(found.values()) == 300
    assert set(found) == {f"get <*> from {n} ok" for n in names[:4]}
    ids = {r["template"]: r["template_id"] for r in templates.collect()}
    new = lines_table(spark, ["get zzz from aa ok", "get zzz from zz ok"])
    matched = [r["template_id"] for r in tp.match_templates(new, members, "line", 0.9).orderBy("line_no").collect()]
    assert matched == [ids["get <*> from aa ok"], -1]


def test_children_beyond_the_limit_share_a_bucket(spark):
    lines = [f"{chr(97 + i)} same rest here" for i in range(8)]
    templates, _ = tp.mine_templates(lines_table(spark, lines), "line", max_children=4)
    found = {r["template"]: r["n"] for r in templates.collect()}
    assert found == {"<*> same rest here": 8}


def test_templates_do_not_depend_on_partitions(spark, sf_dir):
    logs = access_logs(spark, sf_dir)
    one = tp.mine_templates(logs.coalesce(1), "line")[0].orderBy("template_id").collect()
    many = tp.mine_templates(logs.repartition(7), "line")[0].orderBy("template_id").collect()
    assert one == many and one


# --- isolation forest --------------------------------------------------------------------------


def cloud(spark, n=3000, outliers=15):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 3))
    x[:outliers] += 12
    frame = pd.DataFrame(x, columns=["a", "b", "c"]).assign(line_no=np.arange(n))
    return spark.createDataFrame(frame)


def test_average_path():
    assert average_path([0, 1, 2]).tolist() == [0.0, 0.0, 1.0]
    assert average_path(256) == pytest.approx(10.2448, abs=1e-3)


@pytest.mark.parametrize("size", [2, 10, 20])
def test_small_samples_are_full(spark, size):
    df = cloud(spark, 5000)
    counts = tree_samples(df, ["a"], 200, size, 42, 5000).groupBy("tree_id").count().collect()
    assert len(counts) == 200 and {r["count"] for r in counts} == {size}


def test_samples_are_exact_and_distinct(spark):
    df = cloud(spark)
    picked = tree_samples(df, ["a", "b", "c"], 20, 100, 42, 3000).groupBy("tree_id").agg(
        F.count("*").alias("n"), F.count_distinct("line_no").alias("d")
    )
    assert {tuple(r) for r in picked.collect()} == {(t, 100, 100) for t in range(20)}
    few = tree_samples(df.limit(40), ["a", "b", "c"], 3, 100, 42, 40).groupBy("tree_id").count()
    assert {tuple(r) for r in few.collect()} == {(t, 40) for t in range(3)}


def test_forest_score_equals_a_walk_per_row(spark):
    names = ["a", "b", "c"]
    nodes = grow_trees(cloud(spark), names, 3000, 10, 64).toPandas()
    x = cloud(spark).limit(50).toPandas()[names].to_numpy(dtype=np.float32)
    lookup = {(r.tree_id, r.node_id): r for r in nodes.itertuples()}
    expected = []
    for row in x:
        depths = []
        for tree in range(10):
            node = lookup[tree, 0]
            while node.feature >= 0:
                node = lookup[tree, node.left if row[node.feature] <= np.float32(node.threshold) else node.right]
            depths.append(node.depth + float(average_path(node.size)))
        expected.append(2 ** (-np.mean(depths) / float(average_path(64))))
    assert Forest(nodes, 64).score(x, block=7) == pytest.approx(expected)


def test_forest_finds_planted_outliers(spark):
    df = cloud(spark)
    model = fit_iforest(df, ["a", "b", "c"], n_trees=50, max_samples=256)
    out = model.transform(df).toPandas()
    assert out["score"].between(0, 1, inclusive="right").all()
    assert out["anomaly"].sum() == 150  # strict cut above the 95th percentile
    assert set(out.nlargest(15, "score")["line_no"]) == set(range(15))


def test_forest_does_not_depend_on_partitions(spark):
    a = fit_iforest(cloud(spark).coalesce(1), ["a", "b"], 20, 100)
    b = fit_iforest(cloud(spark).repartition(9), ["a", "b"], 20, 100)
    assert a.cutoff == b.cutoff
    assert a.trees.exceptAll(b.trees).isEmpty()


def test_unfitted_models_refuse(spark):
    with pytest.raises(ValueError):
        IsolationForestModel(None, ["a"], 10).flag(F.lit(1.0))
    with pytest.raises(ValueError):
        ReconstructionModel(["a"]).score()
    with pytest.raises(ValueError):
        ReconstructionModel(["zz"], components=np.eye(1)).transform(cloud(spark))
    with pytest.raises(ValueError):
        DetectorConfig(model="ensemble")


# --- reconstruction ----------------------------------------------------------------------------


def test_gradients_match_differences():
    net = Network(5, (6, 4), 2, seed=1)
    net.dropout = 0.0
    rng = np.random.default_rng(2)
    x = rng.normal(size=(16, 5))
    _, grads = net.gradients(x, rng)
    for name in ("w0", "b2", "g1", "s0", "w4", "w2"):
        at = tuple(0 for _ in net.p[name].shape)
        keep, step, losses = net.p[name][at], 1e-6, []
        for move in (step, -step):
            net.p[name][at] = keep + move
            losses.append(net.gradients(x, rng)[0])
        net.p[name][at] = keep
        assert grads[name][at] == pytest.approx((losses[0] - losses[1]) / (2 * step), rel=1e-3, abs=1e-7)


def test_training_steps_write_over_arrays_made_once():
    """Two mini-batches of one size share their arrays, and steps equal the formulas bit by bit."""
    net, rng = Network(5, (6, 4), 2, seed=1), np.random.default_rng(2)
    x = [rng.normal(size=(16, 5)) for _ in range(2)]
    plain, dice = Network(5, (6, 4), 2, seed=1), np.random.default_rng(9)
    h = x[0]
    for i in range(plain.depth):
        z = h @ plain.p[f"w{i}"] + plain.p[f"b{i}"]
        if i in plain.plain:
            h = z
            continue
        a = np.maximum(z, 0)
        norm = (a - a.mean(axis=0)) * (1.0 / np.sqrt(a.var(axis=0) + plain.epsilon))
        h = (norm * plain.p[f"g{i}"] + plain.p[f"s{i}"]) * ((dice.random(a.shape) >= plain.dropout) / (1.0 - plain.dropout))
    loss, grads = net.gradients(x[0], np.random.default_rng(9))
    assert loss == float(((h - x[0]) ** 2).mean())
    rooms = [a for room in net._room(16) for a in room.values()]
    net.gradients(x[1], rng)
    assert all(a is b for a, b in zip(rooms, [a for room in net._room(16) for a in room.values()]))
    adam, before = Adam(), {k: v.copy() for k, v in net.p.items()}
    m = v = {k: np.zeros_like(a) for k, a in before.items()}
    for step in (1, 2):
        adam.update(net.p, grads)
        m = {k: 0.9 * m[k] + (1 - 0.9) * g for k, g in grads.items()}
        v = {k: 0.999 * v[k] + (1 - 0.999) * g * g for k, g in grads.items()}
        before = {k: before[k] - 0.001 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) for k in before}
    assert all(np.array_equal(net.p[k], before[k]) for k in before)
    assert all(np.array_equal(adam.first[k], m[k]) and np.array_equal(adam.second[k], v[k]) for k in before)

def test_default_network_size():
    net = Network(19)
    assert net.sizes == [19, 64, 32, 16, 8, 4, 8, 16, 32, 64, 19]
    assert sum(a.size for k, a in net.p.items() if k[0] in "wb") == 8135
    assert sum(a.size for k, a in net.p.items() if k[0] in "gs") == 480


def correlated(spark, n=2000):
    rng = np.random.default_rng(4)
    z = rng.normal(size=(n, 2))
    x = z @ rng.normal(size=(2, 6)) + 0.01 * rng.normal(size=(n, 6))
    x[:5] += rng.normal(size=(5, 6)) * 8
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    names = [f"f{i}" for i in range(6)]
    return spark.createDataFrame(pd.DataFrame(x, columns=names).assign(line_no=np.arange(n))), names, x


def test_pca_error_equals_numpy(spark):
    df, names, x = correlated(spark)
    model = fit_reconstruction(df, names, "pca", latent=2)
    found = model.transform(df).orderBy("line_no").toPandas()
    _, _, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    expected = ((x - x @ v[:2].T @ v[:2]) ** 2).mean(axis=1)
    assert found["score"].to_numpy() == pytest.approx(expected, abs=1e-9)
    assert found["anomaly"].sum() == 100
    assert set(found.nlargest(5, "score")["line_no"]) == set(range(5))


@pytest.mark.parametrize("kind", ["pca", "mlp"])
def test_reconstruction_model_survives_storage(spark, kind):
    df, names = cloud(spark, 300), ["a", "b", "c"]
    model = fit_reconstruction(df, names, kind, latent=2, hidden=(8, 4), epochs=2, batch_size=32)
    path = scratch_path(spark, "reconstruction")
    model.save(spark, path)
    again = ReconstructionModel.load(spark, path)
    one, two = (sorted(map(tuple, m.transform(df).collect())) for m in (model, again))
    assert one == two and again.layers() == model.layers() and again.threshold == model.threshold


def test_mlp_does_not_depend_on_partitions(spark):
    df, names = cloud(spark, 800), ["a", "b", "c"]
    one, seven = (
        fit_reconstruction(df.repartition(n), names, "mlp", latent=2, hidden=(8, 4), epochs=2, batch_size=32)
        for n in (1, 7)
    )
    assert np.array_equal(one.network.vector(), seven.network.vector())


def test_many_shards_are_summed_by_a_tree(spark, monkeypatch):
    df, names = cloud(spark, 3000), ["a", "b", "c"]
    train = lambda n: reconstruction.fit_mlp(
        df.repartition(n), names, latent=2, hidden=(8, 4), epochs=2, batch_size=16, shards=40
    )
    flat = train(1)[0].vector()  # up to BRANCH results are summed by the driver alone
    monkeypatch.setattr(reconstruction, "BRANCH", 4)
    one, seven = train(1), train(7)
    assert np.array_equal(one[0].vector(), seven[0].vector()) and one[1] == seven[1]
    assert one[0].vector() == pytest.approx(flat, rel=1e-9, abs=1e-12)


def test_shards_follow_from_the_rows(spark, monkeypatch):
    df, names = cloud(spark, 900), ["a", "b", "c"]
    monkeypatch.setattr(reconstruction, "SHARD_ROWS", 60)
    options = dict(latent=2, hidden=(8, 4), epochs=1, batch_size=16)
    fifteen = reconstruction.fit_mlp(df, names, **options)[0].vector()
    assert np.array_equal(fifteen, reconstruction.fit_mlp(df, names, shards=15, **options)[0].vector())
    monkeypatch.setattr(reconstruction, "SHARDS", (8, 10))
    ten = reconstruction.fit_mlp(df, names, **options)[0].vector()
    assert np.array_equal(ten, reconstruction.fit_mlp(df, names, shards=10, **options)[0].vector())


def test_mlp_learns(spark):
    df, names, _ = correlated(spark)
    model = fit_reconstruction(df.repartition(2), names, "mlp", latent=2, hidden=(16, 8), epochs=8, batch_size=64, rate=0.01)
    assert model.losses[-1] < 0.7 * model.losses[0]
    found = model.transform(df).toPandas()
    assert found["anomaly"].sum() == 100
    assert len(set(found.nlargest(5, "score")["line_no"]) & set(range(5))) >= 3


# --- scaling -----------------------------------------------------------------------------------


def test_scaler(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 5.0), (3, 4.0, 5.0)], "line_no bigint, a double, b double")
    scaler = fit_scaler(df, ["a", "b"])
    found = {r["feature"]: (r["mean"], r["scale"]) for r in scaler.collect()}
    assert found["a"] == pytest.approx((7 / 3, 1.247219))
    assert found["b"] == (5.0, 1.0)
    rows = scale(df, scaler, ["a", "b"]).orderBy("line_no").collect()
    assert [r["b"] for r in rows] == [0.0, 0.0, 0.0]
    assert [r["a"] for r in rows] == pytest.approx([-1.06904, -0.26726, 1.33630], abs=1e-4)
    assert scale(df, None, ["a"]) is df


# --- detector ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def fitted(spark, sf_dir):
    return Detector(n_trees=30, tree_samples=128).fit(access_logs(spark, sf_dir))


def result(df):
    return df.select(
        "line_no", "anomaly", F.round("score", 9).alias("score"), "model", "reason", F.to_json("parsed_log").alias("log")
    )


def test_detector_records(spark, sf_dir, fitted):
    out = fitted.transform(access_logs(spark, sf_dir)).cache()
    assert out.count() == 1000
    assert fitted.training_stats().first().asDict() == {
        "total_logs": 1000,
        "parsed_logs": 990,
        "feature_rows": 990,
        "feature_columns": 19,
        "model_type": "isolation_forest",
        "status": "trained",
    }
    assert out.filter("not anomaly and reason <> 'Normal behavior detected'").isEmpty()
    assert out.filter("anomaly and reason = 'Normal behavior detected'").isEmpty()
    first = out.filter("line_no = 0").select("parsed_log.*").first()
    written = access_logs(spark, sf_dir).filter("line_no = 0").select(F.date_format("ingest_ts", "yyyy-MM-dd HH:mm:ss"))
    assert first["timestamp"] == written.first()[0] + "+00:00"
    assert first["template_id"] == 1


def test_model_survives_storage(spark, sf_dir, fitted):
    path = scratch_path(spark, "saved")
    fitted.save(path)
    again = DetectorModel.load(spark, path)
    logs = access_logs(spark, sf_dir)
    assert result(again.transform(logs)).exceptAll(result(fitted.transform(logs))).isEmpty()
    with pytest.raises(FileNotFoundError):
        DetectorModel.load(spark, path + "-nowhere")


@pytest.mark.parametrize("kind", ["pca", "autoencoder"])
def test_reconstruction_detector_survives_storage(spark, sf_dir, kind):
    logs = access_logs(spark, sf_dir)
    model = Detector(model=kind, epochs=2).fit(logs)
    path = scratch_path(spark, "saved")
    model.save(path)
    again = DetectorModel.load(spark, path)
    assert result(again.transform(logs)).exceptAll(result(model.transform(logs))).isEmpty()


def test_training_cap_and_guard(spark, sf_dir):
    logs = access_logs(spark, sf_dir)
    model = Detector(n_trees=5, tree_samples=32, max_samples=200).fit(logs)
    assert model.training_stats().first()["total_logs"] == 200
    with pytest.raises(ValueError):
        Detector(min_samples=1001).fit(logs)


# --- streams -----------------------------------------------------------------------------------


def in_batches(spark, df, order, files):
    """Stream of ``df`` in the given order, one micro-batch per file; files are written one by one."""
    path, total = scratch_path(spark, "stream-source"), df.count()
    numbered = number_rows(df, order, "_pos")
    for i in range(files):
        part = numbered.filter(F.floor(F.col("_pos") * files / total) == i).select(*df.columns)
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_statistics_equal_batch(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id as line_no",
        "concat('ip', user_id % 2) as ip",
        "1704067200000000 + cast(floor(event_id * 0.6) as bigint) * 1000000 as event_us",
        "concat('/', event_type, '/', event_id % 37) as path",
    )
    stream = in_batches(spark, events, ["event_us", "line_no"], 3)
    found = jobs.run_available(stream_ip_statistics(stream, max_requests=100), "statistics")
    wanted = ip_statistics(events, max_requests=100).select(*found.columns)
    near = F.round("ip_request_rate", 9)
    assert found.withColumn("ip_request_rate", near).exceptAll(wanted.withColumn("ip_request_rate", near)).isEmpty()
    assert found.count() == wanted.count()


def test_stream_detect_equals_batch(spark, sf_dir, fitted):
    logs = access_logs(spark, sf_dir)
    # event order, as the -0500 lines are ahead of their neighbours
    timed = parse_logs(logs).select("line_no", "ingest_ts", "line", "event_us")
    stream = in_batches(spark, timed, ["event_us", "line_no"], 3).drop("event_us")
    found = jobs.run_available(jobs.stream_detect(fitted, stream), "detect")
    assert found.count() == 1000
    assert result(found).exceptAll(result(fitted.transform(logs))).isEmpty()


def test_stream_templates_continue_their_ids(spark):
    lines = lines_table(spark, ["a one", "b two", "a one", "c three", "b two", "d four"])
    stream = in_batches(spark, lines, ["line_no"], 3)
    path, state = scratch_path(spark, "learned"), scratch_path(spark, "state")
    assert jobs.known_templates(spark, path).count() == 0
    jobs.learn_templates(stream, path, state).awaitTermination()
    found = [(r["template_id"], r["signature"]) for r in jobs.known_templates(spark, path).orderBy("template_id").collect()]
    assert found == [(1, "a one"), (2, "b two"), (3, "c three"), (4, "d four")]


def test_stream_counters_run_on(spark):
    flags = spark.range(30).selectExpr("id", "id % 5 = 0 as anomaly")
    stats = jobs.stream_stats(in_batches(spark, flags, ["id"], 3))
    assert tuple(jobs.run_available(stats, "counters", "complete").first()) == (30, 6, 0.2)


# --- text --------------------------------------------------------------------------------------


def test_scan(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"  first \r\n\n \t\nsec\xffond\n\xc2\xa0third\xe2\x80\x83\n")
    (tmp_path / "b.log").write_bytes(b"fourth\rfifth")
    found = scan_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [tuple(r) for r in found] == list(enumerate(["first", "second", "third", "fourth", "fifth"]))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        scan_lines(spark, str(tmp_path / "nowhere"))


def test_scan_numbers_across_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(3000)]
    for part in range(3):
        (tmp_path / f"{part}.log").write_text("\n".join(lines[part * 1000 : part * 1000 + 1000]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 5000)
    try:
        found = scan_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [tuple(r) for r in found] == list(enumerate(x.strip() for x in lines))


def test_write_by_split(spark):
    path = scratch_path(spark, "text")
    df = spark.createDataFrame([("train", "a"), ("validation", "b"), ("train", "c")], "split string, line string")
    write_lines(df, path, by="split")
    assert {tuple(r) for r in spark.read.text(path).select("split", "value").collect()} == {
        ("train", "a"),
        ("train", "c"),
        ("validation", "b"),
    }


def test_stream_of_text_files(spark, tmp_path):
    (tmp_path / "a.log").write_text(" one \n\ntwo\n")
    (tmp_path / "b.log").write_text("three")
    found = jobs.run_available(stream_lines(spark, str(tmp_path), 1), "text")
    assert sorted(r["line"] for r in found.collect()) == ["one", "three", "two"]


def test_training_rows_are_dealt_once(spark, monkeypatch):
    """Epochs shuffle no rows: they are dealt to tasks before the first one, and released at the end."""
    from pyspark.sql.classic.dataframe import DataFrame as Rows

    from tidewatch.operators import reconstruction

    dealt, inner = [], Rows.repartition
    monkeypatch.setattr(Rows, "repartition", lambda self, *by: dealt.append(by) or inner(self, *by))
    features = spark.range(400).selectExpr("id as line_no", "sin(id) as a", "cos(id) as b")
    _, losses = reconstruction.fit_mlp(features, ["a", "b"], (4,), 2, epochs=3, shards=4)
    assert len(losses) == 3 and len(dealt) == 1
    assert not spark._jsc.sc().getPersistentRDDs().size()
