"""The pipeline stage by stage beside brute force, with hard rows and clashing columns."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tidewatch.llm import minhash
from test_native import personal
from test_search import alnum, groups, hits, windows
from test_tokens import LIBRARY, wanted


@pytest.fixture
def folder(spark, sf_dir, hard, tmp_path):
    """Documents of the small tables with the hard rows added, and the tables the stages read."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = hard.select((F.col("doc_id") + 10**6).alias("doc_id"), "text")
    rows = documents.unionByName(odd, allowMissingColumns=True)
    rows = rows.withColumns({"ids": F.lit(1), "spans": F.lit("s"), "score": F.lit(0.5), "c0": F.lit(2)})
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["toxicity", "minhash", "decontamination", "pii", "bpe"]
    kept = stages["toxicity"](spark, docs, folder).cache()
    assert kept.columns == docs.columns and kept.count() <= docs.count()

    one = stages["minhash"](spark, kept, folder).cache()
    assert one.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    want = {i for i, (_, g) in groups(rows, pipeline.NEAR_PERCENT).items() if i == g}
    got = collections.Counter(r.doc_id for r in one.collect())
    assert set(got) - {None} == want and all(n == 1 for i, n in got.items() if i is not None)
    assert got[None] == sum(i is None for i, _ in rows)

    clean = stages["decontamination"](spark, one, folder).cache()
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    phrases = windows(items)
    left = {r.doc_id: r for r in clean.collect() if r.doc_id is not None}
    for r in one.collect():
        if r.doc_id is None:
            continue
        n, hit, _ = hits(r.text, phrases)
        if not hit:
            assert left[r.doc_id].text == r.text
        elif len(hit) == n:
            assert r.doc_id not in left
        else:
            words = [w for i, w in enumerate(alnum(r.text)) if i not in hit]
            assert alnum(left[r.doc_id].text) == words

    masked = stages["pii"](spark, clean, folder).cache()
    assert masked.columns == docs.columns and masked.count() == clean.count()
    for r in masked.collect():
        assert r.n_chars == (None if r.text is None else len(r.text))
        before = left.get(r.doc_id)
        if before is not None and not personal(before.text):
            assert r.text == before.text
        elif before is not None:
            assert not any(before.text[s:e] in r.text for _, s, e in personal(before.text))

    coded = stages["bpe"](spark, masked, folder)
    assert coded.columns == [*docs.columns, "_ids", "decoded"]
    for r in coded.collect():
        assert r._ids == wanted(r.text)
        assert r.decoded == LIBRARY.decode(r._ids, skip_special_tokens=False)


def test_run_applies_all_stages(spark, folder, monkeypatch):
    seen = []

    def stage(name):
        return name, lambda s, docs, d: seen.append((name, docs.count())) or docs.filter("doc_id > 3")

    monkeypatch.setattr(pipeline, "STAGES", [stage("a"), stage("b")])
    rows = pipeline.run(spark, folder).count()
    assert [n for n, _ in seen] == ["a", "b"] and seen[1][1] == rows < seen[0][1]


def test_empty_documents(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_near_copies_from_four_fifths_go(spark, tmp_path):
    words = [f"w{i}" for i in range(200)]
    # one changed word at an end of the text is one shingle, inside it five
    changed = [w + "x" if i in (30, 70, 110, 150) else w for i, w in enumerate(words)]
    other = [w + "y" if i in (20, 50, 80, 110, 140, 170) else w for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(other))]
    # the links: 176 of 216 shingles, 0.81; 166 of 226, 0.73
    assert {i: g for i, (_, g) in groups(rows).items()} == {1: 1, 2: 2, 3: 3}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = pipeline.one_of_each(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
    for percent in (80, 85):
        bands, height = minhash.banding(percent)
        assert (1 - (percent / 100) ** height) ** bands <= 3e-7 and bands * height <= minhash.HASHES
