"""What the text operators hold at once."""

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from tidewatch.llm import common, decontaminate, toxicity

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


def test_search_and_cut_are_one_pass(spark, hard):
    items = spark.createDataFrame([("1", ITEM), ("2", "one two")], "item_id string, text string")
    docs = hard.select("doc_id", "text").unionByName(
        spark.createDataFrame([(20, f"before {ITEM} after"), (21, ITEM), (22, "x one two y")], "doc_id bigint, text string")
    )
    once = decontaminate.clean(docs, items)
    # each Python operator of a stage has a worker process of its own
    assert once._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "", r.text is None)
    rows = sorted(once.collect(), key=key)
    assert rows == sorted(decontaminate.clean(docs, items, block_words=5).collect(), key=key)
    left = {r.doc_id: r.text for r in rows}
    assert 21 not in left and 6 not in left and left[20] == "before  after" and left[22] == "x  y"
    assert once.columns == docs.columns


def test_slices_are_cut_without_the_values(monkeypatch):
    monkeypatch.setattr(common, "SLICE_BYTES", 6)
    monkeypatch.setattr(common, "utf8", None)
    for kind in (pa.string(), pa.large_string(), pa.binary()):
        batch = pa.RecordBatch.from_arrays([pa.array(["abc", None, "äöü", "", "a" * 9, "b"]).cast(kind)], names=["t"])
        assert [len(x) for x in common.sliced(iter([batch, batch.slice(0, 0)]), "t")] == [2, 2, 1, 1]


def test_batches_and_slices_of_long_rows_are_bounded(spark):
    rows = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abcd "), 1000).alias("text"))

    def make():
        return lambda texts: [[sum(map(len, texts))] * len(texts)]

    mapped = common.map_text(rows, "text", [StructField("held", LongType())], make)
    assert mapped.agg(F.max("held")).first()[0] <= 1 << 20

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    found = [r.n for r in rows.mapInArrow(sizes, "n bigint").collect()]
    assert sum(found) > 15_000_000 and max(found) < 9_000_000


def test_scorer_keeps_words_in_parts(monkeypatch):
    texts = [" ".join(f"w{i * k % 251}" for i in range(90)).encode() for k in range(1, 40)] + [b"", b"x"]
    network = toxicity.Network([b"w1", b"w7"])
    whole = toxicity.Scorer(network).score(texts)
    monkeypatch.setattr(toxicity, "_PART", 5)
    vectors, most = toxicity.Network.vectors, []
    monkeypatch.setattr(toxicity.Network, "vectors", lambda n, words: most.append(len(words)) or vectors(n, words))
    assert toxicity.Scorer(network).score(texts) == whole and max(most) <= 5
    monkeypatch.setattr(toxicity, "_CACHE", 100)
    scorer = toxicity.Scorer(network)
    found = [x for t in texts for x in scorer.score([t])]
    assert max(abs(a - b) for a, b in zip(found, whole)) < 1e-6 and len(scorer.rows) < 251 + 5
