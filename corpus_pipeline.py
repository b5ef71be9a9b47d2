"""Text corpus pipeline over ``documents``.

Stages: toxic documents go; one document of each group of near copies stays; benchmark text is cut
out; personal data are masked; texts are encoded. Each stage is written as Parquet to the shared
folder and read again, so a lost executor costs one stage's tasks at most. ``doc_id`` and ``text``
are used by name; all other columns, whatever their names, pass through, and ``n_chars`` follows
the text where a stage changes it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, decontaminate, minhash, pii, toxicity
from tidewatch.llm.common import Stash, fresh, table
from tidewatch.llm.queries import VOCABULARY

# Ids that a stage may broadcast; beyond it the join is shuffled.
BROADCAST_IDS = 500_000
# Jaccard similarity, in percent, from which the pipeline takes documents for near copies.
NEAR_PERCENT = 80


def hidden(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with neutral names for all columns but doc_id and text, so that none can clash."""
    names = docs.columns
    short = [c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(names)]
    return docs.toDF(*short), names


def shown(df: DataFrame, names: list[str]) -> DataFrame:
    """Back to the columns of the stage's input; n_chars is the length of the text."""
    df = df.toDF(*names)
    if "n_chars" not in names:
        return df
    kind = df.schema["n_chars"].dataType
    return df.withColumn("n_chars", F.length("text").cast(kind))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the cut-off, null and empty ones too."""
    network = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    name = fresh(docs, "score")
    scored = toxicity.score(docs, network, name=name)
    return scored.filter(F.col(name) < toxicity.CUTOFF).select(*[f"`{c}`" for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of every group of near copies; repeated rows of it stay once.

    Rows without doc_id stay. Rows that share a doc_id but not the text stay if one of them does.
    """
    stash = Stash(spark, "pipeline")
    verdict = stash.keep(minhash.cluster(docs, percent=NEAR_PERCENT), "verdict").filter("doc_id is not null")
    ids = verdict.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    ids = stash.keep(ids.filter("not kept or rows > 1").withColumnRenamed("doc_id", "_of"), "ids")
    gone, repeated = ids.filter("not kept").select("_of"), ids.filter("kept").select("_of")
    match = F.col("doc_id") == F.col("_of")

    def small(side: DataFrame) -> DataFrame:
        return F.broadcast(side) if side.count() <= BROADCAST_IDS else side

    docs, names = hidden(docs)
    kept = docs.join(small(gone), match, "left_anti")
    if not repeated.isEmpty():
        again = small(repeated)
        once = kept.join(again, match, "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(again, match, "left_anti").unionByName(once)
    return kept.toDF(*names)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut out; documents that were nothing else go."""
    docs, names = hidden(docs)
    return shown(decontaminate.clean(docs, table(spark, sf_dir, "benchmark")), names)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that give them away replaced by the name of their kind."""
    docs, names = hidden(docs)
    found = pii.attach(docs, pii.find(docs), "doc_id", "text", "spans")
    text = pii.redact(F.col("text"), F.col("spans"))
    return shown(found.withColumn("text", text).drop("spans"), names)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the text that they spell, beside the columns of the documents."""
    path = public_tokenizers.path(VOCABULARY)
    ids, decoded = fresh(docs, "ids"), fresh(docs, "decoded")
    return bpe.encode(docs, path, ids=ids, decoded=decoded)


STAGES = [
    ("toxicity", not_toxic),
    ("minhash", one_of_each),
    ("decontamination", without_benchmark),
    ("pii", masked),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    stash, docs, last = Stash(spark, "corpus"), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stash.keep(stage(spark, docs, sf_dir), name)
        if last is not None:
            stash.drop(last)
        last = docs
    return docs


# Networks, signatures and automata have no SQL form; tests hold the result against brute force.
ORACLE_SQL = None
