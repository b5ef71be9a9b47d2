"""Registered queries of the text operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import bpe, dac, decontaminate, joins, licenses, minhash, pii, quality, ranking, repeats, toxicity, trie, urls
from tidewatch.llm.common import table
from tidewatch.llm.oracle import oracle  # noqa: F401
from tidewatch.session import scratch_path

QUERIES: dict[str, Callable] = {}
VOCABULARY = "word_bpe_49k.json"


def query(fn: Callable) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query
def op1_disclosure(spark, sf_dir):
    rows = documents(spark, sf_dir)
    found = pii.attach(rows, pii.find(rows), "doc_id", "text").drop("text")

    def joined(keep) -> F.Column:
        own = F.filter("spans", keep)
        return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(joined(lambda s: s["kind"] != "term"), 256).alias("base_sha256"),
        joined(lambda s: F.lit(True)).alias("spans"),
    )


@query
def op2_dac(spark, sf_dir):
    path = scratch_path(spark, "dac")
    dac.write(documents(spark, sf_dir), path, public_tokenizers.path(VOCABULARY))
    return dac.digests(spark, path)


@query
def op3_url_trees(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.fit(pages)).drop("url")


@query
def op4_bpe(spark, sf_dir):
    path = public_tokenizers.path(VOCABULARY)
    coded = bpe.encode(documents(spark, sf_dir), path, decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op5_host_rules(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality.judge(rows).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.round("host_rate", 9).alias("host_rate"),
    )


@query
def op6_fm_index(spark, sf_dir):
    found = decontaminate.find(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    width = F.aggregate(
        "spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"].cast("bigint") - s["start"]
    )
    return found.select(
        "doc_id",
        "n_words",
        width.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


@query
def op7_minhash(spark, sf_dir):
    return minhash.cluster(documents(spark, sf_dir))


@query
def op8_run_index(spark, sf_dir):
    found = repeats.remove(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op9_toxicity(spark, sf_dir):
    rows = documents(spark, sf_dir)
    network = toxicity.fit(rows, table(spark, sf_dir, "labels"))
    return toxicity.score(rows, network).select(
        "doc_id",
        F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.CUTOFF).cast("int").alias("predicted"),
    )


@query
def op10_licenses(spark, sf_dir):
    return licenses.scan(documents(spark, sf_dir)).drop("text", "matches")


@query
def op11_forward_trie(spark, sf_dir):
    turns, conversations = trie.rebuilt(table(spark, sf_dir, "conversations"))
    return trie.trie(turns, conversations)


@query
def op12_mask_ranking(spark, sf_dir):
    return ranking.search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query
def op13_group_join(spark, sf_dir):
    return joins.join(documents(spark, sf_dir))
