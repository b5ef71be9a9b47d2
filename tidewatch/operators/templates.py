"""Log template mining as a Spark job over distinct line signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import scalars as S
from tidewatch.operators.ordering import lookup, number_rows
from tidewatch.session import freeze

WILDCARD = "<*>"


def with_signature(df: DataFrame, line: str = "raw") -> DataFrame:
    """Add ``signature``: the masked line, null for a blank one."""
    text = F.col(line)
    return df.withColumn("signature", F.when(~S.is_blank(text), S.mask_line(S.strip(text))))


def signatures(df: DataFrame, line: str = "raw") -> DataFrame:
    """Distinct signatures with their row count and first line; copies collapse before the shuffle."""
    return (
        df.filter(~S.is_blank(F.col(line)))
        .groupBy(S.mask_line(S.strip(F.col(line))).alias("signature"))
        .agg(F.count("*").alias("n"), F.min("line_no").alias("first_line_no"))
    )


def template_signatures(df: DataFrame, line: str = "raw") -> DataFrame:
    """Signatures as templates, numbered from 1 by first appearance."""
    numbered = number_rows(signatures(df, line), ["first_line_no"], "_pos")
    return numbered.select(
        (F.col("_pos") + 1).alias("template_id"),
        F.col("signature").alias("template"),
        "n",
        "first_line_no",
    )


def _bucketed(found: DataFrame) -> DataFrame:
    """Add ``tokens``, ``lead`` (the first token, the wildcard if it holds a digit) and ``length``."""
    first = F.get("tokens", F.lit(0))
    return found.withColumn("tokens", F.split("signature", f"{S.SPACES}+")).withColumns(
        {
            "length": F.size("tokens"),
            "lead": F.when(first.rlike(r"\d"), F.lit(WILDCARD)).otherwise(first),
        }
    )


def _bucket(lead) -> Column:
    return F.concat_ws("\x01", F.col("length").cast("string"), lead)


def _shape(tokens: str, open_places: str) -> Column:
    return F.array_join(
        F.transform(
            tokens,
            lambda t, i: F.when(F.array_contains(F.col(open_places), i), F.lit(WILDCARD)).otherwise(t),
        ),
        " ",
    )


def _place_kinds(named: DataFrame) -> DataFrame:
    """How many tokens each place of a bucket holds, and whether the wildcard is one of them."""
    tokens = named.select("bucket", F.posexplode("tokens").alias("place", "token"))
    # a flag and not a text, so that the counts are hashed and not sorted
    return (
        tokens.groupBy("bucket", "place", "token")
        .agg(F.lit(1).alias("one"))
        .groupBy("bucket", "place")
        .agg(F.count("*").alias("kinds"), F.max(F.col("token") == WILDCARD).alias("wild"))
    )


def mine_templates(
    df: DataFrame,
    line: str = "raw",
    similarity: float = 0.5,
    depth: int = 4,
    max_children: int = 100,
) -> tuple[DataFrame, DataFrame]:
    """Templates of a log table: ``(templates, members)``.

    ``templates``: template_id, template, n, first_line_no. ``members``: bucket, open, whole,
    template_id, template, what ``match_templates`` needs.

    One rule holds for every bucket, whatever its size. Signatures share a bucket when they have the
    same number of tokens and, unless that length has more than ``max_children`` of them or ``depth``
    is under four, the same leading token (tokens with digits count as the wildcard). If a share of
    ``similarity`` of a bucket's places holds one token only, all its other places are wildcards and
    it is one template; else places with more than ``max_children`` tokens are wildcards. So a
    template depends on the tokens of its own bucket and not on how many lines hold them. Tokens are
    counted by aggregates with partial sums; no bucket is gathered in one task.
    """
    found = freeze(_bucketed(signatures(df, line)), "signatures")
    leads = found.groupBy("length", "lead").agg(F.lit(1).alias("one"))
    wide = leads.groupBy("length").agg(
        ((F.count("*") > max_children) | F.lit(depth < 4)).alias("wide")
    )
    named = lookup(found, wide, "length").withColumn(
        "bucket", _bucket(F.when(F.col("wide"), F.lit(WILDCARD)).otherwise(F.col("lead")))
    )
    named = freeze(named.select("signature", "tokens", "n", "first_line_no", "bucket"), "buckets")
    kinds = _place_kinds(named)
    fixed = F.count_if((F.col("kinds") == 1) & ~F.col("wild"))
    many = F.collect_list(F.when(F.col("kinds") > max_children, F.col("place")))
    varied = F.collect_list(F.when(F.col("kinds") > 1, F.col("place")))
    rules = kinds.groupBy("bucket").agg(
        (fixed >= similarity * F.count("*")).alias("whole"), many.alias("many"), varied.alias("varied")
    )
    rules = freeze(
        rules.select(
            "bucket",
            "whole",
            F.array_sort(F.when(F.col("whole"), F.col("varied")).otherwise(F.col("many"))).alias("open"),
        ),
        "rules",
    )
    shaped = freeze(
        lookup(named, rules, "bucket").select(
            "bucket", "open", "whole", "n", "first_line_no", _shape("tokens", "open").alias("template")
        ),
        "shapes",
    )
    totals = shaped.groupBy("template").agg(
        F.sum("n").alias("n"), F.min("first_line_no").alias("first_line_no")
    )
    templates = number_rows(totals, ["first_line_no", "template"], "_pos").select(
        (F.col("_pos") + 1).alias("template_id"), "template", "n", "first_line_no"
    )
    kept = shaped.select("bucket", "open", "whole", "template").distinct()
    members = lookup(kept, templates.select("template", "template_id"), "template")
    return templates, freeze(members.select("bucket", "open", "whole", "template_id", "template"), "members")


def match_templates(
    df: DataFrame, members: DataFrame, line: str = "raw", similarity: float = 0.5
) -> DataFrame:
    """Add ``template_id`` and ``template`` of the mined template a line belongs to.

    A line takes the places of its bucket that are wildcards and looks its shape up. In a bucket of
    one template, agreement in a share of ``similarity`` of its tokens is enough. Lines that
    match nothing and blank lines get -1 and ''.
    """
    buckets = members.groupBy("bucket").agg(
        F.min("open").alias("open"),
        F.max(F.when(F.col("whole"), F.col("template"))).alias("one"),
        F.max(F.when(F.col("whole"), F.col("template_id"))).alias("one_id"),
    ).withColumn("one_tokens", F.split("one", " "))
    signed = _bucketed(with_signature(df, line))
    own = lookup(
        signed.withColumns({"_own": _bucket(F.col("lead")), "_any": _bucket(F.lit(WILDCARD))}),
        buckets.toDF("_own", "_open1", "_one1", "_id1", "_tokens1"),
        "_own",
    )
    own = lookup(own, buckets.toDF("_any", "_open2", "_one2", "_id2", "_tokens2"), "_any")
    first = F.col("_open1").isNotNull()
    own = own.withColumns(
        {
            "_bucket": F.when(first, F.col("_own")).otherwise(F.col("_any")),
            "_open": F.coalesce("_open1", "_open2"),
            "_one": F.when(first, F.col("_one1")).otherwise(F.col("_one2")),
            "_id": F.when(first, F.col("_id1")).otherwise(F.col("_id2")),
            "_tokens": F.when(first, F.col("_tokens1")).otherwise(F.col("_tokens2")),
        }
    ).withColumn("_shape", _shape("tokens", "_open"))
    exact = members.filter(~F.col("whole")).select(
        F.col("bucket").alias("_bucket"),
        F.col("template").alias("_shape"),
        F.col("template_id").alias("_exact_id"),
    )
    own = lookup(own, exact, ["_bucket", "_shape"])
    agreeing = F.size(
        F.filter(
            F.zip_with("tokens", "_tokens", lambda a, b: (a == b) & (a != WILDCARD)), lambda x: x
        )
    )
    near = F.col("_one").isNotNull() & (agreeing >= similarity * F.col("length"))
    return own.select(
        *df.columns,
        F.coalesce(F.when(near, F.col("_id")), "_exact_id", F.lit(-1)).cast("bigint").alias("template_id"),
        F.coalesce(
            F.when(near, F.col("_one")), F.when(F.col("_exact_id").isNotNull(), F.col("_shape")), F.lit("")
        ).alias("template"),
    )


def assign_templates(df: DataFrame, members: DataFrame, line: str = "raw") -> DataFrame:
    """Add the entry of a dictionary of whole signatures; unseen and blank lines get -1 and ''."""
    signed = with_signature(df, line)
    named = lookup(signed, members.select("signature", "template_id", "template"), "signature")
    return named.select(
        *df.columns,
        F.coalesce("template_id", F.lit(-1)).cast("bigint").alias("template_id"),
        F.coalesce("template", F.lit("")).alias("template"),
    )


def unseen_templates(df: DataFrame, members: DataFrame, line: str = "raw") -> DataFrame:
    """Signatures of ``df`` that the dictionary does not hold, with their row count."""
    return signatures(df, line).join(members.select("signature"), "signature", "left_anti")
