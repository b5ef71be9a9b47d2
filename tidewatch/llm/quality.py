"""Quality rules of documents and of their hosts, in built-in functions only.

Every document is measured on its own. The documents a host lost to a rule are counted by host, the
rates are shrunk towards an empirical beta prior fitted to all hosts by moments, and the host's
verdict is joined back: a host with few rows keeps close to the prior, one with many to its rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Stash, let

# Fixed values of the base rules.
LEAST_WORDS = 20
WINDOW = 8
REPEATED_PERCENT = 30
SYMBOLS = "#*$%&|<>"

SPACE = r"[ \t-\r]+"


def _covered(windows: Column) -> Column:
    """Words inside windows found twice or more: hash and place sorted, neighbours compared."""

    def places(sorted_: Column) -> Column:
        same = F.filter(
            F.transform(
                sorted_,
                lambda p, k: F.when(
                    (F.get(sorted_, k + 1)["h"] == p["h"]) | ((k > 0) & (F.get(sorted_, k - 1)["h"] == p["h"])),
                    p["i"],
                ),
            ),
            lambda i: i.isNotNull(),
        )
        return F.array_sort(same)

    hashed = F.array_sort(
        F.transform(windows, lambda w, i: F.struct(F.xxhash64(w).alias("h"), i.alias("i")))
    )
    lengths = let(
        let(hashed, places),
        lambda at: F.transform(at, lambda i, k: F.least(F.coalesce(F.get(at, k + 1) - i, F.lit(WINDOW)), F.lit(WINDOW))),
    )
    return F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, n: a + n)


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Add word, symbol and repetition counts of every whole text; null counts as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    plain = F.trim(F.regexp_replace(whole, SPACE, " "))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^ \t-\r]"))
    # every run of eight words, found by looking ahead from each word's first character
    windows = F.regexp_extract_all(
        "_plain", F.lit(rf"(?<![^ ])(?=((?:[^ ]++ ){{{WINDOW - 1}}}[^ ]++))"), 1
    )
    repeated = let(
        windows,
        lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), _covered(w)).otherwise(F.lit(0)),
    )
    return (
        df.withColumn("_plain", plain)
        .withColumns(
            {
                "_letters": F.length(F.translate("_plain", " ", "")),
                "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("bigint"),
                "_lines": let(
                    lines,
                    lambda x: F.struct(
                        F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("same")
                    ),
                ),
                "n_repeat_words": repeated.cast("bigint"),
            }
        )
        .withColumns(
            {
                "n_words": F.when(F.col("_plain") == "", 0)
                .otherwise(F.length("_plain") - F.col("_letters") + 1)
                .cast("bigint"),
                "word_chars": F.col("_letters").cast("bigint"),
                "n_lines": F.col("_lines.n").cast("bigint"),
                "n_dup_lines": F.col("_lines.same").cast("bigint"),
            }
        )
        .drop("_plain", "_letters", "_lines")
    )


def rules() -> dict[str, Column]:
    """Rules a document can fail, on the columns of ``measures``."""
    words = F.col("n_words")
    return {
        "few_words": words < LEAST_WORDS,
        "repeated_words": 100 * F.col("n_repeat_words") > REPEATED_PERCENT * words,
        "symbols": 4 * F.col("n_symbols") > words,
        "repeated_lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
        "word_length": (F.col("word_chars") > 15 * words) | (F.col("word_chars") < 2 * words),
    }


def judge(
    df: DataFrame,
    host: str = "source",
    text: str = "text",
    block: float = 0.6,
    suspect: float = 1.5,
) -> DataFrame:
    """Add measures, base_failed, host_rate and kept to the columns of ``df`` other than the text.

    A document goes if it fails a base rule, if it fails two rules, if it fails one and its host's
    shrunk rate is over ``suspect`` times the prior's mean, or if that rate is over ``block``. Null
    and empty texts have no words and fail; a null host counts as a host of its own; repeated rows
    count each time; an empty table gives an empty result. The measures are stored once in the
    shared folder. Columns of ``df`` named like a result are replaced.
    """
    stash = Stash(df.sparkSession, "quality")
    made = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    made += ["n_failed", "base_failed", "host_rate", "kept"]
    # neutral names, so that no column of the rows can clash with a helper
    rest = {c: f"c{i}" for i, c in enumerate(df.columns) if c not in {*made, text, host}}
    named = df.select(
        *[F.col(f"`{c}`").alias(short) for c, short in rest.items()], F.col(text).alias("_text"), F.col(host).alias("_host")
    )
    own = rules()
    failed = sum((F.coalesce(r, F.lit(False)).cast("int") for r in own.values()), F.lit(0))
    measured = stash.keep(
        measures(named, "_text")
        .withColumns({"n_failed": failed, "base_failed": own["few_words"] | own["repeated_words"]})
        .drop("_text"),
        "measured",
    )
    hosts = stash.keep(
        measured.groupBy("_host").agg(
            F.count("*").alias("n"), F.sum((F.col("n_failed") > 0).cast("bigint")).alias("k")
        ),
        "hosts",
    )
    alpha, beta = prior(hosts)
    rates = hosts.select("_host", ((F.col("k") + alpha) / (F.col("n") + alpha + beta)).alias("host_rate"))
    mean = alpha / (alpha + beta)
    bad = (
        F.col("base_failed")
        | (F.col("n_failed") >= 2)
        | ((F.col("n_failed") >= 1) & (F.col("host_rate") > suspect * mean))
        | (F.col("host_rate") > block)
    )
    judged = measured.join(rates.withColumnRenamed("_host", "_of"), F.col("_host").eqNullSafe(F.col("_of")))
    back = {"_host": host, **{short: c for c, short in rest.items()}}
    judged = judged.withColumn("kept", ~bad).drop("_of")
    return judged.select(*[F.col(c).alias(back.get(c, c)) for c in judged.columns])


def prior(hosts: DataFrame) -> tuple[float, float]:
    """Beta prior of the hosts' failure rates by moments; one row reaches the driver."""
    rate = F.col("k") / F.col("n")
    row = hosts.agg(
        F.sum("k").alias("k"),
        F.sum("n").alias("n"),
        F.avg(rate).alias("m"),
        F.var_pop(rate).alias("v"),
        F.avg(1 / F.col("n")).alias("s"),
    ).first()
    if not row.n:
        return 1.0, 1.0
    mean = min(max(row.k / row.n, 1e-3), 1 - 1e-3)
    # what the rates differ by beyond the sampling of their rows
    spread = max(row.v - mean * (1 - mean) * row.s, mean * (1 - mean) / 1000)
    total = min(max(mean * (1 - mean) / spread - 1, 1.0), 1000.0)
    return mean * total, (1 - mean) * total
