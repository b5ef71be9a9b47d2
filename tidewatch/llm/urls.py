"""URL filters: listed rules, and gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Stash

# Fixed values: (verdict, host, path); a rule holds for its host and all subdomains.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
SAMPLE = 20_000
# Rows that a table of statistics may have to be broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 200_000
ROUNDS = 12
DEPTH = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add host and path; null urls and urls without ``://`` have empty ones."""
    whole = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.substr(whole, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return df.withColumns(
        {
            "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
            "host": F.translate(host, _UPPER, _LOWER),
        }
    )


def ruled(rules=RULES) -> tuple[Column, Column]:
    """Longest fitting rule and its verdict, null where none fits."""
    rule = verdict = None
    for decision, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(
            F.col("path"), F.lit(path)
        )
        name = F.lit(host + path)
        rule = F.when(fits, name) if rule is None else rule.when(fits, name)
        verdict = F.when(fits, decision) if verdict is None else verdict.when(fits, decision)
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits a character of the text, over its distinct characters."""
    size = F.length(text)
    bits = F.transform(
        F.array_distinct(F.split(text, "")),
        lambda c: F.when(c == "", 0.0).otherwise(
            (size - F.length(F.replace(text, c, F.lit("")))) / size
        ),
    )
    return F.aggregate(
        bits, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    )


def features(df: DataFrame, url: str = "url") -> DataFrame:
    """Add lexical features (``f_...``) and the host's last label and last two labels."""
    whole = F.coalesce(F.col(url), F.lit(""))
    query = F.regexp_extract(whole, r"\?([^#]*)", 1)

    def count(text: Column, chars: str) -> Column:
        return F.length(text) - F.length(F.translate(text, chars, ""))

    host, path = F.col("host"), F.col("path")
    made = {
        "f_length": F.length(whole),
        "f_host_length": F.length(host),
        "f_path_length": F.length(path),
        "f_host_depth": count(host, "."),
        "f_path_depth": count(path, "/"),
        "f_digits": count(whole, "0123456789") / F.greatest(F.length(whole), F.lit(1)),
        "f_host_digits": count(host, "0123456789") / F.greatest(F.length(host), F.lit(1)),
        "f_hyphens": count(host, "-"),
        "f_parameters": F.when(query == "", 0).otherwise(count(query, "&") + 1),
        "f_fragment": F.contains(whole, F.lit("#")).cast("int"),
        "f_secure": F.startswith(whole, F.lit("https:")).cast("int"),
        "f_entropy": _entropy(host),
        "f_path_entropy": _entropy(F.regexp_extract(path, r"^/?([^/]*)", 1)),
        "f_slash": F.endswith(path, F.lit("/")).cast("int"),
    }
    made = {k: v.cast("double") for k, v in made.items()}
    return df.withColumns({**made, **_keys()})


def _keys() -> dict[str, Column]:
    """What statistics are kept of: the host's last label, its last two, the path's first folder."""
    host, path = F.col("host"), F.col("path")
    return {
        "_suffix": F.substring_index(host, ".", -1),
        "_suffix2": F.substring_index(host, ".", -2),
        "_folder": F.regexp_extract(path, r"^/([^/]*)/", 1),
    }


def _statistics(pages: DataFrame) -> tuple[dict[str, DataFrame], float]:
    """Share of all pages and shrunk rate of blocked ones among the ruled, by key; mean rate."""
    whole = pages.agg(F.count("*").alias("n"), F.avg("label").alias("mean")).first()
    stash = Stash(pages.sparkSession, "urls")
    made = {}
    for key, value in _keys().items():
        table = pages.groupBy(value.alias(key)).agg(
            ((F.coalesce(F.sum("label"), F.lit(0.0)) + 10 * whole.mean) / (F.count("label") + 10)).alias(f"f{key}_rate"),
            (F.count("*") / whole.n).alias(f"f{key}_share"),
        )
        table = stash.keep(table, key)
        made[key] = F.broadcast(table) if table.count() <= BROADCAST_ROWS else table
    return made, whole.mean


class UrlModel:
    """Trees and the suffix statistics they read; ``None`` trees decide by ``default``."""

    def __init__(self, trees, statistics: dict[str, DataFrame], names: list[str], default: str):
        self.trees, self.statistics, self.names, self.default = trees, statistics, names, default


def _with_statistics(df: DataFrame, statistics: dict[str, DataFrame], mean: float) -> DataFrame:
    for key, table in statistics.items():
        df = df.join(table, key, "left").fillna({f"f{key}_rate": mean, f"f{key}_share": 0.0})
    return df


def fit(df: DataFrame, url: str = "url", rules=RULES, sample: int = SAMPLE) -> UrlModel:
    """Train on urls that a rule decides.

    At most ``sample`` distinct urls with the lowest hashes are used, so training does not grow with
    the table. The suffix statistics are those of all pages and all ruled pages. With one class or none there are no trees and the class, or allow, is the verdict.
    """
    rule, verdict = ruled(rules)
    pages = parts(df.select(F.col(url).alias("url"))).withColumn("label", (verdict == "block").cast("double"))
    labelled = (
        pages.filter("label is not null")
        .groupBy("url", "host", "path", "label")
        .agg(F.count("*").alias("copies"))
        .orderBy(F.xxhash64("url"), "url")
        .limit(sample)
    )
    # at most ``sample`` rows: they are kept on the executors for the passes of the training
    rows = features(labelled, "url").drop("url", "host", "path", "copies").persist()
    found = rows.agg(F.count("*").alias("n"), F.avg("label").alias("mean")).first()
    if not found.n or found.mean in (0.0, 1.0):
        rows.unpersist()
        return UrlModel(None, {}, [], "block" if found.n and found.mean == 1.0 else "allow")
    statistics, mean = _statistics(pages)
    whole = _with_statistics(rows, statistics, mean)
    names = [c for c in whole.columns if c.startswith("f_")]
    table = VectorAssembler(inputCols=names, outputCol="_features").transform(whole)
    trees = GBTClassifier(
        featuresCol="_features", labelCol="label", maxIter=ROUNDS, maxDepth=DEPTH, seed=7, stepSize=0.3
    ).fit(table.select("_features", "label"))
    rows.unpersist()
    model = UrlModel(trees, statistics, names, "allow")
    model.mean = mean
    return model


def judge(df: DataFrame, model: UrlModel, url: str = "url", rules=RULES) -> DataFrame:
    """Add host, path, rule and verdict to every row.

    The longest fitting rule decides, else the model. Null and empty urls and those without ``://``
    have an empty host and path, fit no rule with a host, and are judged by the model like all
    others. Repeated rows repeat the result. Columns of ``df`` named like a result are replaced.
    """
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    rule, verdict = ruled(rules)
    named = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(url).alias("_url"))
    rows = parts(named, "_url").withColumns({"rule": rule, "_ruled": verdict})
    if model.trees is None:
        guess = F.lit(model.default)
    else:
        rows = _with_statistics(features(rows, "_url"), model.statistics, model.mean)
        assembler = VectorAssembler(inputCols=model.names, outputCol="_features")
        rows = model.trees.transform(assembler.transform(rows))
        guess = F.when(F.col("prediction") == 1, "block").otherwise("allow")
    return rows.withColumn("verdict", F.coalesce("_ruled", guess)).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], "host", "path", "rule", "verdict"
    )
