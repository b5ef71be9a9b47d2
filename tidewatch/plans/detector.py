"""End-to-end detection: lines to flagged, scored and explained records."""

from __future__ import annotations

import dataclasses
import json
from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import scalars as S
from tidewatch.operators import prep, stats
from tidewatch.operators.clusters import match_clusters, mine_clusters
from tidewatch.operators.explain import explain
from tidewatch.operators.features import extract_features, row_table, with_statistics
from tidewatch.operators.iforest import IsolationForestModel, fit_iforest
from tidewatch.operators.parse import STRICT_FORMATS, parse_logs
from tidewatch.operators.reconstruction import (
    HIDDEN,
    LATENT,
    LAYER_SCHEMA,
    ReconstructionModel,
    fit_reconstruction,
    restore_network,
)
from tidewatch.operators.scaling import fit_scaler, scaled_columns
from tidewatch.operators.templates import match_templates, mine_templates
from tidewatch.schema import DEFAULT_FEATURES, SUSPICIOUS_PATTERNS, feature_names
from tidewatch.session import freeze

MODELS = ("isolation_forest", "autoencoder", "pca")

# Columns that a row keeps beside its features on the way to its record.
KEEP = ["line_no", "parsed_log"]

RECORD_FIELDS = ("timestamp", "ip", "method", "path", "status", "template_id")


class Estimator(ABC):
    """Extension point: a detector that learns from a table of lines."""

    @abstractmethod
    def fit(self, lines: DataFrame) -> "Model": ...


class Model(ABC):
    """Extension point: a fitted detector."""

    @abstractmethod
    def transform(self, lines: DataFrame) -> DataFrame: ...

    @abstractmethod
    def save(self, path: str) -> None: ...


@dataclass(frozen=True)
class DetectorConfig:
    model: str = "isolation_forest"
    format: str = "auto"
    pattern: str | None = None
    features: tuple[str, ...] = DEFAULT_FEATURES
    patterns: tuple[str, ...] = SUSPICIOUS_PATTERNS
    ip_window_minutes: int = 60
    min_samples: int = 0
    max_samples: int | None = None
    # templates: "buckets" (one rule a bucket) or "similarity" (clusters of similar lines)
    mining: str = "buckets"
    similarity: float = 0.5
    depth: int = 4
    max_children: int = 100
    rare_after: int = 1000
    # isolation forest
    n_trees: int = 200
    tree_samples: int = 1000
    contamination: float = 0.05
    seed: int = 42
    # reconstruction
    latent: int = LATENT
    hidden: tuple[int, ...] = HIDDEN
    rate: float = 0.001
    epochs: int = 50
    batch_size: int = 256
    threshold_percentile: float = 95.0

    def __post_init__(self):
        if self.model not in MODELS:
            raise ValueError(f"unknown model type: {self.model}")
        if self.mining not in ("buckets", "similarity"):
            raise ValueError(f"unknown way of mining: {self.mining}")

    def match(self, parsed: DataFrame, members: DataFrame) -> DataFrame:
        """Add ``template_id`` and ``template`` of the template that each parsed line belongs to."""
        match = match_clusters if self.mining == "similarity" else match_templates
        return match(parsed, members, similarity=self.similarity)

    @property
    def reconstruction(self) -> str:
        """Kind of the reconstruction model: the network, or principal components under their own name."""
        return "mlp" if self.model == "autoencoder" else "pca"

    @property
    def names(self) -> list[str]:
        return feature_names(self.features)


class Detector(Estimator):
    """Fits templates, scaler and model on a table with ``line_no``, ``line`` and ``ingest_ts``."""

    def __init__(self, config: DetectorConfig | None = None, **options):
        self.config = dataclasses.replace(config or DetectorConfig(), **options)

    def fit(self, lines: DataFrame, records: bool = False) -> "DetectorModel":
        """With ``records`` the model also keeps the rows of all lines, parsed once for both, for ``fitted_records``."""
        cfg = self.config
        if records and cfg.max_samples:
            raise ValueError("a model that learns from a sample has no rows of all lines")
        if cfg.max_samples:
            lines = prep.sample(lines, cfg.max_samples, cfg.seed)
        if cfg.min_samples:
            lines = prep.require_samples(lines, cfg.min_samples)
        parsed = parse_logs(lines, cfg.format, cfg.pattern)
        mine = mine_clusters if cfg.mining == "similarity" else mine_templates
        templates, members = mine(
            *self._mined(lines, parsed),
            similarity=cfg.similarity,
            depth=cfg.depth,
            max_children=cfg.max_children,
        )
        rows = None
        if records:
            matched = cfg.match(parsed, members).withColumn("parsed_log", record_fields())
            rows = freeze(row_table(matched, cfg.features, cfg.patterns, KEEP), "rows")
            usable = rows.filter("keep_parsed_log.status > 0").drop("keep_parsed_log")
            features = with_statistics(usable, cfg.features, cfg.ip_window_minutes)
        else:
            usable = cfg.match(parsed.filter("status > 0"), members)
            features = extract_features(usable, cfg.features, cfg.patterns, cfg.ip_window_minutes, stored=True)
        features = freeze(features, "features")
        names = cfg.names
        scaler = freeze(fit_scaler(features, names), "scaler")
        found = scaler.collect()  # one row per feature
        total = found[0]["n"] if found else 0
        if not total:
            raise ValueError("no parsable lines to train on")
        state = {r["feature"]: (r["mean"], r["scale"]) for r in found}
        scaled = features.select("line_no", *scaled_columns(state, names))
        if cfg.model == "isolation_forest":
            fitted = fit_iforest(
                scaled, names, cfg.n_trees, cfg.tree_samples, cfg.contamination, cfg.seed, total
            )
        else:
            if cfg.reconstruction == "mlp":
                scaled = freeze(scaled, "scaled")  # read once per epoch
            fitted = fit_reconstruction(
                scaled,
                names,
                cfg.reconstruction,
                cfg.latent,
                cfg.hidden,
                cfg.rate,
                cfg.epochs,
                cfg.batch_size,
                cfg.threshold_percentile,
                cfg.seed,
            )
        model = DetectorModel(cfg, state, templates, members, scaler, fitted)
        # the lines and the parsable ones, counted without parsing again
        model.training = (lines, total, len(names))
        model.rows = rows
        return model


    def _mined(self, lines: DataFrame, parsed: DataFrame) -> tuple[DataFrame, str]:
        """Table and column to mine. Only a strict format needs the match to know the raw line."""
        if self.config.format in STRICT_FORMATS:
            return parsed, "raw"
        return lines, "line"


class DetectorModel(Model):
    def __init__(self, config, state, templates, members, scaler, fitted):
        self.config, self.state, self.fitted = config, state, fitted
        self.templates, self.members, self.scaler = templates, members, scaler
        self.training = self.rows = None

    def training_stats(self) -> DataFrame:
        """One row: lines seen, lines parsed, feature shape, model type, status."""
        if self.training is None:
            raise ValueError("training statistics belong to the fitting session")
        lines, usable, width = self.training
        counted = lines.agg(F.count("*").alias("total_logs"))
        return counted.select(
            "total_logs",
            F.lit(usable).cast("bigint").alias("parsed_logs"),
            F.lit(usable).cast("bigint").alias("feature_rows"),
            F.lit(width).alias("feature_columns"),
            F.lit(self.config.model).alias("model_type"),
            F.lit("trained").alias("status"),
        )

    def parse(self, lines: DataFrame) -> DataFrame:
        """Parsed rows with template and the ``parsed_log`` fields of the result record."""
        parsed = parse_logs(lines, self.config.format, self.config.pattern)
        return self.config.match(parsed, self.members)

    def transform(self, lines: DataFrame, **ip_options) -> DataFrame:
        """One record per line: line_no, anomaly, score, model, reason, parsed_log."""
        cfg = self.config
        parsed = self.parse(lines).withColumn("parsed_log", record_fields())
        features = extract_features(
            parsed,
            cfg.features,
            cfg.patterns,
            cfg.ip_window_minutes,
            keep=KEEP,
            **ip_options,
        )
        return self.score(features)

    def fitted_records(self, **ip_options) -> DataFrame:
        """The records that ``transform`` gives for the lines of the fit, from their stored rows."""
        if self.rows is None:
            raise ValueError("rows of all lines belong to a session that fitted with records=True")
        cfg = self.config
        return self.score(with_statistics(self.rows, cfg.features, cfg.ip_window_minutes, KEEP, **ip_options))

    def score(self, features: DataFrame) -> DataFrame:
        """Finish feature rows that carry ``line_no`` and ``parsed_log``; also works on a stream."""
        cfg = self.config
        score = self.fitted.score(scaled_columns(self.state, cfg.names))
        scored = features.select("line_no", "parsed_log", score.alias("score"))
        flagged = scored.withColumn("anomaly", self.fitted.flag(F.col("score")))
        reason = explain(
            F.col("anomaly"), F.col("score"), cfg.patterns, cfg.rare_after, record="parsed_log"
        )
        return flagged.select(
            "line_no",
            "anomaly",
            "score",
            F.lit(cfg.model).alias("model"),
            reason.alias("reason"),
            "parsed_log",
        )

    def save(self, path: str) -> None:
        spark = self.scaler.sparkSession
        self.scaler.write.parquet(f"{path}/scaler")
        self.templates.write.parquet(f"{path}/templates")
        self.members.write.parquet(f"{path}/members")
        forest = isinstance(self.fitted, IsolationForestModel)
        if forest:
            self.fitted.trees.write.parquet(f"{path}/trees")
        else:
            layers = spark.createDataFrame(self.fitted.layers(), LAYER_SCHEMA)
            layers.write.parquet(f"{path}/layers")
        meta = {
            "config": dataclasses.asdict(self.config),
            "psi": self.fitted.psi if forest else None,
            "cutoff": self.fitted.cutoff if forest else self.fitted.threshold,
        }
        # written last: its presence marks a complete model
        spark.createDataFrame([(json.dumps(meta),)], "meta string").write.parquet(f"{path}/model_meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "DetectorModel":
        try:
            meta = json.loads(spark.read.parquet(f"{path}/model_meta").first()["meta"])
        except Exception as e:
            raise FileNotFoundError(f"no model under {path}") from e
        options = {k: tuple(v) if isinstance(v, list) else v for k, v in meta["config"].items()}
        cfg = DetectorConfig(**options)
        scaler = spark.read.parquet(f"{path}/scaler")
        state = {r["feature"]: (r["mean"], r["scale"]) for r in scaler.collect()}
        if cfg.model == "isolation_forest":
            trees = spark.read.parquet(f"{path}/trees")
            fitted = IsolationForestModel(trees, cfg.names, meta["psi"], meta["cutoff"])
        else:
            rows = [tuple(r) for r in spark.read.parquet(f"{path}/layers").collect()]
            fitted = ReconstructionModel(cfg.names, threshold=meta["cutoff"])
            if cfg.reconstruction == "pca":
                net = restore_components(rows)
                fitted.components = net
            else:
                fitted.network = restore_network(len(cfg.names), rows, cfg.hidden, cfg.latent)
        templates = spark.read.parquet(f"{path}/templates")
        return cls(cfg, state, templates, spark.read.parquet(f"{path}/members"), scaler, fitted)


def restore_components(rows):
    import numpy as np

    (_, _, shape, weights) = rows[0]
    return np.array(weights).reshape(shape)


def record_fields():
    """The ``parsed_log`` struct of a result record, from parsed columns and the template id."""
    return F.struct(
        S.timestamp_text(F.col("wall_ts"), F.col("zone")).alias("timestamp"),
        "ip",
        "method",
        "path",
        "status",
        "template_id",
    )


def alerts(records: DataFrame) -> DataFrame:
    return records.filter("anomaly")
