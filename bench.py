"""Headline timings as one JSON line.

``detect`` scores, flags and explains every access-log line with a fitted model and is reported
as lines per second too; ``fit`` is the whole training run. Every query writes all its rows to
the no-op sink; the better of two runs counts.
"""

from __future__ import annotations

import json
import os
import time

from tidewatch.operators.ip_stats import ip_statistics
from tidewatch.operators.templates import mine_templates
from tidewatch.plans import queries as q
from tidewatch.plans.detector import Detector
from tidewatch.session import local_session
from tidewatch.sources.access_logs import access_logs

RUNS = 2


def timed(run, runs: int = RUNS) -> float:
    best = float("inf")
    for _ in range(runs):
        start = time.perf_counter()
        df = run()
        if df is not None:
            df.write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - start)
    return round(best, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus))
    lines = access_logs(spark, sf_dir).count()
    models = {}

    def fit(kind: str):
        models[kind] = Detector(model=kind).fit(access_logs(spark, sf_dir))

    runs = {
        "parse_auto": lambda: q.parsed_logs(spark, sf_dir),
        "attack_categories": lambda: q.QUERIES["attack_categories"](spark, sf_dir),
        "ip_statistics": lambda: ip_statistics(q.dense_requests(spark, sf_dir)),
        "ip_statistics_chunked": lambda: ip_statistics(
            q.dense_requests(spark, sf_dir), strategy="chunked", chunk_rows=20000
        ),
        "features_all": lambda: q.QUERIES["features_all"](spark, sf_dir),
        "mine_templates": lambda: mine_templates(access_logs(spark, sf_dir), "line")[0],
        "dedup_lines": lambda: q.QUERIES["dedup_lines"](spark, sf_dir),
        "split_train_val": lambda: q.QUERIES["split_train_val"](spark, sf_dir),
        "sample_exact": lambda: q.QUERIES["sample_exact"](spark, sf_dir),
        "threshold_iqr": lambda: q.QUERIES["threshold_iqr"](spark, sf_dir),
        "moving_average": lambda: q.QUERIES["moving_average"](spark, sf_dir),
        "fit": lambda: fit("isolation_forest"),
        "detect": lambda: models["isolation_forest"].transform(access_logs(spark, sf_dir)),
        "fit_pca": lambda: fit("pca"),
        "detect_pca": lambda: models["pca"].transform(access_logs(spark, sf_dir)),
        "fit_autoencoder": lambda: fit("autoencoder"),
        "detect_autoencoder": lambda: models["autoencoder"].transform(access_logs(spark, sf_dir)),
    }
    # training the network takes 50 passes and is timed once
    seconds = {name: timed(run, 1 if name == "fit_autoencoder" else RUNS) for name, run in runs.items()}
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "lines": lines,
                "detect_lines_per_sec": round(lines / seconds["detect"]),
                "detect_autoencoder_lines_per_sec": round(lines / seconds["detect_autoencoder"]),
                "cpus": int(cpus),
                "spark": spark.version,
            }
        )
    )


if __name__ == "__main__":
    main()
