"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from emberline.plans.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "tpt_evaluation",
    "tpt_sliding",
    "tpt_by_detection",
    "history_prob",
    "eager_gate",
    "episodes",
    "running_fps",
    "metric_matrix",
    "sweep_tpt_sticky",
    "sweep_tpt_sliding",
    "frame_diff",
    "active_blocks",
    "skip_decision",
    "motion_memory",
    "two_point_mask",
    "sweep_motion",
    "profile_report",
    "gpu_stats",
    "wide_report",
    "stratified_split",
    "best_so_far",
    "topk",
    "stream_tpt_sticky",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    # Start the JVM's code paths and the Python workers once, outside the timings.
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").count().collect()
    spark.range(8).mapInPandas(lambda it: it, "id long").collect()
    QUERIES[HEADLINE[0]](spark, sf_dir).collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    frames = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    pixels = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.sum(F.size("embedding"))).first()[0]
    rates = {
        "tpt_frames_per_sec": round(frames / seconds["tpt_evaluation"], 1),
        "frame_diff_pixels_per_sec": round(pixels / seconds["frame_diff"], 1),
        "motion_memory_pixels_per_sec": round(pixels / seconds["motion_memory"], 1),
    }
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "rates": rates,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
