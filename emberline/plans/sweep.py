"""Parameter grids, and whole grids evaluated in one job.

A trial is never a copy of the frames. What differs between trials is applied to aggregates:
frames or pixels are read once per distinct window or block size, reduced to one row per
video or frame, and only those small rows meet the thresholds.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.functions.labels import is_detection, is_fire_or_smoke
from emberline.operators import motion as M
from emberline.operators.metrics import confusion_counts, with_metrics
from emberline.operators.ordered import CHUNK, with_halo


def expand_range(start: float, end: float, step: float) -> list[float]:
    """start, start+step, ... below ``end``."""
    n = max(0, math.ceil(round((end - start) / step, 9)))
    return [round(start + i * step, 10) for i in range(n)]


def values_of(spec) -> list:
    """Values of one parameter: a list, or ``{"type": "list"|"range", "values": [...]}``."""
    if isinstance(spec, Mapping):
        if spec["type"] == "range":
            return expand_range(*spec["values"])
        if spec["type"] != "list":
            raise ValueError(f"unknown parameter type {spec['type']!r}")
        spec = spec["values"]
    return list(spec)


def trial_count(space: Mapping) -> int:
    return math.prod(len(values_of(s)) for s in space.values())


def with_grid(df: DataFrame, space: Mapping) -> DataFrame:
    """Every row of ``df`` once per trial; ``trial_id`` counts in the order of the parameters.

    The values are literals expanded in place. Use this on small rows only.
    """
    trial: Column = F.lit(0)
    out = df
    for name, spec in space.items():
        values = values_of(spec)
        options = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(values)])
        out = out.withColumn(f"__{name}", F.explode(options))
        trial = trial * len(values) + F.col(f"__{name}.i")
    out = out.withColumn("trial_id", trial.cast("int"))
    return out.withColumns({n: F.col(f"__{n}.v") for n in space}).drop(*[f"__{n}" for n in space])


def param_grid(spark: SparkSession, space: Mapping) -> DataFrame:
    return with_grid(spark.range(1).select(), space)


def sweep_tpt_video(
    frames: DataFrame, truth: Column, windows: Sequence[int], thresholds: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Video-level metrics of every (window, threshold) of the sticky rule.

    One pass: each frame is repeated per distinct window, reduced at once to the first hit per
    (video, window, slot), and the thresholds pick from the sorted firsts of a video.
    """
    hit = is_fire_or_smoke("pred_label")
    keys = [*by, "video"]
    slots = frames.withColumn("window", F.explode(F.array(*[F.lit(w) for w in windows])))
    slots = slots.groupBy(*keys, "window", F.pmod(F.col("frame_idx") - 1, F.col("window")).alias("__slot")).agg(
        F.min(F.when(hit, F.col("frame_idx"))).alias("__first"),
        F.max(truth).alias("__truth"),
    )
    videos = slots.groupBy(*keys, "window").agg(
        F.count("__first").alias("__set"),  # slots that ever held a hit
        F.max("__truth").alias("truth"),
    )
    # The k-th first exists exactly when k slots were ever set, so the count is enough.
    trials = with_grid(videos, {"thr": list(thresholds)})
    pred = F.col("__set") >= F.ceil(F.col("thr") * F.col("window"))
    counts = trials.groupBy(*by, "window", "thr").agg(
        *[c.alias(n) for n, c in confusion_counts(pred, F.col("truth")).items()]
    )
    return with_metrics(counts)


def sweep_tpt_sliding(
    frames: DataFrame,
    truth: Column,
    windows: Sequence[int],
    thresholds: Sequence[float],
    by: Sequence[str] = (),
    size: int = CHUNK,
) -> DataFrame:
    """Video-level metrics of every (window, threshold) of the sliding rule.

    A video stays positive when some positive frame has enough detections behind it, so the
    largest such count per (video, window) decides every threshold.
    """
    widths = sorted(set(windows))
    base = frames.select(
        *by,
        "video",
        "frame_idx",
        truth.alias("__truth"),
        is_fire_or_smoke("pred_label").alias("__pos"),
        is_detection("pred_label").cast("int").alias("__det"),
    )
    rows = with_halo(base, "frame_idx", max(widths) - 1, size)
    order = Window.partitionBy("video", "__chunk").orderBy("frame_idx")
    rows = rows.withColumns({f"__c{w}": F.sum("__det").over(order.rowsBetween(-(w - 1), 0)) for w in widths})
    videos = (
        rows.filter(~F.col("__halo"))
        .groupBy(*by, "video")
        .agg(
            F.max("__truth").alias("truth"),
            *[F.coalesce(F.max(F.when(F.col("__pos"), F.col(f"__c{w}"))), F.lit(-1)).alias(f"__m{w}") for w in widths],
        )
    )
    per_window = videos.withColumn(
        "__w",
        F.explode(F.array(*[F.struct(F.lit(w).alias("window"), F.col(f"__m{w}").alias("best")) for w in widths])),
    ).select(*by, "truth", "__w.*")
    trials = with_grid(per_window, {"thr": list(thresholds)})
    pred = (F.col("best") >= 0) & (F.col("best") >= F.col("thr") * F.col("window"))
    counts = trials.groupBy(*by, "window", "thr").agg(
        *[c.alias(n) for n, c in confusion_counts(pred, F.col("truth")).items()]
    )
    return with_metrics(counts)


def sweep_motion(
    diffs: DataFrame,
    width: int,
    height: int,
    diff_thres: Sequence[float],
    blk_sizes: Sequence[int],
    blk_act_thres: Sequence[float],
    frm_act_thres: Sequence[float],
) -> DataFrame:
    """Skipped, full and block-scored frames for every combination of motion thresholds.

    Pixels are aggregated once, to blocks of the sizes' common divisor and with one count column
    per difference threshold; larger blocks are sums of those. The other thresholds only meet
    per-frame rows.
    """
    tables = []
    frames = M.FRAME
    base = math.gcd(*blk_sizes)
    names = [f"__c{i}" for i in range(len(diff_thres))]
    cells = M.to_blocks(diffs, base, width, height).groupBy(*frames, "by", "bx").agg(
        *[F.sum(F.when(F.col("diff") > t, 1).otherwise(0)).alias(n) for n, t in zip(names, diff_thres)]
    )
    for blk in blk_sizes:
        n_blocks = -(-width // blk) * -(-height // blk)
        up = blk // base
        counts = cells if up == 1 else cells.groupBy(
            *frames,
            F.floor(F.col("by") / F.lit(up)).alias("by"),
            F.floor(F.col("bx") / F.lit(up)).alias("bx"),
        ).agg(*[F.sum(n).alias(n) for n in names])
        pairs = [(i, d, a) for i, d in enumerate(diff_thres) for a in blk_act_thres]
        per_frame = counts.groupBy(*frames).agg(
            *[
                F.sum(F.when(F.col(f"__c{i}") / F.lit(blk * blk) > a, 1).otherwise(0)).alias(f"__a{j}")
                for j, (i, _, a) in enumerate(pairs)
            ]
        )
        active = F.array(
            *[
                F.struct(
                    F.lit(float(d)).alias("diff_thres"),
                    F.lit(float(a)).alias("blk_act_thres"),
                    F.col(f"__a{j}").alias("n_active"),
                )
                for j, (_, d, a) in enumerate(pairs)
            ]
        )
        tables.append(
            per_frame.withColumn("__p", F.explode(active)).select(
                *frames, F.lit(blk).alias("blk_size"), F.lit(n_blocks).alias("n_blocks"), "__p.*"
            )
        )
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    rows = with_grid(rows, {"frm_act_thres": [float(v) for v in frm_act_thres]}).drop("trial_id")
    share = F.col("n_active") / F.col("n_blocks")
    return rows.groupBy("diff_thres", "blk_size", "blk_act_thres", "frm_act_thres").agg(
        F.count(F.lit(1)).alias("frames"),
        F.sum(F.when(F.col("n_active") == 0, 1).otherwise(0)).alias("skipped"),
        F.sum(F.when((F.col("n_active") > 0) & (share >= F.col("frm_act_thres")), 1).otherwise(0)).alias("full"),
        F.sum(F.when((F.col("n_active") > 0) & (share < F.col("frm_act_thres")), 1).otherwise(0)).alias("scored"),
    )
