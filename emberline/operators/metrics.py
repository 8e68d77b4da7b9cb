"""Frames to videos to metrics.

Everything is sums and counts, so Spark combines per task before the shuffle and a video with
very many frames costs nothing extra.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.labels import POSITIVE, confusion_cell, frame_fps, is_fire_or_smoke, known_label
from emberline.functions.scores import cross_entropy, target_rank
from emberline.operators.ordered import spread_join

COUNTS = ["tp", "fp", "tn", "fn"]


def _count(condition: Column) -> Column:
    return F.sum(F.coalesce(condition, F.lit(False)).cast("long"))


def confusion_counts(pred: Column, truth: Column) -> dict[str, Column]:
    """Mergeable TP/FP/TN/FN state of a group."""
    return {
        "tp": _count(pred & truth),
        "fp": _count(pred & ~truth),
        "tn": _count(~pred & ~truth),
        "fn": _count(~pred & truth),
    }


def ratio(top: Column, bottom: Column) -> Column:
    """0.0 when there is nothing to divide by."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def _counts(names: Sequence[str] = COUNTS) -> list[Column]:
    return [F.col(n) for n in names]


def accuracy() -> Column:
    tp, fp, tn, fn = _counts()
    return ratio(tp + tn, tp + fp + tn + fn)


def precision() -> Column:
    return ratio(F.col("tp"), F.col("tp") + F.col("fp"))


def recall() -> Column:
    return ratio(F.col("tp"), F.col("tp") + F.col("fn"))


def f1_score() -> Column:
    return ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))


def fpr() -> Column:
    return ratio(F.col("fp"), F.col("fp") + F.col("tn"))


def fps_rate() -> Column:
    return ratio(F.col("timed_frames"), F.col("timed_seconds"))


METRICS: dict[str, Callable[[], Column]] = {
    "accuracy": accuracy,
    "f1_score": f1_score,
    "precision": precision,
    "recall (TPR)": recall,
    "FPR": fpr,
    "FPS": fps_rate,
}


def confusion(df: DataFrame, pred: Column, truth: Column, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in confusion_counts(pred, truth).items()])


def with_metrics(counts: DataFrame) -> DataFrame:
    """Add accuracy, precision, recall, f1_score and fpr to confusion counts."""
    return counts.withColumns(
        {"accuracy": accuracy(), "precision": precision(), "recall": recall(), "f1_score": f1_score(), "fpr": fpr()}
    )


def classification_metrics(df: DataFrame, pred: Column, truth: Column, by: Sequence[str] = ()) -> DataFrame:
    return with_metrics(confusion(df, pred, truth, by))


def per_video(df: DataFrame, pred: Column, truth: Column, by: Sequence[str] = ()) -> DataFrame:
    """A video is positive when any of its frames is."""
    return df.groupBy(*by, "video").agg(
        F.max(F.coalesce(pred, F.lit(False))).alias("pred"), F.max(F.coalesce(truth, F.lit(False))).alias("truth")
    )


def per_video_unique(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Older rule: negative only when ``None`` is the single label, so ``skipped`` counts as positive."""
    return df.groupBy(*by, "video").agg(F.max(known_label("pred_label") != "None").alias("pred"))


def fps(df: DataFrame, by: Sequence[str] = (), mode: str = "total") -> DataFrame:
    """Frames per second.

    ``total``: frames over seconds without each video's first frame. ``mean_time``: one over the
    mean time of those frames. ``mean_rate``: mean of the per-frame rates over all frames.
    """
    later = F.col("frame_idx") > 1
    timed = df.groupBy(*by).agg(
        _count(later & F.col("elapsed_time").isNotNull()).alias("timed_frames"),
        F.coalesce(F.sum(F.when(later, F.col("elapsed_time"))), F.lit(0.0)).alias("timed_seconds"),
        F.avg(F.when(later, F.col("elapsed_time"))).alias("__mean_time"),
        F.avg(frame_fps("elapsed_time")).alias("__mean_rate"),
    )
    value = {
        "total": fps_rate(),
        "mean_time": ratio(F.lit(1.0), F.col("__mean_time")),
        "mean_rate": F.coalesce("__mean_rate", F.lit(0.0)),
    }[mode]
    return timed.select(*by, "timed_frames", "timed_seconds", value.alias("fps"))


def video_summary(df: DataFrame, pred: Column, truth: Column, by: Sequence[str] = ()) -> DataFrame:
    """One row per video that holds the state of every metric in both modes."""
    later = F.col("frame_idx") > 1
    state = confusion_counts(pred, truth)
    return df.groupBy(*by, "video").agg(
        *[c.alias(f"frame_{n}") for n, c in state.items()],
        F.max(F.coalesce(pred, F.lit(False))).alias("any_pred"),
        F.max(F.coalesce(truth, F.lit(False))).alias("any_truth"),
        _count(later & F.col("elapsed_time").isNotNull()).alias("timed_frames"),
        F.coalesce(F.sum(F.when(later, F.col("elapsed_time"))), F.lit(0.0)).alias("timed_seconds"),
    )


def metric_matrix(
    df: DataFrame,
    pred: Column,
    truth: Column,
    by: Sequence[str] = (),
    modes: str | Sequence[str] = ("per_video", "per_frame"),
    metrics: Sequence[str] = tuple(METRICS),
) -> DataFrame:
    """Every metric in every mode as ``(by..., mode, metric, value)`` from one pass over the frames.

    Both modes come out of one aggregate: their counts sit side by side in one row per group
    and are only unpivoted at the end.
    """
    modes = [modes] if isinstance(modes, str) else list(modes)
    unknown = [m for m in modes if m not in ("per_video", "per_frame")] + [m for m in metrics if m not in METRICS]
    if unknown:
        raise ValueError(f"unknown modes or metrics: {unknown}")
    videos = video_summary(df, pred, truth, by)
    video_state = confusion_counts(F.col("any_pred"), F.col("any_truth"))
    groups = videos.groupBy(*by).agg(
        *[c.alias(f"per_video_{n}") for n, c in video_state.items()],
        *[F.sum(f"frame_{n}").alias(f"per_frame_{n}") for n in COUNTS],
        F.sum("timed_frames").alias("timed_frames"),
        F.sum("timed_seconds").alias("timed_seconds"),
    )
    rows = groups.withColumn(
        "__mode",
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("mode"), *[F.col(f"{m}_{n}").alias(n) for n in COUNTS]) for m in modes])
        ),
    ).select(*by, "__mode.*", "timed_frames", "timed_seconds")
    values = F.array(*[F.struct(F.lit(m).alias("metric"), METRICS[m]().alias("value")) for m in metrics])
    return rows.withColumn("__m", F.explode(values)).select(*by, "mode", "__m.*")


def perf_rows(
    df: DataFrame, pred: Column, truth: Column, experiment: Column, by: Sequence[str] = ("dataset",), mode: str = "per_video"
) -> DataFrame:
    """One wide perf row per group, named like the perf files."""
    long = metric_matrix(df, pred, truth, by, mode)
    wide = long.groupBy(*by, "mode").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(f"metric_{m}") for m in METRICS]
    )
    return wide.withColumn("experiment", F.concat_ws("_", experiment, F.col("mode"))).select(
        "experiment", *by, *[f"metric_{m}" for m in METRICS]
    )


def error_table(videos: DataFrame) -> DataFrame:
    """Prediction, truth and correctness per video, errors first. ``pred`` and ``truth`` are labels."""
    return videos.withColumn("correct", confusion_cell("pred", "truth")).orderBy("correct", "video")


def topk_accuracy(scores: DataFrame, ks: Sequence[int] = (1, 5), by: Sequence[str] = (), logits: str = "logits", target: str = "target") -> DataFrame:
    """Percentage of rows whose target is among the k best scores, and the mean loss."""
    ranked = scores.withColumns({"__rank": target_rank(logits, target), "__loss": cross_entropy(logits, target)})
    return ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("__loss").alias("loss"),
        *[(F.avg(F.when(F.col("__rank") <= k, 1.0).otherwise(0.0)) * 100).alias(f"top{k}") for k in ks],
    )


def weighted_mean(df: DataFrame, values: Sequence[str], weight: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean of batch values weighted with the batch size."""
    w = F.col(weight)
    return df.groupBy(*by).agg(*[ratio(F.sum(F.col(v) * w), F.sum(w)).alias(v) for v in values])


def run_summary(frames: DataFrame, technique: str, threshold: float | None, window: int | None) -> DataFrame:
    """One row per video: settings, whether and when something was detected, mean time per frame."""
    hit = is_fire_or_smoke("pred_label")
    return frames.groupBy("video").agg(
        F.lit(technique).alias("technique"),
        F.lit(threshold).cast("double").alias("threshold"),
        F.lit(window).cast("int").alias("window_size"),
        F.bool_or(hit).alias("detected"),
        F.min(F.when(hit, F.col("frame_idx"))).alias("first_frame"),
        F.avg("elapsed_time").alias("time_avg"),
    )


def count_videos(meta: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    return meta.groupBy(*by).agg(
        F.count(F.lit(1)).alias("videos"),
        F.sum("frame_count").alias("frames"),
        F.sum(F.when(F.col("fps") > 0, F.col("frame_count") / F.col("fps"))).alias("seconds"),
    )


def attach_truth(frames: DataFrame, truth: DataFrame, keys: Sequence[str] = ("video",)) -> DataFrame:
    """Add each frame's truth; a truth table by video is spread so that no video is one task."""
    return spread_join(frames, truth, list(keys), F.col("frame_idx"), may_grow=True)


def positive(label: Column | str) -> Column:
    """Whether a binary label column says positive."""
    return (F.col(label) if isinstance(label, str) else label) == POSITIVE
