"""Temporal filters over the label sequence of each video.

``frame_idx`` is the 1-based, gap-free position of a frame in its video; use
``ordered.renumber_frames`` first on a log that was filtered.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.functions.labels import fire_smoke_flags, frame_fps, is_detection, is_fire_or_smoke, mean_rate
from emberline.operators.grouped import append_to_sorted_groups, map_sorted_groups
from emberline.operators.ordered import (
    CHUNK,
    chunk_of,
    join_carry,
    number_rows,
    number_runs,
    over_recent,
    running,
    spread_join,
)
from emberline.operators.stabilize import temp_stabilize


def no_temp(frames: DataFrame) -> DataFrame:
    """Labels pass through unchanged."""
    return frames


# --- persistence thresholds ------------------------------------------------------------------


def _suppress_before(frames: DataFrame, release: DataFrame) -> DataFrame:
    """Set the label to ``none`` on the frames before the video's release frame (or on all)."""
    out = spread_join(frames, release, ["video"], F.col("frame_idx"))
    early = F.col("__release").isNull() | (F.col("frame_idx") < F.col("__release"))
    return out.withColumn("pred_label", F.when(early, F.lit("none")).otherwise(F.col("pred_label"))).drop("__release")


def slot_firsts(frames: DataFrame, window: int, hit: Column) -> DataFrame:
    """First hit of each buffer slot: at most ``window`` rows per video, combined on the map side."""
    slot = F.pmod(F.col("frame_idx") - 1, F.lit(window)).cast("int")
    return (
        frames.filter(hit)
        .groupBy("video", slot.alias("slot"))
        .agg(F.min("frame_idx").alias("first_idx"))
    )


def _kth_first(firsts: DataFrame, k: int) -> DataFrame:
    ordered = F.sort_array(F.collect_list("first_idx"))
    return firsts.groupBy("video").agg(F.get(ordered, F.lit(k - 1)).alias("__release"))


def tpt_sticky(frames: DataFrame, window: int = 20, thr: float = 0.5, strict: bool = True) -> DataFrame:
    """Persistence threshold with a slot buffer that is never cleared.

    The number of set slots only grows, so a video is suppressed up to one release frame: the
    k-th smallest first hit over its slots. No scan over the sequence is needed.
    """
    k = math.floor(thr * window) + 1 if strict else math.ceil(thr * window)
    if k <= 0:
        return frames
    release = _kth_first(slot_firsts(frames, window, is_detection("pred_label")), k)
    return _suppress_before(frames, release)


def tpt_sliding(
    frames: DataFrame, window: int = 20, thr: float = 0.5, strict: bool = False, size: int = CHUNK
) -> DataFrame:
    """Keep a label when the last ``window`` frames hold at least ``thr * window`` detections."""
    hits = F.sum(F.when(is_detection("pred_label"), 1).otherwise(0))
    out = over_recent(frames, ["video"], "frame_idx", window, {"__hits": hits}, size)
    low = F.col("__hits") <= thr * window if strict else F.col("__hits") < thr * window
    return out.withColumn("pred_label", F.when(low, F.lit("none")).otherwise(F.col("pred_label"))).drop("__hits")


def tpt_by_detection(frames: DataFrame, window: int = 20, thr: float = 0.5) -> DataFrame:
    """The buffer advances on detections only, so the k-th detection releases the video."""
    k = math.floor(thr * window) + 1
    hits = frames.filter(is_detection("pred_label"))
    if k > window:
        return frames.withColumn("pred_label", F.lit("none"))
    if k <= 0:
        return frames
    place = F.row_number().over(Window.partitionBy("video").orderBy("frame_idx"))
    release = (
        hits.select("video", "frame_idx")
        .withColumn("__place", place)
        .filter(F.col("__place") <= k)  # Spark keeps only k rows per video and task before the shuffle
        .groupBy("video")
        .agg(F.max(F.when(F.col("__place") == k, F.col("frame_idx"))).alias("__release"))
    )
    return _suppress_before(frames, release)


def tpt_video(frames: DataFrame, window: int = 20, thr: float = 0.5) -> DataFrame:
    """One row per video: is it positive, and at which frame did the buffer reach the threshold."""
    k = math.ceil(thr * window)
    videos = frames.groupBy("video").agg(F.min("frame_idx").alias("__start"))
    if k <= 0:
        first = videos.withColumn("first_frame", F.col("__start"))
    else:
        release = _kth_first(slot_firsts(frames, window, is_fire_or_smoke("pred_label")), k)
        first = join_carry(videos, release, ["video"]).withColumnRenamed("__release", "first_frame")
    label = F.when(F.col("first_frame").isNotNull(), "positive").otherwise("negative")
    return first.select("video", label.alias("pred"), "first_frame")


# --- probabilities and gates -----------------------------------------------------------------


def history_prob(
    frames: DataFrame, window: int = 20, scored: Column | None = None, size: int = CHUNK
) -> DataFrame:
    """Share of fire and of smoke labels over the last ``window`` scored frames.

    The history starts full of zeros, so the divisor is always ``window``. Frames that were not
    scored get 0.0 and leave the history unchanged.
    """
    scored = F.lower(F.coalesce("pred_label", F.lit("None"))) != "skipped" if scored is None else scored
    flags = fire_smoke_flags("pred_label")
    done = number_rows(frames.filter(scored), ["video"], ["frame_idx"], chunk_of("frame_idx", size), "__place")
    share = over_recent(
        done,
        ["video"],
        "__place",
        window,
        {"fire_prob": F.sum(flags["fire"]), "smoke_prob": F.sum(flags["smoke"])},
        size,
    ).drop("__place")
    share = share.withColumns({c: F.col(c) / F.lit(float(window)) for c in ("fire_prob", "smoke_prob")})
    rest = frames.filter(~F.coalesce(scored, F.lit(False)))
    return share.unionByName(rest.withColumns({"fire_prob": F.lit(0.0), "smoke_prob": F.lit(0.0)}))


class GateRules:
    """The scoring gate of one channel as a small state machine.

    States 0 .. window-1: eager, that many scored frames since the last positive one.
    States window .. window+period-1: not eager, the counter is ``state - window``.
    Last state: eager at the start, when nothing was scored yet.
    """

    def __init__(self, window: int, period: int):
        self.window, self.period = window, period
        self.start = window + period
        self.states = window + period + 1
        eager = np.arange(self.states)
        eager_state = (eager < window) | (eager == self.start)
        counter = np.where(eager_state, 0, eager - window)
        self.passes = eager_state | (counter + 1 >= period)
        idle = np.where(eager_state, eager, np.minimum(eager + 1, window + period - 1))
        # A frame that passes but is dropped by the motion test resets the counter only.
        still = np.where(eager_state, eager, window)
        aged = np.where(eager < window, eager + 1, window)
        aged = np.where(aged >= window, window, aged)
        # Frame kinds: 0 dropped by motion, 1 scored negative, 2 scored positive.
        positive = np.zeros(self.states, dtype=np.int64)
        self.step = np.stack([np.where(self.passes, after, idle) for after in (still, aged, positive)]).astype(np.int32)

    def map_of(self, kinds: np.ndarray) -> np.ndarray:
        """Final state for every start state."""
        state = np.arange(self.states, dtype=np.int32)
        for kind in kinds.tolist():
            state = self.step[kind][state]
        return state

    def run(self, state: int, kinds: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """Follow one start state; also returns which frames were let through and where eager was on."""
        steps, before, after = self.step.tolist(), [], []
        for kind in kinds.tolist():
            before.append(state)
            state = steps[kind][state]
            after.append(state)
        after = np.array(after, dtype=np.int64)
        passed = self.passes[np.array(before, dtype=np.int64)]
        return int(state), passed, (after < self.window) | (after == self.start)


def _gate_kind(label: Column, dropped: Column) -> Column:
    flags = fire_smoke_flags(label)
    return F.when(dropped, 0).when(flags["smoke"] == 1, 2).otherwise(1).cast("int")


def eager_gate(
    frames: DataFrame,
    period: int = 5,
    window: int = 20,
    boost: bool = False,
    dropped: Column | None = None,
    size: int = CHUNK,
) -> DataFrame:
    """Which frames get scored when a quiet channel is looked at once per ``period`` frames.

    Adds ``passed`` (the gate let the frame through), ``scored`` (and motion did not drop it)
    and ``eager`` (the state after the frame). The gate depends on its own output, but it has
    only ``window + period + 1`` states: each chunk is first reduced to a table "start state ->
    end state", the tables are chained per video, then every chunk is replayed from its own
    start state. No task sees more than one chunk of frames.
    """
    dropped = F.lower(F.coalesce("pred_label", F.lit("None"))) == "skipped" if dropped is None else dropped
    if boost:
        return frames.withColumns({"passed": F.lit(True), "scored": ~dropped, "eager": F.lit(True)})
    rules = GateRules(window, period)
    rows = frames.withColumns(
        {
            "__chunk": chunk_of("frame_idx", size),
            "__place": F.col("frame_idx").cast("long"),
            "__kind": _gate_kind(F.col("pred_label"), dropped),
        }
    )
    keyed = rows.select(
        "video", F.col("__chunk").alias("chunk"), F.col("__place").alias("place"), F.col("__kind").alias("kind")
    )

    def reduce_chunk(g: dict) -> dict:
        # Every video starts in the same state, so its first chunk needs no table.
        first = g["chunk"][0] == 0
        ends = [rules.run(rules.start, g["kind"])[0]] if first else rules.map_of(g["kind"]).tolist()
        table = np.empty(1, dtype=object)
        table[0] = ends
        return {"video": g["video"][:1], "chunk": g["chunk"][:1], "ends": table}

    maps = map_sorted_groups(
        keyed, ["video", "chunk"], ["place"], reduce_chunk, "video string, chunk long, ends array<int>"
    )

    def chain(g: dict) -> dict | None:
        state, starts = rules.start, []
        for chunk, ends in zip(g["chunk"], g["ends"]):
            starts.append(state)
            state = int(ends[0] if chunk == 0 else ends[state])
        if len(starts) == 1:
            return None
        return {"video": g["video"][1:], "chunk": g["chunk"][1:], "state": np.array(starts[1:], dtype=np.int32)}

    starts = map_sorted_groups(maps, ["video"], ["chunk"], chain, "video string, chunk long, state int")

    # A chunk's start state travels as a row in front of its frames: one shuffle brings both.
    lead = starts.select(
        "video",
        F.col("chunk").alias("__chunk"),
        F.lit(0).cast("long").alias("__place"),
        (-1 - F.col("state")).alias("__kind"),
    )
    marked = rows.unionByName(lead, allowMissingColumns=True)

    def replay(g: dict) -> dict:
        kinds, state, at = g["__kind"], rules.start, 0
        if kinds[0] < 0:
            state, at = -1 - int(kinds[0]), 1
        passed, eager = np.zeros(len(kinds), dtype=bool), np.zeros(len(kinds), dtype=bool)
        _, passed[at:], eager[at:] = rules.run(state, kinds[at:])
        return {"passed": passed, "eager": eager}

    flags = [T.StructField("passed", T.BooleanType()), T.StructField("eager", T.BooleanType())]
    out = append_to_sorted_groups(marked, ["video", "__chunk"], ["__place"], ["__kind"], replay, flags)
    out = out.filter(F.col("__kind") >= 0).withColumn("scored", F.col("passed") & (F.col("__kind") > 0))
    return out.drop("__chunk", "__place", "__kind")


# --- runs, firsts and running values -----------------------------------------------------------


def episodes(frames: DataFrame, gap: int = 30, size: int = CHUNK) -> DataFrame:
    """Detection episodes: a new one starts after at least ``gap`` frames without fire or smoke."""
    hits = frames.filter(is_fire_or_smoke("pred_label")).select("video", "frame_idx")
    numbered = number_runs(
        hits,
        ["video"],
        "frame_idx",
        F.col("frame_idx"),
        lambda previous, current: current - previous - 1 >= gap,
        "__run",
        chunk_of("frame_idx", size),
    ).withColumn("episode", F.col("__run") + 1)
    return numbered.groupBy("video", "episode").agg(
        F.min("frame_idx").alias("start_frame"),
        F.max("frame_idx").alias("end_frame"),
        F.count(F.lit(1)).alias("detections"),
    )


def first_detection(frames: DataFrame, hit: Column | None = None) -> DataFrame:
    hit = is_fire_or_smoke("pred_label") if hit is None else hit
    return frames.groupBy("video").agg(
        F.bool_or(hit).alias("detected"), F.min(F.when(hit, F.col("frame_idx"))).alias("first_frame")
    )


def running_fps(frames: DataFrame, size: int = CHUNK) -> DataFrame:
    """Frames per second over all frames so far: one over the mean elapsed time."""
    out = running(
        frames,
        ["video"],
        "frame_idx",
        {"__time": ("sum", F.col("elapsed_time")), "__frames": ("count", F.col("elapsed_time"))},
        chunk_of("frame_idx", size),
    )
    return out.withColumn("running_fps", mean_rate(F.col("__frames"), F.col("__time"))).drop("__time", "__frames")


def speed_guard(frames: DataFrame, min_fps: float = 5.0, after: int = 10, size: int = CHUNK) -> DataFrame:
    """Frames up to the one at which the mean FPS so far is too low, checked from frame ``after`` on."""
    out = running(
        frames,
        ["video"],
        "frame_idx",
        {
            "__rates": ("sum", frame_fps("elapsed_time")),
            "__frames": ("count", F.col("frame_idx")),
        },
        chunk_of("frame_idx", size),
    )
    out = out.withColumn("mean_fps", F.col("__rates") / F.col("__frames"))
    slow = (F.col("__frames") >= after) & (F.col("mean_fps") < min_fps)
    # A frame stays while no earlier frame was slow.
    stops = out.filter(slow).groupBy("video").agg(F.min("frame_idx").alias("__stop"))
    out = spread_join(out, stops, ["video"], F.col("frame_idx"))
    return out.filter(F.col("__stop").isNull() | (F.col("frame_idx") <= F.col("__stop"))).drop("__rates", "__frames", "__stop")


def best_so_far(
    epochs: DataFrame, key: str = "run", epoch: str = "epoch", metric: str = "metric", size: int = CHUNK
) -> DataFrame:
    """Best value so far and the epoch that set it; ties keep the earlier epoch, start is (0, 0)."""
    pair = F.struct(F.col(metric).cast("double").alias("m"), (-F.col(epoch).cast("long")).alias("e"))
    zero = F.struct(F.lit(0.0).alias("m"), F.lit(0).cast("long").alias("e"))
    value = F.when(F.col(metric) > 0, pair).otherwise(zero)
    out = running(epochs, [key], epoch, {"__best": ("max", value)}, chunk_of(epoch, size))
    return out.withColumns({"best_metric": F.col("__best.m"), "best_epoch": -F.col("__best.e")}).drop("__best")


def tta_mean(scores: DataFrame, r: int, n_classes: int, index: str = "row_id", target: str = "target") -> DataFrame:
    """Mean of every ``r`` consecutive score rows (0-based ``index``); an incomplete last group is dropped."""
    group = F.floor(F.col(index) / F.lit(r)).cast("long")
    out = scores.groupBy(group.alias("group_id")).agg(
        F.count(F.lit(1)).alias("__n"),
        F.array(*[F.avg(F.get("logits", F.lit(i))) for i in range(n_classes)]).alias("logits"),
        F.min_by(target, index).alias(target),
    )
    return out.filter(F.col("__n") == r).drop("__n")


def segment_on_resize(frames: DataFrame, size: int = CHUNK) -> DataFrame:
    """Number the stretches of equal frame size; state of the motion filters restarts with each."""
    return number_runs(
        frames,
        ["video"],
        "frame_idx",
        F.struct("height", "width"),
        lambda a, b: (a["height"] != b["height"]) | (a["width"] != b["width"]),
        "segment",
        chunk_of("frame_idx", size),
    )


# --- registry ----------------------------------------------------------------------------------

METHODS: dict[str, Callable[..., DataFrame]] = {
    "no_temp": no_temp,
    "temp_tpt": tpt_sticky,
    "temp_tpt_sliding": tpt_sliding,
    "temp_tpt_by_detection": tpt_by_detection,
    "temp_stabilize": temp_stabilize,
}


def apply_method(frames: DataFrame, name: str, **params) -> DataFrame:
    """Run a temporal method by name."""
    if name not in METHODS:
        raise ValueError(f"unknown temporal method {name!r}; known: {sorted(METHODS)}")
    return METHODS[name](frames, **params)


_MODELS: dict = {}


def score_frames(df: DataFrame, load_fn: Callable[[], object], predict_fn: Callable, schema: str, key: str = "model") -> DataFrame:
    """Score batches of rows with a model that each Python worker loads once.

    ``predict_fn(model, pandas_frame)`` returns a pandas frame with the columns of ``schema``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if key not in _MODELS:
            _MODELS[key] = load_fn()
        for batch in batches:
            yield predict_fn(_MODELS[key], batch)

    return df.mapInPandas(run, schema)
