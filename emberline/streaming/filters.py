"""Per-channel filters with keyed state.

Input rows carry ``channel, frame_idx, pred_label`` (plus ``ts`` where event time is used).
The rows of a channel in a micro-batch are put in ``frame_idx`` order; a frame at or before the
last one already handled is late and dropped. State per channel has a fixed size.
The channels of a bucket are handled together, each by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from emberline.functions.labels import fire_smoke_flags, is_detection, is_fire_or_smoke, mean_rate
from emberline.operators.grouped import Arrays
from emberline.operators.motion import TILE, _DOWN, _TOP, _UP
from emberline.operators.temporal import GateRules


def prepare(frames: DataFrame, dropped: Column | None = None) -> DataFrame:
    """Reduce a record stream to what the filters read; labels are judged on the JVM side."""
    flags = fire_smoke_flags("pred_label")
    low = F.lower(F.coalesce("pred_label", F.lit("None")))
    return frames.select(
        F.col("channel").cast("long").alias("channel"),
        F.col("frame_idx").cast("long").alias("frame_idx"),
        "pred_label",
        is_detection("pred_label").alias("hit"),
        flags["fire"].alias("fire"),
        flags["smoke"].alias("smoke"),
        (low == "skipped" if dropped is None else dropped).alias("dropped"),
    )


BUCKETS = 512


class ChannelFilter(StatefulProcessor):
    """Orders each channel's rows, drops late ones and keeps one row of numbers for each channel.

    A key is a bucket of channels, see :func:`_run`: a call of Python and of the state store serves all channels of it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("state", "channels binary, last binary, data binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        batch = batch[batch["frame_idx"].notna()]
        # rows without a channel have a bucket of their own
        channel = batch["channel"].fillna(0).to_numpy(np.int64) if key[0] >= 0 else np.zeros(len(batch), np.int64)
        frame = batch["frame_idx"].to_numpy(np.int64)
        known, last, data = (np.frombuffer(bytes(v), t) for v, t in zip(self._state.get(), ("<i8", "<i8", "<i4"))) if self._state.exists() else (np.zeros(0, t) for t in ("<i8", "<i8", "<i4"))
        every = np.union1d(known, channel)
        old = np.searchsorted(every, known)
        states = np.tile(self.fresh(), (len(every), 1))
        states[old] = data.reshape(len(known), states.shape[1])
        lasts = np.zeros(len(every), np.int64)
        lasts[old] = last
        of = np.searchsorted(every, channel)
        by = np.lexsort((frame, of))
        by = by[frame[by] > lasts[of[by]]]
        by = by[np.append(True, (np.diff(of[by]) != 0) | (np.diff(frame[by]) != 0))[: len(by)]]
        if not len(by):
            return
        columns = {c: batch[c].to_numpy()[by] for c in batch.columns}
        columns["frame_idx"], of = frame[by], of[by]
        first = np.flatnonzero(np.append(True, np.diff(of) != 0))
        out = []
        for low, high in zip(first.tolist(), [*first[1:].tolist(), len(of)]):
            i = of[low]
            states[i], found = self.apply(states[i], {c: v[low:high] for c, v in columns.items()})
            lasts[i] = columns["frame_idx"][high - 1]
            out.append(found)
        self._state.update((every.astype("<i8").tobytes(), lasts.astype("<i8").tobytes(), states.astype("<i4").tobytes()))
        found = {c: np.concatenate([o[c] for o in out]) for c in out[0]}
        yield pd.DataFrame({"channel": columns["channel"], "frame_idx": columns["frame_idx"], **found})

    def close(self) -> None:
        pass


class TptFilter(ChannelFilter):
    """Sticky, sliding or by-detection persistence threshold."""

    def __init__(self, mode: str, window: int, thr: float):
        self.mode, self.window, self.thr = mode, window, thr

    def fresh(self) -> np.ndarray:
        return np.zeros(self.window, dtype=np.int32)

    def apply(self, state: np.ndarray, batch: Arrays):
        hits = batch["hit"].astype(bool)
        index = batch["frame_idx"]
        bar = self.thr * self.window
        if self.mode == "by_detection":
            total = int(state[0]) + np.cumsum(hits)
            counts = np.minimum(total, self.window)
            state[0] = min(int(total[-1]), self.window)
        else:
            # what each frame changes in its slot: against the frame before in the same slot, or the state
            slot = (index - 1) % self.window
            by = np.argsort(slot, kind="stable")
            first = np.append(True, slot[by][1:] != slot[by][:-1])
            value = hits[by].astype(np.int32)
            if self.mode == "sticky":  # a slot once set stays set
                seen = np.cumsum(value) - value
                start = np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
                before = np.where(seen > seen[start], 1, state[slot[by]])
                value = np.maximum(value, before)
            else:
                before = np.where(first, state[slot[by]], np.append(0, value[:-1]))
            change = np.empty(len(by), dtype=np.int64)
            change[by] = value - before
            counts = int(state.sum()) + np.cumsum(change)
            last = np.append(first[1:], True)
            state[slot[by][last]] = value[last]
        low = counts < bar if self.mode == "sliding" else counts <= bar
        return state, {"pred_label": np.where(low, "none", batch["pred_label"].astype(object))}


class HistoryFilter(ChannelFilter):
    """Fire and smoke share of the last scored frames; state is a ring of both flags."""

    def __init__(self, window: int):
        self.window = window

    def fresh(self) -> np.ndarray:
        return np.zeros(2 * self.window + 1, dtype=np.int32)

    def apply(self, state: np.ndarray, batch: Arrays):
        w, at = self.window, int(state[-1])
        scored = ~batch["dropped"].astype(bool)
        out = np.zeros((len(scored), 2))
        n = int(scored.sum())
        for k, name in enumerate(("fire", "smoke")):
            ring = state[k * w : (k + 1) * w]
            # the ring from its oldest value on, then the batch: sums of the last w
            flags = np.concatenate([ring[at:], ring[:at], batch[name][scored].astype(np.int32)])
            sums = np.append(0, np.cumsum(flags))
            out[scored, k] = (sums[w + 1 :] - sums[1 : n + 1]) / w
            ring[:] = np.roll(flags[n:], (at + n) % w)
        at = (at + n) % w
        state[-1] = at
        return state, {"fire_prob": out[:, 0], "smoke_prob": out[:, 1]}


class GateFilter(ChannelFilter):
    """The scoring gate; state is one small integer."""

    def __init__(self, window: int, period: int):
        self.rules = GateRules(window, period)

    def fresh(self) -> np.ndarray:
        return np.array([self.rules.start], dtype=np.int32)

    def apply(self, state: np.ndarray, batch: Arrays):
        dropped = batch["dropped"].astype(bool)
        kinds = np.where(dropped, 0, np.where(batch["smoke"] == 1, 2, 1))
        after, passed, eager = self.rules.run(int(state[0]), kinds)
        return np.array([after]), {"passed": passed, "scored": passed & ~dropped, "eager": eager}


def _run(prepared: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    """Channels are dealt to ``BUCKETS`` keys by a hash; rows without a channel are a key of their own."""
    bucket = F.when(F.col("channel").isNotNull(), F.pmod(F.xxhash64("channel"), F.lit(BUCKETS))).otherwise(-1)
    return prepared.withColumn("bucket", bucket.cast("long")).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None"
    )


def stream_tpt(frames: DataFrame, mode: str = "sticky", window: int = 20, thr: float = 0.5) -> DataFrame:
    if mode not in ("sticky", "sliding", "by_detection"):
        raise ValueError(f"unknown persistence mode {mode!r}")
    return _run(prepare(frames), TptFilter(mode, window, thr), "channel long, frame_idx long, pred_label string")


def stream_history_prob(frames: DataFrame, window: int = 20, dropped: Column | None = None) -> DataFrame:
    return _run(
        prepare(frames, dropped), HistoryFilter(window), "channel long, frame_idx long, fire_prob double, smoke_prob double"
    )


def stream_eager_gate(frames: DataFrame, period: int = 5, window: int = 20, dropped: Column | None = None) -> DataFrame:
    return _run(
        prepare(frames, dropped),
        GateFilter(window, period),
        "channel long, frame_idx long, passed boolean, scored boolean, eager boolean",
    )


class MotionMemoryFilter(StatefulProcessor):
    """Previous pixels and change counters of one tile of one channel, from the last change of the frame size on."""

    def __init__(self, thr: float, active_at: int, tile: int):
        self.thr, self.active_at, self.tile = thr, active_at, tile

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("state", "last long, segment long, pixels binary, memory binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.tile * self.tile
        saved = self._state.get() if self._state.exists() else None
        if saved:
            last, segment = saved[0], saved[1]
            pixels = np.frombuffer(bytes(saved[2]), dtype="<i4").copy()
            memory = np.frombuffer(bytes(saved[3]), dtype="<i4").copy()
        else:
            last, segment, pixels, memory = 0, None, np.full(n, -1, dtype=np.int32), np.zeros(n, dtype=np.int32)
        batch = pd.concat(list(rows), ignore_index=True)
        batch = batch[batch["frame_idx"] > last]
        if batch.empty:
            return
        for frame, part in batch.groupby("frame_idx", sort=True):
            if segment != (now := int(part["segment"].iloc[0])):
                segment, pixels, memory = now, np.full(n, -1, dtype=np.int32), np.zeros(n, dtype=np.int32)
            place = (part["y"].to_numpy() % self.tile) * self.tile + part["x"].to_numpy() % self.tile
            value = part["gray"].to_numpy().astype(np.int32)
            known = pixels[place] >= 0
            step = np.where(known, np.where(np.abs(value - pixels[place]) > self.thr, _UP, _DOWN), 0)
            memory[place] = np.clip(memory[place] + step, 0, _TOP)
            pixels[place] = value
            yield pd.DataFrame(
                {
                    "video": part["video"].to_numpy(),
                    "frame_idx": part["frame_idx"].to_numpy(),
                    "y": part["y"].to_numpy(),
                    "x": part["x"].to_numpy(),
                    "memory": memory[place],
                    "active": memory[place] >= self.active_at,
                }
            )
            last = int(frame)
        self._state.update((last, segment, pixels.astype("<i4").tobytes(), memory.astype("<i4").tobytes()))

    def close(self) -> None:
        pass


def stream_motion_memory(
    cells: DataFrame, thr: float = 1, active_at: int = 10, tile: int = TILE, segment: str | None = None
) -> DataFrame:
    """Change counters on a stream of ``video, frame_idx, y, x, gray``; state is keyed by tile.

    With ``segment``, the number of changes of the frame size so far, a tile starts anew with every segment.
    """
    rows = cells.select(
        "video",
        F.col("frame_idx").cast("long").alias("frame_idx"),
        F.col("y").cast("int").alias("y"),
        F.col("x").cast("int").alias("x"),
        F.col("gray").cast("int").alias("gray"),
        (F.col(segment) if segment else F.lit(0)).cast("long").alias("segment"),
        F.floor(F.col("y") / F.lit(tile)).cast("int").alias("ty"),
        F.floor(F.col("x") / F.lit(tile)).cast("int").alias("tx"),
    )
    return rows.groupBy("video", "ty", "tx").transformWithStateInPandas(
        statefulProcessor=MotionMemoryFilter(thr, active_at, tile),
        outputStructType="video string, frame_idx long, y int, x int, memory int, active boolean",
        outputMode="Append",
        timeMode="None",
    )


# --- event time --------------------------------------------------------------------------------


def stream_episodes(frames: DataFrame, gap: str = "30 seconds", delay: str | None = "1 minute") -> DataFrame:
    """Detection episodes on event time: a session closes after ``gap`` without fire or smoke.

    In Append mode a session is given out once the watermark has passed its end. Without ``delay`` the frames have a watermark already.
    """
    hits = (frames.withWatermark("ts", delay) if delay else frames).filter(is_fire_or_smoke("pred_label"))
    return (
        hits.groupBy("channel", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("detections"), F.max("ts").alias("last_ts"))
        .select("channel", F.col("w.start").alias("start_ts"), "last_ts", "detections")
    )


def stream_fps(frames: DataFrame, width: str = "10 seconds", slide: str | None = None, delay: str = "1 minute") -> DataFrame:
    """Frames and mean rate per channel and time window; in Append mode once the watermark has passed a window's end."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    frames_of, total = F.count(F.lit(1)), F.sum("elapsed_time")
    return (
        frames.withWatermark("ts", delay)
        .groupBy("channel", window.alias("w"))
        .agg(frames_of.alias("frames"), mean_rate(frames_of, total).alias("fps"))
        .select("channel", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "frames", "fps")
    )


def late_frames(frames: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Drop repeated frames; rows older than the watermark are dropped by the engine."""
    return frames.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["channel", "frame_idx"])
