"""The whole per-channel loop on a stream of images: gate, motion, region, model, history.

One processor holds what a channel needs: whether it is eager and its counter, the last looked-at image with its change counters, and a
ring of the last model results. The parts depend on each other frame by frame. The gate looks at what the model said before, and motion is
compared between the images that the gate let through only. The state has a fixed size, one image and its counters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from emberline.operators.motion import _DOWN, _TOP, _UP, minimum_roi
from emberline.operators.tiles import _changed

_OUT = (
    "channel long, frame_idx long, passed boolean, scored boolean, x1 int, y1 int, x2 int, y2 int, "
    "label string, fire_prob double, smoke_prob double, eager boolean"
)
_STATE = (
    "last long, seen long, timer long, eager boolean, count int, height int, width int, channels int, "
    "image binary, memory binary, ring binary, at int"
)
FILL = 114  # what an excluded rectangle shows to the model


def region_of(active: np.ndarray, blk: tuple[int, int], min_count: int, least: tuple[int, int]) -> tuple[int, int, int, int] | None:
    """Box around the blocks with at least ``min_count`` active pixels, shifted into the image at the least (width, height)."""
    h, w = active.shape
    rows, cols = np.arange(0, h, blk[0]), np.arange(0, w, blk[1])
    counts = np.add.reduceat(np.add.reduceat(active.astype(np.int64), rows, axis=0), cols, axis=1)
    by, bx = np.nonzero(counts >= min_count)
    if not len(by):
        return None
    box = []
    for low, high, size, extent in (
        (cols[bx.min()], min(cols[bx.max()] + blk[1], w), least[0], w),
        (rows[by.min()], min(rows[by.max()] + blk[0], h), least[1], h),
    ):
        if high - low < size:
            low = min(extent - size, max(0, low - (size - (high - low)) // 2))
            high = low + size
        box.append((int(low), int(high)))
    return box[0][0], box[1][0], box[0][1], box[1][1]


class OnlineChain(StatefulProcessor):
    """See :func:`stream_online_chain`."""

    def __init__(self, score, period, window, thr, active_at, blk, min_count, least, excluded, boost, idle_ms):
        self.score, self.period, self.window, self.thr, self.active_at = score, period, window, thr, active_at
        self.blk, self.min_count, self.least, self.excluded, self.boost, self.idle_ms = blk, min_count, least, excluded, boost, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("state", _STATE)

    def fresh(self) -> None:
        self.eager, self.count, self.image, self.memory = True, 0, None, None
        self.ring, self.at = np.zeros((2, self.window), dtype=np.uint8), 0

    def load(self, saved: tuple) -> tuple[int, int, int]:
        last, seen, timer, self.eager, self.count, h, w, channels, image, memory, ring, self.at = saved
        shape = (h, w, channels)
        self.image = np.frombuffer(bytes(image), dtype=np.uint8).reshape(shape) if h else None
        self.memory = np.frombuffer(bytes(memory), dtype=np.uint8).reshape(shape[:2]).astype(np.int16) if memory else None
        self.ring = np.frombuffer(bytes(ring), dtype=np.uint8).reshape(2, self.window).copy()
        return last, seen, timer

    def save(self, last: int, seen: int, timer: int) -> None:
        h, w, channels = self.image.shape if self.image is not None else (0, 0, 0)
        image = self.image.tobytes() if self.image is not None else b""
        memory = self.memory.astype(np.uint8).tobytes() if self.memory is not None else b""
        self._state.update((last, seen, timer, self.eager, self.count, h, w, channels, image, memory, self.ring.tobytes(), self.at))

    def motion(self, image: np.ndarray) -> tuple[int, int, int, int] | None:
        """The image's region; None on the first image of a size, and without enough motion."""
        before, self.image = self.image, image
        if before is None or before.shape != image.shape:
            self.memory = None
            return None
        changed = _changed(image, before, self.thr)
        memory = np.zeros(changed.shape, np.int16) if self.memory is None else self.memory
        self.memory = np.clip(memory + np.where(changed, _UP, _DOWN), 0, _TOP)
        h, w = changed.shape
        return region_of(self.memory >= self.active_at, self.blk, self.min_count, self.least or minimum_roi(w, h))

    def look(self, image: np.ndarray) -> tuple | None:
        """Region and label of an image that the gate let through, if it gets to the model."""
        box = self.motion(image)
        if box is None:
            return None
        x1, y1, x2, y2 = box
        part = image[y1:y2, x1:x2]
        if self.excluded is not None:
            a, b, c, d = self.excluded
            part = part.copy()
            part[max(0, b - y1) : max(0, d - y1), max(0, a - x1) : max(0, c - x1)] = FILL
        label = self.score(part)
        low = (label or "None").lower()
        self.ring[:, self.at] = low == "fire", low == "fire" or "smoke" in low
        self.at = (self.at + 1) % self.window
        if not self.boost:
            self.eager = bool(self.ring.any())
        return box, label

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, seen, timer = 0, None, None
        if self._state.exists():
            last, seen, timer = self.load(self._state.get())
        else:
            self.fresh()
        batch = pd.concat(list(rows), ignore_index=True)
        batch = batch[batch["frame_idx"] > last].drop_duplicates("frame_idx").sort_values("frame_idx")
        if batch.empty:
            return
        out = []
        for r in batch.itertuples(index=False):
            if seen is not None and r.ms - seen > self.idle_ms:
                self.fresh()
            last, seen = int(r.frame_idx), int(r.ms)
            passed, found = True, None
            if not self.boost and not self.eager:
                self.count += 1
                passed = self.count >= self.period
            if passed:
                self.count = 0
                found = self.look(np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width, r.channels))
            box, label = found or ((None,) * 4, None)
            fire, smoke = (self.ring.sum(axis=1) / self.window).tolist() if found else (0.0, 0.0)
            out.append((key[0], last, passed, found is not None, *box, label, fire, smoke, self.eager))
        if timer is not None:
            self._handle.deleteTimer(timer)
        timer = seen + self.idle_ms + 1
        self._handle.registerTimer(timer)
        self.save(last, seen, timer)
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])
        yield frame.astype({c: "Int32" for c in ("x1", "y1", "x2", "y2")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A channel without frames for long keeps its last frame number only."""
        if self._state.exists():
            last, seen, timer = self.load(self._state.get())
            if timer == expiredTimerInfo.getExpiryTimeInMs():
                self.fresh()
                self.save(last, seen, timer)
        return iter([])

    def close(self) -> None:
        pass


def stream_online_chain(
    images: DataFrame,
    score: Callable[[np.ndarray], str | None],
    period: int = 5,
    window: int = 20,
    thr: float = 1,
    active_at: int = 10,
    blk: tuple[int, int] = (90, 160),
    min_count: int = 200,
    least: tuple[int, int] | None = None,
    excluded: tuple[int, int, int, int] | None = None,
    boost: bool = False,
    idle_ms: int = 600_000,
    delay: str = "1 minute",
) -> DataFrame:
    """``channel, frame_idx, passed, scored, x1, y1, x2, y2, label, fire_prob, smoke_prob, eager`` of a stream of images.

    ``images`` has ``channel, frame_idx, ts, height, width, channels, data``. ``score`` gets the pixels of a region and returns a label. A frame that
    the gate holds back, or that shows no motion, has no region, no label and zero probabilities. Motion starts anew with another frame size, and
    everything starts anew after ``idle_ms`` without a frame, when an event-time timer also empties the state. ``excluded`` is (x1, y1, x2, y2); ``least`` the least (width, height)
    of a region.
    """
    rows = images.withWatermark("ts", delay).select(
        F.col("channel").cast("long").alias("channel"),
        F.col("frame_idx").cast("long").alias("frame_idx"),
        "ts",
        F.unix_millis("ts").alias("ms"),
        *[F.col(c).cast("int").alias(c) for c in ("height", "width", "channels")],
        "data",
    )
    chain = OnlineChain(score, period, window, thr, active_at, blk, min_count, least, excluded, boost, idle_ms)
    return rows.groupBy("channel").transformWithStateInPandas(
        statefulProcessor=chain, outputStructType=_OUT, outputMode="Append", timeMode="EventTime"
    )
