"""The stabilizing method for a whole grid of its parameters, with the metrics of every trial.

Frames are not copied per trial. For each setting of shrink, difference threshold and block size, a frame's active blocks fall into the
cells of a small table: between which two activity thresholds their share lies, and between which two class thresholds their
probability. Sums and bounds of the table's upper corners are the number of active blocks, the kept blocks and their box for every
pair of thresholds. What is left of a frame are its different outcomes (skipped, whole, or a region), each with the
trials that lead to it. The frame model sees each region once, and trials meet counts only.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import geometry as G
from emberline.functions.labels import is_fire_or_smoke
from emberline.functions.scores import argmax_label, softmax
from emberline.operators import motion as M
from emberline.operators.metrics import with_metrics
from emberline.operators.ordered import join_carry
from emberline.plans.sweep import param_grid, trial_count, values_of
from emberline.storage import materialize

PARAMS = ("diff_thres", "shrink", "blk_size", "blk_act_thres", "frm_act_thres", "cls_thres", "min_roi")
REGION = [*M.FRAME, "x1", "y1", "x2", "y2"]
SKIP, FULL, ROI = 0, 1, 2


def _grid(width: int, height: int, shrink: int, blk: int) -> int:
    return -(-(-(-width // shrink)) // blk) * -(-(-(-height // shrink)) // blk)


def setting_blocks(cells: DataFrame, width: int, height: int, shrinks: Sequence[int], diff_thres: Sequence[float], blk_sizes: Sequence[int], least: float, value: str | None = None) -> DataFrame:
    """``(video, frame_idx, shrink, blk_size, diff_thres, by, bx, blk_idx, frac)`` of all blocks with a share above ``least``; with their ``pixels`` if ``value`` names a channel.

    Pixels are compared once for each shrink, and counted in blocks of the sizes' common divisor with one column per difference threshold.
    """
    base = math.gcd(*blk_sizes)
    names = [f"n{i}" for i in range(len(diff_thres))]
    channels = [c for c in ("gray", "b", "g", "r") if c in cells.columns]
    tables = []
    for shrink in shrinks:
        small = M.downscale(cells, shrink, channels) if shrink > 1 else cells
        w, h = -(-width // shrink), -(-height // shrink)
        counts = M.to_blocks(M.frame_diff(small, 0), base, w, h).groupBy(*M.FRAME, "by", "bx")
        counts = counts.agg(*[F.sum((F.col("diff") > t).cast("long")).alias(n) for n, t in zip(names, diff_thres)])
        for blk in blk_sizes:
            up = blk // base
            rows = counts
            if up > 1:
                rows = counts.groupBy(*M.FRAME, *(F.floor(F.col(c) / up).cast("int").alias(c) for c in ("by", "bx"))).agg(*[F.sum(n).alias(n) for n in names])
            each = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("diff_thres"), (F.col(n) / F.lit(blk * blk)).alias("frac")) for n, t in zip(names, diff_thres)]))
            rows = rows.withColumn("each", each).select(*M.FRAME, F.lit(shrink).alias("shrink"), F.lit(blk).alias("blk_size"), "each.diff_thres", "by", "bx", "each.frac")
            rows = rows.where(F.col("frac") > least).withColumn("blk_idx", (F.col("by") * -(-w // blk) + F.col("bx")).cast("int"))
            if value is not None:
                pixels = M.block_pixels(M.to_blocks(small, blk, w, h), value).select(*M.FRAME, "blk_idx", "pixels")
                rows = join_carry(rows, pixels, [*M.FRAME, "blk_idx"], "inner")
            tables.append(rows)
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _above(column: str, thresholds: Sequence[float], strict: bool) -> Column:
    """How many of the thresholds a value is above."""
    over = [(F.col(column) > t) if strict else (F.col(column) >= t) for t in thresholds]
    return sum((F.coalesce(o, F.lit(False)).cast("int") for o in over), F.lit(0))


def _boxes(low: np.ndarray, high: np.ndarray, blk: int, scale: float, extent: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """One side of the regions, as :func:`motion.roi_from_blocks` clips them."""
    a = np.floor(low * blk / scale).astype(np.int64)
    b = np.floor((high + 1) * blk / scale).astype(np.int64)
    least = math.floor(share * extent)
    grow = np.where(b - a < least, (least - (b - a)) // 2, 0)
    return np.maximum(0, a - grow), np.minimum(extent, b + grow)


_OUTCOMES = "video string, frame_idx long, kind int, x1 int, y1 int, x2 int, y2 int, n_scored long, trials array<int>"


def outcomes(corners: DataFrame, width: int, height: int, space: Mapping[str, list]) -> DataFrame:
    """Different outcomes of each frame under each setting, with their trials; trials without any active block are left out.

    ``corners`` has for each frame and setting the ``table`` of its blocks: ``(i, j, n, least_x, most_x, least_y, most_y)``, ``i`` and ``j`` being the numbers of
    activity and class thresholds that its blocks pass. ``n_scored`` is the number of blocks that the block model sees.
    """
    acts, shares, classes, rois = (space[p] for p in ("blk_act_thres", "frm_act_thres", "cls_thres", "min_roi"))
    order = np.arange(trial_count(space)).reshape([len(space[p]) for p in space])
    order = np.transpose(order, [list(space).index(p) for p in PARAMS])
    far = 1 << 30

    def of_setting(part: pa.Table, d: float, shrink: int, blk: int) -> pa.Table:
        n = part.num_rows
        cells = part.column("table").combine_chunks()
        row = np.repeat(np.arange(n), np.diff(cells.offsets.to_numpy()))
        i, j, count, *bounds = (cells.flatten().field(c).to_numpy() for c in ("i", "j", "n", "least_x", "most_x", "least_y", "most_y"))
        dense = np.zeros((5, n, len(acts) + 1, len(classes) + 1), np.int64)
        dense[1:] = far
        # the largest as the smallest of the negative values
        for k, v in enumerate((count, bounds[0], -bounds[1], bounds[2], -bounds[3])):
            dense[k, row, i, j] = v
        back = dense[:, :, ::-1, ::-1]
        counts = back[0].cumsum(axis=1).cumsum(axis=2)[:, ::-1, ::-1]
        corner = np.minimum.accumulate(np.minimum.accumulate(back[1:], axis=2), axis=3)[:, :, ::-1, ::-1]
        n_blocks = _grid(width, height, shrink, blk)
        scale = 1 / shrink
        at = tuple(space[p].index(v) for p, v in (("diff_thres", d), ("shrink", shrink), ("blk_size", blk)))
        found = []
        for (a, _), (s, share), (c, _), (m, roi) in itertools.product(*map(enumerate, (acts, shares, classes, rois))):
            active, kept = counts[:, a + 1, 0], counts[:, a + 1, c + 1]
            low_x, high_x, low_y, high_y = corner[:, :, a + 1, c + 1]
            full = (active > 0) & (active / n_blocks >= share)
            region = (active > 0) & ~full & (kept > 0)
            x1, x2 = _boxes(np.where(region, low_x, 0), np.where(region, -high_x, 0), blk, scale, width, roi)
            y1, y2 = _boxes(np.where(region, low_y, 0), np.where(region, -high_y, 0), blk, scale, height, roi)
            kind = np.where(full, FULL, np.where(region, ROI, SKIP))
            box = [np.where(full, whole, np.where(region, v, 0)) for v, whole in ((x1, 0), (y1, 0), (x2, width), (y2, height))]
            trial = int(order[at + (a, s, c, m)])
            found.append(np.stack([np.arange(n), kind, *box, np.where(full, 0, active), np.full(n, trial)])[:, active > 0])
        rows = np.concatenate(found, axis=1)
        rows = rows[:, np.lexsort(rows[::-1])]
        first = np.flatnonzero(np.append(True, (rows[:-1, 1:] != rows[:-1, :-1]).any(axis=0))) if rows.shape[1] else np.zeros(0, np.int64)
        head = rows[:, first]
        columns = [part.column(c).combine_chunks().take(pa.array(head[0])) for c in M.FRAME]
        columns += [pa.array(v, pa.int32()) for v in head[1:6]] + [pa.array(head[6])]
        trials = pa.ListArray.from_arrays(pa.array(np.append(first, rows.shape[1]), pa.int32()), pa.array(rows[7], pa.int32()))
        return pa.table([*columns, trials], names=[*M.FRAME, "kind", "x1", "y1", "x2", "y2", "n_scored", "trials"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for key in {k: None for k in zip(*(table.column(c).to_pylist() for c in ("diff_thres", "shrink", "blk_size")))}:
                mask = np.logical_and.reduce([table.column(c).to_numpy() == v for c, v in zip(("diff_thres", "shrink", "blk_size"), key)])
                yield from of_setting(table.filter(pa.array(mask)), *key).to_batches()

    return corners.mapInArrow(run, _OUTCOMES)


def sweep_stabilize(
    frames: DataFrame,
    truth: Column,
    cells: DataFrame,
    width: int,
    height: int,
    block_fn: Callable[[pd.DataFrame], np.ndarray],
    frame_fn: Callable[[DataFrame, list[str]], DataFrame],
    class_names: Sequence[str],
    space: Mapping,
    block_value: str | None = None,
    costs: tuple[float, float, float] = (1e-3, 1e-4, 1e-8),
) -> DataFrame:
    """A row for each trial of ``space`` (lists or ranges of ``PARAMS``), in the grid's order: parameters, frames by decision, frame-level metrics, and load.

    ``frames`` are ``video, frame_idx`` and what ``truth`` needs. ``block_fn`` is as in :func:`stabilize.temp_stabilize`; ``frame_fn`` gets the pixels of regions and the
    columns that name a region, and returns those columns and ``logits``. A skipped frame, and one without scores, counts as negative. ``fps`` is what the trial would
    reach at ``costs``: seconds for a frame's motion test, for a block and for a pixel of the frame model.
    """
    if sorted(space) != sorted(PARAMS):
        raise ValueError(f"the parameters are {', '.join(PARAMS)}")
    space = {p: values_of(space[p]) for p in space}
    space["diff_thres"] = [float(v) for v in space["diff_thres"]]
    acts, shares, classes = (space[p] for p in ("blk_act_thres", "frm_act_thres", "cls_thres"))
    blocks = setting_blocks(cells, width, height, space["shrink"], space["diff_thres"], space["blk_size"], min(acts), block_value)
    blocks = materialize(blocks, "setting-blocks")

    setting = [*M.FRAME, "shrink", "blk_size", "diff_thres"]
    n_blocks = F.lit(0)
    for s, b in itertools.product(space["shrink"], space["blk_size"]):
        n_blocks = F.when((F.col("shrink") == s) & (F.col("blk_size") == b), _grid(width, height, s, b)).otherwise(n_blocks)
    # the block model sees the blocks of frames that some trial does not take whole
    few = blocks.groupBy(*setting).agg(F.sum((F.col("frac") > max(acts)).cast("long")).alias("n")).where(F.col("n") / n_blocks < max(shares))
    asked = join_carry(blocks, few.drop("n"), setting, "inner")
    scored = M.score_blocks(asked, block_fn, 0).select(*setting, "by", "bx", "prob")
    rows = join_carry(blocks.drop("pixels"), scored, [*setting, "by", "bx"])
    rows = rows.withColumns({"i": _above("frac", acts, True), "j": _above("prob", classes, False)})
    # the table of a frame has as many cells as pairs of thresholds, whatever its number of blocks
    bounds = [f(c).alias(f"{n}_{c[1]}") for c in ("bx", "by") for f, n in ((F.min, "least"), (F.max, "most"))]
    cells_of = rows.groupBy(*setting, "i", "j").agg(F.count(F.lit(1)).alias("n"), *bounds)
    # thresholds may be in any order: ranks stand for them
    corners = cells_of.groupBy(*setting).agg(F.collect_list(F.struct("i", "j", "n", "least_x", "most_x", "least_y", "most_y")).alias("table"))
    ranked = {p: sorted(v) if p in ("blk_act_thres", "cls_thres") else v for p, v in space.items()}
    found = materialize(outcomes(corners, width, height, ranked), "outcomes")

    regions = found.where(F.col("kind") != SKIP).select(*REGION).distinct()
    pixels = join_carry(cells, regions, M.FRAME, "inner").where(G.inside("y", "x", G.rect(*(F.col(c) for c in REGION[2:]))))
    scores = frame_fn(pixels, REGION).select(*REGION, "logits")
    names = F.array(*[F.lit(n) for n in class_names])
    scores = scores.select(*REGION, is_fire_or_smoke(argmax_label(softmax("logits"), names)).alias("pred"))

    facts = frames.select(*M.FRAME, truth.alias("truth"))
    rows = join_carry(join_carry(found, scores, REGION), facts, M.FRAME, "inner")
    size = F.when(F.col("kind") != SKIP, (F.col("x2") - F.col("x1")).cast("long") * (F.col("y2") - F.col("y1"))).otherwise(0)
    pred = F.coalesce(F.col("pred"), F.lit(False))
    sums = {"full": F.col("kind") == FULL, "roi": F.col("kind") == ROI, "tp": pred & F.col("truth"), "fp": pred & ~F.col("truth")}
    counts = rows.withColumns({"size": size, "trial_id": F.explode("trials")}).groupBy("trial_id")
    counts = counts.agg(*[F.sum(c.cast("long")).alias(n) for n, c in sums.items()], F.sum("n_scored").alias("blocks"), F.sum("size").alias("pixels"))
    all_ = facts.agg(F.count(F.lit(1)).alias("frames"), F.coalesce(F.sum(F.col("truth").cast("long")), F.lit(0)).alias("positives"))

    spark = frames.sparkSession
    trials = join_carry(param_grid(spark, ranked), counts, ["trial_id"]).fillna(0, ["full", "roi", "tp", "fp", "blocks", "pixels"])
    out = trials.join(F.broadcast(all_))  # one row
    out = out.withColumns({"skipped": F.col("frames") - F.col("full") - F.col("roi"), "fn": F.col("positives") - F.col("tp"), "tn": F.col("frames") - F.col("positives") - F.col("fp")})
    seconds = F.col("frames") * costs[0] + F.col("blocks") * costs[1] + F.col("pixels") * costs[2]
    out = with_metrics(out).withColumn("fps", F.when(seconds > 0, F.col("frames") / seconds))
    return out.drop("positives")
