"""The stabilizing method end to end: pixels in, a frame log out.

Cheap motion tests decide most frames. Only the active blocks of frames with little motion reach the
block model, and only the pixels of a frame's region reach the frame model.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions import geometry as G
from emberline.functions.scores import argmax_index, argmax_label, fill_skipped, softmax
from emberline.operators import motion as M
from emberline.operators.ordered import join_carry
from emberline.storage import materialize

_ADDED = ("n_active", "n_kept", "active_share", "decision", "roi", "logits", "probs", "pred_label_idx", "pred_label")


def temp_stabilize(
    frames: DataFrame,
    cells: DataFrame,
    width: int,
    height: int,
    block_fn: Callable[[pd.DataFrame], np.ndarray],
    frame_fn: Callable[[DataFrame], DataFrame],
    class_names: Sequence[str],
    shrink: int = 1,
    blk: int = 32,
    diff_thres: float = 5,
    blk_act_thres: float = 0.1,
    frm_act_thres: float = 0.4,
    cls_thres: float = 0.5,
    min_roi: float = 0.5,
    block_value: str | None = None,
) -> DataFrame:
    """``frames`` with ``decision``, ``roi``, ``logits``, ``probs``, ``pred_label_idx`` and ``pred_label``.

    ``cells`` are the frames' pixels (``gray`` or ``b, g, r``), each side shrunk by ``shrink`` for the motion tests.
    ``block_fn`` gives a probability for each row of a pandas batch of blocks, with their ``pixels`` if
    ``block_value`` names a channel. ``frame_fn`` gets the pixels inside the regions and returns
    ``video, frame_idx, logits``. Skipped frames have no region, zero scores, index -1 and the label
    ``skipped``; a frame that the frame model gives no scores has a NULL label. Columns of ``frames`` with
    one of the added names are replaced.
    """
    channels = [c for c in ("gray", "b", "g", "r") if c in cells.columns]
    small = M.downscale(cells, shrink, channels) if shrink > 1 else cells
    w, h = -(-width // shrink), -(-height // shrink)
    blocks = M.to_blocks(M.frame_diff(small, diff_thres), blk, w, h)
    active = materialize(M.active_blocks(blocks, blk * blk, blk_act_thres), "active-blocks")

    rows = frames.drop(*_ADDED)
    n_blocks = -(-w // blk) * -(-h // blk)
    tests = M.skip_decision(rows, active, n_blocks, blk_act_thres, frm_act_thres).drop("n_kept")
    few = tests.filter(F.col("decision") == "roi").select(*M.FRAME)
    asked = join_carry(active, few, M.FRAME, "inner")
    if block_value is not None:
        pixels = M.block_pixels(M.to_blocks(small, blk, w, h), block_value).select(*M.FRAME, "blk_idx", "pixels")
        asked = join_carry(asked, pixels, [*M.FRAME, "blk_idx"])
    kept = M.score_blocks(asked, block_fn, cls_thres).filter("kept")
    rois = M.roi_from_blocks(kept, blk, width, height, min_roi, 1 / shrink)

    whole = G.rect(F.lit(0), F.lit(0), F.lit(width), F.lit(height))
    out = join_carry(tests, rois.withColumnRenamed("roi", "__box"), M.FRAME)
    out = out.withColumn("n_kept", F.coalesce("n_kept", F.lit(0).cast("long")))
    out = out.withColumn("roi", F.when(F.col("decision") == "full", whole).otherwise(F.col("__box"))).drop("__box")
    out = out.withColumn("decision", F.when(F.col("roi").isNull(), "skip").otherwise(F.col("decision")))
    out = materialize(out, "regions")

    scores = frame_fn(M.crop(cells, out.filter(F.col("roi").isNotNull()))).select(*M.FRAME, "logits")
    out = join_carry(out, scores, M.FRAME).withColumn("probs", softmax("logits"))
    names = F.array(*[F.lit(n) for n in class_names])
    out = out.withColumns({"pred_label_idx": argmax_index("probs"), "pred_label": argmax_label("probs", names)})
    return fill_skipped(out, F.col("decision") == "skip", len(class_names))
