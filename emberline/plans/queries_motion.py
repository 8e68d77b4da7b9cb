"""Queries over the motion operators."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from emberline.deploy import ship
from emberline.functions import geometry as G
from emberline.functions import labels as L
from emberline.operators import metrics as MT
from emberline.operators import motion as M
from emberline.operators import temporal as T
from emberline.operators import tiles as TI
from emberline.plans import report as R
from emberline.plans import sweep as SW
from emberline.plans import sweep_stabilize as SS
from emberline.plans import views as V
from emberline.plans.registry import query
from emberline.sources import media
from emberline.storage import fresh_path

VC, VD = V.CELLS, V.DIFFS
THR = 20  # difference of two 8-bit values of the test frames that counts as motion
W8 = {"width": 8, "height": 8}

FRAC = f"""motion AS (SELECT video, frame_idx, y // 4 AS by_, x // 4 AS bx_, CAST(sum(CAST(coalesce(diff > {THR}, FALSE) AS INT)) AS BIGINT) AS n
  FROM diffs GROUP BY 1, 2, 3, 4)"""


def _diffs(spark, sf, thr=THR):
    return M.frame_diff(V.cells(spark, sf), thr)


def _motion(spark, sf):
    return M.block_motion(M.to_blocks(_diffs(spark, sf), 4, **W8), 16)


def _blocks_out(df):
    return df.select("video", "frame_idx", "by", "bx", "blk_idx", "fg_count", "frac")


@query(
    "frame_diff",
    f"WITH {VD} SELECT video, frame_idx, y, x, coalesce(diff, -1) AS diff, coalesce(diff > {THR}, FALSE) AS fg FROM diffs",
)
def _frame_diff(spark, sf):
    d = _diffs(spark, sf)
    return d.select(
        "video",
        "frame_idx",
        "y",
        "x",
        F.coalesce("diff", F.lit(-1)).alias("diff"),
        F.coalesce("fg", F.lit(False)).alias("fg"),
    )


@query(
    "frame_diff_color",
    f"""WITH {V.BGR}, p AS (SELECT *, lag(b) OVER w AS pb, lag(g) OVER w AS pg, lag(r) OVER w AS pr FROM bgr
      WINDOW w AS (PARTITION BY video, y, x ORDER BY frame_idx))
    SELECT video, frame_idx, y, x, coalesce(CAST(floor(abs(r - pr) * 0.299::DOUBLE + abs(g - pg) * 0.587::DOUBLE
      + abs(b - pb) * 0.114::DOUBLE + 0.5) AS INTEGER), -1) AS diff FROM p""",
)
def _frame_diff_color(spark, sf):
    d = M.frame_diff(V.cells_bgr(spark, sf), THR)
    return d.select("video", "frame_idx", "y", "x", F.coalesce("diff", F.lit(-1)).alias("diff"))


@query(
    "downscale",
    f"""WITH {VC} SELECT video, frame_idx, y // 2 AS y, x // 2 AS x, CAST(round_even(avg(gray), 0) AS INTEGER) AS gray
    FROM cells GROUP BY 1, 2, 3, 4""",
)
def _downscale(spark, sf):
    return M.downscale(V.cells(spark, sf), 2)


@query(
    "to_blocks",
    f"""WITH {VC} SELECT video, frame_idx, y, x, y // 3 AS "by", x // 3 AS bx, y // 3 * 3 + x // 3 AS blk_idx FROM cells""",
)
def _to_blocks(spark, sf):
    return M.to_blocks(V.cells(spark, sf), 3, **W8).drop("gray")


@query(
    "to_blocks_truncate",
    f"""WITH {VC} SELECT video, frame_idx, y // 3 AS "by", x // 5 AS bx, y // 3 * 2 + x // 5 AS blk_idx, count(*) AS pixels,
    CAST(sum(gray) AS BIGINT) AS total FROM cells GROUP BY 1, 2, 3, 4, 5""",
)
def _to_blocks_truncate(spark, sf):
    b = M.to_blocks(V.cells(spark, sf), (3, 5), **W8, mode="truncate")
    return b.groupBy("video", "frame_idx", "by", "bx", "blk_idx").agg(
        F.count(F.lit(1)).alias("pixels"), F.sum("gray").alias("total")
    )


@query(
    "to_blocks_crop",
    f"""WITH {VC} SELECT video, frame_idx, y, x, y // 3 AS "by", x // 3 AS bx, y // 3 * 2 + x // 3 AS blk_idx FROM cells
    WHERE y < 6 AND x < 6""",
)
def _to_blocks_crop(spark, sf):
    return M.to_blocks(V.cells(spark, sf), 3, **W8, mode="crop").drop("gray")


@query(
    "active_blocks",
    f"""WITH {VD}, {FRAC} SELECT video, frame_idx, by_ AS "by", bx_ AS bx, by_ * 2 + bx_ AS blk_idx, n AS fg_count,
    n / CAST(16 AS DOUBLE) AS frac FROM motion WHERE n / 16.0 > 0.25""",
)
def _active(spark, sf):
    return _blocks_out(M.active_blocks(M.to_blocks(_diffs(spark, sf), 4, **W8), 16, 0.25))


@query(
    "active_blocks_count",
    f"""WITH {VD}, {FRAC} SELECT video, frame_idx, by_ AS "by", bx_ AS bx, by_ * 2 + bx_ AS blk_idx, n AS fg_count,
    n / CAST(16 AS DOUBLE) AS frac FROM motion WHERE n >= 6""",
)
def _active_count(spark, sf):
    return _blocks_out(M.active_blocks(M.to_blocks(_diffs(spark, sf), 4, **W8), 16, min_count=6))


@query(
    "motion_totals",
    f"""WITH {VD}, {FRAC} SELECT video, frame_idx, CAST(sum(n) AS BIGINT) AS fg_total,
    CAST(sum(CASE WHEN n >= 6 THEN n ELSE 0 END) AS BIGINT) AS fg_inside FROM motion GROUP BY 1, 2""",
)
def _totals(spark, sf):
    return M.motion_totals(_motion(spark, sf), 6)


def _logistic(batch: pd.DataFrame) -> np.ndarray:
    return np.round(1 / (1 + np.exp(2 - 4 * batch["frac"].to_numpy())), 9)


SCORED = f"""{FRAC}, scored AS (SELECT *, n / CAST(16 AS DOUBLE) AS frac,
  round(1 / (1 + exp(2 - 4 * (n / CAST(16 AS DOUBLE)))), 9) AS prob FROM motion WHERE n / 16.0 > 0.25)"""


def _scored(spark, sf):
    ship(spark)
    active = M.active_blocks(M.to_blocks(_diffs(spark, sf), 4, **W8), 16, 0.25)
    return M.score_blocks(active, _logistic, 0.4)


@query(
    "score_blocks",
    f"""WITH {VD}, {SCORED} SELECT video, frame_idx, by_ * 2 + bx_ AS blk_idx, prob, prob >= 0.4 AS kept FROM scored""",
)
def _score_blocks(spark, sf):
    return _scored(spark, sf).select("video", "frame_idx", "blk_idx", "prob", "kept")


@query(
    "block_feature_fn",
    f"""WITH {VC} SELECT video, frame_idx, y // 4 * 2 + x // 4 AS blk_idx, round(stddev_pop(gray), 6) AS spread
    FROM cells GROUP BY 1, 2, 3""",
)
def _block_feature(spark, sf):
    ship(spark)
    pixels = M.block_pixels(M.to_blocks(V.cells(spark, sf), 4, **W8))
    scored = M.score_blocks(pixels, lambda b: np.stack(b["pixels"].to_numpy()).std(axis=1), 0.0)
    return scored.select("video", "frame_idx", "blk_idx", F.round("prob", 6).alias("spread"))


@query(
    "block_pixels",
    f"""WITH {VC} SELECT video, frame_idx, y // 4 * 2 + x // 4 AS blk_idx, max(gray) FILTER (y % 4 = 0 AND x % 4 = 0) AS first,
    max(gray) FILTER (y % 4 = 3 AND x % 4 = 3) AS last, CAST(16 AS INTEGER) AS n FROM cells GROUP BY 1, 2, 3""",
)
def _block_pixels(spark, sf):
    pixels = M.block_pixels(M.to_blocks(V.cells(spark, sf), 4, **W8))
    return pixels.select(
        "video",
        "frame_idx",
        "blk_idx",
        F.get("pixels", F.lit(0)).alias("first"),
        F.get("pixels", F.lit(15)).alias("last"),
        F.size("pixels").alias("n"),
    )


@query(
    "skip_decision",
    f"""WITH {VD}, {SCORED}, every AS (SELECT video, frame_idx FROM emb),
    c AS (SELECT e.video, e.frame_idx, count(s.prob) AS n_active, count(s.prob) FILTER (s.prob >= 0.4) AS n_kept
      FROM every e LEFT JOIN scored s ON s.video = e.video AND s.frame_idx = e.frame_idx GROUP BY 1, 2)
    SELECT video, frame_idx, n_active, n_kept, n_active / CAST(4 AS DOUBLE) AS active_share,
    CASE WHEN n_active = 0 THEN 'skip' WHEN n_active / 4.0 >= 0.8 THEN 'full' WHEN n_kept = 0 THEN 'skip' ELSE 'roi' END AS decision
    FROM c""",
)
def _skip(spark, sf):
    every = V._numbered_vectors(spark, sf).select("video", "frame_idx")
    return M.skip_decision(every, _scored(spark, sf), 4, 0.25, 0.8)


def _roi_sql(mode: str) -> str:
    """Boxes of kept 2x2 blocks on an 8x8 frame; at least 5 wide and 5 high."""
    box = f"""kept AS (SELECT video, frame_idx, y // 2 AS by_, x // 2 AS bx_ FROM diffs GROUP BY 1, 2, 3, 4
      HAVING sum(CAST(coalesce(diff > {THR}, FALSE) AS INT)) >= 3),
    box AS (SELECT video, frame_idx, count(*) AS n_kept, min(bx_) * 2 AS x1, min(by_) * 2 AS y1, max(bx_ + 1) * 2 AS x2,
      max(by_ + 1) * 2 AS y2 FROM kept GROUP BY 1, 2)"""
    if mode == "clip":
        side = {
            a: (
                f"greatest(0, {a}1 - CASE WHEN {a}2 - {a}1 < 5 THEN (5 - ({a}2 - {a}1)) // 2 ELSE 0 END)",
                f"least(8, {a}2 + CASE WHEN {a}2 - {a}1 < 5 THEN (5 - ({a}2 - {a}1)) // 2 ELSE 0 END)",
            )
            for a in "xy"
        }
    else:
        side = {}
        for a in "xy":
            start = f"greatest(0, least(8 - 5, {a}1 - (5 - ({a}2 - {a}1)) // 2))"
            side[a] = (
                f"CASE WHEN {a}2 - {a}1 < 5 THEN {start} ELSE {a}1 END",
                f"CASE WHEN {a}2 - {a}1 < 5 THEN {start} + 5 ELSE {a}2 END",
            )
    cols = ", ".join(f"CAST({side[a][i]} AS INTEGER) AS {a}{i + 1}" for a in "xy" for i in (0, 1))
    return f"{VD}, {box}, rois AS (SELECT video, frame_idx, n_kept, {cols} FROM box)"


def _rois(spark, sf, mode):
    kept = M.active_blocks(M.to_blocks(_diffs(spark, sf), 2, **W8), 4, min_count=3)
    return M.roi_from_blocks(kept, 2, 8, 8, min_roi=0.65, mode=mode)


@query("roi_clip", f"WITH {_roi_sql('clip')} SELECT * FROM rois")
def _roi_clip(spark, sf):
    return _rois(spark, sf, "clip").select("video", "frame_idx", "n_kept", "roi.*")


@query("roi_shift", f"WITH {_roi_sql('shift')} SELECT * FROM rois")
def _roi_shift(spark, sf):
    return _rois(spark, sf, "shift").select("video", "frame_idx", "n_kept", "roi.*")


@query(
    "crop",
    f"""WITH {_roi_sql('clip')} SELECT c.video, c.frame_idx, c.y, c.x, c.gray FROM cells c JOIN rois r
    ON r.video = c.video AND r.frame_idx = c.frame_idx AND c.x >= x1 AND c.x < x2 AND c.y >= y1 AND c.y < y2""",
)
def _crop(spark, sf):
    return M.crop(V.cells(spark, sf), _rois(spark, sf, "clip"))


@query(
    "motion_memory",
    f"""WITH RECURSIVE {VD}, mem AS (SELECT video, y, x, frame_idx, 0 AS memory FROM diffs WHERE frame_idx = 1
      UNION ALL SELECT d.video, d.y, d.x, d.frame_idx,
        greatest(0, least(24, m.memory + CASE WHEN d.diff > {THR} THEN 4 ELSE -1 END))
      FROM mem m JOIN diffs d ON d.video = m.video AND d.y = m.y AND d.x = m.x AND d.frame_idx = m.frame_idx + 1)
    SELECT video, frame_idx, y, x, memory, memory >= 10 AS active FROM mem""",
)
def _memory(spark, sf):
    ship(spark)
    return M.motion_memory(_diffs(spark, sf))


@query(
    "two_point_mask",
    f"""WITH {VC} SELECT video, frame_idx, y, x, gray <> first_value(gray) OVER (PARTITION BY video, y, x ORDER BY frame_idx) AS fg
    FROM cells""",
)
def _two_point(spark, sf):
    return M.two_point_mask(V.cells(spark, sf)).drop("gray")


@query(
    "cell_mean_diff",
    f"""WITH {VD} SELECT video, frame_idx, y // 4 AS "by", x // 4 AS bx, avg(diff) AS mean_diff, avg(diff) > 15 AS moving
    FROM diffs WHERE diff IS NOT NULL GROUP BY 1, 2, 3, 4""",
)
def _cell_mean(spark, sf):
    return M.cell_mean_diff(_diffs(spark, sf), 4, 15)


@query(
    "median_diff_threshold",
    f"""WITH {VD}, l AS (SELECT DISTINCT video, frame_idx, diff FROM diffs WHERE diff IS NOT NULL),
    m AS (SELECT video, frame_idx, median(diff) AS med FROM l GROUP BY 1, 2)
    SELECT d.video, d.frame_idx, d.y, d.x, m.med AS median_diff, d.diff > m.med AS fg FROM diffs d JOIN m USING (video, frame_idx)""",
)
def _median(spark, sf):
    out = M.median_diff_threshold(_diffs(spark, sf)).filter(F.col("median_diff").isNotNull())
    return out.select("video", "frame_idx", "y", "x", "median_diff", "fg")


@query(
    "motion_pattern",
    f"""WITH {V.POINTS} SELECT vec_id, count(*) AS n_points, round(var_pop(atan2(dy, dx)), 6) AS flicker,
    round(-avg(dy), 6) AS upward, var_pop(atan2(dy, dx)) > 3.0 AND -avg(dy) > 0.005 AS fire_like FROM points GROUP BY vec_id
    HAVING count(*) >= 2""",
)
def _pattern(spark, sf):
    out = M.motion_pattern(V.points(spark, sf), ["vec_id"], 3.0, 0.005)
    return out.withColumns({c: F.round(c, 6) for c in ("flicker", "upward")})


_FLOW = """SELECT vec_id, count(*) AS n_points, round(avg(sqrt(dx * dx + dy * dy)), 6) AS mean_length,
  avg(CASE WHEN sqrt(dx * dx + dy * dy) > 0.2 THEN 1.0 ELSE 0.0 END) AS moving_ratio, {skip} AS skip FROM points GROUP BY vec_id"""


@query("flow_skip_mean", f"WITH {V.POINTS} " + _FLOW.format(skip="avg(sqrt(dx * dx + dy * dy)) < 0.15"))
def _flow_mean(spark, sf):
    out = M.flow_skip(V.points(spark, sf), ["vec_id"], "mean", min_mean=0.15, min_length=0.2)
    return out.withColumn("mean_length", F.round("mean_length", 6))


@query(
    "flow_skip_ratio",
    f"WITH {V.POINTS} "
    + _FLOW.format(skip="count(*) < 10 OR avg(CASE WHEN sqrt(dx * dx + dy * dy) > 0.2 THEN 1.0 ELSE 0.0 END) < 0.25"),
)
def _flow_ratio(spark, sf):
    out = M.flow_skip(V.points(spark, sf), ["vec_id"], "ratio", min_length=0.2, min_ratio=0.25)
    return out.withColumn("mean_length", F.round("mean_length", 6))


@query(
    "top_regions",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS area, l_discount * 50 AS mean_change,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place
      FROM lineitem WHERE l_quantity >= 10)
    SELECT l_orderkey, l_linenumber, l_partkey, area, CAST(place AS INTEGER) AS place FROM r WHERE place <= 2 AND mean_change >= 2""",
)
def _top_regions(spark, sf):
    li = V.table(spark, sf, "lineitem").withColumns(
        {"area": F.col("l_quantity"), "mean_change": F.col("l_discount") * 50}
    )
    out = M.top_regions(
        li, ["l_orderkey"], 2, 10, 2.0, tie=["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    )
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "area", "place")


@query(
    "sample_blocks",
    f"""WITH {VD}, {FRAC}, o AS (SELECT *, by_ * 2 + bx_ AS blk_idx, row_number() OVER (PARTITION BY video, frame_idx
      ORDER BY (frame_idx * 31 + (by_ * 2 + bx_) * 17) % 7, by_ * 2 + bx_) AS place FROM motion)
    SELECT video, frame_idx, blk_idx, n AS fg_count FROM o WHERE place <= 2""",
)
def _sample(spark, sf):
    order = (F.col("frame_idx") * 31 + F.col("blk_idx") * 17) % 7
    return M.sample_blocks(_motion(spark, sf), 2, order).select("video", "frame_idx", "blk_idx", "fg_count")


@query(
    "roi_gray_diff",
    f"""WITH {_roi_sql('clip')} SELECT d.video, d.frame_idx, CAST(0 AS INTEGER) AS region_id, round(avg(d.diff), 6) AS mean_change
    FROM diffs d JOIN rois r ON r.video = d.video AND r.frame_idx = d.frame_idx AND d.x >= x1 AND d.x < x2 AND d.y >= y1 AND d.y < y2
    WHERE d.diff IS NOT NULL GROUP BY 1, 2""",
)
def _roi_diff(spark, sf):
    regions = _rois(spark, sf, "clip").withColumn("region_id", F.lit(0))
    out = M.roi_gray_diff(_diffs(spark, sf), regions)
    return out.withColumn("mean_change", F.round("mean_change", 6))


# --- the stabilizing method ---------------------------------------------------------------------------
#
# 2 x 2 blocks on the 8 x 8 frames. The block model is ``_logistic``; the frame model scores the mean gray value of the region.

_CLIP = ", ".join(
    f"CAST({v} AS INTEGER) AS {a}{i}"
    for a in "xy"
    for i, v in (
        (1, f"greatest(0, {a}1 - CASE WHEN {a}2 - {a}1 < 5 THEN (5 - ({a}2 - {a}1)) // 2 ELSE 0 END)"),
        (2, f"least(8, {a}2 + CASE WHEN {a}2 - {a}1 < 5 THEN (5 - ({a}2 - {a}1)) // 2 ELSE 0 END)"),
    )
)
STABILIZED = f"""{VD}, counted AS (SELECT video, frame_idx, y // 2 AS by_, x // 2 AS bx_, sum(CAST(coalesce(diff > {THR}, FALSE) AS INT)) AS n
    FROM diffs GROUP BY 1, 2, 3, 4),
  active AS (SELECT * FROM counted WHERE n >= 3),
  tests AS (SELECT e.video, e.frame_idx, count(a.n) AS n_active FROM emb e LEFT JOIN active a ON a.video = e.video AND a.frame_idx = e.frame_idx GROUP BY 1, 2),
  box AS (SELECT a.video, a.frame_idx, min(bx_) * 2 AS x1, min(by_) * 2 AS y1, max(bx_ + 1) * 2 AS x2, max(by_ + 1) * 2 AS y2
    FROM active a JOIN tests t ON t.video = a.video AND t.frame_idx = a.frame_idx WHERE t.n_active < 4 AND a.n = 4 GROUP BY 1, 2),
  rois AS (SELECT video, frame_idx, {_CLIP} FROM box
    UNION ALL SELECT video, frame_idx, 0, 8, 0, 8 FROM tests WHERE n_active >= 4),
  means AS (SELECT c.video, c.frame_idx, avg(c.gray) - 128 AS m FROM cells c JOIN rois r
    ON r.video = c.video AND r.frame_idx = c.frame_idx AND c.x >= x1 AND c.x < x2 AND c.y >= y1 AND c.y < y2 GROUP BY 1, 2),
  stabilized AS (SELECT t.video, t.frame_idx, t.n_active, x1, y1, x2, y2,
    CASE WHEN r.video IS NULL THEN 'skip' WHEN n_active >= 4 THEN 'full' ELSE 'roi' END AS decision,
    CASE WHEN r.video IS NULL THEN 'skipped' WHEN m >= 1 THEN 'Fire' WHEN m >= -1 THEN 'None' ELSE 'SmokeOnly' END AS pred_label,
    CASE WHEN r.video IS NULL THEN 0.0::DOUBLE ELSE round(exp(m / 4) / (exp(m / 4) + exp(0.25::DOUBLE) + exp(-m / 4)), 6) END AS fire
    FROM tests t LEFT JOIN rois r ON r.video = t.video AND r.frame_idx = t.frame_idx
    LEFT JOIN means s ON s.video = t.video AND s.frame_idx = t.frame_idx)"""


def _region_scores(pixels):
    mean = pixels.groupBy(*M.FRAME).agg((F.avg("gray") - 128).alias("m"))
    return mean.select(*M.FRAME, F.array(F.col("m") / 4, F.lit(0.25), -F.col("m") / 4).alias("logits"))


def _stabilized(spark, sf):
    ship(spark)
    every = V._numbered_vectors(spark, sf).select("video", "frame_idx")
    return T.apply_method(
        every,
        "temp_stabilize",
        cells=V.cells(spark, sf),
        **W8,
        block_fn=_logistic,
        frame_fn=_region_scores,
        class_names=V.CLASS_NAMES,
        blk=2,
        diff_thres=THR,
        blk_act_thres=0.5,
        frm_act_thres=0.25,
        cls_thres=0.8,
        min_roi=0.65,
    )


@query("temp_stabilize", f"WITH {STABILIZED} SELECT * FROM stabilized")
def _temp_stabilize(spark, sf):
    fire = F.round(F.get("probs", F.lit(0)), 6).alias("fire")
    return _stabilized(spark, sf).select("video", "frame_idx", "n_active", "roi.*", "decision", "pred_label", fire)


@query(
    "temp_stabilize_metrics",
    f"""WITH {STABILIZED}, p AS (SELECT pred_label IN ('Fire', 'SmokeOnly') AS pred, CAST(substr(video, 5) AS INTEGER) % 2 = 0 AS truth FROM stabilized),
    c AS (SELECT count(*) FILTER (pred AND truth) AS tp, count(*) FILTER (pred AND NOT truth) AS fp,
      count(*) FILTER (NOT pred AND NOT truth) AS tn, count(*) FILTER (NOT pred AND truth) AS fn FROM p)
    SELECT *, (tp + tn) / (tp + fp + tn + fn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
      coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1_score, coalesce(fp / nullif(fp + tn, 0), 0) AS fpr FROM c""",
)
def _temp_stabilize_metrics(spark, sf):
    truth = F.substring("video", 5, 9).cast("int") % 2 == 0
    return MT.classification_metrics(_stabilized(spark, sf), L.is_fire_or_smoke("pred_label"), truth)


_SPACE = {
    "diff_thres": [THR],
    "shrink": [1, 2],
    "blk_size": [2],
    "blk_act_thres": {"type": "range", "values": [0.3, 0.61, 0.3]},
    "frm_act_thres": [0.25, 0.4],
    "cls_thres": {"type": "range", "values": [0.5, 0.81, 0.1]},
    "min_roi": {"type": "range", "values": [0.5, 0.71, 0.1]},
}
_TRIALS = ", ".join(
    f"({i}, {', '.join(map(str, v))})" for i, v in enumerate(itertools.product(*(SW.values_of(s) for s in _SPACE.values())))
)


def _clipped(side: str) -> str:
    low, high, least = f"{side}1 * shrink", f"{side}2 * shrink", "CAST(floor(min_roi * 8) AS BIGINT)"
    grow = f"CASE WHEN {high} - {low} < {least} THEN ({least} - ({high} - {low})) // 2 ELSE 0 END"
    return f"greatest(0, {low} - {grow}) AS {side}1, least(8, {high} + {grow}) AS {side}2"


STABILIZE_SWEEP = f"""{VC}, trials(trial_id, diff_thres, shrink, blk_size, blk_act_thres, frm_act_thres, cls_thres, min_roi) AS (VALUES {_TRIALS}),
  scaled AS (SELECT 1 AS shrink, video, frame_idx, y, x, gray FROM cells
    UNION ALL SELECT 2, video, frame_idx, y // 2, x // 2, CAST(round_even(avg(gray), 0) AS INTEGER) FROM cells GROUP BY 2, 3, 4, 5),
  changes AS (SELECT *, abs(gray - lag(gray) OVER (PARTITION BY shrink, video, y, x ORDER BY frame_idx)) AS diff FROM scaled),
  counted AS (SELECT shrink, video, frame_idx, y // 2 AS by_, x // 2 AS bx_, sum(CAST(coalesce(diff > {THR}, FALSE) AS INT)) / CAST(4 AS DOUBLE) AS frac FROM changes GROUP BY 1, 2, 3, 4, 5),
  scored AS (SELECT *, round(1 / (1 + exp(2 - 4 * frac)), 9) AS prob FROM counted),
  tests AS (SELECT t.*, s.video, s.frame_idx, count(*) FILTER (frac > blk_act_thres) AS n_active, count(*) FILTER (frac > blk_act_thres AND prob >= cls_thres) AS n_kept,
    min(bx_) FILTER (frac > blk_act_thres AND prob >= cls_thres) * 2 AS x1, max(bx_ + 1) FILTER (frac > blk_act_thres AND prob >= cls_thres) * 2 AS x2,
    min(by_) FILTER (frac > blk_act_thres AND prob >= cls_thres) * 2 AS y1, max(by_ + 1) FILTER (frac > blk_act_thres AND prob >= cls_thres) * 2 AS y2
    FROM trials t JOIN scored s ON s.shrink = t.shrink GROUP BY ALL),
  decided AS (SELECT * EXCLUDE (x1, x2, y1, y2), {_clipped("x")}, {_clipped("y")},
    CASE WHEN n_active = 0 THEN 'skip' WHEN n_active / (16 / (shrink * shrink)) >= frm_act_thres THEN 'full' WHEN n_kept = 0 THEN 'skip' ELSE 'roi' END AS decision FROM tests),
  regions AS (SELECT trial_id, video, frame_idx, decision, CASE decision WHEN 'full' THEN 0 ELSE n_active END AS n_scored,
    CASE decision WHEN 'full' THEN 0 ELSE x1 END AS x1, CASE decision WHEN 'full' THEN 8 ELSE x2 END AS x2,
    CASE decision WHEN 'full' THEN 0 ELSE y1 END AS y1, CASE decision WHEN 'full' THEN 8 ELSE y2 END AS y2 FROM decided),
  boxes AS (SELECT DISTINCT video, frame_idx, x1, x2, y1, y2 FROM regions WHERE decision <> 'skip'),
  means AS (SELECT b.*, avg(c.gray) - 128 AS m FROM boxes b JOIN cells c USING (video, frame_idx) WHERE c.x >= x1 AND c.x < x2 AND c.y >= y1 AND c.y < y2 GROUP BY ALL),
  preds AS (SELECT r.*, CAST(substr(r.video, 5) AS INTEGER) % 2 = 0 AS truth, decision <> 'skip' AND coalesce(m >= 1 OR m < -1, FALSE) AS pred
    FROM regions r LEFT JOIN means s ON r.decision <> 'skip' AND (r.video, r.frame_idx, r.x1, r.x2, r.y1, r.y2) = (s.video, s.frame_idx, s.x1, s.x2, s.y1, s.y2)),
  sums AS (SELECT trial_id, count(*) AS frames, count(*) FILTER (decision = 'skip') AS skipped, count(*) FILTER (decision = 'full') AS "full", count(*) FILTER (decision = 'roi') AS roi,
    sum(n_scored)::BIGINT AS blocks, coalesce(sum((x2 - x1) * (y2 - y1)) FILTER (decision <> 'skip'), 0)::BIGINT AS pixels,
    count(*) FILTER (pred AND truth) AS tp, count(*) FILTER (pred AND NOT truth) AS fp, count(*) FILTER (NOT pred AND NOT truth) AS tn, count(*) FILTER (NOT pred AND truth) AS fn
    FROM preds GROUP BY 1),
  swept AS (SELECT trial_id, shrink, blk_act_thres::DOUBLE AS blk_act_thres, frm_act_thres::DOUBLE AS frm_act_thres, cls_thres::DOUBLE AS cls_thres, min_roi::DOUBLE AS min_roi,
    frames, skipped, "full", roi, blocks, pixels, tp, fp, tn, fn, (tp + tn) / frames AS accuracy, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1_score,
    round(frames / (frames * 0.001::DOUBLE + blocks * 0.0001::DOUBLE + pixels * 0.00000001::DOUBLE), 6) AS fps FROM sums JOIN trials USING (trial_id))"""


def _box_scores(pixels, keys):
    mean = pixels.groupBy(*keys).agg((F.avg("gray") - 128).alias("m"))
    return mean.select(*keys, F.array(F.col("m") / 4, F.lit(0.25), -F.col("m") / 4).alias("logits"))


def _swept(spark, sf):
    ship(spark)
    every = V._numbered_vectors(spark, sf).select("video", "frame_idx")
    truth = F.substring("video", 5, 9).cast("int") % 2 == 0
    out = SS.sweep_stabilize(every, truth, V.cells(spark, sf), 8, 8, _logistic, _box_scores, V.CLASS_NAMES, _SPACE)
    params = ["trial_id", "shrink", "blk_act_thres", "frm_act_thres", "cls_thres", "min_roi"]
    counts = ["frames", "skipped", "full", "roi", "blocks", "pixels", "tp", "fp", "tn", "fn"]
    return out.select(*params, *counts, "accuracy", "f1_score", F.round("fps", 6).alias("fps"))


@query("sweep_stabilize", f"WITH {STABILIZE_SWEEP} SELECT * FROM swept")
def _sweep_stabilize(spark, sf):
    return _swept(spark, sf)


@query("best_stabilize", f"WITH {STABILIZE_SWEEP} SELECT * FROM swept ORDER BY f1_score DESC, trial_id LIMIT 1")
def _best_stabilize(spark, sf):
    return R.best_trial(_swept(spark, sf), "f1_score")


# --- packed tiles ------------------------------------------------------------------------------------


@query(
    "tile_block_motion",
    f"""WITH {VD}, {FRAC} SELECT video, frame_idx, by_ AS "by", bx_ AS bx, by_ * 2 + bx_ AS blk_idx, n AS fg_count,
    n / CAST(16 AS DOUBLE) AS frac FROM motion""",
)
def _tile_motion(spark, sf):
    ship(spark)
    return TI.block_motion(V.tiles(spark, sf), THR, 4, 8, tile=8)


@query(
    "tile_motion_memory",
    f"""WITH RECURSIVE {VD}, mem AS (SELECT video, y, x, frame_idx, 0 AS memory FROM diffs WHERE frame_idx = 1
      UNION ALL SELECT d.video, d.y, d.x, d.frame_idx,
        greatest(0, least(24, m.memory + CASE WHEN d.diff > {THR} THEN 4 ELSE -1 END))
      FROM mem m JOIN diffs d ON d.video = m.video AND d.y = m.y AND d.x = m.x AND d.frame_idx = m.frame_idx + 1),
    b AS (SELECT video, frame_idx, y // 2 AS by_, x // 2 AS bx_, sum(CAST(memory >= 10 AS INT)) AS n FROM mem GROUP BY 1, 2, 3, 4)
    SELECT video, frame_idx, by_ AS "by", bx_ AS bx, by_ * 4 + bx_ AS blk_idx, CAST(n AS BIGINT) AS fg_count, n / CAST(4 AS DOUBLE) AS frac FROM b""",
)
def _tile_memory(spark, sf):
    ship(spark)
    return TI.memory_blocks(TI.motion_memory(V.tiles(spark, sf), THR), 2, 8, tile=8)


@query(
    "frame_block_motion",
    f"""WITH {V.BGR}, p AS (SELECT *, lag(b) OVER w AS pb, lag(g) OVER w AS pg, lag(r) OVER w AS pr FROM bgr
      WINDOW w AS (PARTITION BY video, y, x ORDER BY frame_idx)),
    m AS (SELECT video, frame_idx, y // 2 AS by_, x // 2 AS bx_, CAST(sum(CAST(coalesce(floor(abs(r - pr) * 0.299::DOUBLE
      + abs(g - pg) * 0.587::DOUBLE + abs(b - pb) * 0.114::DOUBLE + 0.5) > {THR}, FALSE) AS INT)) AS BIGINT) AS n FROM p GROUP BY 1, 2, 3, 4)
    SELECT video, frame_idx, by_ AS "by", bx_ AS bx, by_ * 4 + bx_ AS blk_idx, n AS fg_count, n / CAST(4 AS DOUBLE) AS frac FROM m""",
)
def _frame_motion(spark, sf):
    ship(spark)
    return TI.frame_block_motion(V.images(spark, sf), THR, 2, 8)


# --- frames that change their size -----------------------------------------------------------------------

RESIZED_MEMORY = f"""{V.RESIZED}, mem AS (SELECT video, segment, y, x, frame_idx, 0 AS memory FROM diffs WHERE diff IS NULL
    UNION ALL SELECT d.video, d.segment, d.y, d.x, d.frame_idx, greatest(0, least(24, m.memory + CASE WHEN d.diff > {THR} THEN 4 ELSE -1 END))
    FROM mem m JOIN diffs d ON d.video = m.video AND d.segment = m.segment AND d.y = m.y AND d.x = m.x AND d.frame_idx = m.frame_idx + 1)"""


@query("frame_diff_resize", f"WITH {V.RESIZED} SELECT video, frame_idx, y, x, diff, diff > {THR} AS fg FROM diffs")
def _frame_diff_resize(spark, sf):
    out = M.frame_diff(V.resized_cells(spark, sf), THR, segment="segment")
    return out.select("video", "frame_idx", "y", "x", "diff", "fg")


@query("motion_memory_resize", f"WITH RECURSIVE {RESIZED_MEMORY} SELECT video, frame_idx, y, x, memory, memory >= 10 AS active FROM mem")
def _memory_resize(spark, sf):
    ship(spark)
    masks = M.frame_diff(V.resized_cells(spark, sf), THR, segment="segment")
    out = M.motion_memory(masks, size=4, segment="segment", fan=2)
    return out.select("video", "frame_idx", "y", "x", "memory", "active")


@query(
    "tile_memory_resize",
    f"""WITH RECURSIVE {RESIZED_MEMORY} SELECT video, frame_idx, y // 2 AS "by", x // 2 AS bx, CAST(sum(CAST(memory >= 10 AS INT)) AS BIGINT) AS fg_count
    FROM mem GROUP BY 1, 2, 3, 4""",
)
def _tile_memory_resize(spark, sf):
    ship(spark)
    memory = TI.motion_memory(V.resized_tiles(spark, sf), THR, size=4, segment="segment", fan=2)
    return TI.memory_blocks(memory, 2, 16, tile=16).select("video", "frame_idx", "by", "bx", "fg_count")


@query(
    "tile_block_motion_resize",
    f"""WITH {V.RESIZED} SELECT video, frame_idx, y // 2 AS "by", x // 2 AS bx, CAST(sum(CAST(coalesce(diff > {THR}, FALSE) AS INT)) AS BIGINT) AS fg_count
    FROM diffs GROUP BY 1, 2, 3, 4""",
)
def _tile_motion_resize(spark, sf):
    ship(spark)
    out = TI.block_motion(V.resized_tiles(spark, sf), THR, 2, 16, tile=16, segment="segment")
    return out.select("video", "frame_idx", "by", "bx", "fg_count")


@query(
    "motion_memory_tree",
    f"""WITH RECURSIVE {VD}, mem AS (SELECT video, y, x, frame_idx, 0 AS memory FROM diffs WHERE frame_idx = 1
      UNION ALL SELECT d.video, d.y, d.x, d.frame_idx, greatest(0, least(24, m.memory + CASE WHEN d.diff > {THR} THEN 4 ELSE -1 END))
      FROM mem m JOIN diffs d ON d.video = m.video AND d.y = m.y AND d.x = m.x AND d.frame_idx = m.frame_idx + 1)
    SELECT video, frame_idx, y, x, memory FROM mem""",
)
def _memory_tree(spark, sf):
    """Chunks of two frames, joined four at a time."""
    ship(spark)
    return M.motion_memory(_diffs(spark, sf), tile=4, size=2, fan=4).select("video", "frame_idx", "y", "x", "memory")


# --- image files -----------------------------------------------------------------------------------------


def _image_folder(spark, sf):
    """The colour frames as image files, read again."""
    ship(spark)
    folder = fresh_path(spark, "images")
    media.write_image_frames(V.images(spark, sf), folder)
    return media.read_image_frames(spark, folder)


@query("image_frames", f"WITH {V.BGR} SELECT video, frame_idx, y, x, b, g, r FROM bgr")
def _image_frames(spark, sf):
    return media.image_cells(_image_folder(spark, sf))


@query(
    "image_blocks",
    f"""WITH {V.BGR}, c AS (SELECT video, frame_idx, y // 4 * 2 + x // 4 AS blk_idx, y % 4 * 4 + x % 4 AS place, unnest([r, g, b]) AS v, unnest([0, 16, 32]) AS first FROM bgr)
    SELECT video, frame_idx, blk_idx, first + place AS place, round(v / 255.0::DOUBLE, 6) AS value FROM c""",
)
def _image_blocks(spark, sf):
    blocks = media.image_blocks(_image_folder(spark, sf), 4)
    out = blocks.select("video", "frame_idx", "blk_idx", F.posexplode("values").alias("place", "v"))
    return out.select("video", "frame_idx", "blk_idx", "place", F.round(F.col("v"), 6).alias("value"))
