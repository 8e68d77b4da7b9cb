"""The sweep of the stabilizing method against one run of the method for each trial."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.functions.labels import is_fire_or_smoke
from emberline.operators import metrics, motion as M
from emberline.operators.stabilize import temp_stabilize
from emberline.plans import sweep_stabilize as SS

W, H = 12, 8
NAMES = ["Fire", "None", "SmokeOnly"]


def block_fn(batch):
    return 1 / (1 + np.exp(3 - 5 * batch["frac"].to_numpy()))


def logits(pixels, keys):
    return pixels.groupBy(*keys).agg((F.avg("gray") - 100).alias("m")).select(*keys, F.array(F.col("m") / 9, F.lit(0.1), -F.col("m") / 9).alias("logits"))


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(4)
    rows = []
    for video in ("a", "b"):
        image = rng.integers(0, 256, (H, W))
        for f in range(1, 13):
            y, x = rng.integers(0, H - 2), rng.integers(0, W - 3)
            if f % 4:
                image[y : y + 2 + f % 3, x : x + 3 + f % 5] = rng.integers(0, 256)
            rows += [(video, f, i, j, int(image[i, j])) for i in range(H) for j in range(W)]
    return spark.createDataFrame(rows, "video string, frame_idx long, y int, x int, gray int").cache()


def test_every_trial_as_its_own_run(spark, cells):
    space = {"shrink": [2, 1], "diff_thres": [5, 40], "min_roi": [0.6], "blk_size": [2, 4], "cls_thres": [0.7, 0.3], "blk_act_thres": [0.4, 0.1], "frm_act_thres": [0.5, 0.2]}
    frames = cells.select("video", "frame_idx").distinct().withColumn("truth", F.col("frame_idx") % 2 == 0)
    got = {tuple(r[p] for p in space): r for r in SS.sweep_stabilize(frames, F.col("truth"), cells, W, H, block_fn, logits, NAMES, space).collect()}
    assert len(got) == 64 and sorted(r.trial_id for r in got.values()) == list(range(64))
    assert len({(r.skipped, r.full, r.roi, r.tp, r.fp) for r in got.values()}) > 8
    for n, values in enumerate(itertools.product(*space.values())):
        if n % 7:
            continue
        p = dict(zip(space, values))
        one = temp_stabilize(
            frames, cells, W, H, block_fn, lambda px: logits(px, M.FRAME), NAMES, p["shrink"], p["blk_size"], p["diff_thres"],
            p["blk_act_thres"], p["frm_act_thres"], p["cls_thres"], p["min_roi"],
        )
        rows = one.collect()
        want = metrics.classification_metrics(spark.createDataFrame(rows, one.schema), is_fire_or_smoke("pred_label"), F.col("truth")).first()
        r = got[tuple(float(v) if k == "diff_thres" else v for k, v in p.items())]
        assert (r.tp, r.fp, r.tn, r.fn, r.f1_score, r.accuracy) == (want.tp, want.fp, want.tn, want.fn, want.f1_score, want.accuracy), p
        count = lambda d: sum(x.decision == d for x in rows)
        assert (r.frames, r.skipped, r.full, r.roi) == (24, count("skip"), count("full"), count("roi")), p
        area = sum((x.roi.x2 - x.roi.x1) * (x.roi.y2 - x.roi.y1) for x in rows if x.roi)
        assert r.pixels == area and r.blocks == sum(x.n_active for x in rows if x.decision != "full"), p
        assert abs(r.fps - 24 / (24 * 1e-3 + r.blocks * 1e-4 + area * 1e-8)) < 1e-9


def test_pixels_of_blocks_and_wrong_space(spark, cells):
    space = {"diff_thres": [5], "shrink": [1], "blk_size": [4], "blk_act_thres": [0.1], "frm_act_thres": [0.9], "cls_thres": {"type": "range", "values": [0.2, 0.9, 0.2]}, "min_roi": [0.5]}
    frames = cells.select("video", "frame_idx").distinct()
    mean = lambda batch: np.array([np.mean(p) / 255 for p in batch["pixels"]])
    rows = SS.sweep_stabilize(frames, F.lit(True), cells, W, H, mean, logits, NAMES, space, block_value="gray").orderBy("trial_id").collect()
    assert [r.cls_thres for r in rows] == [0.2, 0.4, 0.6, 0.8]
    assert [r.roi for r in rows] == sorted((r.roi for r in rows), reverse=True) and rows[0].roi > rows[-1].roi
    with pytest.raises(ValueError):
        SS.sweep_stabilize(frames, F.lit(True), cells, W, H, mean, logits, NAMES, {"shrink": [1]})
