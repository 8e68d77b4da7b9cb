"""Packed tiles and whole images must give what the pixel tables give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators import motion as M
from emberline.operators import tiles as TI
from emberline.operators.grouped import map_sorted_groups
from emberline.sources.media import image_cells

H, W, N, THR = 22, 29, 17, 12


def video(seed, channels):
    rng = np.random.default_rng(seed)
    frames = [rng.integers(0, 256, (H, W, channels), dtype=np.uint8)]
    for _ in range(N - 1):
        f = frames[-1].copy()
        y, x = rng.integers(0, H - 6), rng.integers(0, W - 6)
        f[y : y + 6, x : x + 6] = rng.integers(0, 256, (6, 6, channels))
        frames.append(f)
    return frames


@pytest.fixture(scope="module", params=[1, 3], ids=["gray", "color"])
def images(request, spark):
    c = request.param
    rows = [
        (f"v{v}", t, H, W, c, bytearray(f.tobytes())) for v in range(3) for t, f in enumerate(video(v, c), 1)
    ]
    return spark.createDataFrame(
        rows[::-1], "video string, frame_idx int, height int, width int, channels int, data binary"
    ).repartition(5)


def counts(df):
    return {(r.video, r.frame_idx, r.by, r.bx): (r.blk_idx, r.fg_count, r.frac) for r in df.collect()}


def from_cells(images, blk):
    diffs = M.frame_diff(image_cells(images), THR)
    return counts(M.block_motion(M.to_blocks(diffs, blk, W, H), blk * blk)), diffs


@pytest.mark.parametrize("tile,blk,size", [(8, 4, 1024), (16, 16, 5), (5, 5, 3)])
def test_block_motion(images, tile, blk, size):
    want, _ = from_cells(images, blk)
    assert counts(TI.block_motion(TI.image_tiles(images, tile), THR, blk, W, tile, size)) == want
    assert counts(TI.frame_block_motion(images, THR, blk, W, size=size)) == want
    assert any(v[1] for v in want.values())


@pytest.mark.parametrize("batch", [10000, 2])
def test_small_arrow_batches(spark, images, batch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        want, _ = from_cells(images, 4)
        assert counts(TI.frame_block_motion(images, THR, 4, W, size=7)) == want
        total = map_sorted_groups(
            images.select("video", "frame_idx"),
            ["video"],
            ["frame_idx"],
            lambda g: {"video": g["video"][:1], "n": np.array([len(g["frame_idx"])]), "sorted": np.array([bool((np.diff(g["frame_idx"]) == 1).all())])},
            "video string, n long, sorted boolean",
        )
        assert sorted(tuple(r) for r in total.collect()) == [(f"v{v}", N, True) for v in range(3)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("size", [256, 4])
def test_motion_memory(images, size):
    _, diffs = from_cells(images, 4)
    memory = M.motion_memory(diffs)
    blocks = M.to_blocks(memory, 4, W, H)
    want = counts(M.block_motion(blocks, 16, "active"))
    got = TI.memory_blocks(TI.motion_memory(TI.image_tiles(images, 8), THR, size), 4, W, 8)
    assert counts(got) == want and any(v[1] for v in want.values())


def test_shrink(spark):
    rng = np.random.default_rng(4)
    f = rng.integers(0, 256, (6, 4, 1), dtype=np.uint8)
    df = spark.createDataFrame([("v", 1, 6, 4, 1, bytearray(f.tobytes()))], "video string, frame_idx int, height int, width int, channels int, data binary")
    row = TI.image_tiles(df, 8, k=2).first()
    cells = image_cells(df).select("video", "frame_idx", "y", "x", F.col("b").alias("gray"))
    want = {(r.y, r.x): r.gray for r in M.downscale(cells, 2).collect()}
    got = np.frombuffer(bytes(row.data), dtype=np.uint8).reshape(3, 2)
    assert want == {(y, x): got[y, x] for y in range(3) for x in range(2)}
    with pytest.raises(Exception):
        TI.image_tiles(df, 8, k=4).collect()


def test_tile_must_hold_whole_blocks(images):
    with pytest.raises(ValueError):
        TI.block_motion(TI.image_tiles(images, 8), THR, 3, W, 8)
