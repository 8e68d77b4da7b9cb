"""The per-channel loop on a stream of images against the sequential loop."""

import numpy as np
from pyspark.sql import functions as F

from emberline.streaming import online, sinks
from tests import loops

PARAMS = dict(period=4, window=3, thr=12, active_at=10, blk=(4, 5), min_count=4, least=(6, 5), excluded=(3, 2, 9, 5), idle_ms=30_000)


def label_of(mean):
    return "Fire" if mean > 150 else "SmokeOnly" if mean > 135 else "None"


def test_chain_in_small_epochs(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for channel in (1, 2, 3):
        images, ms = [], 0
        image = rng.integers(0, 256, (8, 12))
        for f in range(1, 140):
            if f % 45 == 0:  # another size
                image = rng.integers(0, 256, (10, 13) if f % 90 else (8, 12))
            if (f // 15 + channel) % 3:  # stretches with motion
                y, x = int(rng.integers(0, 4)), int(rng.integers(0, 7))
                image = image.copy()
                image[y : y + 5, x : x + 6] = rng.integers(0, 256, (5, 6)) // 2 + (f * 7 % 128)
            ms += 1000 if f % 50 else 100_000  # idle twice
            images.append((f, ms, image.tolist()))
            rows.append((channel, f, ms, *image.shape, 1, image.astype(np.uint8).tobytes()))
        want[channel] = loops.online(images, lambda p: label_of(np.mean(p)), **PARAMS)
    df = spark.createDataFrame(rows, "channel long, frame_idx long, ms long, height int, width int, channels int, data binary")
    df = df.withColumn("ts", F.timestamp_millis("ms")).drop("ms")

    def chain(stream):
        return online.stream_online_chain(stream, lambda part: label_of(part.mean()), **PARAMS)

    got = sinks.run_in_epochs(df, F.unix_micros("ts"), chain, "chain", epoch_rows=60).collect()
    for channel, rows in want.items():
        mine = sorted((tuple(r)[1:] for r in got if r.channel == channel), key=lambda r: r[0])
        assert [r[:2] for r in mine] == [r[:2] for r in rows]
        assert mine == rows
    flat = [r for rows in want.values() for r in rows]
    assert any(not r[1] for r in flat) and sum(r[2] for r in flat) > 30 and {r[7] for r in flat} >= {"Fire", "None", None}


def test_region():
    active = np.zeros((10, 13), bool)
    active[8:, 11:] = True
    assert online.region_of(active, (4, 5), 3, (1, 1)) == (10, 8, 13, 10)
    assert online.region_of(active, (4, 5), 5, (1, 1)) is None
    assert online.region_of(active, (4, 5), 3, (6, 7)) == (7, 3, 13, 10)
