import pytest
from pyspark.sql import functions as F

from emberline.operators import temporal as T
from emberline.operators.ordered import number_rows, running, with_previous
from tests import loops

SCHEMA = "video string, frame_idx int, pred_label string, elapsed_time double"
ROWS = loops.make_frames(7)
VIDEOS = loops.by_video(ROWS)


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def expect(fn):
    return {(v, r[1]): out for v, seq in VIDEOS.items() for r, out in zip(seq, fn(seq))}


def got(df, *cols):
    rows = df.select("video", "frame_idx", *cols).collect()
    out = {(r[0], r[1]): r[2] if len(cols) == 1 else tuple(r[2:]) for r in rows}
    assert len(out) == len(rows) == len(ROWS)
    return out


@pytest.mark.parametrize("window,thr", [(20, 0.5), (5, 0.4), (5, 0.6), (3, 1.0), (4, 0.0)])
def test_tpt_sticky(frames, window, thr):
    assert got(T.tpt_sticky(frames, window, thr), "pred_label") == expect(lambda s: loops.sticky(s, window, thr))


@pytest.mark.parametrize("window,thr,size", [(20, 0.5, 1 << 16), (20, 0.5, 16), (6, 0.5, 7), (1, 1.0, 5)])
def test_tpt_sliding(frames, window, thr, size):
    assert got(T.tpt_sliding(frames, window, thr, size=size), "pred_label") == expect(lambda s: loops.sliding(s, window, thr))


@pytest.mark.parametrize("window,thr", [(20, 0.5), (5, 0.99), (5, 1.0), (4, 0.25)])
def test_tpt_by_detection(frames, window, thr):
    out = T.tpt_by_detection(frames, window, thr)
    assert got(out, "pred_label") == expect(lambda s: loops.by_detection(s, window, thr))


def test_tpt_table_of_the_method(spark):
    """Ten detections in a window of 20 at one half: frame 10 is the first that is kept."""
    rows = [("v", i, "Fire", 0.1) for i in range(1, 12)]
    out = T.tpt_sliding(spark.createDataFrame(rows, SCHEMA), 20, 0.5)
    kept = [r.frame_idx for r in out.filter("pred_label = 'Fire'").collect()]
    assert sorted(kept) == [10, 11]
    sticky = T.tpt_sticky(spark.createDataFrame(rows, SCHEMA), 20, 0.5)
    assert [r.frame_idx for r in sticky.filter("pred_label = 'Fire'").collect()] == [11]


@pytest.mark.parametrize("window,thr", [(20, 0.5), (5, 0.6), (50, 0.9), (4, 0.0)])
def test_tpt_video(frames, window, thr):
    out = {r.video: (r.pred, r.first_frame) for r in T.tpt_video(frames, window, thr).collect()}
    assert out == {v: loops.tpt_video(s, window, thr) for v, s in VIDEOS.items()}


@pytest.mark.parametrize("window,size", [(8, 1 << 16), (8, 9), (3, 4)])
def test_history_prob(frames, window, size):
    out = T.history_prob(frames, window, size=size)
    assert got(out, "fire_prob", "smoke_prob") == expect(lambda s: loops.history(s, window))


@pytest.mark.parametrize("period,window,size", [(5, 20, 1 << 16), (4, 6, 10), (1, 3, 7), (3, 1, 5)])
def test_eager_gate(frames, spark, period, window, size):
    quiet = frames.withColumn(
        "pred_label", F.when(F.col("frame_idx") % 29 < 20, F.lit("None")).otherwise(F.col("pred_label"))
    )
    rows = [tuple(r) for r in quiet.select("video", "frame_idx", "pred_label", "elapsed_time").collect()]
    want = {}
    for v, seq in loops.by_video(rows).items():
        want.update({(v, r[1]): o for r, o in zip(seq, loops.gate(seq, period, window))})
    out = T.eager_gate(quiet, period, window, size=size)
    assert got(out, "passed", "scored", "eager") == want
    if period > 1:
        assert not all(o[0] for o in want.values())


def test_eager_gate_boost(frames):
    out = T.eager_gate(frames, boost=True)
    assert out.filter("not passed").count() == 0


@pytest.mark.parametrize("gap,size", [(3, 1 << 16), (2, 5), (30, 11)])
def test_episodes(frames, gap, size):
    out = T.episodes(frames, gap, size)
    rows = sorted((r.video, r.start_frame, r.end_frame, r.detections) for r in out.collect())
    assert rows == sorted((v, *e) for v, s in VIDEOS.items() for e in loops.episodes(s, gap))


def test_first_detection(frames):
    out = {r.video: (r.detected, r.first_frame) for r in T.first_detection(frames).collect()}
    for v, seq in VIDEOS.items():
        first = next((r[1] for r in seq if loops.positive(r[2])), None)
        assert out[v] == (first is not None, first)


@pytest.mark.parametrize("size", [1 << 16, 6])
def test_running_fps_and_guard(frames, size):
    out = got(T.running_fps(frames, size), "running_fps")
    guarded = {(r[0], r[1]) for r in T.speed_guard(frames, 60.0, 10, size).select("video", "frame_idx").collect()}
    for v, seq in VIDEOS.items():
        time, rates, stopped = 0.0, 0.0, False
        for n, r in enumerate(seq, 1):
            time += r[3]
            rates += 1 / r[3]
            assert out[v, r[1]] == pytest.approx(n / time)
            assert ((v, r[1]) in guarded) == (not stopped)
            stopped = stopped or (n >= 10 and rates / n < 60.0)


@pytest.mark.parametrize("size", [1 << 16, 3])
def test_best_so_far(spark, size):
    values = [0.0, -1.0, 2.0, 2.0, 1.0, 5.0, 5.0, 4.0, 6.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values, 1)], "run int, epoch int, metric double")
    best, at, want = 0.0, 0, []
    for i, v in enumerate(values, 1):
        if v > best:
            best, at = v, i
        want.append((i, best, at))
    out = T.best_so_far(df, size=size).select("epoch", "best_metric", "best_epoch").orderBy("epoch")
    assert [tuple(r) for r in out.collect()] == want


def test_tta_mean_drops_the_incomplete_group(spark):
    df = spark.createDataFrame(
        [(i, [float(i), 1.0], i) for i in range(7)], "row_id long, logits array<double>, target int"
    )
    out = T.tta_mean(df, 3, 2).orderBy("group_id").collect()
    assert [(r.group_id, r.logits, r.target) for r in out] == [(0, [1.0, 1.0], 0), (1, [4.0, 1.0], 3)]


@pytest.mark.parametrize("size", [1 << 16, 2])
def test_segments(spark, size):
    sizes = [(1, 1), (1, 1), (2, 1), (2, 1), (1, 1), (1, 3)]
    df = spark.createDataFrame(
        [("v", i, h, w) for i, (h, w) in enumerate(sizes, 1)], "video string, frame_idx int, height int, width int"
    )
    out = T.segment_on_resize(df, size).orderBy("frame_idx").collect()
    assert [r.segment for r in out] == [0, 0, 1, 1, 2, 3]


def test_registry(frames):
    assert T.apply_method(frames, "no_temp").count() == len(ROWS)
    with pytest.raises(ValueError):
        T.apply_method(frames, "nothing")


# --- building blocks ---------------------------------------------------------------------------


def test_number_rows_over_buckets(spark):
    rows = [(k, i * 3 % 17, i) for k in "ab" for i in range(17)]
    df = spark.createDataFrame(rows, "k string, o int, i int")
    out = number_rows(df, ["k"], ["o"], F.floor(F.col("o") / F.lit(4)), "n")
    assert all(r.n == r.o + 1 for r in out.collect())
    rank = number_rows(df.withColumn("o", F.col("o") % 5), [], ["o"], F.col("o"), "n", "rank").collect()
    for r in rank:
        assert r.n == 1 + sum(x[1] % 5 < r.o for x in rows)


@pytest.mark.parametrize("size", [1 << 16, 3])
@pytest.mark.parametrize("exclusive", [False, True])
def test_running_kinds(spark, size, exclusive):
    from emberline.operators.ordered import chunk_of

    values = [None, 3.0, None, 1.0, 7.0, None, 2.0, None]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values, 1)], "k string, i int, v double")
    kinds = ["sum", "count", "max", "min", "last"]
    out = running(df, ["k"], "i", {n: (n, F.col("v")) for n in kinds}, chunk_of("i", size), exclusive)
    for r in out.collect():
        past = [v for v in values[: r.i - (1 if exclusive else 0)] if v is not None]
        assert (r["count"] or 0) == len(past)
        assert (r["sum"], r["max"], r["min"], r["last"]) == (
            (sum(past), max(past), min(past), past[-1]) if past else (None,) * 4
        )


@pytest.mark.parametrize("size", [4, 1000])
def test_with_previous(spark, size):
    df = spark.createDataFrame([("k", i, i * i) for i in range(1, 30)], "k string, i int, v int")
    out = with_previous(df, ["k"], "i", {"p": F.col("v")}, size).collect()
    assert len(out) == 29
    assert all(r.p == (None if r.i == 1 else (r.i - 1) ** 2) for r in out)


def test_renumber(frames):
    from emberline.operators.ordered import renumber_frames

    kept = frames.filter(F.col("frame_idx") % 3 != 0)
    out = renumber_frames(kept, size=5).groupBy("video").agg(
        F.min("frame_idx"), F.max("frame_idx"), F.countDistinct("frame_idx"), F.count("*")
    )
    assert all(r[1] == 1 and r[2] == r[3] == r[4] for r in out.collect())
