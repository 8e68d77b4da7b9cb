"""Streams fed in several micro-batches must equal the batch forms."""

import os

import pytest
from pyspark.sql import functions as F

from emberline.operators import motion as M
from emberline.operators import temporal as T
from emberline.sources.logs import stream_frame_log
from emberline.storage import fresh_path, materialize
from emberline.streaming import filters as ST
from emberline.streaming import sinks
from tests import loops

ROWS = [(int(v[1:]), v, i, l, e) for v, i, l, e in loops.make_frames(11, lengths=(1, 9, 40), hot=200)]
SCHEMA = "channel long, video string, frame_idx long, pred_label string, elapsed_time double"


@pytest.fixture(scope="module")
def frames(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("frame_idx") * 10 + F.col("channel")))


def in_batches(spark, df, edges, column="frame_idx"):
    """One file per stretch of ``column``, picked up one per micro-batch in that order."""
    path = fresh_path(spark, "batches")
    stamp = 1_600_000_000
    for i, (low, high) in enumerate(zip(edges, [*edges[1:], 1 << 30])):
        part = df.filter((F.col(column) >= low) & (F.col(column) < high)).orderBy(F.rand(i))
        part.coalesce(1).write.mode("append").parquet(path)
        for name in os.listdir(path):
            full = os.path.join(path, name)
            if name.endswith(".parquet") and os.path.getmtime(full) > 1_650_000_000:
                os.utime(full, (stamp + i * 100, stamp + i * 100))
    return stream_frame_log(spark, path, df.schema, glob="*.parquet", files_per_trigger=1)


EDGES = [1, 6, 30, 31, 120]


def keyed(df, *cols):
    return sorted(tuple(r) for r in df.select("channel", "frame_idx", *cols).collect())


@pytest.mark.parametrize(
    "mode,batch", [("sticky", T.tpt_sticky), ("sliding", T.tpt_sliding), ("by_detection", T.tpt_by_detection)]
)
def test_tpt(spark, frames, mode, batch):
    out = sinks.run_to_table(ST.stream_tpt(in_batches(spark, frames, EDGES), mode, 8, 0.5), "t")
    label = F.coalesce("pred_label", F.lit("-")).alias("l")
    assert keyed(out, label) == keyed(batch(frames, 8, 0.5), label)


def test_history(spark, frames):
    out = sinks.run_to_table(ST.stream_history_prob(in_batches(spark, frames, EDGES), 5), "t")
    assert keyed(out, "fire_prob", "smoke_prob") == keyed(T.history_prob(frames, 5), "fire_prob", "smoke_prob")


def test_gate(spark, frames):
    quiet = frames.withColumn("pred_label", F.when(F.col("frame_idx") % 17 < 12, "None").otherwise(F.col("pred_label")))
    out = sinks.run_to_table(ST.stream_eager_gate(in_batches(spark, quiet, EDGES), 4, 3), "t")
    cols = ("passed", "scored", "eager")
    assert keyed(out, *cols) == keyed(T.eager_gate(quiet, 4, 3, size=13), *cols)


def test_motion_memory(spark):
    import random

    rng = random.Random(2)
    rows = [("v", t, y, x, rng.choice([0, 0, 0, 50])) for t in range(1, 25) for y in range(5) for x in range(3)]
    cells = spark.createDataFrame(rows, "video string, frame_idx long, y int, x int, gray int")
    out = sinks.run_to_table(ST.stream_motion_memory(in_batches(spark, cells, [1, 2, 9]), 5, tile=2), "t")
    want = M.motion_memory(M.frame_diff(cells, 5))
    cols = ["video", "frame_idx", "y", "x", "memory", "active"]
    assert sorted(map(tuple, out.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_late_and_repeated_frames_are_dropped(spark, frames):
    """The second batch brings old frames again; state ignores them."""
    late = frames.filter("frame_idx < 20").withColumn("arrival", F.lit(50).cast("long"))
    both = frames.withColumn("arrival", F.col("frame_idx")).unionByName(late)
    assert both.count() > len(ROWS)
    out = sinks.run_to_table(ST.stream_tpt(in_batches(spark, both, [1, 40], "arrival"), "sticky", 8, 0.5), "t")
    label = F.coalesce("pred_label", F.lit("-")).alias("l")
    assert keyed(out, label) == keyed(T.tpt_sticky(frames, 8, 0.5), label)


def test_duplicates_within_watermark(spark, frames):
    both = frames.unionByName(frames)
    out = sinks.run_to_table(ST.late_frames(in_batches(spark, both, [1]), "1 hour"), "t")
    assert out.count() == len(ROWS)


def test_fps_windows(spark, frames):
    out = sinks.run_to_table(ST.stream_fps(in_batches(spark, frames, EDGES), "5 minutes"), "t", "complete")
    total = out.agg(F.sum("frames")).first()[0]
    assert total == len(ROWS)
    batch = frames.groupBy("channel", F.window("ts", "5 minutes").start.alias("s")).agg(F.count("*").alias("n"))
    assert sorted((r.channel, r.start_ts, r.frames) for r in out.collect()) == sorted(tuple(r) for r in batch.collect())


def test_episode_sessions(spark, frames):
    """Ten seconds per frame: a session gap of 35 s is an episode gap of 3 quiet frames."""
    out = sinks.run_to_table(ST.stream_episodes(in_batches(spark, frames, EDGES), "35 seconds"), "t", "complete")
    got = sorted((r.channel, r.detections) for r in out.collect())
    want = sorted((int(r.video[1:]), r.detections) for r in T.episodes(frames, 3).collect())
    assert got == want


def test_handlers_see_every_batch(spark, frames):
    calls = []

    class Count(sinks.ResultHandler):
        def open(self):
            calls.append("open")

        def handle(self, batch, batch_id):
            calls.append(batch.count())

        def close(self):
            calls.append("close")

    n = sinks.stream_results(in_batches(spark, frames, EDGES), [Count()])
    assert n == len(EDGES) and calls[0] == "open" and calls[-1] == "close" and sum(calls[1:-1]) == len(ROWS)


def test_restart_after_a_failed_batch(spark, frames):
    """A handler that fails once is given the same batch again on restart; nothing is lost or doubled."""
    path, out, progress = fresh_path(spark, "in"), fresh_path(spark, "out"), fresh_path(spark, "progress")
    frames.write.parquet(path)
    failed = []

    def handle(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if not failed:
            failed.append(batch_id)
            raise RuntimeError("lost")

    for attempt in range(2):
        stream = stream_frame_log(spark, path, frames.schema, files_per_trigger=2)
        q = stream.writeStream.foreachBatch(handle).option("checkpointLocation", progress).trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except Exception:
            assert attempt == 0
    assert failed and spark.read.parquet(out).count() == len(ROWS)


def test_materialize_cuts_the_lineage(spark, frames):
    back = materialize(frames)
    assert back.count() == len(ROWS) and back.schema.simpleString() == frames.schema.simpleString()


def test_epochs_have_rows_not_time_in_common(spark, frames):
    """An outlying time does not make one epoch of all the rest; a missing time is an error."""
    at = F.when(F.col("frame_idx") == 1, F.lit(-1_000_000_000)).otherwise(F.col("frame_idx"))
    out = sinks.run_in_epochs(frames, at, lambda s: ST.stream_tpt(s, "sticky", 8, 0.5), "t", epoch_rows=60)
    assert out.count() == frames.count()

    class Sizes(sinks.ResultHandler):
        rows: list[int] = []

        def handle(self, batch, batch_id):
            self.rows.append(batch.count())

    batches = sinks.stream_results(sinks.land_in_epochs(frames, at, "t", epoch_rows=60), [Sizes()])
    assert batches == len(Sizes.rows) >= frames.count() // 120 and max(Sizes.rows) <= frames.count() // 2
    lost = F.when(F.col("frame_idx") != 3, F.col("frame_idx"))
    with pytest.raises(ValueError):
        sinks.run_in_epochs(frames, lost, lambda s: s, "t", epoch_rows=60)


def test_late_rows_and_closed_windows(spark):
    """Append mode: what lies behind the watermark of the batch before goes, what it has passed closes, the rest stays open."""
    hour = 3600
    rows = [(1, 1, "Fire", 0, 0), (1, 2, "Fire", 1 * hour, 0), (1, 3, "None", 30 * hour, 1), (1, 4, "Fire", 50 * hour, 2)]
    rows += [(1, 2, "Fire", 1 * hour, 1), (1, 5, "Fire", 2 * hour, 3), (1, 6, "Fire", 29 * hour, 2), (1, 7, "Fire", 80 * hour, 3), (1, 8, "Fire", 3 * hour, 1)]
    df = spark.createDataFrame(rows, "channel long, frame_idx long, pred_label string, s long, epoch long")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("s") + 240 * hour)).withColumn("elapsed_time", F.lit(0.5))

    def run(transform):
        return sinks.run_in_epochs(df, F.col("epoch") * 1000 + F.col("frame_idx"), transform, "t", epoch=F.col("epoch")).collect()

    kept = sorted(r.frame_idx for r in run(lambda s: ST.late_frames(s.select("channel", "frame_idx", "ts"), "1 hour")))
    assert kept == [1, 2, 3, 4, 6, 7, 8]  # 2 again is a repeat; 5 comes when the watermark is at 49 h; 8 and 6 come while it is at 0 h and 29 h less
    closed = run(lambda s: ST.stream_episodes(ST.late_frames(s.drop("s", "epoch"), "1 hour"), "12 hours", None))
    assert sorted((r.start_ts.timestamp() // hour - 240, r.detections) for r in closed) == [(0, 3), (29, 1), (50, 1)]
    windows = run(lambda s: ST.stream_fps(s.drop("s", "epoch"), "1 day", delay="1 hour"))
    assert sorted((r.start_ts.timestamp() // hour - 240, r.frames, r.fps) for r in windows) == [(0, 4, 2.0), (24, 2, 2.0), (48, 1, 2.0)]


def test_failed_batch_is_repeated_under_its_number(spark, tmp_path):
    from pyspark.errors import StreamingQueryException

    from emberline.plans.queries_stream import _FailsOnce

    df = spark.range(100).withColumn("at", F.col("id"))
    stream = sinks.land_in_epochs(df, F.col("at"), "t")
    first, second = sinks.ParquetHandler(f"{tmp_path}/a"), _FailsOnce(f"{tmp_path}/b")
    progress = f"{tmp_path}/progress"
    with pytest.raises(StreamingQueryException):
        sinks.stream_results(stream, [first, second], progress=progress)
    assert sinks.stream_results(stream, [first, second], progress=progress) == 2
    for sink in (first, second):
        assert sorted(r.id for r in spark.read.parquet(sink.path).collect()) == list(range(100))


def test_epochs_go_on_from_the_state(spark, frames):
    """Many small epochs give what one batch gives."""
    out = sinks.run_in_epochs(
        frames, F.col("frame_idx"), lambda s: ST.stream_tpt(s, "sticky", 8, 0.5), "t", epoch_rows=60
    )
    label = F.coalesce("pred_label", F.lit("-")).alias("l")
    assert keyed(out, label) == keyed(T.tpt_sticky(frames, 8, 0.5), label)


def test_stateful_stream_from_another_folder(tmp_path):
    """The package is found by ``ship`` alone, whatever the folder and the path of the workers."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "run.py"
    script.write_text(
        f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
from emberline.deploy import ship
from emberline.streaming import filters, sinks
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate()
ship(spark)
df = spark.range(1, 30).select(F.lit(1).alias("channel"), F.col("id").alias("frame_idx"), F.lit("Fire").alias("pred_label"))
out = sinks.run_in_epochs(df, F.col("frame_idx"), lambda s: filters.stream_tpt(s, "sticky", 4, 0.5), "t")
print("rows", out.count(), out.where("pred_label = 'none'").count())
"""
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 29 2" in done.stdout, done.stderr[-2000:]


def test_channels_of_a_bucket_are_filtered_each_by_itself(spark, tmp_path, monkeypatch):
    from emberline.streaming import filters

    calls = tmp_path / "calls"
    calls.mkdir()

    class Counted(filters.TptFilter):
        def handleInputRows(self, key, rows, timerValues):
            import uuid

            (calls / uuid.uuid4().hex).touch()
            yield from super().handleInputRows(key, rows, timerValues)

    monkeypatch.setattr(filters, "BUCKETS", 2)
    rows = [(c, i, "Fire" if c is not None and (i + c) % 3 else "None") for c in [*range(40), None] for i in (3, 1, 2, 2)]
    spark.createDataFrame(rows, "channel long, frame_idx long, pred_label string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("channel long, frame_idx long, pred_label string").parquet(str(tmp_path / "in"))
    out = filters._run(filters.prepare(stream), Counted("sliding", 2, 1.0), "channel long, frame_idx long, pred_label string")
    from emberline.streaming import sinks

    got = {(r.channel, r.frame_idx): r.pred_label for r in sinks.run_to_table(out, "buckets").collect()}
    hit = lambda c, i: c is not None and i > 0 and (i + c) % 3 > 0
    assert got == {(c, i): "Fire" if hit(c, i) and hit(c, i - 1) else ("none") for c in [*range(40), None] for i in (1, 2, 3)}
    assert len(list(calls.iterdir())) == 3


def test_small_epochs_have_few_partitions_of_state(spark):
    rows = [(c, i, f"2024-01-01 00:{i:02d}:00") for c in (1, 2) for i in range(1, 31)]
    df = spark.createDataFrame(rows, "channel long, frame_idx long, at string").withColumn("ts", F.to_timestamp("at"))
    setting = "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "50")
    try:
        stream, largest = sinks._land(df, F.unix_micros("ts"), "few", 30, None)
        assert largest >= 12 and sinks.state_partitions(spark, largest) == spark.sparkContext.defaultParallelism
        assert sinks.state_partitions(spark, 45 * sinks.PARTITION_ROWS) == 45
        assert sinks.state_partitions(spark, 10**9) == 50
        out = sinks.run_in_epochs(df, F.unix_micros("ts"), lambda s: ST.late_frames(s, "1 hour"), "few", epoch_rows=30)
        assert out.select("channel", "frame_idx").distinct().count() == out.count() == len(rows)
        assert spark.conf.get(setting) == "50"
        # each batch writes a file for every partition that has rows, at most
        assert all(int(f.split("part-")[1][:5]) < spark.sparkContext.defaultParallelism for f in out.inputFiles())
    finally:
        spark.conf.set(setting, before)
