"""Queries that run as streams over all available input and return the written result."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.deploy import ship
from emberline.functions import labels as L
from emberline.plans import views as V
from emberline.plans.queries_temporal import GATE, HISTORY, SLIDING, STICKY, THR, W
from emberline.plans.registry import query
from emberline.sources import logs
from emberline.storage import fresh_path
from emberline.streaming import filters as ST
from emberline.streaming import online, sinks

VF, POS, DET = V.FRAMES, V.POS, V.DET


def _frames(spark, sf) -> DataFrame:
    ship(spark)
    return V.frames(spark, sf).select(
        "channel", "video", "frame_idx", "pred_label", "elapsed_time", F.timestamp_micros(V.micros_of("ts")).alias("ts")
    )


def _run(spark, sf, transform, name: str, mode: str = "append") -> DataFrame:
    """Stream the frames in time order."""
    return sinks.run_in_epochs(_frames(spark, sf), F.unix_micros("ts"), transform, name, mode)


def _labels(df: DataFrame) -> DataFrame:
    return df.withColumn("pred_label", F.coalesce("pred_label", F.lit("(empty)")))


def _channel(cte: str, source: str) -> str:
    """The batch form keyed by channel instead of video."""
    return f"""WITH {cte} SELECT f.channel, s.frame_idx, coalesce(s.pred_label, '(empty)') AS pred_label
    FROM {source} s JOIN frames f ON f.video = s.video AND f.frame_idx = s.frame_idx"""


@query("stream_frame_log", f"WITH {VF} SELECT channel, frame_idx, coalesce(pred_label, '(empty)') AS pred_label FROM frames")
def _stream_log(spark, sf):
    out = _run(spark, sf, lambda s: s, "log")
    return _labels(out.select("channel", "frame_idx", "pred_label"))


@query("stream_tpt_sticky", _channel(f"{VF}, {STICKY}", "sticky"))
def _tpt_sticky(spark, sf):
    return _labels(_run(spark, sf, lambda s: ST.stream_tpt(s, "sticky", W, THR), "tpt"))


@query("stream_tpt_sliding", _channel(f"{VF}, {SLIDING}", "sliding"))
def _tpt_sliding(spark, sf):
    return _labels(_run(spark, sf, lambda s: ST.stream_tpt(s, "sliding", 20, 0.7), "tpt"))


@query(
    "stream_tpt_by_detection",
    f"""WITH {VF}, n AS (SELECT *, least(20, sum(CAST({DET} AS INT)) OVER (PARTITION BY video ORDER BY frame_idx)) AS c
    FROM frames) SELECT channel, frame_idx, CASE WHEN c <= 0.6 * 20 THEN 'none' ELSE coalesce(pred_label, '(empty)') END
    AS pred_label FROM n""",
)
def _tpt_by_detection(spark, sf):
    return _labels(_run(spark, sf, lambda s: ST.stream_tpt(s, "by_detection", 20, 0.6), "tpt"))


@query(
    "stream_history_prob",
    f"""WITH {VF}, {HISTORY} SELECT f.channel, h.frame_idx, h.fire_prob, h.smoke_prob FROM history h
    JOIN frames f ON f.video = h.video AND f.frame_idx = h.frame_idx""",
)
def _history(spark, sf):
    return _run(spark, sf, lambda s: ST.stream_history_prob(s, 8), "history")


@query(
    "stream_eager_gate",
    f"""WITH {GATE} SELECT f.channel, g.frame_idx, g.passed, g.scored, g.eager FROM gate g
    JOIN frames f ON f.video = g.video AND f.frame_idx = g.frame_idx""",
)
def _gate(spark, sf):
    return _run(spark, sf, lambda s: ST.stream_eager_gate(s, period=4, window=6), "gate")


@query(
    "stream_episodes",
    f"""WITH {VF}, h AS (SELECT channel, ts, CASE WHEN lag(ts) OVER (PARTITION BY channel ORDER BY ts) IS NULL
        OR ts >= lag(ts) OVER (PARTITION BY channel ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM frames WHERE {POS}),
    n AS (SELECT channel, ts, sum(new) OVER (PARTITION BY channel ORDER BY ts) AS e FROM h)
    SELECT channel, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us, count(*) AS detections FROM n GROUP BY channel, e""",
)
def _episodes(spark, sf):
    out = _run(spark, sf, lambda s: ST.stream_episodes(s, "6 hours"), "episodes", "complete")
    return out.select(
        "channel",
        F.unix_micros("start_ts").alias("start_us"),
        F.unix_micros("last_ts").alias("last_us"),
        "detections",
    )


@query(
    "stream_fps",
    f"""WITH {VF} SELECT channel, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start_us, count(*) AS frames,
    round(count(*) / sum(elapsed_time), 6) AS fps FROM frames GROUP BY 1, 2""",
)
def _fps(spark, sf):
    out = _run(spark, sf, lambda s: ST.stream_fps(s, "1 day"), "fps", "complete")
    return out.select("channel", F.unix_micros("start_ts").alias("start_us"), "frames", F.round("fps", 6).alias("fps"))


@query(
    "stream_fps_sliding",
    f"""WITH {VF}, w AS (SELECT channel, elapsed_time, time_bucket(INTERVAL 12 HOUR, ts) - to_hours(12 * i) AS start_ts
      FROM frames, (VALUES (0), (1)) b(i))
    SELECT channel, epoch_us(start_ts) AS start_us, count(*) AS frames, round(count(*) / sum(elapsed_time), 6) AS fps FROM w GROUP BY 1, 2""",
)
def _fps_sliding(spark, sf):
    out = _run(spark, sf, lambda s: ST.stream_fps(s, "1 day", "12 hours"), "fps", "complete")
    return out.select("channel", F.unix_micros("start_ts").alias("start_us"), "frames", F.round("fps", 6).alias("fps"))


@query(
    "stream_motion_memory",
    f"""WITH RECURSIVE {V.DIFFS}, mem AS (SELECT video, y, x, frame_idx, 0 AS memory FROM diffs WHERE frame_idx = 1
      UNION ALL SELECT d.video, d.y, d.x, d.frame_idx, greatest(0, least(24, m.memory + CASE WHEN d.diff > 20 THEN 4 ELSE -1 END))
      FROM mem m JOIN diffs d ON d.video = m.video AND d.y = m.y AND d.x = m.x AND d.frame_idx = m.frame_idx + 1)
    SELECT video, frame_idx, y, x, memory, memory >= 10 AS active FROM mem""",
)
def _memory(spark, sf):
    ship(spark)
    cells = V.cells(spark, sf)
    return sinks.run_in_epochs(cells, F.col("frame_idx"), lambda s: ST.stream_motion_memory(s, thr=20), "memory")


@query(
    "stream_motion_memory_resize",
    f"""WITH RECURSIVE {V.RESIZED}, mem AS (SELECT video, segment, y, x, frame_idx, 0 AS memory FROM diffs WHERE diff IS NULL
      UNION ALL SELECT d.video, d.segment, d.y, d.x, d.frame_idx, greatest(0, least(24, m.memory + CASE WHEN d.diff > 20 THEN 4 ELSE -1 END))
      FROM mem m JOIN diffs d ON d.video = m.video AND d.segment = m.segment AND d.y = m.y AND d.x = m.x AND d.frame_idx = m.frame_idx + 1)
    SELECT video, frame_idx, y, x, memory, memory >= 10 AS active FROM mem""",
)
def _memory_resize(spark, sf):
    ship(spark)
    cells = V.resized_cells(spark, sf)
    return sinks.run_in_epochs(cells, F.col("frame_idx"), lambda s: ST.stream_motion_memory(s, thr=20, segment="segment"), "memory")


def _shown(part) -> str:
    mean = part.mean() - 128
    return "Fire" if mean >= 1 else "None" if mean >= -1 else "SmokeOnly"


# A frame a second, and an hour without any after every twentieth. Blocks of 4 x 4 pixels; regions of at least 5 x 6.
_BLOCKS = ", ".join(
    f"len(list_filter(range(1, 65), lambda i: mem[i] >= 8 AND (i - 1) // 32 = {r} AND (i - 1) % 8 // 4 = {c})) >= 4 AS b{r}{c}" for r in (0, 1) for c in (0, 1)
)
_SIDES = {
    "x1": "CASE WHEN b00 OR b10 THEN 0 WHEN b01 OR b11 THEN 4 END",
    "x2": "CASE WHEN b01 OR b11 THEN 8 WHEN b00 OR b10 THEN 4 END",
    "y1": "CASE WHEN b00 OR b01 THEN 0 WHEN b10 OR b11 THEN 4 END",
    "y2": "CASE WHEN b10 OR b11 THEN 8 WHEN b00 OR b01 THEN 4 END",
}


def _shifted(a: str, least: int) -> str:
    low = f"least({8 - least}, greatest(0, {a}1 - ({least} - ({a}2 - {a}1)) // 2))"
    return f"CASE WHEN {a}2 - {a}1 < {least} THEN {low} ELSE {a}1 END AS {a}1, CASE WHEN {a}2 - {a}1 < {least} THEN {low} + {least} ELSE {a}2 END AS {a}2"


_INSIDE = "list_filter(range(1, 65), lambda i: (i - 1) % 8 >= x1 AND (i - 1) % 8 < x2 AND (i - 1) // 8 >= y1 AND (i - 1) // 8 < y2)"
_SHOWN = f"list_transform({_INSIDE}, lambda i: CASE WHEN (i - 1) % 8 >= 2 AND (i - 1) % 8 < 4 AND (i - 1) // 8 >= 3 AND (i - 1) // 8 < 5 THEN 114 ELSE now[i] END)"
ONLINE = f"""WITH RECURSIVE {V.EMB}, images AS (SELECT label AS channel, frame_idx, list_transform(embedding, lambda v: CAST(floor((CAST(v AS DOUBLE) + 1) * 128) AS INTEGER)) AS now FROM emb),
  chain AS (
    SELECT channel, 0::BIGINT AS frame_idx, FALSE AS passed, NULL::BIGINT AS x1, NULL::BIGINT AS y1, NULL::BIGINT AS x2, NULL::BIGINT AS y2, NULL::VARCHAR AS label,
      TRUE AS eager, 0 AS n, NULL::INTEGER[] AS seen, NULL::INTEGER[] AS mem, [0, 0, 0] AS fire, [0, 0, 0] AS smoke FROM images WHERE frame_idx = 1
    UNION ALL
    SELECT channel, frame_idx, passed, x1, y1, x2, y2, label, CASE WHEN label IS NULL THEN eager ELSE list_sum(fire) > 0 OR list_sum(smoke) > 0 END, n, seen, mem, fire, smoke FROM (
      SELECT * EXCLUDE (fire, smoke), CASE WHEN label IS NULL THEN fire ELSE fire[2:3] || [CAST(label = 'Fire' AS INTEGER)] END AS fire,
        CASE WHEN label IS NULL THEN smoke ELSE smoke[2:3] || [CAST(label <> 'None' AS INTEGER)] END AS smoke FROM (
      SELECT *, CASE WHEN x1 IS NULL THEN NULL WHEN list_avg({_SHOWN}) - 128 >= 1 THEN 'Fire' WHEN list_avg({_SHOWN}) - 128 >= -1 THEN 'None' ELSE 'SmokeOnly' END AS label FROM (
      SELECT * EXCLUDE (x1, x2, y1, y2), {_shifted("x", 5)}, {_shifted("y", 6)} FROM (
      SELECT *, {", ".join(f"CASE WHEN moved THEN {v} END AS {c}" for c, v in _SIDES.items())} FROM (
      SELECT *, {_BLOCKS} FROM (
      SELECT * EXCLUDE (seen, mem), passed AND seen IS NOT NULL AS moved, CASE WHEN passed THEN now ELSE seen END AS seen,
        CASE WHEN NOT passed OR seen IS NULL THEN mem ELSE list_transform(range(1, 65), lambda i:
          greatest(0, least(24, coalesce(mem[i], 0) + CASE WHEN abs(now[i] - seen[i]) > 20 THEN 4 ELSE -1 END))) END AS mem FROM (
      SELECT channel, frame_idx, now, seen, mem, fire, smoke, eager, eager OR n + 1 >= 4 AS passed, CASE WHEN eager OR n + 1 >= 4 THEN 0 ELSE n + 1 END AS n FROM (
      SELECT i.channel, i.frame_idx, i.now, CASE WHEN anew THEN NULL ELSE c.seen END AS seen, CASE WHEN anew THEN NULL ELSE c.mem END AS mem,
        CASE WHEN anew THEN [0, 0, 0] ELSE c.fire END AS fire, CASE WHEN anew THEN [0, 0, 0] ELSE c.smoke END AS smoke, anew OR c.eager AS eager, CASE WHEN anew THEN 0 ELSE c.n END AS n
        FROM chain c JOIN (SELECT *, frame_idx % 20 = 0 AS anew FROM images) i ON i.channel = c.channel AND i.frame_idx = c.frame_idx + 1))))))))
  )"""


@query(
    "stream_online_chain",
    f"""{ONLINE} SELECT channel, frame_idx, passed, label IS NOT NULL AS scored, x1, y1, x2, y2, coalesce(label, '-') AS label,
    CASE WHEN label IS NULL THEN 0.0 ELSE list_sum(fire) / 3.0::DOUBLE END AS fire_prob, CASE WHEN label IS NULL THEN 0.0 ELSE list_sum(smoke) / 3.0::DOUBLE END AS smoke_prob, eager
    FROM chain WHERE frame_idx > 0""",
)
def _online(spark, sf):
    ship(spark)
    images = V.tiles(spark, sf).select(
        F.substring("video", 5, 9).cast("long").alias("channel"),
        "frame_idx",
        F.timestamp_seconds(F.col("frame_idx") + 3600 * F.floor(F.col("frame_idx") / 20)).alias("ts"),
        F.col("h").alias("height"),
        F.col("w").alias("width"),
        "channels",
        "data",
    )

    def chain(stream):
        return online.stream_online_chain(
            stream, _shown, period=4, window=3, thr=20, active_at=8, blk=(4, 4), min_count=4, least=(5, 6), excluded=(2, 3, 4, 5)
        )

    out = sinks.run_in_epochs(images, F.unix_micros("ts"), chain, "chain")
    return out.withColumn("label", F.coalesce("label", F.lit("-")))


class _FailsOnce(sinks.ParquetHandler):
    """A sink that is cut off in its fourth batch, after the sinks before it have written theirs."""

    failed = False

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id == 3 and not self.failed:
            self.failed = True
            raise RuntimeError("cut off")
        super().handle(batch, batch_id)


@query(
    "stream_results",
    f"""WITH {VF} SELECT 'all' AS sink, count(*) AS rows, CAST(sum(frame_idx) AS BIGINT) AS idx, 5 AS batches FROM frames
    UNION ALL SELECT 'positive', count(*), CAST(sum(frame_idx) AS BIGINT), 5 FROM frames WHERE {POS}""",
)
def _results(spark, sf):
    """Five batches to two sinks; the fourth is repeated after a failure between the sinks."""
    every, positive, progress = (fresh_path(spark, "sink") for _ in range(3))
    frames = _frames(spark, sf).select("channel", "frame_idx", "pred_label", "ts")
    stream = sinks.land_in_epochs(frames, F.unix_micros("ts"), "results")
    handlers = [
        sinks.ParquetHandler(every),
        _FailsOnce(positive, lambda b: b.filter(L.is_fire_or_smoke("pred_label"))),
    ]
    try:
        sinks.stream_results(stream, handlers, progress=progress)
    except StreamingQueryException:
        sinks.stream_results(stream, handlers, progress=progress)
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    both = (
        spark.read.schema(schema).parquet(every).withColumn("sink", F.lit("all"))
        .unionByName(spark.read.schema(schema).parquet(positive).withColumn("sink", F.lit("positive")))
    )
    sums = {"rows": F.count(F.lit(1)), "idx": F.sum("frame_idx"), "batches": F.count_distinct("batch").cast("int")}
    return both.groupBy("sink").agg(*[c.alias(n) for n, c in sums.items()])


@query("late_frames", f"WITH {VF} SELECT channel, frame_idx, elapsed_time FROM frames")
def _late(spark, sf):
    ship(spark)
    fr = V.frames(spark, sf).select("channel", "frame_idx", "elapsed_time", F.timestamp_micros(V.micros_of("ts")).alias("ts"))
    # Every frame arrives twice.
    twice = fr.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    out = sinks.run_in_epochs(twice, F.unix_micros("ts"), lambda s: ST.late_frames(s, "1 hour"), "late")
    return out.select("channel", "frame_idx", "elapsed_time")


# --- late rows ---------------------------------------------------------------------------------------
#
# Frames arrive in epochs of four days. One in ten comes six days late, one in five twice, the second time an hour later, one in
# fifty again ten days later. A batch drops what lies behind the watermark of the batch before it: the latest time of all
# epochs up to the last but one, less an hour. What the watermark has not passed at the end is still open.

_HOUR = 3_600_000_000
_EPOCH = 96 * _HOUR


def _arrivals(spark, sf) -> DataFrame:
    ship(spark)
    fr = V.frames(spark, sf).select("channel", "frame_idx", "pred_label", "elapsed_time", F.timestamp_micros(V.micros_of("ts")).alias("ts"))
    n = F.col("frame_idx") + F.col("channel")
    times = F.array_compact(F.array(F.when(n % 10 == 7, 144).otherwise(0), F.when(n % 5 == 0, 1), F.when(n % 50 == 10, 240)))
    return fr.withColumn("late", F.explode(times)).withColumn("arrival", F.unix_micros("ts") + F.col("late") * F.lit(_HOUR)).drop("late")


ARRIVALS = f"""{VF}, times AS (SELECT channel, frame_idx, pred_label, elapsed_time, ts, epoch_us(ts) AS us,
    unnest(list_filter([CASE WHEN (frame_idx + channel) % 10 = 7 THEN 144 ELSE 0 END, CASE WHEN (frame_idx + channel) % 5 = 0 THEN 1 END,
      CASE WHEN (frame_idx + channel) % 50 = 10 THEN 240 END], lambda h: h IS NOT NULL)) AS late FROM frames),
  arrivals AS (SELECT *, (us + late * {_HOUR}::BIGINT) // {_EPOCH} AS epoch FROM times),
  ends AS (SELECT e.epoch, (SELECT max(us) // 1000 * 1000 - {_HOUR} FROM arrivals a WHERE a.epoch < e.before) AS mark
    FROM (SELECT epoch, lag(epoch) OVER (ORDER BY epoch) AS before FROM (SELECT DISTINCT epoch FROM arrivals)) e),
  marked AS (SELECT a.*, coalesce(e.mark, 0) AS mark FROM arrivals a JOIN ends e USING (epoch)),
  last AS (SELECT max(us) // 1000 * 1000 - {_HOUR} AS mark FROM arrivals),
  kept AS (SELECT DISTINCT channel, frame_idx, pred_label, elapsed_time, ts, us FROM marked WHERE us > mark)"""


def _arriving(spark, sf, transform, name: str) -> DataFrame:
    frames = _arrivals(spark, sf)
    arrival = F.col("arrival")
    return sinks.run_in_epochs(frames, arrival, transform, name, epoch=F.floor(arrival / _EPOCH))


@query("late_frames_dropped", f"WITH {ARRIVALS} SELECT channel, frame_idx, elapsed_time, count(*) AS n FROM kept GROUP BY ALL")
def _late_dropped(spark, sf):
    out = _arriving(spark, sf, lambda s: ST.late_frames(s, "1 hour"), "late")
    return out.groupBy("channel", "frame_idx", "elapsed_time").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_fps_closed",
    f"""WITH {ARRIVALS}, w AS (SELECT channel, elapsed_time, mark, us // (24 * {_HOUR}::BIGINT) * 24 * {_HOUR} AS start_us FROM marked)
    SELECT channel, start_us, count(*) AS frames, round(count(*) / sum(elapsed_time), 6) AS fps FROM w
    WHERE start_us + 24 * {_HOUR}::BIGINT > mark AND start_us + 24 * {_HOUR}::BIGINT <= (SELECT mark FROM last) GROUP BY 1, 2""",
)
def _fps_closed(spark, sf):
    out = _arriving(spark, sf, lambda s: ST.stream_fps(s, "1 day", delay="1 hour"), "fps")
    return out.select("channel", F.unix_micros("start_ts").alias("start_us"), "frames", F.round("fps", 6).alias("fps"))


@query(
    "stream_episodes_closed",
    f"""WITH {ARRIVALS}, h AS (SELECT channel, us, CASE WHEN us >= lag(us) OVER (PARTITION BY channel ORDER BY us) + 12 * {_HOUR}::BIGINT THEN 1 ELSE 0 END AS new
      FROM kept WHERE {POS}),
    n AS (SELECT channel, us, sum(new) OVER (PARTITION BY channel ORDER BY us) AS e FROM h)
    SELECT channel, min(us) AS start_us, max(us) AS last_us, count(*) AS detections FROM n GROUP BY channel, e
    HAVING max(us) + 12 * {_HOUR}::BIGINT <= (SELECT mark FROM last)""",
)
def _episodes_closed(spark, sf):
    """Late and repeated frames go first, so that none of them opens an episode again."""
    out = _arriving(spark, sf, lambda s: ST.stream_episodes(ST.late_frames(s, "1 hour"), "12 hours", None), "episodes")
    return out.select("channel", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("last_ts").alias("last_us"), "detections")
