"""Queries over the temporal filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.deploy import ship
from emberline.functions import labels as L
from emberline.operators import metrics as M
from emberline.operators import temporal as T
from emberline.operators.ordered import number_rows
from emberline.plans import views as V
from emberline.plans.registry import query

VF, POS, DET = V.FRAMES, V.POS, V.DET
W, THR = 50, 0.5

# Slots of the sticky buffer, and each frame with the number of slots set so far.
STICKY = f"""slots AS (SELECT video, (frame_idx - 1) % {W} AS slot, min(frame_idx) AS f FROM frames WHERE {DET} GROUP BY 1, 2),
sticky AS (SELECT f.video, f.dataset, f.frame_idx,
  CASE WHEN count(s.slot) <= {THR} * {W} THEN 'none' ELSE any_value(f.pred_label) END AS pred_label
  FROM frames f LEFT JOIN slots s ON s.video = f.video AND s.f <= f.frame_idx GROUP BY f.video, f.dataset, f.frame_idx)"""

METRICS_SQL = """
  CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn,
  CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn) AS accuracy,
  CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS "precision",
  CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0 END AS f1_score,
  CASE WHEN fp + tn > 0 THEN CAST(fp AS DOUBLE) / (fp + tn) ELSE 0 END AS fpr"""


def counts_sql(source: str, by: str, pred: str = POS) -> str:
    """Video-level confusion counts of a labelled frame table."""
    return f"""videos AS (SELECT {by}, video, bool_or({pred}) AS p, NOT contains(video, 'nofire') AS t
      FROM {source} GROUP BY {by}, video),
    counts AS (SELECT {by}, sum(CAST(p AND t AS INT)) AS tp, sum(CAST(p AND NOT t AS INT)) AS fp,
      sum(CAST(NOT p AND NOT t AS INT)) AS tn, sum(CAST(NOT p AND t AS INT)) AS fn FROM videos GROUP BY {by})"""


def truth():
    return M.positive(L.ground_truth("video", F.lit("test")))


@query(
    "tpt_evaluation",
    f"WITH {VF}, {STICKY}, {counts_sql('sticky', 'dataset')} SELECT dataset, 'temp_tpt' AS method, {METRICS_SQL} FROM counts",
)
def _evaluation(spark, sf):
    labelled = T.tpt_sticky(V.frames(spark, sf), W, THR)
    videos = M.per_video(labelled, L.is_fire_or_smoke("pred_label"), truth(), ["dataset"])
    out = M.classification_metrics(videos, F.col("pred"), F.col("truth"), ["dataset"])
    return out.withColumn("method", F.lit("temp_tpt"))


def _labels(df):
    return df.select("video", "frame_idx", F.coalesce("pred_label", F.lit("(empty)")).alias("pred_label"))


@query("no_temp", f"WITH {VF} SELECT video, frame_idx, coalesce(pred_label, '(empty)') AS pred_label FROM frames")
def _no_temp(spark, sf):
    return _labels(V.frames(spark, sf).transform(T.no_temp))


@query(
    "tpt_sticky",
    f"WITH {VF}, {STICKY} SELECT video, frame_idx, coalesce(pred_label, '(empty)') AS pred_label FROM sticky",
)
def _sticky(spark, sf):
    return _labels(T.tpt_sticky(V.frames(spark, sf), W, THR))


SLIDING = f"""sliding AS (SELECT video, dataset, frame_idx, CASE WHEN sum(CAST({DET} AS INT)) OVER
  (PARTITION BY video ORDER BY frame_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) < 0.7 * 20 THEN 'none'
  ELSE pred_label END AS pred_label FROM frames)"""


@query(
    "tpt_sliding",
    f"WITH {VF}, {SLIDING} SELECT video, frame_idx, coalesce(pred_label, '(empty)') AS pred_label FROM sliding",
)
def _sliding(spark, sf):
    return _labels(T.tpt_sliding(V.frames(spark, sf), 20, 0.7))


@query(
    "tpt_by_detection",
    f"""WITH {VF}, n AS (SELECT *, least(20, sum(CAST({DET} AS INT)) OVER (PARTITION BY video ORDER BY frame_idx)) AS c
    FROM frames) SELECT video, frame_idx, CASE WHEN c <= 0.6 * 20 THEN 'none' ELSE coalesce(pred_label, '(empty)') END
    AS pred_label FROM n""",
)
def _by_detection(spark, sf):
    return _labels(T.tpt_by_detection(V.frames(spark, sf), 20, 0.6))


@query(
    "tpt_video",
    f"""WITH {VF}, slots AS (SELECT video, (frame_idx - 1) % {W} AS slot, min(frame_idx) AS f FROM frames WHERE {POS} GROUP BY 1, 2),
    n AS (SELECT fr.video, fr.frame_idx, count(s.slot) AS c FROM frames fr LEFT JOIN slots s
      ON s.video = fr.video AND s.f <= fr.frame_idx GROUP BY 1, 2)
    SELECT video, CASE WHEN max(c) >= {THR} * {W} THEN 'positive' ELSE 'negative' END AS pred,
    coalesce(min(frame_idx) FILTER (c >= {THR} * {W}), -1) AS first_frame FROM n GROUP BY video""",
)
def _tpt_video(spark, sf):
    return T.tpt_video(V.frames(spark, sf), W, THR).withColumn("first_frame", F.coalesce("first_frame", F.lit(-1)))


HISTORY = """scored AS (SELECT *, CAST(lower(coalesce(pred_label,'None')) = 'fire' AS INT) AS fi,
    CAST(lower(coalesce(pred_label,'None')) IN ('fire', 'smokeonly') AS INT) AS sm FROM frames
    WHERE coalesce(pred_label, 'None') <> 'skipped'),
  history AS (SELECT video, frame_idx,
    sum(fi) OVER w / CAST(8 AS DOUBLE) AS fire_prob, sum(sm) OVER w / CAST(8 AS DOUBLE) AS smoke_prob FROM scored
    WINDOW w AS (PARTITION BY video ORDER BY frame_idx ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)
    UNION ALL SELECT video, frame_idx, 0.0, 0.0 FROM frames WHERE coalesce(pred_label, 'None') = 'skipped')"""


@query("history_prob", f"WITH {VF}, {HISTORY} SELECT * FROM history")
def _history(spark, sf):
    return T.history_prob(V.frames(spark, sf), 8).select("video", "frame_idx", "fire_prob", "smoke_prob")


@query(
    "alarm",
    f"WITH {VF}, {HISTORY} SELECT video, frame_idx, fire_prob >= 0.2 OR smoke_prob >= 0.5 AS alarm FROM history",
)
def _alarm(spark, sf):
    out = T.history_prob(V.frames(spark, sf), 8)
    return out.select("video", "frame_idx", L.alarm("fire_prob", "smoke_prob").alias("alarm"))


# The gate step by step: eager flag, counter, and scored frames since the last positive one.
GATE = f"""RECURSIVE {VF}, kinds AS (SELECT video, frame_idx, coalesce(pred_label, 'None') = 'skipped' AS dropped, {POS} AS hit FROM frames),
  gate AS (
    SELECT video, CAST(0 AS BIGINT) AS frame_idx, TRUE AS eager, 0 AS cnt, 6 AS age, FALSE AS passed, FALSE AS scored
    FROM kinds WHERE frame_idx = 1
    UNION ALL
    SELECT k.video, k.frame_idx,
      CASE WHEN NOT (g.eager OR g.cnt + 1 >= 4) OR k.dropped THEN g.eager
           WHEN k.hit THEN TRUE ELSE g.age + 1 < 6 END,
      CASE WHEN g.eager OR g.cnt + 1 >= 4 THEN 0 ELSE g.cnt + 1 END,
      CASE WHEN NOT (g.eager OR g.cnt + 1 >= 4) OR k.dropped THEN g.age WHEN k.hit THEN 0 ELSE least(6, g.age + 1) END,
      g.eager OR g.cnt + 1 >= 4,
      (g.eager OR g.cnt + 1 >= 4) AND NOT k.dropped
    FROM gate g JOIN kinds k ON k.video = g.video AND k.frame_idx = g.frame_idx + 1)"""


@query("eager_gate", f"WITH {GATE} SELECT video, frame_idx, passed, scored, eager FROM gate WHERE frame_idx > 0")
def _gate(spark, sf):
    ship(spark)
    out = T.eager_gate(V.frames(spark, sf), period=4, window=6)
    return out.select("video", "frame_idx", "passed", "scored", "eager")


@query(
    "episodes",
    f"""WITH {VF}, hits AS (SELECT video, frame_idx, frame_idx - lag(frame_idx) OVER (PARTITION BY video ORDER BY frame_idx) - 1 AS quiet
      FROM frames WHERE {POS}),
    n AS (SELECT video, frame_idx, sum(CASE WHEN quiet IS NULL OR quiet >= 4 THEN 1 ELSE 0 END)
      OVER (PARTITION BY video ORDER BY frame_idx) AS episode FROM hits)
    SELECT video, CAST(episode AS BIGINT) AS episode, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame,
    count(*) AS detections FROM n GROUP BY 1, 2""",
)
def _episodes(spark, sf):
    return T.episodes(V.frames(spark, sf), gap=4)


@query(
    "first_detection",
    f"""WITH {VF} SELECT video, bool_or({POS}) AS detected, coalesce(min(frame_idx) FILTER ({POS}), -1) AS first_frame
    FROM frames GROUP BY video""",
)
def _first(spark, sf):
    return T.first_detection(V.frames(spark, sf)).withColumn("first_frame", F.coalesce("first_frame", F.lit(-1)))


@query(
    "speed_guard",
    f"""WITH {VF}, m AS (SELECT video, frame_idx, avg(CASE WHEN elapsed_time > 0 THEN 1 / elapsed_time ELSE 0 END)
      OVER (PARTITION BY video ORDER BY frame_idx) AS mean_fps FROM frames),
    s AS (SELECT video, min(frame_idx) AS stop FROM m WHERE frame_idx >= 10 AND mean_fps < 60 GROUP BY video)
    SELECT m.video, m.frame_idx, round(mean_fps, 6) AS mean_fps FROM m LEFT JOIN s USING (video)
    WHERE stop IS NULL OR frame_idx <= stop""",
)
def _guard(spark, sf):
    out = T.speed_guard(V.frames(spark, sf), min_fps=60.0, after=10)
    return out.select("video", "frame_idx", F.round("mean_fps", 6).alias("mean_fps"))


@query(
    "running_fps",
    f"""WITH {VF} SELECT video, frame_idx, round(1 / avg(elapsed_time) OVER (PARTITION BY video ORDER BY frame_idx), 6)
    AS running_fps FROM frames""",
)
def _running_fps(spark, sf):
    out = T.running_fps(V.frames(spark, sf))
    return out.select("video", "frame_idx", F.round("running_fps", 6).alias("running_fps"))


def epochs(spark, sf):
    """Orders as a training log: one run per customer."""
    o = V.table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    o = number_rows(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], month, "epoch")
    return o.select(F.col("o_custkey").alias("run"), "epoch", F.col("o_totalprice").alias("metric"))


EPOCHS = """epochs AS (SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS epoch,
  o_totalprice AS metric FROM orders)"""


@query(
    "best_so_far",
    f"""WITH {EPOCHS}, b AS (SELECT *, max(metric) OVER (PARTITION BY run ORDER BY epoch) AS best,
      max(metric) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM epochs)
    SELECT run, epoch, best AS best_metric, max(CASE WHEN before IS NULL OR metric > before THEN epoch END)
    OVER (PARTITION BY run ORDER BY epoch) AS best_epoch FROM b""",
)
def _best(spark, sf):
    return T.best_so_far(epochs(spark, sf)).select("run", "epoch", "best_metric", "best_epoch")


@query(
    "tta_mean",
    f"""WITH {V.SCORES} SELECT vec_id // 4 AS group_id, round(avg(a), 9) AS mean_0, round(avg(c), 9) AS mean_2,
    CAST(arg_min(target, vec_id) AS INTEGER) AS target FROM scores GROUP BY 1 HAVING count(*) = 4""",
)
def _tta(spark, sf):
    out = T.tta_mean(V.scores(spark, sf), 4, 3, index="vec_id")
    return out.select(
        "group_id",
        F.round(F.get("logits", F.lit(0)), 9).alias("mean_0"),
        F.round(F.get("logits", F.lit(2)), 9).alias("mean_2"),
        "target",
    )


@query(
    "segment_on_resize",
    f"""WITH {VF}, s AS (SELECT video, frame_idx, CASE WHEN (frame_idx - 1) // 7 % 2 = 0 THEN 720 ELSE 1080 END AS height,
      CASE WHEN k < 30 THEN 1280 ELSE 1920 END AS width FROM frames),
    c AS (SELECT *, lag(height) OVER w IS NOT NULL AND (lag(height) OVER w <> height OR lag(width) OVER w <> width) AS changed
      FROM s WINDOW w AS (PARTITION BY video ORDER BY frame_idx))
    SELECT video, frame_idx, CAST(sum(CAST(changed AS INT)) OVER (PARTITION BY video ORDER BY frame_idx) AS BIGINT) AS segment FROM c""",
)
def _segments(spark, sf):
    fr = V.frames(spark, sf).withColumns(
        {
            "height": F.when(F.floor((F.col("frame_idx") - 1) / F.lit(7)) % 2 == 0, 720).otherwise(1080),
            "width": F.when(F.col("k") < 30, 1280).otherwise(1920),
        }
    )
    return T.segment_on_resize(fr).select("video", "frame_idx", "segment")


@query(
    "method_registry",
    f"""WITH {VF}, {STICKY}, {SLIDING.replace('0.7 * 20', '0.5 * 20')},
    every AS (SELECT 'no_temp' AS method, video, pred_label FROM frames UNION ALL SELECT 'temp_tpt', video, pred_label FROM sticky
      UNION ALL SELECT 'temp_tpt_sliding', video, pred_label FROM sliding)
    SELECT method, count(*) AS frames, CAST(sum(CAST({POS} AS INT)) AS BIGINT) AS positive FROM every GROUP BY method""",
)
def _registry(spark, sf):
    fr = V.frames(spark, sf)
    params = {"no_temp": {}, "temp_tpt": {"window": W, "thr": THR}, "temp_tpt_sliding": {"window": 20, "thr": 0.5}}
    out = None
    for name, p in params.items():
        one = T.apply_method(fr, name, **p).select(F.lit(name).alias("method"), "pred_label")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("method").agg(
        F.count(F.lit(1)).alias("frames"),
        F.sum(L.is_fire_or_smoke("pred_label").cast("long")).alias("positive"),
    )


@query(
    "renumber_frames",
    f"""WITH {VF} SELECT video, row_number() OVER (PARTITION BY video ORDER BY frame_idx) AS frame_idx, elapsed_time
    FROM frames WHERE coalesce(pred_label, 'None') <> 'skipped'""",
)
def _renumber(spark, sf):
    from emberline.operators.ordered import renumber_frames

    kept = V.frames(spark, sf).filter(F.coalesce("pred_label", F.lit("None")) != "skipped")
    return renumber_frames(kept).select("video", "frame_idx", "elapsed_time")
