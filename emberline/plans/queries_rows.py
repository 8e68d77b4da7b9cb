"""Queries over sources, sinks and row-level functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.deploy import ship
from emberline.functions import geometry as G
from emberline.functions import labels as L
from emberline.functions import scores as S
from emberline.operators import frames as FR
from emberline.operators import metrics as M
from emberline.operators import temporal as T
from emberline.operators.ordered import spread_join
from emberline.plans import views as V
from emberline.plans.registry import query
from emberline.sources import logs, media
from emberline.storage import fresh_path

VF = V.FRAMES

# --- sources and sinks ---------------------------------------------------------------------------


def _log_rows(spark, sf) -> DataFrame:
    """Frames with every column of the log file; scores made from the event's own numbers."""
    ship(spark)
    fr = V.frames(spark, sf)
    total = fr.groupBy("video").agg(F.count(F.lit(1)).cast("int").alias("num_frames"))
    k = F.coalesce(F.col("k"), F.lit(0)) / F.lit(100.0)
    return spread_join(fr, total, ["video"], F.col("frame_idx")).select(
        "video",
        "num_frames",
        F.col("frame_idx").cast("int").alias("frame_idx"),
        "elapsed_time",
        F.array(*[F.lit(c) for c in V.CLASS_NAMES]).alias("class_names"),
        F.array(k, F.lit(0.5), -k).alias("logits"),
        F.array(k, F.lit(0.5), -k).alias("probs"),
        F.when(F.col("pred_label") == "skipped", -1).otherwise(0).alias("pred_label_idx"),
        "pred_label",
    )


@query(
    "read_frame_log",
    f"""WITH {VF} SELECT video, CAST(count(*) OVER (PARTITION BY video) AS INTEGER) AS num_frames,
    CAST(frame_idx AS INTEGER) AS frame_idx, elapsed_time, coalesce(pred_label, '(empty)') AS pred_label,
    coalesce(k, 0) / CAST(100.0 AS DOUBLE) AS first_logit, 'SmokeOnly' AS last_class,
    CASE WHEN pred_label = 'skipped' THEN -1 ELSE 0 END AS pred_label_idx FROM frames""",
)
def _read_frame_log(spark, sf):
    path = fresh_path(spark, "frame-log")
    logs.write_frame_log(_log_rows(spark, sf), path)
    back = FR.parse_list_columns(logs.read_frame_log(spark, path))
    return back.select(
        "video",
        "num_frames",
        "frame_idx",
        "elapsed_time",
        F.coalesce("pred_label", F.lit("(empty)")).alias("pred_label"),
        F.get("logits", F.lit(0)).alias("first_logit"),
        F.get("class_names", F.lit(2)).alias("last_class"),
        "pred_label_idx",
    )


@query(
    "write_frame_log",
    f"""WITH {VF} SELECT video, count(*) AS frames, max(frame_idx) AS last_frame,
    round(sum(elapsed_time), 6) AS seconds FROM frames GROUP BY video""",
)
def _write_frame_log(spark, sf):
    path = fresh_path(spark, "frame-log")
    logs.write_frame_log(_log_rows(spark, sf), path)
    folder = F.regexp_extract("file_path", r"video_part=([^/]+)/", 1)
    back = logs.read_frame_log(spark, path).withColumn("file_path", logs.file_path())
    # The video comes from the folder here: each video has its own.
    return back.groupBy(folder.alias("video")).agg(
        F.count(F.lit(1)).alias("frames"),
        F.max("frame_idx").cast("long").alias("last_frame"),
        F.round(F.sum("elapsed_time"), 6).alias("seconds"),
    )


@query(
    "with_video_name",
    f"""WITH {VF} SELECT DISTINCT video || '_results.csv' AS file_name, video FROM frames""",
)
def _with_video_name(spark, sf):
    fr = V.frames(spark, sf).select(
        F.explode(
            F.array(F.concat("video", F.lit("_results.csv")), F.concat("video", F.lit("__per_video__perf.csv")))
        ).alias("file_name")
    )
    return logs.with_video_name(fr.distinct())


@query("list_videos", f"WITH {VF} SELECT DISTINCT video, TRUE AS has_bytes FROM frames")
def _list_videos(spark, sf):
    path = fresh_path(spark, "frame-log")
    logs.write_frame_log(_log_rows(spark, sf), path)
    files = media.list_videos(spark, path, exts=["csv"], recursive=True)
    folder = F.regexp_extract("video_path", r"video_part=([^/]+)/", 1)
    return files.groupBy(folder.alias("video")).agg(F.bool_and(F.col("length") > 0).alias("has_bytes"))


@query(
    "read_video_meta",
    f"""WITH {V.META} SELECT dataset, video_path, frame_count, fps FROM meta""",
)
def _read_video_meta(spark, sf):
    root = fresh_path(spark, "meta")
    meta = V.video_meta(spark, sf)
    meta = meta.withColumn("kind", F.concat("dataset", F.lit("_meta.csv")))
    meta.select("kind", "video_path", "frame_count", "fps").write.partitionBy("kind").options(
        sep=";", header="true", escape='"'
    ).csv(root)
    back = logs.read_video_meta(spark, root)
    return back.withColumn("dataset", F.regexp_replace("dataset", "^kind=", ""))


def _perf(spark, sf, mode="per_video") -> DataFrame:
    fr = V.frames(spark, sf)
    pos, truth = L.is_fire_or_smoke("pred_label"), M.positive(L.ground_truth("video", F.lit("test")))
    return M.perf_rows(fr, pos, truth, F.lit("no_temp"), mode=mode)


_COUNTS = f"""counts AS (
  SELECT dataset, sum(CAST(p AND t AS INTEGER)) AS tp, sum(CAST(p AND NOT t AS INTEGER)) AS fp,
         sum(CAST(NOT p AND NOT t AS INTEGER)) AS tn, sum(CAST(NOT p AND t AS INTEGER)) AS fn
  FROM (SELECT dataset, video, bool_or({V.POS}) AS p, bool_or(NOT contains(video, 'nofire')) AS t
        FROM frames GROUP BY dataset, video) GROUP BY dataset), speed AS (
  SELECT dataset, count(*) / sum(elapsed_time) AS fps FROM frames WHERE frame_idx > 1 GROUP BY dataset)"""


@query(
    "perf_round_trip",
    f"""WITH {VF}, {_COUNTS} SELECT 'no_temp_per_video_again' AS experiment, dataset,
    CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn) AS "metric_accuracy",
    CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) AS "metric_f1_score",
    CAST(tp AS DOUBLE) / (tp + fp) AS "metric_precision", CAST(tp AS DOUBLE) / (tp + fn) AS "metric_recall (TPR)",
    CASE WHEN fp + tn > 0 THEN CAST(fp AS DOUBLE) / (fp + tn) ELSE 0.0 END AS "metric_FPR",
    round(fps, 6) AS "metric_FPS" FROM counts JOIN speed USING (dataset)""",
)
def _perf_round_trip(spark, sf):
    path = fresh_path(spark, "perf")
    logs.write_perf(_perf(spark, sf), path, F.col("experiment"), F.lit("again"))
    return logs.read_perf(spark, path).withColumn("metric_FPS", F.round("metric_FPS", 6))


@query(
    "read_raw_errors",
    f"""WITH {VF} SELECT 'PC' AS machine, dataset, 'no_temp' AS method, '20240101.000000' AS stamp, video,
    max({V.BINARY}) AS pred, max({V.TRUTH}) AS truth,
    CAST(max({V.BINARY}) = max({V.TRUTH}) AS INTEGER) AS correct FROM frames GROUP BY dataset, video""",
)
def _read_raw_errors(spark, sf):
    path = fresh_path(spark, "raw")
    fr = V.frames(spark, sf)
    videos = fr.groupBy("dataset", "video").agg(
        F.max(L.to_binary_label("pred_label")).alias("preds"),
        F.max(L.ground_truth("video", F.lit("test"))).alias("target"),
    )
    rows = videos.select(
        F.concat(
            L.make_run_name(F.lit("PC"), "dataset", F.lit("no_temp"), F.lit("20240101.000000")), F.lit("_raw.csv")
        ).alias("run"),
        F.concat(F.lit("E:\\out\\"), "video", F.lit("_results.csv")).alias("csv_outfile"),
        "preds",
        "target",
        L.confusion_cell("preds", "target").alias("corrected?"),
    )
    rows.write.partitionBy("run").options(sep=";", header="true", escape='"').csv(path)
    return logs.read_raw_errors(spark, path)


@query(
    "read_machine_names",
    "SELECT s_suppkey, n_name AS pc_name, 'M' || n_nationkey AS abbr FROM supplier JOIN nation ON s_nationkey = n_nationkey",
)
def _read_machines(spark, sf):
    path = fresh_path(spark, "machines")
    nation = V.table(spark, sf, "nation").withColumn("abbr", F.concat(F.lit("M"), F.col("n_nationkey").cast("string")))
    nation.select(F.col("n_name").alias("pc_name"), "abbr").write.options(sep=";", header="true").csv(path)
    names = logs.read_machine_names(spark, path)
    hosts = V.table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return hosts.select("s_suppkey", F.col("n_name").alias("pc_name")).join(names, "pc_name")


@query(
    "read_speed_logs",
    """WITH s AS (SELECT 'alg' || l_linenumber AS algorithm, round(avg(l_quantity), 6) AS q,
    round(avg(l_extendedprice), 4) AS p FROM lineitem GROUP BY 1)
    SELECT algorithm, q AS fps, CAST(-1 AS DOUBLE) AS fps_included, CAST(-1 AS DOUBLE) AS fps_excluded, 'cam.mp4' AS video_file FROM s
    UNION ALL SELECT algorithm, -1, q, p, 'cam.mp4' FROM s""",
)
def _read_speed_logs(spark, sf):
    li = V.table(spark, sf, "lineitem")
    s = li.groupBy(F.concat(F.lit("alg"), F.col("l_linenumber").cast("string")).alias("Algorithm")).agg(
        F.round(F.avg("l_quantity"), 6).alias("q"), F.round(F.avg("l_extendedprice"), 4).alias("p")
    )
    one, two = fresh_path(spark, "speed"), fresh_path(spark, "speed")
    logs.append_speed_log(
        s.select("Algorithm", F.col("q").alias("FPS"), F.lit("cam.mp4").alias("Video File (1920x1080@30)")), one
    )
    both = s.select(
        "Algorithm",
        F.col("q").alias("FPS (include_cap_read)"),
        F.col("p").alias("FPS (exlcude_cap_read)"),
        F.lit("cam.mp4").alias("Video File (1920*1060@30)"),
    )
    logs.append_speed_log(both, two)
    out = logs.read_speed_logs(spark, [one, two])
    speeds = {c: F.coalesce(c, F.lit(-1.0)) for c in ("fps", "fps_included", "fps_excluded")}
    return out.withColumns(speeds).drop("source")


@query(
    "write_predictions",
    f"""WITH {V.SCORES} SELECT f AS format, count(*) AS rows, CAST(sum(vec_id) AS BIGINT) AS ids, round(sum(a), 6) AS first_logits
    FROM scores, (VALUES ('csv'), ('json'), ('parquet')) t(f) GROUP BY f""",
)
def _write_predictions(spark, sf):
    df = V.scores(spark, sf)
    path = fresh_path(spark, "predictions")
    csv, js, pq = logs.write_predictions(df, path, ("csv", "json", "parquet"))
    flat = "vec_id LONG, logits STRING, class_names STRING, target INT"
    back = [
        spark.read.schema(flat).options(header="true", quote='"', escape='"').csv(csv).select(
            F.lit("csv").alias("format"), "vec_id", F.get(F.from_json("logits", "array<double>"), F.lit(0)).alias("v")
        ),
        spark.read.schema(df.schema).json(js).select(F.lit("json"), "vec_id", F.get("logits", F.lit(0))),
        spark.read.schema(df.schema).parquet(pq).select(F.lit("parquet"), "vec_id", F.get("logits", F.lit(0))),
    ]
    rows = back[0].union(back[1]).union(back[2])
    return rows.groupBy("format").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("vec_id").alias("ids"), F.round(F.sum("v"), 6).alias("first_logits")
    )


# --- labels and names ----------------------------------------------------------------------------


@query(
    "to_binary_label",
    f"WITH {VF} SELECT video, frame_idx, {V.BINARY} AS label FROM frames",
)
def _binary(spark, sf):
    return V.frames(spark, sf).select("video", "frame_idx", L.to_binary_label("pred_label").alias("label"))


@query(
    "ground_truth",
    """WITH named AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'DFire' WHEN 1 THEN 'DFireStatic'
      WHEN 2 THEN 'FireNet' WHEN 3 THEN 'pexels' ELSE 'test' END AS dataset,
      CASE WHEN p_size % 2 = 0 THEN 'VP' ELSE 'FP' END || CASE WHEN p_size % 3 = 0 THEN 'NoFireVid' WHEN p_size % 3 = 1
      THEN 'nofire' ELSE '' END || p_partkey AS video FROM part)
    SELECT video, dataset, CASE
      WHEN dataset IN ('DFire', 'DFireStatic') THEN CASE WHEN contains(video, 'VP') THEN 'positive' ELSE 'negative' END
      WHEN dataset = 'FireNet' THEN CASE WHEN contains(video, 'NoFireVid') THEN 'negative' ELSE 'positive' END
      WHEN dataset = 'pexels' THEN 'positive'
      ELSE CASE WHEN contains(video, 'nofire') THEN 'negative' ELSE 'positive' END END AS truth FROM named""",
)
def _truth(spark, sf):
    p = V.table(spark, sf, "part")
    ds = F.element_at(
        F.array(*[F.lit(d) for d in ("DFire", "DFireStatic", "FireNet", "pexels", "test")]),
        (F.col("p_partkey") % 5 + 1).cast("int"),
    )
    tail = F.when(F.col("p_size") % 3 == 0, "NoFireVid").when(F.col("p_size") % 3 == 1, "nofire").otherwise("")
    video = F.concat(F.when(F.col("p_size") % 2 == 0, "VP").otherwise("FP"), tail, F.col("p_partkey").cast("string"))
    rows = p.select(video.alias("video"), ds.alias("dataset"))
    return rows.withColumn("truth", L.ground_truth("video", "dataset"))


@query(
    "fire_smoke_flags",
    f"""WITH {VF} SELECT video, frame_idx, CAST(lower(coalesce(pred_label,'None')) = 'fire' AS INTEGER) AS fire,
    CAST(lower(coalesce(pred_label,'None')) IN ('fire', 'smokeonly') AS INTEGER) AS smoke FROM frames""",
)
def _flags(spark, sf):
    return V.frames(spark, sf).select("video", "frame_idx", L.fire_smoke_flags("pred_label").alias("f")).select(
        "video", "frame_idx", "f.fire", "f.smoke"
    )


@query(
    "confusion_cell",
    f"WITH {VF} SELECT video, frame_idx, CAST({V.BINARY} = {V.TRUTH} AS INTEGER) AS correct FROM frames",
)
def _cell(spark, sf):
    return V.frames(spark, sf).select(
        "video",
        "frame_idx",
        L.confusion_cell(L.to_binary_label("pred_label"), L.ground_truth("video", F.lit("test"))).alias("correct"),
    )


@query(
    "frame_fps",
    f"""WITH {VF} SELECT video, frame_idx, CASE WHEN elapsed_time > 0 THEN round(1 / elapsed_time, 6) ELSE 0 END AS fps
    FROM frames""",
)
def _frame_fps(spark, sf):
    return V.frames(spark, sf).select("video", "frame_idx", F.round(L.frame_fps("elapsed_time"), 6).alias("fps"))


@query(
    "caption",
    f"""WITH {VF}, n AS (SELECT *, count(*) OVER (PARTITION BY video) AS num_frames FROM frames)
    SELECT video, frame_idx, (frame_idx + 1) || '/' || num_frames AS caption_frame,
    coalesce(pred_label, 'None') || ' (' || k || '.0%)' AS caption_label, k || '.00%' AS caption_active FROM n""",
)
def _caption(spark, sf):
    fr = V.frames(spark, sf)
    total = fr.groupBy("video").agg(F.count(F.lit(1)).alias("num_frames"))
    fr = spread_join(fr, total, ["video"], F.col("frame_idx"))
    fr = fr.withColumns({"probs": F.array(F.col("k") / F.lit(100.0)), "pred_label_idx": F.lit(0)})
    out = FR.caption(fr).withColumn("caption_active", L.active_caption(F.col("k") / F.lit(100.0)))
    return out.select("video", "frame_idx", "caption_frame", "caption_label", "caption_active")


@query("limit_frames", f"WITH {VF} SELECT video, frame_idx, elapsed_time FROM frames WHERE frame_idx <= 5")
def _limit(spark, sf):
    return FR.limit_frames(V.frames(spark, sf), 5).select("video", "frame_idx", "elapsed_time")


@query(
    "parse_run_name",
    f"WITH {V.RUNS} SELECT o_orderkey, machine, dataset, method, stamp FROM named",
)
def _parse_run(spark, sf):
    rows = V.run_rows(spark, sf)
    return rows.select("o_orderkey", L.parse_run_name("run").alias("r")).select("o_orderkey", "r.*")


@query("make_run_name", f"WITH {V.RUNS} SELECT o_orderkey, run FROM named")
def _make_run(spark, sf):
    rows = V.run_rows(spark, sf).select("o_orderkey", L.parse_run_name("run").alias("r"))
    return rows.select("o_orderkey", L.make_run_name("r.machine", "r.dataset", "r.method", "r.stamp").alias("run"))


@query(
    "flatten_struct",
    """SELECT l_orderkey AS "id", l_quantity AS "params.blk.size", l_tax AS "params.blk.thr", l_returnflag AS "params.mode",
    CAST(l_linenumber AS INTEGER) AS "line" FROM lineitem""",
)
def _flatten(spark, sf):
    nested = V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.struct(
            F.struct(F.col("l_quantity").alias("size"), F.col("l_tax").alias("thr")).alias("blk"),
            F.col("l_returnflag").alias("mode"),
        ).alias("params"),
        F.col("l_linenumber").alias("line"),
    )
    return FR.flatten_struct(nested)


@query(
    "parse_list_columns",
    f"""WITH {VF} SELECT video, frame_idx, k / CAST(100.0 AS DOUBLE) AS p0, 'O''Fire' AS c0, 'None' AS c1, CAST(2 AS INTEGER) AS n
    FROM frames""",
)
def _parse_lists(spark, sf):
    fr = V.frames(spark, sf)
    text = fr.select(
        "video",
        "frame_idx",
        F.concat(F.lit("["), (F.col("k") / F.lit(100.0)).cast("string"), F.lit(", 0.5]")).alias("probs"),
        F.lit("""["O'Fire", 'None']""").alias("class_names"),
    )
    out = FR.parse_list_columns(text)
    return out.select(
        "video",
        "frame_idx",
        F.get("probs", F.lit(0)).alias("p0"),
        F.get("class_names", F.lit(0)).alias("c0"),
        F.get("class_names", F.lit(1)).alias("c1"),
        F.size("probs").alias("n"),
    )


@query(
    "split_valid",
    f"""WITH {VF} SELECT CASE WHEN pred_label IS NULL THEN 'bad' ELSE 'good' END AS part, count(*) AS rows,
    CAST(sum(frame_idx) AS BIGINT) AS idx FROM frames GROUP BY 1""",
)
def _valid(spark, sf):
    good, bad = S.split_valid(V.frames(spark, sf), ["pred_label", "elapsed_time"])
    both = good.withColumn("part", F.lit("good")).unionByName(bad.withColumn("part", F.lit("bad")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum("frame_idx").alias("idx"))


@query(
    "validate_frames",
    f"WITH {VF} SELECT video, frame_idx, elapsed_time FROM frames",
)
def _validate(spark, sf):
    fr = V.frames(spark, sf).select("video", "frame_idx", "elapsed_time")
    return S.validate_frames(fr, ["video", "frame_idx", "elapsed_time"])


# --- scores --------------------------------------------------------------------------------------

VS = V.SCORES
_P = """probs AS (SELECT *, exp(a - greatest(a, b, c)) AS ea, exp(b - greatest(a, b, c)) AS eb, exp(c - greatest(a, b, c)) AS ec
  FROM scores)"""


@query(
    "softmax",
    f"""WITH {VS}, {_P} SELECT vec_id, round(ea / (ea + eb + ec), 9) AS p0, round(eb / (ea + eb + ec), 9) AS p1,
    round(ec / (ea + eb + ec), 9) AS p2 FROM probs""",
)
def _softmax(spark, sf):
    s = V.scores(spark, sf).withColumn("probs", S.softmax("logits"))
    return s.select("vec_id", *[F.round(F.get("probs", F.lit(i)), 9).alias(f"p{i}") for i in range(3)])


_ARG = "CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END"


@query(
    "argmax_label",
    f"""WITH {VS} SELECT vec_id, CAST({_ARG} AS INTEGER) AS idx,
    CASE {_ARG} WHEN 0 THEN 'Fire' WHEN 1 THEN 'None' ELSE 'SmokeOnly' END AS label FROM scores""",
)
def _argmax(spark, sf):
    s = V.scores(spark, sf)
    return s.select("vec_id", S.argmax_index("logits").alias("idx"), S.argmax_label("logits", "class_names").alias("label"))


@query(
    "topk",
    """WITH v AS (SELECT vec_id, unnest(range(0, 64)) AS i, embedding FROM embeddings),
    r AS (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS p,
      row_number() OVER (PARTITION BY vec_id ORDER BY embedding[i + 1] DESC, i) AS place FROM v)
    SELECT vec_id, CAST(max(i) FILTER (place = 1) AS INTEGER) AS index_0, CAST(max(i) FILTER (place = 2) AS INTEGER) AS index_1,
    CAST(max(i) FILTER (place = 3) AS INTEGER) AS index_2, max(p) FILTER (place = 1) AS prob_0,
    max(p) FILTER (place = 2) AS prob_1, max(p) FILTER (place = 3) AS prob_2 FROM r GROUP BY vec_id""",
)
def _topk(spark, sf):
    emb = V.table(spark, sf, "embeddings")
    s = emb.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("probs"))
    out = S.with_topk(s, 3, 64, names=None)
    return out.select("vec_id", *[f"{n}_{i}" for n in ("index", "prob") for i in range(3)])


@query(
    "topk_labels",
    f"""WITH {VS}, r AS (SELECT vec_id, [{{'p': -a, 'i': 0}}, {{'p': -b, 'i': 1}}, {{'p': -c, 'i': 2}}] AS l FROM scores),
    o AS (SELECT vec_id, list_sort(l) AS l FROM r)
    SELECT vec_id, ['Fire', 'None', 'SmokeOnly'][l[1].i + 1] AS best, ['Fire', 'None', 'SmokeOnly'][l[2].i + 1] AS second,
    CAST(3 AS INTEGER) AS n FROM o""",
)
def _topk_labels(spark, sf):
    out = S.with_topk(V.scores(spark, sf).withColumnRenamed("logits", "probs"), 5, 3, separate=False)
    return out.select(
        "vec_id",
        F.get("label", F.lit(0)).alias("best"),
        F.get("label", F.lit(1)).alias("second"),
        F.size("label").alias("n"),
    )


@query(
    "fill_skipped",
    f"""WITH {VS} SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 0 ELSE a END AS logit_0,
    CASE WHEN vec_id % 4 = 0 THEN 0 ELSE c END AS prob_2, CASE WHEN vec_id % 4 = 0 THEN -1 ELSE {_ARG} END AS idx,
    CASE WHEN vec_id % 4 = 0 THEN 'skipped' ELSE CASE {_ARG} WHEN 0 THEN 'Fire' WHEN 1 THEN 'None' ELSE 'SmokeOnly' END END AS label
    FROM scores""",
)
def _fill(spark, sf):
    s = V.scores(spark, sf)
    s = s.withColumns(
        {
            "probs": F.col("logits"),
            "pred_label_idx": S.argmax_index("logits"),
            "pred_label": S.argmax_label("logits", "class_names"),
        }
    )
    out = S.fill_skipped(s, F.col("vec_id") % 4 == 0, 3)
    return out.select(
        "vec_id",
        F.get("logits", F.lit(0)).alias("logit_0"),
        F.get("probs", F.lit(2)).alias("prob_2"),
        F.col("pred_label_idx").alias("idx"),
        F.col("pred_label").alias("label"),
    )


def _linear_model() -> np.ndarray:
    return np.array([0.5, -1.0, 2.0])


def _linear_predict(model: np.ndarray, batch: pd.DataFrame) -> pd.DataFrame:
    x = np.stack(batch["logits"].to_numpy())
    return pd.DataFrame({"vec_id": batch["vec_id"], "score": np.round(x @ model, 9)})


@query(
    "score_frames",
    f"WITH {VS} SELECT vec_id, round(0.5 * a - b + 2 * c, 9) AS score FROM scores",
)
def _score_frames(spark, sf):
    ship(spark)
    s = V.scores(spark, sf).select("vec_id", "logits")
    return T.score_frames(s, _linear_model, _linear_predict, "vec_id long, score double", key="linear")


# --- rectangles and pixels -----------------------------------------------------------------------

_BOXES = """boxes AS (SELECT o_orderkey, CAST(o_custkey % 50 AS INTEGER) AS ax, CAST(o_orderkey % 40 AS INTEGER) AS ay,
  CAST(o_orderkey % 60 AS INTEGER) AS bx, CAST(o_custkey % 30 AS INTEGER) AS "by" FROM orders)"""


@query(
    "rect_overlap",
    f"""WITH {_BOXES}, o AS (SELECT o_orderkey, ax, ay, greatest(ax, bx) AS x1, greatest(ay, "by") AS y1,
    least(ax + 20, bx + 15) AS x2, least(ay + 20, "by" + 25) AS y2 FROM boxes)
    SELECT o_orderkey, x1 - ax AS x1, y1 - ay AS y1, x2 - ax AS x2, y2 - ay AS y2 FROM o WHERE x2 > x1 AND y2 > y1""",
)
def _overlap(spark, sf):
    o = V.table(spark, sf, "orders")
    ax, ay = F.col("o_custkey") % 50, F.col("o_orderkey") % 40
    bx, by = F.col("o_orderkey") % 60, F.col("o_custkey") % 30
    hit = G.rect_overlap(G.rect(ax, ay, ax + 20, ay + 20), G.rect(bx, by, bx + 15, by + 25))
    return o.select("o_orderkey", hit.alias("r")).filter(F.col("r").isNotNull()).select("o_orderkey", "r.*")


@query(
    "mask_excluded",
    f"""WITH {V.CELLS} SELECT video, frame_idx, y, x,
    CASE WHEN x >= 2 AND x < 5 AND y >= 1 AND y < 4 THEN 114 ELSE gray END AS gray FROM cells""",
)
def _mask(spark, sf):
    from emberline.operators.motion import mask_excluded

    return mask_excluded(V.cells(spark, sf), G.rect(F.lit(2), F.lit(1), F.lit(5), F.lit(4)))


@query(
    "normalize_pixels",
    f"""WITH {V.BGR} SELECT video, frame_idx, y, x, round((r / 255.0::DOUBLE - 0.485::DOUBLE) / 0.229::DOUBLE, 6) AS r_norm,
    round((g / 255.0::DOUBLE - 0.456::DOUBLE) / 0.224::DOUBLE, 6) AS g_norm,
    round((b / 255.0::DOUBLE - 0.406::DOUBLE) / 0.225::DOUBLE, 6) AS b_norm FROM bgr""",
)
def _normalize(spark, sf):
    out = FR.normalize_pixels(V.cells_bgr(spark, sf))
    return out.select("video", "frame_idx", "y", "x", *[F.round(f"{c}_norm", 6).alias(f"{c}_norm") for c in "rgb"])


@query(
    "heat_value",
    f"""WITH {V.CELLS} SELECT video, frame_idx, y, x, CAST(floor((gray % 26) * 255 / 25.0) AS INTEGER) AS heat FROM cells""",
)
def _heat(spark, sf):
    return V.cells(spark, sf).select("video", "frame_idx", "y", "x", G.heat_value(F.col("gray") % 26).alias("heat"))
