"""Queries over metrics, profiles, joins, reports and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.functions import labels as L
from emberline.functions import scores as S
from emberline.operators import inventory as J
from emberline.operators import metrics as M
from emberline.operators import motion as MO
from emberline.operators import profiling as P
from emberline.operators import temporal as T
from emberline.plans import report as R
from emberline.plans import sweep as SW
from emberline.plans import views as V
from emberline.plans.queries_temporal import METRICS_SQL, STICKY, W, THR, counts_sql, truth
from emberline.plans.registry import query

VF, POS, BINARY, TRUTH = V.FRAMES, V.POS, V.BINARY, V.TRUTH


def _labels(spark, sf):
    """Quality as truth and toxicity as prediction."""
    return V.table(spark, sf, "labels").select(
        "doc_id", (F.col("quality") == 1).alias("truth"), (F.col("toxic") == 1).alias("pred")
    )


LAB = """lab AS (SELECT doc_id % 3 AS grp, quality = 1 AS t, toxic = 1 AS p FROM labels),
  counts AS (SELECT grp, sum(CAST(p AND t AS INT)) AS tp, sum(CAST(p AND NOT t AS INT)) AS fp,
    sum(CAST(NOT p AND NOT t AS INT)) AS tn, sum(CAST(NOT p AND t AS INT)) AS fn FROM lab GROUP BY grp)"""


@query(
    "confusion",
    f"""WITH {LAB} SELECT grp, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn,
    CAST(fn AS BIGINT) AS fn FROM counts""",
)
def _confusion(spark, sf):
    rows = _labels(spark, sf).withColumn("grp", F.col("doc_id") % 3)
    return M.confusion(rows, F.col("pred"), F.col("truth"), ["grp"])


@query("classification_metrics", f"WITH {LAB} SELECT grp, {METRICS_SQL} FROM counts")
def _classification(spark, sf):
    rows = _labels(spark, sf).withColumn("grp", F.col("doc_id") % 3)
    return M.classification_metrics(rows, F.col("pred"), F.col("truth"), ["grp"])


@query(
    "fpr",
    f"""WITH {VF}, {counts_sql('frames', 'dataset')} SELECT dataset,
    CASE WHEN fp + tn > 0 THEN CAST(fp AS DOUBLE) / (fp + tn) ELSE 0 END AS fpr FROM counts""",
)
def _fpr(spark, sf):
    videos = M.per_video(V.frames(spark, sf), L.is_fire_or_smoke("pred_label"), truth(), ["dataset"])
    counts = M.confusion(videos, F.col("pred"), F.col("truth"), ["dataset"])
    return counts.select("dataset", M.fpr().alias("fpr"))


_FPS = {
    "total": "count(*) FILTER (frame_idx > 1) / sum(elapsed_time) FILTER (frame_idx > 1)",
    "mean_time": "1 / avg(elapsed_time) FILTER (frame_idx > 1)",
    "mean_rate": "avg(CASE WHEN elapsed_time > 0 THEN 1 / elapsed_time ELSE 0 END)",
}


def _register_fps(mode: str) -> None:
    @query(
        f"fps_{mode}",
        f"""WITH {VF} SELECT dataset, count(*) FILTER (frame_idx > 1) AS timed_frames,
        round({_FPS[mode]}, 6) AS fps FROM frames GROUP BY dataset""",
    )
    def _fps(spark, sf):
        out = M.fps(V.frames(spark, sf), ["dataset"], mode)
        return out.select("dataset", "timed_frames", F.round("fps", 6).alias("fps"))


for _mode in _FPS:
    _register_fps(_mode)


@query(
    "per_video",
    f"""WITH {VF} SELECT dataset, video, bool_or({POS}) AS pred, bool_or(NOT contains(video, 'nofire')) AS truth
    FROM frames GROUP BY 1, 2""",
)
def _per_video(spark, sf):
    return M.per_video(V.frames(spark, sf), L.is_fire_or_smoke("pred_label"), truth(), ["dataset"])


@query(
    "per_video_unique",
    f"WITH {VF} SELECT video, bool_or(coalesce(pred_label, 'None') <> 'None') AS pred FROM frames GROUP BY video",
)
def _unique(spark, sf):
    return M.per_video_unique(V.frames(spark, sf))


FRAME_COUNTS = f"""fcounts AS (SELECT dataset, sum(CAST(p AND t AS INT)) AS tp, sum(CAST(p AND NOT t AS INT)) AS fp,
  sum(CAST(NOT p AND NOT t AS INT)) AS tn, sum(CAST(NOT p AND t AS INT)) AS fn
  FROM (SELECT dataset, {POS} AS p, NOT contains(video, 'nofire') AS t FROM frames) GROUP BY dataset)"""


@query("per_frame", f"WITH {VF}, {FRAME_COUNTS} SELECT dataset, {METRICS_SQL} FROM fcounts")
def _per_frame(spark, sf):
    return M.classification_metrics(V.frames(spark, sf), L.is_fire_or_smoke("pred_label"), truth(), ["dataset"])


@query(
    "error_table",
    f"""WITH {VF} SELECT video, max({BINARY}) AS pred, max({TRUTH}) AS truth,
    CAST(max({BINARY}) = max({TRUTH}) AS INTEGER) AS correct FROM frames GROUP BY video""",
)
def _errors(spark, sf):
    videos = V.frames(spark, sf).groupBy("video").agg(
        F.max(L.to_binary_label("pred_label")).alias("pred"), F.max(L.ground_truth("video", F.lit("test"))).alias("truth")
    )
    return M.error_table(videos)


@query(
    "first_errors",
    f"""WITH {VF} SELECT video, max({BINARY}) AS pred, max({TRUTH}) AS truth, CAST(0 AS INTEGER) AS correct FROM frames
    GROUP BY video HAVING max({BINARY}) <> max({TRUTH}) ORDER BY video LIMIT 10""",
)
def _first_errors(spark, sf):
    return R.first_errors(_errors(spark, sf), 10)


_NAMES = {
    "accuracy": "accuracy",
    "f1_score": "f1_score",
    "precision": '"precision"',
    "recall (TPR)": "recall",
    "FPR": "fpr",
}
MATRIX = f"""{VF}, {counts_sql('frames', 'dataset')}, {FRAME_COUNTS},
  vm AS (SELECT dataset, {METRICS_SQL} FROM counts), fm AS (SELECT dataset, {METRICS_SQL} FROM fcounts),
  speed AS (SELECT dataset, {_FPS['total']} AS fps FROM frames GROUP BY dataset),
  matrix AS ({' UNION ALL '.join(
      f"SELECT dataset, '{mode}' AS mode, '{n}' AS metric, {c} AS value FROM {t}"
      for mode, t in (('per_video', 'vm'), ('per_frame', 'fm')) for n, c in _NAMES.items())}
  UNION ALL SELECT dataset, mode, 'FPS', fps FROM speed, (VALUES ('per_video'), ('per_frame')) m(mode))"""


def _matrix(spark, sf, modes=("per_video", "per_frame")):
    return M.metric_matrix(V.frames(spark, sf), L.is_fire_or_smoke("pred_label"), truth(), ["dataset"], modes)


@query("metric_matrix", f"WITH {MATRIX} SELECT dataset, mode, metric, round(value, 6) AS value FROM matrix")
def _metric_matrix(spark, sf):
    return _matrix(spark, sf).withColumn("value", F.round("value", 6))


_X = "greatest(a, b, c)"
_LSE = f"({_X} + ln(exp(a - {_X}) + exp(b - {_X}) + exp(c - {_X})))"
_T = "CASE target WHEN 0 THEN a WHEN 1 THEN b ELSE c END"
_RANK = f"""(1 + CAST(a > {_T} OR (a = {_T} AND 0 < target) AS INT) + CAST(b > {_T} OR (b = {_T} AND 1 < target) AS INT)
  + CAST(c > {_T} OR (c = {_T} AND 2 < target) AS INT))"""


@query(
    "topk_accuracy",
    f"""WITH {V.SCORES} SELECT target AS class_id, count(*) AS rows, round(avg({_LSE} - ({_T})), 6) AS loss,
    round(avg(CASE WHEN {_RANK} <= 1 THEN 1.0 ELSE 0 END) * 100, 6) AS top1,
    round(avg(CASE WHEN {_RANK} <= 2 THEN 1.0 ELSE 0 END) * 100, 6) AS top2 FROM scores GROUP BY target""",
)
def _topk_accuracy(spark, sf):
    rows = V.scores(spark, sf).withColumn("class_id", F.col("target"))
    out = M.topk_accuracy(rows, (1, 2), ["class_id"])
    return out.withColumns({c: F.round(c, 6) for c in ("loss", "top1", "top2")})


@query("cross_entropy", f"WITH {V.SCORES} SELECT vec_id, round({_LSE} - ({_T}), 9) AS loss FROM scores")
def _cross_entropy(spark, sf):
    return V.scores(spark, sf).select("vec_id", F.round(S.cross_entropy("logits", "target"), 9).alias("loss"))


@query(
    "weighted_mean",
    """SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS l_discount,
    round(sum(l_tax * l_quantity) / sum(l_quantity), 6) AS l_tax FROM lineitem GROUP BY l_returnflag""",
)
def _weighted(spark, sf):
    out = M.weighted_mean(V.table(spark, sf, "lineitem"), ["l_discount", "l_tax"], "l_quantity", ["l_returnflag"])
    return out.withColumns({c: F.round(c, 6) for c in ("l_discount", "l_tax")})


@query(
    "run_summary",
    f"""WITH {VF}, {STICKY} SELECT s.video, 'persistence' AS technique, CAST(0.5 AS DOUBLE) AS threshold, CAST(50 AS INTEGER) AS window_size,
    bool_or({POS.replace('pred_label', 's.pred_label')}) AS detected,
    coalesce(min(s.frame_idx) FILTER ({POS.replace('pred_label', 's.pred_label')}), -1) AS first_frame,
    round(avg(f.elapsed_time), 6) AS time_avg FROM sticky s JOIN frames f USING (video, frame_idx) GROUP BY s.video""",
)
def _run_summary(spark, sf):
    out = M.run_summary(T.tpt_sticky(V.frames(spark, sf), W, THR), "persistence", THR, W)
    return out.withColumns({"first_frame": F.coalesce("first_frame", F.lit(-1)), "time_avg": F.round("time_avg", 6)})


@query(
    "count_videos",
    f"""WITH {V.META} SELECT dataset, count(*) AS videos, CAST(sum(frame_count) AS BIGINT) AS frames,
    round(sum(frame_count / fps), 6) AS seconds FROM meta GROUP BY dataset""",
)
def _count_videos(spark, sf):
    return M.count_videos(V.video_meta(spark, sf)).withColumn("seconds", F.round("seconds", 6))


# --- profiles --------------------------------------------------------------------------------------


@query(
    "profile_report",
    f"""WITH {V.SPANS}, s AS (SELECT ctx, step, count(*) AS calls, avg(t_end - t_start) AS m FROM spans WHERE t_end IS NOT NULL
      GROUP BY 1, 2 HAVING avg(t_end - t_start) >= 0.00001)
    SELECT ctx, step, calls, round(m, 6) AS avg_time, round(sum(m) OVER (PARTITION BY ctx), 6) AS total_avg_time,
    round(m / sum(m) OVER (PARTITION BY ctx) * 100, 6) AS percent_time FROM s""",
)
def _profile(spark, sf):
    out = P.profile_report(V.spans(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("avg_time", "total_avg_time", "percent_time")})


@query(
    "context_durations",
    f"WITH {V.SPANS} SELECT ctx, round(max(t_end) - min(t_start), 6) AS duration FROM spans GROUP BY ctx",
)
def _durations(spark, sf):
    return P.context_durations(V.spans(spark, sf)).withColumn("duration", F.round("duration", 6))


INTERVALS = """iv AS (SELECT event_id AS id, user_id, epoch_us(ts) AS t_start,
    epoch_us(ts) + CAST(floor(value * 60000000) AS BIGINT) AS t_end FROM events WHERE event_type = 'purchase'),
  sm AS (SELECT event_id AS sample_id, user_id, epoch_us(ts) AS t, value AS power,
    CAST(json_extract(props, '$.k') AS INTEGER) AS memory FROM events WHERE event_type <> 'purchase')"""


def _device(spark, sf):
    ev = V.table(spark, sf, "events")
    micros = V.micros_of("ts")
    iv = ev.filter(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("id"),
        "user_id",
        micros.alias("t_start"),
        (micros + F.floor(F.col("value") * 60000000).cast("long")).alias("t_end"),
    )
    sm = ev.filter(F.col("event_type") != "purchase").select(
        F.col("event_id").alias("sample_id"),
        "user_id",
        micros.alias("t"),
        F.col("value").alias("power"),
        F.get_json_object("props", "$.k").cast("int").alias("memory"),
    )
    return iv, sm


HOUR = 3600 * 1_000_000


@query(
    "samples_in_frame",
    f"""WITH {INTERVALS} SELECT iv.id, sm.sample_id FROM iv JOIN sm ON sm.user_id = iv.user_id AND t >= t_start AND t <= t_end""",
)
def _samples(spark, sf):
    iv, sm = _device(spark, sf)
    return P.samples_in_frame(iv, sm, ["user_id"], HOUR).select("id", "sample_id")


@query(
    "gpu_stats",
    f"""WITH {INTERVALS} SELECT iv.id, round(coalesce(avg(power), 0), 6) AS gpu_avg_power,
    CAST(coalesce(max(memory), 0) AS DOUBLE) AS gpu_max_memory FROM iv LEFT JOIN sm ON sm.user_id = iv.user_id AND t >= t_start
    AND t <= t_end GROUP BY iv.id""",
)
def _gpu(spark, sf):
    iv, sm = _device(spark, sf)
    out = P.gpu_stats(iv, sm, ["user_id"], "id", HOUR)
    return out.withColumn("gpu_avg_power", F.round("gpu_avg_power", 6))


def _stages(spark, sf):
    fr = V.frames(spark, sf)
    return fr.withColumns(
        {"data_time": F.col("elapsed_time") * 0.25, "infer_time": F.col("elapsed_time") * 0.75, "total_time": F.col("elapsed_time")}
    )


@query(
    "stage_means",
    f"""WITH {VF} SELECT dataset, round(avg(elapsed_time * 0.25), 9) AS data_time, round(avg(elapsed_time * 0.75), 9) AS infer_time,
    round(avg(elapsed_time), 9) AS total_time FROM frames WHERE frame_idx > 1 GROUP BY dataset""",
)
def _stage_means(spark, sf):
    stages = ["data_time", "infer_time", "total_time"]
    return P.stage_means(_stages(spark, sf), stages, ["dataset"]).withColumns({s: F.round(s, 9) for s in stages})


@query(
    "stage_ms",
    f"""WITH {VF} SELECT dataset, round(sum(elapsed_time * 0.25) / count(*) * 1000, 6) AS data_time_ms,
    round(sum(elapsed_time * 0.75) / count(*) * 1000, 6) AS infer_time_ms FROM frames GROUP BY dataset""",
)
def _stage_ms(spark, sf):
    out = P.stage_ms(_stages(spark, sf), ["data_time", "infer_time"], ["dataset"])
    return out.withColumns({c: F.round(c, 6) for c in ("data_time_ms", "infer_time_ms")})


# --- joins -------------------------------------------------------------------------------------------


def _ids(spark, sf, name):
    return V.table(spark, sf, name).select(F.col("doc_id").alias("video"))


@query(
    "missing_outputs",
    """SELECT doc_id AS video, 'no result' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT doc_id, 'no video' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
)
def _missing(spark, sf):
    return J.missing_outputs(_ids(spark, sf, "documents"), _ids(spark, sf, "labels"))


@query(
    "pending_videos",
    "SELECT doc_id AS video FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def _pending(spark, sf):
    return J.pending_videos(_ids(spark, sf, "documents"), _ids(spark, sf, "labels"))


@query(
    "attach_truth",
    f"""WITH {VF}, t AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'nofire_' ELSE 'fire_' END || c_custkey AS video,
      CASE WHEN c_acctbal > 0 THEN 'positive' ELSE 'negative' END AS truth FROM customer)
    SELECT f.video, f.frame_idx, coalesce(t.truth, 'unknown') AS truth FROM frames f LEFT JOIN t USING (video)""",
)
def _attach_truth(spark, sf):
    c = V.table(spark, sf, "customer")
    t = c.select(
        F.concat(F.when(F.col("c_custkey") % 3 == 0, "nofire_").otherwise("fire_"), F.col("c_custkey").cast("string")).alias("video"),
        F.when(F.col("c_acctbal") > 0, "positive").otherwise("negative").alias("truth"),
    )
    fr = V.frames(spark, sf).select("video", "frame_idx")
    return M.attach_truth(fr, t).withColumn("truth", F.coalesce("truth", F.lit("unknown")))


@query(
    "attach_machine",
    """SELECT s_suppkey, n_name AS pc_name, 'M' || n_nationkey AS machine FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def _machine(spark, sf):
    n = V.table(spark, sf, "nation")
    hosts = n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("pc_name"))
    runs = V.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey").join(hosts, "s_nationkey").drop("s_nationkey")
    names = n.select(F.col("n_name").alias("pc_name"), F.concat(F.lit("M"), F.col("n_nationkey").cast("string")).alias("abbr"))
    return J.attach_machine(runs, names)


def _parsed_runs(spark, sf):
    rows = V.run_rows(spark, sf)
    return rows.select("run", L.parse_run_name("run").alias("r")).select("run", "r.*").distinct()


@query(
    "reuse_runs",
    f"""WITH {V.RUNS}, d AS (SELECT DISTINCT run, machine, dataset, method, stamp FROM named),
    src AS (SELECT machine, dataset, arg_max(run, stamp) AS source_run FROM d WHERE method = 'no_temp' GROUP BY 1, 2)
    SELECT d.run, d.machine, d.dataset, d.stamp, src.source_run FROM d JOIN src USING (machine, dataset) WHERE method = 'temp_tpt'""",
)
def _reuse(spark, sf):
    out = J.reuse_runs(_parsed_runs(spark, sf))
    return out.filter(F.col("method") == "temp_tpt").select("run", "machine", "dataset", "stamp", "source_run")


@query(
    "latest_runs",
    f"""WITH {V.RUNS} SELECT machine, dataset, max(stamp) AS stamp FROM runs GROUP BY 1, 2""",
)
def _latest(spark, sf):
    return J.latest_runs(_parsed_runs(spark, sf)).select("machine", "dataset", "stamp")


@query(
    "experiment_matrix",
    f"""WITH {VF}, d AS (SELECT dataset, row_number() OVER (ORDER BY dataset) AS place FROM (SELECT DISTINCT dataset FROM frames))
    SELECT m.method, d.dataset, 't' || (m.i * 4 + d.place) AS stamp
    FROM d, (VALUES (0, 'no_temp'), (1, 'temp_tpt'), (2, 'temp_stabilize')) m(i, method)""",
)
def _experiments(spark, sf):
    methods = ["no_temp", "temp_tpt", "temp_stabilize"]
    stamps = [f"t{i + 1}" for i in range(12)]
    return J.experiment_matrix(V.frames(spark, sf), methods, stamps, n_datasets=4)


@query(
    "param_grid",
    f"""WITH {VF}, d AS (SELECT dataset, count(*) AS frames FROM frames GROUP BY dataset)
    SELECT d.*, CAST(bi * 12 + ai * 4 + ci AS INTEGER) AS trial_id, blk_size, blk_act_thres, cls_thres FROM d,
    (VALUES (0, 32), (1, 64)) b(bi, blk_size), (VALUES (0, 0.05::DOUBLE), (1, 0.1::DOUBLE), (2, 0.15::DOUBLE)) a(ai, blk_act_thres),
    (VALUES (0, 0.2::DOUBLE), (1, 0.3::DOUBLE), (2, 0.4::DOUBLE), (3, 0.5::DOUBLE)) c(ci, cls_thres)""",
)
def _grid(spark, sf):
    sizes = V.frames(spark, sf).groupBy("dataset").agg(F.count(F.lit(1)).alias("frames"))
    return SW.with_grid(
        sizes,
        {
            "blk_size": {"type": "list", "values": [32, 64]},
            "blk_act_thres": {"type": "range", "values": [0.05, 0.2, 0.05]},
            "cls_thres": {"type": "range", "values": [0.2, 0.51, 0.1]},
        },
    )


@query(
    "select_manifest",
    "SELECT doc_id AS video, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
)
def _manifest(spark, sf):
    docs = V.table(spark, sf, "documents").select(F.col("doc_id").alias("video"), "n_chars")
    wanted = V.table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("video"))
    return J.select_manifest(docs, wanted)


@query(
    "union_perf",
    f"""WITH {VF}, {counts_sql('frames', 'dataset')} SELECT 'a' AS method, dataset, CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn) AS metric_accuracy,
    CAST(-1 AS DOUBLE) AS metric_TNR FROM counts UNION ALL SELECT 'b', dataset, -1, CASE WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / (tn + fp) ELSE 0 END FROM counts""",
)
def _union_perf(spark, sf):
    videos = M.per_video(V.frames(spark, sf), L.is_fire_or_smoke("pred_label"), truth(), ["dataset"])
    counts = M.confusion(videos, F.col("pred"), F.col("truth"), ["dataset"])
    a = counts.select(F.lit("a").alias("method"), "dataset", M.accuracy().alias("metric_accuracy"))
    b = counts.select(
        F.lit("b").alias("method"), "dataset", M.ratio(F.col("tn"), F.col("tn") + F.col("fp")).alias("metric_TNR")
    )
    return J.union_perf(a, b).withColumns(
        {c: F.coalesce(c, F.lit(-1.0)) for c in ("metric_accuracy", "metric_TNR")}
    )


SPEED = """speed AS (SELECT p_brand || '/' || p_type AS algorithm, round(avg(p_retailprice), 2) AS fps,
  round(avg(p_retailprice + p_size), 2) AS fps2 FROM part GROUP BY 1)"""


def _speeds(spark, sf):
    p = V.table(spark, sf, "part")
    return p.groupBy(F.concat_ws("/", "p_brand", "p_type").alias("algorithm")).agg(
        F.round(F.avg("p_retailprice"), 2).alias("fps"), F.round(F.avg(F.col("p_retailprice") + F.col("p_size")), 2).alias("fps2")
    )


@query(
    "compare_speed",
    f"WITH {SPEED} SELECT algorithm, fps AS fps_included, fps2 AS fps_excluded, round(fps2 / fps, 6) AS speedup FROM speed",
)
def _compare(spark, sf):
    s = _speeds(spark, sf)
    out = J.compare_speed(s.select("algorithm", "fps"), s.select("algorithm", F.col("fps2").alias("fps")))
    return out.withColumn("speedup", F.round("speedup", 6))


@query(
    "speed_ranking",
    f"WITH {SPEED} SELECT algorithm, fps, rank() OVER (ORDER BY fps DESC) AS place FROM speed",
)
def _ranking(spark, sf):
    return R.speed_ranking(_speeds(spark, sf).select("algorithm", "fps"))


@query(
    "stratified_split",
    """WITH n AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY (doc_id * 2654435761) % 1000003, doc_id) AS place,
      count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT doc_id, lang, CASE WHEN place <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN place <= floor(n * 0.9::DOUBLE) THEN 'val'
    ELSE 'test' END AS split FROM n""",
)
def _split(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", "lang")
    # The same remainder with a product that stays small for any id.
    order = (F.col("doc_id") % 1000003) * F.lit(2654435761) % 1000003
    return J.stratified_split(
        docs, [("train", 0.7), ("val", 0.2), ("test", 0.1)], "lang", order, 1000003, "doc_id"
    )


@query(
    "class_index",
    """SELECT p_brand AS class_name, row_number() OVER (ORDER BY p_brand) - 1 AS class_id
    FROM (SELECT DISTINCT p_brand FROM part)""",
)
def _classes(spark, sf):
    return J.class_index(V.table(spark, sf, "part"), "p_brand")


@query(
    "with_class_index",
    """SELECT p_partkey, p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS class_id FROM part""",
)
def _with_classes(spark, sf):
    return J.with_class_index(V.table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand")


# --- reports -----------------------------------------------------------------------------------------


def _perf_long(spark, sf):
    """Accuracy and FPR per dataset, without and with the persistence threshold."""
    fr = V.frames(spark, sf)
    pos = L.is_fire_or_smoke("pred_label")
    out = None
    for name, df in (("no_temp", fr), ("temp_tpt", T.tpt_sticky(fr, W, THR))):
        one = M.metric_matrix(df, pos, truth(), ["dataset"], "per_video", ["accuracy", "FPR"])
        one = one.select(F.lit(name).alias("method"), "dataset", "metric", "value")
        out = one if out is None else out.unionByName(one)
    return out


def _long_sql() -> str:
    parts = []
    for name, source in (("no_temp", "frames"), ("temp_tpt", "sticky")):
        c = counts_sql(source, "dataset").replace("videos AS", f"v_{name} AS").replace("FROM videos", f"FROM v_{name}")
        parts.append(c.replace("counts AS", f"c_{name} AS"))
    rows = []
    for name in ("no_temp", "temp_tpt"):
        rows.append(
            f"SELECT '{name}' AS method, dataset, 'accuracy' AS metric, CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn) AS value FROM c_{name}"
        )
        rows.append(
            f"SELECT '{name}', dataset, 'FPR', CASE WHEN fp + tn > 0 THEN CAST(fp AS DOUBLE) / (fp + tn) ELSE 0 END FROM c_{name}"
        )
    return f"{VF}, {STICKY}, {', '.join(parts)}, perf AS ({' UNION ALL '.join(rows)})"


LONG = _long_sql()
PAIRS = [(f"ds{d}", m) for d in range(4) for m in ("accuracy", "FPR")]


@query(
    "wide_report",
    f"""WITH {LONG} SELECT method, {', '.join(
        f"max(value) FILTER (dataset = '{d}' AND metric = '{m}') AS {d}_{m}" for d, m in PAIRS)} FROM perf GROUP BY method""",
)
def _wide(spark, sf):
    out = R.wide_report(_perf_long(spark, sf), PAIRS)
    return out.select("method", *[F.col(f"`{d}|{m}`").alias(f"{d}_{m}") for d, m in PAIRS])


@query(
    "long_report",
    f"WITH {LONG} SELECT method, dataset, metric, value FROM perf WHERE NOT (method = 'temp_tpt' AND dataset = 'ds2')",
)
def _long(spark, sf):
    wide = R.wide_report(_perf_long(spark, sf), PAIRS)
    # Empty cells of the wide table must not come back as rows.
    holes = {
        f"ds2|{m}": F.when(F.col("method") != "temp_tpt", F.col(f"`ds2|{m}`")) for m in ("accuracy", "FPR")
    }
    return R.long_report(wide.withColumns(holes), [(f"{d}|{m}", d, m) for d, m in PAIRS])


@query(
    "order_methods",
    f"""WITH {LONG} SELECT method, dataset, metric, value, CASE method WHEN 'temp_tpt' THEN 2 ELSE 1 END AS method_order FROM perf""",
)
def _order(spark, sf):
    return R.order_methods(_perf_long(spark, sf), ["no_temp", "temp_tpt", "temp_stabilize"])


@query(
    "baseline_delta",
    f"""WITH {LONG} SELECT p.*, b.value AS base_value, p.value - b.value AS delta FROM perf p
    JOIN perf b ON b.method = 'no_temp' AND b.dataset = p.dataset AND b.metric = p.metric""",
)
def _delta(spark, sf):
    return R.baseline_delta(_perf_long(spark, sf))


@query("perf_to_long", f"WITH {LONG} SELECT method, dataset, metric, value FROM perf")
def _to_long(spark, sf):
    wide = _perf_long(spark, sf).groupBy("method", "dataset").pivot("metric", ["accuracy", "FPR"]).agg(F.first("value"))
    wide = wide.withColumnsRenamed({"accuracy": "metric_accuracy", "FPR": "metric_FPR"})
    return R.to_long(wide, ["method", "dataset"])


# --- sweeps ------------------------------------------------------------------------------------------

_WINDOWS, _THRS = [10, 20, 50], [0.25, 0.5, 0.75]


def _values(name: str, values, kind: str) -> str:
    return f"(VALUES {', '.join(f'({v}::{kind})' for v in values)}) {name}_({name})"


SWEEP = f"""slots AS (SELECT video, w, (frame_idx - 1) % w AS slot FROM frames, {_values('w', _WINDOWS, 'INTEGER')} WHERE {POS} GROUP BY 1, 2, 3),
  n AS (SELECT v.video, w_.w, count(s.slot) AS c FROM (SELECT DISTINCT video FROM frames) v CROSS JOIN {_values('w', _WINDOWS, 'INTEGER')}
    LEFT JOIN slots s ON s.video = v.video AND s.w = w_.w GROUP BY 1, 2),
  trials AS (SELECT w, thr, c >= thr * w AS p, NOT contains(video, 'nofire') AS t FROM n, {_values('thr', _THRS, 'DOUBLE')}),
  counts AS (SELECT w AS "window", thr, sum(CAST(p AND t AS INT)) AS tp, sum(CAST(p AND NOT t AS INT)) AS fp,
    sum(CAST(NOT p AND NOT t AS INT)) AS tn, sum(CAST(NOT p AND t AS INT)) AS fn FROM trials GROUP BY 1, 2)"""


@query("sweep_tpt_sticky", f'WITH {VF}, {SWEEP} SELECT "window", thr, {METRICS_SQL} FROM counts')
def _sweep_sticky(spark, sf):
    return SW.sweep_tpt_video(V.frames(spark, sf), truth(), _WINDOWS, _THRS)


SLIDE = f"""c AS (SELECT video, frame_idx, {POS} AS pos, {', '.join(
    f"sum(CAST({V.DET} AS INT)) OVER (PARTITION BY video ORDER BY frame_idx ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS c{w}"
    for w in _WINDOWS)} FROM frames),
  kept AS (SELECT video, w, thr, bool_or(pos AND CASE w {' '.join(f'WHEN {w} THEN c{w}' for w in _WINDOWS)} END >= thr * w) AS p,
    NOT contains(video, 'nofire') AS t FROM c, {_values('w', _WINDOWS, 'INTEGER')}, {_values('thr', _THRS, 'DOUBLE')} GROUP BY video, w, thr),
  counts AS (SELECT w AS "window", thr, sum(CAST(p AND t AS INT)) AS tp, sum(CAST(p AND NOT t AS INT)) AS fp,
    sum(CAST(NOT p AND NOT t AS INT)) AS tn, sum(CAST(NOT p AND t AS INT)) AS fn FROM kept GROUP BY 1, 2)"""


@query("sweep_tpt_sliding", f'WITH {VF}, {SLIDE} SELECT "window", thr, {METRICS_SQL} FROM counts')
def _sweep_sliding(spark, sf):
    return SW.sweep_tpt_sliding(V.frames(spark, sf), truth(), _WINDOWS, _THRS)


@query(
    "best_trial",
    f"""WITH {VF}, {SWEEP}, m AS (SELECT "window", thr, {METRICS_SQL} FROM counts),
    t AS (SELECT *, row_number() OVER (ORDER BY "window", thr) AS trial_id FROM m)
    SELECT trial_id, "window", thr, accuracy AS value FROM t ORDER BY accuracy DESC, trial_id LIMIT 1""",
)
def _best_trial(spark, sf):
    trials = _sweep_sticky(spark, sf)
    trial_id = (
        F.array_position(F.array(*[F.lit(w) for w in _WINDOWS]), F.col("window")) * 3
        + F.array_position(F.array(*[F.lit(t) for t in _THRS]), F.col("thr"))
        - 3
    )
    rows = trials.select(trial_id.cast("long").alias("trial_id"), "window", "thr", F.col("accuracy").alias("value"))
    return R.best_trial(rows)


_MOTION = f"""per AS (SELECT video, frame_idx, d, bs, a, sum(CAST(n / CAST(bs * bs AS DOUBLE) > a AS INT)) AS n_active,
    CAST(8 // bs * (8 // bs) AS INTEGER) AS n_blocks
  FROM (SELECT video, frame_idx, d, bs, y // bs AS by_, x // bs AS bx_, sum(CAST(coalesce(diff > d, FALSE) AS INT)) AS n
    FROM diffs, {_values('d', [10, 20, 30], 'DOUBLE')}, {_values('bs', [2, 4], 'INTEGER')} GROUP BY 1, 2, 3, 4, 5, 6),
  {_values('a', [0.1, 0.3], 'DOUBLE')} GROUP BY 1, 2, 3, 4, 5)"""


@query(
    "sweep_motion",
    f"""WITH {V.DIFFS}, {_MOTION} SELECT d AS diff_thres, bs AS blk_size, a AS blk_act_thres, f AS frm_act_thres, count(*) AS frames,
    count(*) FILTER (n_active = 0) AS skipped, count(*) FILTER (n_active > 0 AND n_active / CAST(n_blocks AS DOUBLE) >= f) AS "full",
    count(*) FILTER (n_active > 0 AND n_active / CAST(n_blocks AS DOUBLE) < f) AS scored
    FROM per, {_values('f', [0.4, 0.7], 'DOUBLE')} GROUP BY 1, 2, 3, 4""",
)
def _sweep_motion(spark, sf):
    diffs = MO.frame_diff(V.cells(spark, sf), 0)
    return SW.sweep_motion(diffs, 8, 8, [10, 20, 30], [2, 4], [0.1, 0.3], [0.4, 0.7])
