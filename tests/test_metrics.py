import pytest
from pyspark.sql import functions as F

from emberline.functions import labels as L
from emberline.functions import scores as S
from emberline.operators import inventory as J
from emberline.operators import metrics as M
from emberline.operators import profiling as P
from emberline.plans import report as R
from emberline.plans import sweep as SW
from tests import loops

# Published per-video outcome counts (tp, fp, tn, fn) and metrics
# (accuracy, f1_score, precision, recall, fpr) of twelve runs.
GOLDEN = {
    ("DFireStatic", "no_temp"): ((27, 2, 13, 8), (0.8000, 0.8438, 0.9310, 0.7714, 0.1333)),
    ("DFireStatic", "temp_stabilize"): ((27, 2, 13, 8), (0.8000, 0.8438, 0.9310, 0.7714, 0.1333)),
    ("DFireStatic", "temp_tpt"): ((26, 2, 13, 9), (0.7800, 0.8254, 0.9286, 0.7429, 0.1333)),
    ("DFire", "no_temp"): ((27, 11, 24, 8), (0.7286, 0.7397, 0.7105, 0.7714, 0.3143)),
    ("DFire", "temp_stabilize"): ((27, 11, 24, 8), (0.7286, 0.7397, 0.7105, 0.7714, 0.3143)),
    ("DFire", "temp_tpt"): ((26, 7, 28, 9), (0.7714, 0.7647, 0.7879, 0.7429, 0.2000)),
    ("FireNet", "no_temp"): ((46, 3, 13, 0), (0.9516, 0.9684, 0.9388, 1.0, 0.1875)),
    ("FireNet", "temp_stabilize"): ((46, 3, 13, 0), (0.9516, 0.9684, 0.9388, 1.0, 0.1875)),
    ("FireNet", "temp_tpt"): ((45, 2, 14, 1), (0.9516, 0.9677, 0.9574, 0.9783, 0.1250)),
    ("pexels", "no_temp"): ((96, 0, 0, 1), (0.9897, 0.9948, 1.0, 0.9897, 0.0)),
    ("pexels", "temp_stabilize"): ((96, 0, 0, 1), (0.9897, 0.9948, 1.0, 0.9897, 0.0)),
    ("pexels", "temp_tpt"): ((96, 0, 0, 1), (0.9897, 0.9948, 1.0, 0.9897, 0.0)),
}
NAMES = ["accuracy", "f1_score", "precision", "recall", "fpr"]


@pytest.fixture(scope="module")
def outcomes(spark):
    rows = []
    for (ds, method), ((tp, fp, tn, fn), _) in GOLDEN.items():
        for n, (pred, truth) in ((tp, (True, True)), (fp, (True, False)), (tn, (False, False)), (fn, (False, True))):
            rows += [(ds, method, f"{ds}{len(rows) + i}", pred, truth) for i in range(n)]
    return spark.createDataFrame(rows, "dataset string, method string, video string, pred boolean, truth boolean")


def test_published_metrics(outcomes):
    out = M.classification_metrics(outcomes, F.col("pred"), F.col("truth"), ["dataset", "method"]).collect()
    assert len(out) == 12
    for r in out:
        counts, values = GOLDEN[r.dataset, r.method]
        assert (r.tp, r.fp, r.tn, r.fn) == counts
        assert [r[n] for n in NAMES] == pytest.approx(values, abs=5e-5)


def test_published_report(outcomes):
    long = M.metric_matrix(
        outcomes.withColumns({"frame_idx": F.lit(1), "elapsed_time": F.lit(0.1)}),
        F.col("pred"), F.col("truth"), ["dataset", "method"], "per_video", ["accuracy", "FPR"],
    )
    pairs = [(d, m) for d in ("DFire", "FireNet") for m in ("accuracy", "FPR")]
    wide = R.order_methods(R.wide_report(long, pairs), ["no_temp", "temp_stabilize", "temp_tpt"]).collect()
    assert [r.method for r in wide] == ["no_temp", "temp_stabilize", "temp_tpt"]
    assert wide[2]["DFire|FPR"] == pytest.approx(0.2) and wide[0]["FireNet|accuracy"] == pytest.approx(0.9516, abs=5e-5)
    delta = {(r.dataset, r.method, r.metric): r.delta for r in R.baseline_delta(long).collect()}
    assert delta["DFire", "temp_tpt", "accuracy"] == pytest.approx(0.7714 - 0.7286, abs=1e-4)
    with pytest.raises(Exception):
        R.order_methods(long, ["no_temp"]).collect()


def test_small_published_values(spark):
    t = spark.createDataFrame([(i, v) for i, v in enumerate([9.0, 0.033, 0.040, 0.042, 0.037], 1)], "frame_idx int, elapsed_time double")
    assert M.fps(t).first().fps == pytest.approx(26.3158, abs=1e-4)
    assert M.fps(t.limit(0)).first().fps == 0.0
    p = spark.createDataFrame(list(zip([1, 0, 1, 0, 1], [0, 0, 1, 0, 1])), "p int, t int")
    assert M.classification_metrics(p, F.col("p") == 1, F.col("t") == 1).first().fpr == pytest.approx(1 / 3)
    q = spark.createDataFrame(list(zip([1, 0, 1, 1], [1, 0, 1, 0])), "p int, t int")
    r = M.classification_metrics(q, F.col("p") == 1, F.col("t") == 1).first()
    assert (r.accuracy, r.recall) == (0.75, 1.0) and r.precision == pytest.approx(2 / 3) and r.f1_score == pytest.approx(0.8)


def test_no_negatives_and_no_rows(spark):
    one = spark.createDataFrame([(True, True)], "p boolean, t boolean")
    assert M.classification_metrics(one, F.col("p"), F.col("t")).first().fpr == 0.0
    none = M.classification_metrics(one.filter("not p"), F.col("p"), F.col("t")).first()
    assert none.accuracy == 0.0 and none.f1_score == 0.0


def test_matrix_modes(spark):
    df = spark.createDataFrame([("v", 1, True, True, 0.1)], "video string, frame_idx int, p boolean, t boolean, elapsed_time double")
    out = M.metric_matrix(df, F.col("p"), F.col("t"), modes="per_frame").collect()
    assert {r["mode"] for r in out} == {"per_frame"} and len(out) == 6
    with pytest.raises(ValueError):
        M.metric_matrix(df, F.col("p"), F.col("t"), modes="per_day")


def test_labels(spark):
    rows = [(None, "negative"), ("None", "negative"), ("none", "negative"), ("skipped", "negative"), ("FIRE", "positive"), ("SmokeOnly", "positive")]
    df = spark.createDataFrame(rows, "label string, want string")
    assert df.filter(L.to_binary_label("label") != F.col("want")).count() == 0


@pytest.mark.parametrize(
    "video,dataset,want",
    [("VP1FP", "DFire", "positive"), ("FP1", "DFireStatic", "negative"), ("NoFireVid1", "FireNet", "negative"),
     ("nofirevid", "FireNet", "positive"), ("x", "pexels", "positive"), ("my_nofire_1", "test", "negative"),
     ("vp1", "DFire", None), ("x", "other", None)],
)
def test_ground_truth(spark, video, dataset, want):
    df = spark.createDataFrame([(video, dataset)], "v string, d string").select(L.ground_truth("v", "d").alias("t"))
    if want is None:
        with pytest.raises(Exception):
            df.collect()
    else:
        assert df.first().t == want


def test_run_names(spark):
    name = "BOX1__ds_DFire__mt_no_temp__20240102.030405__perf.csv"
    df = spark.createDataFrame([(name,), ("plain.csv",)], "n string").select(L.parse_run_name("n").alias("r")).collect()
    assert tuple(df[0].r) == ("BOX1", "DFire", "no_temp", "20240102.030405") and tuple(df[1].r) == (None,) * 4


def test_scores(spark):
    df = spark.createDataFrame([([1000.0, 1001.0, 1001.0], ["a", "b", "c"], 0)], "logits array<double>, names array<string>, t int")
    r = df.select(
        S.softmax("logits").alias("p"), S.argmax_label("logits", "names").alias("l"), S.target_rank("logits", "t").alias("rank"),
        S.cross_entropy("logits", "t").alias("loss"),
    ).first()
    assert sum(r.p) == pytest.approx(1.0) and r.l == "b" and r["rank"] == 3 and r.loss == pytest.approx(1.8620, abs=1e-4)
    top = S.with_topk(df.withColumnRenamed("logits", "probs"), 9, 3, names="names", separate=False).first()
    assert top["index"] == [1, 2, 0] and top.label == ["b", "c", "a"]
    with pytest.raises(Exception):
        df.select(S.argmax_label("logits", F.array(F.lit("a")))).collect()


def test_validate_frames(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    good, bad = S.split_valid(df, ["s"])
    assert good.count() == 1 and bad.count() == 1
    with pytest.raises(Exception):
        S.validate_frames(df, ["s"]).collect()
    with pytest.raises(ValueError):
        S.validate_frames(df, ["missing"])


def test_profile(spark):
    df = spark.createDataFrame(
        [("c", "a", 0, 0.0, 3.0), ("c", "a", 1, 5.0, 6.0), ("c", "a", 2, 9.0, None), ("c", "b", 0, 0.0, 6.0), ("c", "z", 0, 0.0, 1e-6)],
        "ctx string, step string, call_idx int, t_start double, t_end double",
    )
    out = {r.step: (r.calls, r.avg_time, r.percent_time) for r in P.profile_report(df).collect()}
    assert out == {"a": (2, 2.0, 25.0), "b": (1, 6.0, 75.0)}


def test_interval_join_meets_each_pair_once(spark):
    iv = spark.createDataFrame([(1, "k", 0.0, 25.0), (2, "k", 30.0, 30.0), (3, "k", 50.0, 60.0)], "id int, k string, t_start double, t_end double")
    sm = spark.createDataFrame([("k", float(t), t * 1.0, t) for t in range(0, 40, 5)], "k string, t double, power double, memory int")
    pairs = sorted((r.id, r.t) for r in P.samples_in_frame(iv, sm, ["k"], 10.0).collect())
    assert pairs == [(1, float(t)) for t in range(0, 30, 5)] + [(2, 30.0)]
    stats = {r.id: (r.gpu_avg_power, r.gpu_max_memory) for r in P.gpu_stats(iv, sm, ["k"], "id", 10.0).collect()}
    assert stats == {1: (12.5, 25.0), 2: (30.0, 30.0), 3: (0.0, 0.0)}


# --- joins -----------------------------------------------------------------------------------------


def test_missing_and_manifest(spark):
    v = spark.createDataFrame([("a",), ("b",)], "video string")
    r = spark.createDataFrame([("b",), ("c",)], "video string")
    assert sorted(tuple(x) for x in J.missing_outputs(v, r).collect()) == [("a", "no result"), ("c", "no video")]
    assert J.select_manifest(v, r, strict=False).count() == 1
    with pytest.raises(Exception):
        J.select_manifest(v, r).collect()


def test_unknown_machine(spark):
    runs = spark.createDataFrame([("h1",), ("h2",)], "pc_name string")
    names = spark.createDataFrame([("h1", "A")], "pc_name string, abbr string")
    assert J.attach_machine(runs.limit(1), names).first().machine == "A"
    with pytest.raises(Exception):
        J.attach_machine(runs, names).collect()


def test_experiment_matrix(spark):
    ds = spark.createDataFrame([("y",), ("x",)], "dataset string")
    out = sorted((r.stamp, r.method, r.dataset) for r in J.experiment_matrix(ds, ["m", "n"], ["1", "2", "3", "4"], 2).collect())
    assert out == [("1", "m", "x"), ("2", "m", "y"), ("3", "n", "x"), ("4", "n", "y")]
    with pytest.raises(ValueError):
        J.experiment_matrix(ds, ["m"], ["1"], 2)


def test_grid_size(spark):
    """Two scales, two block thresholds, two frame thresholds, four class thresholds, three minimum sizes."""
    space = {
        "diff_thres": {"type": "list", "values": [5]},
        "scale_factor": {"type": "list", "values": [1.0, 0.5]},
        "blk_size": {"type": "list", "values": [64]},
        "blk_act_thres": {"type": "range", "values": [0.05, 0.15, 0.05]},
        "frm_act_thres": {"type": "list", "values": [0.4, 0.7]},
        "firesmoke_cls_thres": {"type": "range", "values": [0.2, 0.51, 0.1]},
        "min_roi": {"type": "range", "values": [0.5, 0.71, 0.1]},
    }
    assert SW.trial_count(space) == 96
    grid = SW.param_grid(spark, space)
    assert sorted(r.trial_id for r in grid.collect()) == list(range(96))


def test_stratified_split(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(90)], "id long, cls string")
    out = J.stratified_split(df, [("train", 0.7), ("val", 0.2), ("test", 0.1)], "cls", F.col("id") * 7919 % 101, 101, "id", fan=8)
    got = {(r.cls, r.split): r["count"] for r in out.groupBy("cls", "split").count().collect()}
    assert got == {("a", "train"): 42, ("a", "val"): 12, ("a", "test"): 6, ("b", "train"): 21, ("b", "val"): 6, ("b", "test"): 3}


def test_ranking_shares_ties(spark):
    log = spark.createDataFrame([("a", 10.5), ("b", 120.0), ("c", 10.5), ("d", 0.2)], "algorithm string, fps double")
    assert {r.algorithm: r.place for r in R.speed_ranking(log).collect()} == {"b": 1, "a": 2, "c": 2, "d": 4}


def test_ranking_puts_null_and_nan_as_rank_does(spark):
    from pyspark.sql import Window

    rows = [("a", 10.5), ("b", None), ("c", 20.0), ("d", float("nan")), ("e", None), ("f", 20.0), ("g", -1.0)]
    log = spark.createDataFrame(rows, "algorithm string, fps double").repartition(5)
    want = log.withColumn("place", F.rank().over(Window.orderBy(F.col("fps").desc())))
    assert {r.algorithm: r.place for r in R.speed_ranking(log).collect()} == {r.algorithm: r.place for r in want.collect()}


def test_best_trial_and_tie(spark):
    t = spark.createDataFrame([(0, 0.1, None), (1, 0.2, 0.9), (2, 0.3, 0.9), (3, 0.4, 0.5)], "trial_id int, thr double, value double")
    assert R.best_trial(t).first().trial_id == 1


def test_long_report_drops_empty_cells(spark):
    wide = spark.createDataFrame([("m", 1.0, None), ("n", None, 2.0)], "method string, a double, b double")
    out = R.long_report(wide, [("a", "ds1", "acc"), ("b", "ds2", "f1")]).collect()
    assert sorted(tuple(r) for r in out) == [("m", "ds1", "acc", 1.0), ("n", "ds2", "f1", 2.0)]


def test_sweeps_equal_single_runs(spark):
    from emberline.operators import temporal as T

    rows = loops.make_frames(3, lengths=(5, 30, 60, 61, 90), hot=400, weights=(1, 1, 12, 4, 2, 3, 1))
    frames = spark.createDataFrame(rows, "video string, frame_idx int, pred_label string, elapsed_time double")
    truth = F.col("video") > "v2"
    windows, thresholds = [4, 10], [0.2, 0.5, 0.8]
    sticky = {(r.window, r.thr): (r.tp, r.fp, r.tn, r.fn) for r in SW.sweep_tpt_video(frames, truth, windows, thresholds).collect()}
    slide = {(r.window, r.thr): (r.tp, r.fp, r.tn, r.fn) for r in SW.sweep_tpt_sliding(frames, truth, windows, thresholds, size=16).collect()}
    for w in windows:
        for t in thresholds:
            videos = T.tpt_video(frames, w, t)
            c = M.confusion(videos, F.col("pred") == "positive", truth).first()
            assert sticky[w, t] == tuple(c)
            kept = M.per_video(T.tpt_sliding(frames, w, t), L.is_fire_or_smoke("pred_label"), truth)
            assert slide[w, t] == tuple(M.confusion(kept, F.col("pred"), F.col("truth")).first())
    assert len(set(sticky.values())) > 1 and len(set(slide.values())) > 1


@pytest.mark.parametrize("fan,order_range", [(4, 1000), (1024, 1000), (16, 3)])
def test_split_cuts_where_a_sort_would(spark, fan, order_range):
    """One class holds most rows, many rows share a hash, and there are NULLs."""
    import random

    rng = random.Random(order_range)
    rows = [(i, rng.choice(["a"] * 8 + ["b", "c", None]), rng.randrange(order_range)) for i in range(700)] + [(900, "single", 1)]
    df = spark.createDataFrame(rows, "id long, cls string, h long").repartition(5)
    shares = [("train", 0.7), ("val", 0.2), ("test", 0.1)]
    got = {r.id: r.split for r in J.stratified_split(df, shares, "cls", F.col("h"), order_range, "id", fan).collect()}
    for cls in {r[1] for r in rows}:
        own = sorted((r[2], r[0]) for r in rows if r[1] == cls)
        n = len(own)
        for place, (_, i) in enumerate(own, 1):
            assert got[i] == ("train" if place <= int(n * 0.7) else "val" if place <= int(n * 0.9) else "test")
