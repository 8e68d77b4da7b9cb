import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators import frames as FR
from emberline.sources import logs, media

LOG = """video;num_frames;frame_idx;elapsed_time;class_names;logits;probs;pred_label_idx;pred_label
{v};2;1;0.9;['Fire', 'None', 'SmokeOnly'];[0.5, -1.25, 3e-05];[0.6, 0.2, 0.2];0;Fire
{v};2;2;0.04;['Fire', 'None', 'SmokeOnly'];[0.0, 0.0, 0.0];[0.0, 0.0, 0.0];-1;None
"""


def write(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)


def test_frame_log(spark, tmp_path):
    for v in ("VP1.cam", "FP2"):
        write(tmp_path / f"{v}_results.csv", LOG.format(v=v))
    write(tmp_path / "run__per_video__perf.csv", "experiment;dataset\nx;y\n")
    log = logs.with_video_name(FR.parse_list_columns(logs.read_frame_log(spark, str(tmp_path))))
    rows = log.orderBy("video", "frame_idx").collect()
    assert [(r.video, r.frame_idx, r.pred_label) for r in rows] == [
        ("FP2", 1, "Fire"), ("FP2", 2, "None"), ("VP1.cam", 1, "Fire"), ("VP1.cam", 2, "None")
    ]
    assert rows[0].logits == [0.5, -1.25, 3e-05] and rows[0].class_names == ["Fire", "None", "SmokeOnly"]


def test_frame_log_round_trip_keeps_the_word_none(spark, tmp_path):
    df = spark.createDataFrame(
        [("v", 1, i, 0.1, ["a'b", "c;d"], [1.0], [1.0], 0, l) for i, l in enumerate(["None", None, "Fire"], 1)],
        "video string, num_frames int, frame_idx int, elapsed_time double, class_names array<string>, logits array<double>,"
        "probs array<double>, pred_label_idx int, pred_label string",
    )
    path = str(tmp_path / "out")
    logs.write_frame_log(df, path)
    assert [d for d in os.listdir(path) if d.startswith("video_part=")] == ["video_part=v"]
    back = FR.parse_list_columns(logs.read_frame_log(spark, path)).orderBy("frame_idx").collect()
    assert [r.pred_label for r in back] == ["None", None, "Fire"] and back[0].class_names == ["a'b", "c;d"]


def test_video_meta_and_names(spark, tmp_path):
    write(tmp_path / "DFire_meta.csv", "video_path;frame_count;fps\ndatasets\\DFire\\test\\FP1.mp4;30;1.0\n")
    write(tmp_path / "pexels_meta.csv", "video_path;frame_count;fps\na/b.mp4;60;2.0\n")
    rows = sorted(tuple(r) for r in logs.read_video_meta(spark, str(tmp_path)).collect())
    assert rows == [("a/b.mp4", 60, 2.0, "pexels"), ("datasets\\DFire\\test\\FP1.mp4", 30, 1.0, "DFire")]
    write(tmp_path / "pcs.csv", "pc_name;abbr\nDESKTOP-1;MainPC\n", "utf-8-sig")
    assert [tuple(r) for r in logs.read_machine_names(spark, str(tmp_path / "pcs.csv")).collect()] == [("DESKTOP-1", "MainPC")]


def test_raw_errors(spark, tmp_path):
    write(
        tmp_path / "BOX1__ds_DFire__mt_no_temp__20240102.030405_raw.csv",
        "csv_outfile;preds;target;corrected?\nE:\\out\\run\\VP22_results.csv;negative;positive;0\n",
    )
    r = logs.read_raw_errors(spark, str(tmp_path)).first()
    assert tuple(r) == ("BOX1", "DFire", "no_temp", "20240102.030405", "VP22", "negative", "positive", 0)


def test_speed_logs(spark, tmp_path):
    write(tmp_path / "a.csv", "Algorithm;FPS;Video File (1920x1080@30)\nKNN;21.58;x.mp4\n")
    write(tmp_path / "b.csv", "Algorithm;FPS (include_cap_read);FPS (exlcude_cap_read);Video File (1920*1060@30)\nKNN;25.6;28.9;x.mp4\n")
    rows = logs.read_speed_logs(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()
    assert {(r.algorithm, r.fps, r.fps_included, r.fps_excluded) for r in rows} == {
        ("KNN", 21.58, None, None), ("KNN", None, 25.6, 28.9)
    }


def test_perf(spark, tmp_path):
    write(
        tmp_path / "x__perf.csv",
        "experiment;dataset;metric_accuracy;metric_f1_score;metric_precision;metric_recall (TPR);metric_FPR;metric_FPS\n"
        "no_temp;DFire;0.7285714149475098;0.7397;0.71;0.77;0.31;57.46\n",
    )
    r = logs.read_perf(spark, str(tmp_path)).first()
    assert r.experiment == "no_temp" and r["metric_recall (TPR)"] == 0.77
    logs.write_perf(logs.read_perf(spark, str(tmp_path)), str(tmp_path / "o"), F.lit("cfg"), F.lit("per_video"))
    assert logs.read_perf(spark, str(tmp_path / "o")).first().experiment == "cfg_per_video"


def test_predictions_reject_other_formats(spark, tmp_path):
    with pytest.raises(ValueError):
        logs.write_predictions(spark.range(1), str(tmp_path), ("xml",))


def test_list_videos(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.mp4", "b.MOV", "c.txt", "sub/d.avi"):
        (tmp_path / name).write_bytes(b"12345")
    flat = media.list_videos(spark, str(tmp_path))
    assert sorted((r.video, r.length) for r in flat.collect()) == [("a", 5), ("b", 5)]
    assert media.list_videos(spark, str(tmp_path), recursive=True).count() == 3
    assert "content" not in flat.columns


def png(path, rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\x00" + rgb[y].astype("uint8").tobytes() for y in range(h))

    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_frames(spark, tmp_path):
    rng = np.random.default_rng(0)
    images = {}
    for v in ("cam1", "cam2"):
        (tmp_path / v).mkdir()
        for i in (1, 2, 3):
            images[v, i] = rng.integers(0, 256, (3, 4, 3))
            png(tmp_path / v / f"f{i:03d}.png", images[v, i])
    frames = media.read_image_frames(spark, str(tmp_path))
    assert frames.count() == 6
    cells = media.image_cells(frames).collect()
    assert len(cells) == 6 * 12
    for c in cells:
        assert [c.r, c.g, c.b] == images[c.video, c.frame_idx][c.y, c.x].tolist()


def test_flatten(spark):
    df = spark.sql("SELECT named_struct('a', 1, 'b.c', named_struct('d', 2)) AS s, 3 AS t")
    assert FR.flatten_struct(df).columns == ["s.a", "s.b.c.d", "t"]


def test_images_written_and_cut_into_blocks(spark, tmp_path):
    import numpy as np

    from emberline.sources import media

    rng = np.random.default_rng(3)
    images = {("a", f): rng.integers(0, 256, (5, 7, 3), dtype=np.uint8) for f in (1, 2, 3)} | {("b", 1): rng.integers(0, 256, (4, 4, 1), dtype=np.uint8)}
    rows = [(v, f, *i.shape, i.tobytes()) for (v, f), i in images.items()] + [("b", 2, -1, -1, -1, None)]
    df = spark.createDataFrame(rows, "video string, frame_idx int, height int, width int, channels int, data binary")
    folder = f"file://{tmp_path}/images"
    assert media.write_image_frames(df, folder) == media.write_image_frames(df, folder) == 4
    back = media.read_image_frames(spark, folder)
    got = {(r.video, r.frame_idx): np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels) for r in back.collect()}
    assert got.keys() == images.keys()
    assert all((got[k] == np.broadcast_to(i, (*i.shape[:2], 3))).all() for k, i in images.items())
    blocks = {(r.video, r.frame_idx, r.blk_idx): r for r in media.image_blocks(df, 4).collect()}
    assert len(blocks) == 3 * 4 + 1
    one = np.array(blocks["a", 2, 3]["values"]).reshape(3, 4, 4)
    want = np.zeros((3, 4, 4))
    want[:, :1, :3] = images["a", 2][4:, 4:, ::-1].transpose(2, 0, 1) / 255
    assert (one == want).all() and (blocks["a", 2, 3].by, blocks["a", 2, 3].bx) == (1, 1)


def test_many_small_images_are_read_by_few_tasks(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(4)
    sizes = [(2, 3)] * 99 + [(300, 400)]
    images = {(v, f): rng.integers(0, 256, (*size, 3), dtype=np.uint8) for v in ("a", "b c") for f, size in enumerate(sizes, 1)}
    rows = [(v, f, *i.shape, i.tobytes()) for (v, f), i in images.items()]
    df = spark.createDataFrame(rows, "video string, frame_idx int, height int, width int, channels int, data binary")
    folder = f"{tmp_path}/images"
    media.write_image_frames(df, f"file://{folder}")
    (tmp_path / "images" / "a" / "999.bmp").write_bytes(b"no image")
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "1k")
    spark.sparkContext.setJobGroup("many-images", "")
    try:
        found = media.read_image_frames(spark, folder).collect()
    finally:
        spark.sparkContext.setJobGroup("", "")
        spark.conf.set(setting, before)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("many-images") for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) <= len(images) // 2
    assert [r.frame_idx for r in found if r.height < 0] == [101]
    got = {(r.video.replace("%20", " "), r.frame_idx): r.data for r in found if r.height > 0}
    assert {k: bytes(v) for k, v in got.items()} == {k: v.tobytes() for k, v in images.items()}
    cells = media.image_cells(df.where("video = 'a' AND frame_idx >= 98")).toPandas()
    for f in (98, 99, 100):
        part = cells[cells.frame_idx == f].sort_values(["y", "x"])
        assert (part[["b", "g", "r"]].to_numpy().reshape(images["a", f].shape) == images["a", f]).all()
    blocks = media.image_blocks(df.where("video = 'a'").coalesce(1), 4).collect()
    assert len(blocks) == len({(r.frame_idx, r.blk_idx) for r in blocks}) == 99 + 75 * 100
    last = next(r for r in blocks if (r.frame_idx, r.by, r.bx) == (100, 74, 99))
    assert (np.array(last["values"]).reshape(3, 4, 4) == images["a", 100][296:, 396:, ::-1].transpose(2, 0, 1) / 255).all()


def test_a_filter_on_the_video_opens_its_files_only(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("frame_idx", T.IntegerType()), T.StructField("pred_label", T.StringType())])
    df = spark.createDataFrame([(v, i, "Fire") for v in "abc" for i in range(1, 5)], "video string, frame_idx int, pred_label string")
    logs.write_frame_log(df.select("frame_idx", "pred_label", "video"), str(tmp_path / "log"))
    both = T.StructType([*schema.fields, T.StructField("video", T.StringType())])
    one = logs.read_frame_log(spark, str(tmp_path / "log"), both, by_video=True).where("video_part = 'b'")
    assert sorted((r.frame_idx, r.video_part, r.video) for r in one.collect()) == [(i, "b", "b") for i in range(1, 5)]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(video_part" in plan
    assert logs.read_frame_log(spark, str(tmp_path / "log"), both).count() == 12
