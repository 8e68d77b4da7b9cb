"""Files of a frame log: whole, named by video and range, and read back as written."""

import pathlib

from emberline.sources import logs


def test_each_task_puts_its_own_files_in_place(spark, tmp_path):
    path = tmp_path / "log"
    rows = [("a b", 1, 0.5, "x;\"y\""), ("a b", (1 << 20) + 1, 0.25, None), ("c=d%", 1, 1e-7, ""), ("e", 1, None, "None")]
    logs.write_frame_log(spark.createDataFrame(rows, "video string, frame_idx int, elapsed_time double, pred_label string").repartition(3), str(path))
    files = sorted(str(p.relative_to(path)) for p in pathlib.Path(path).rglob("*") if p.is_file())
    assert files == ["video_part=a b/part-0.csv", "video_part=a b/part-1.csv", "video_part=c%3Dd%25/part-0.csv", "video_part=e/part-0.csv"]
    got = spark.read.options(sep=";", header="true", quote='"', escape='"', nullValue="").csv(str(path), schema="video string, frame_idx int, elapsed_time double, pred_label string")
    want = {(v, i, e, p or None) for v, i, e, p in rows}
    assert {(r.video, r.frame_idx, r.elapsed_time, r.pred_label or None) for r in got.collect()} == want
