"""Frame logs, perf rows and the small tables around them."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.functions.labels import parse_run_name, video_of_file

FRAME_LOG = T.StructType(
    [
        T.StructField("video", T.StringType()),
        T.StructField("num_frames", T.IntegerType()),
        T.StructField("frame_idx", T.IntegerType()),
        T.StructField("elapsed_time", T.DoubleType()),
        T.StructField("class_names", T.StringType()),
        T.StructField("logits", T.StringType()),
        T.StructField("probs", T.StringType()),
        T.StructField("pred_label_idx", T.IntegerType()),
        T.StructField("pred_label", T.StringType()),
    ]
)
PERF = T.StructType(
    [T.StructField("experiment", T.StringType()), T.StructField("dataset", T.StringType())]
    + [
        T.StructField(f"metric_{m}", T.DoubleType())
        for m in ("accuracy", "f1_score", "precision", "recall (TPR)", "FPR", "FPS")
    ]
)
VIDEO_META = "video_path STRING, frame_count INT, fps DOUBLE"
RAW_ERRORS = "csv_outfile STRING, preds STRING, target STRING, `corrected?` INT"
MACHINES = "pc_name STRING, abbr STRING"
VIDEO_TYPES = ("mp4", "avi", "mov", "mkv")

_CSV = {"sep": ";", "header": "true", "encoding": "UTF-8", "multiLine": "false", "mode": "FAILFAST"}


def _reader(spark: SparkSession, **options: str):
    # The word None is a class name and stays text; only an empty field is NULL.
    return spark.read.options(**{**_CSV, "nullValue": "", "quote": '"', "escape": '"', **options})


def file_name() -> Column:
    return F.col("_metadata.file_name")


def file_path() -> Column:
    """Whole path, so that a name may be a file's or the folder's that Spark wrote it into."""
    return F.col("_metadata.file_path")


def read_frame_log(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType = FRAME_LOG, by_video: bool = False
) -> DataFrame:
    """Per-frame results of many videos; perf files lying in the same folder are left out.

    With ``by_video`` the folders are those of :func:`write_frame_log`, ``video_part`` is a column, and a filter on it
    opens the files of its videos only. Else files may lie at any depth.
    """
    if by_video:
        log = _reader(spark, pathGlobFilter="*.csv").schema(T.StructType([*schema.fields, T.StructField("video_part", T.StringType())]))
    else:
        log = _reader(spark, recursiveFileLookup="true", pathGlobFilter="*.csv").schema(schema)
    log = log.csv(path).withColumn("file_name", file_name())
    return log.filter(~F.col("file_name").contains("__perf"))


def with_video_name(df: DataFrame, name: Column | None = None) -> DataFrame:
    """Video name from the file name ``<video>_results.csv``; perf files are dropped."""
    source = F.col("file_name") if name is None else name
    video = F.regexp_replace(video_of_file(source), "_results$", "")
    return df.filter(~source.contains("__perf")).withColumn("video", video)


_UNSAFE = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def _folder(video: str | None) -> str:
    """Folder of a video, named as Spark names a partition."""
    return "video_part=" + (_UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", video) if video else "__HIVE_DEFAULT_PARTITION__")


def write_frame_log(df: DataFrame, path: str) -> None:
    """One folder per video, arrays as list text.

    Rows are first brought together by video and frame range, so a task writes few files and a
    long video is still written by several tasks. Spark makes the lines; each task puts its own files in place, whole, under
    names that follow from video and range, so a task that runs again replaces them. Spark's own writer, whose driver moves the folders
    of all videos one after the other, is left for places that Arrow can't write to.
    """
    lists = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    flat = df.withColumns({c: F.to_json(c) for c in lists})
    stretch = F.floor(F.col("frame_idx") / F.lit(1 << 20))
    flat = flat.withColumn("video_part", F.col("video")).repartition("video", stretch)
    options = {"sep": ";", "header": "true", "encoding": "UTF-8", "quote": '"', "escape": '"', "nullValue": ""}
    try:
        files, root = fs.FileSystem.from_uri(path)
    except pa.ArrowException:
        flat.sortWithinPartitions("video", "frame_idx").write.partitionBy("video_part").options(**options).csv(path)
        return
    if files.get_file_info(root).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    files.create_dir(root, recursive=True)
    head = (";".join(df.columns) + "\n").encode()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(path)
        open_, out, n = None, None, 0

        def close() -> None:
            if out is not None:
                out.close()
                folder, name = f"{root}/{_folder(open_[0])}", f"part-{open_[1]}.csv"
                files.move(f"{folder}/.{name}-{own}", f"{folder}/{name}")

        own = uuid.uuid4().hex
        for batch in batches:
            videos, stretches, lines = (batch.column(c) for c in ("video_part", "stretch", "line"))
            keys = list(zip(videos.to_pylist(), stretches.to_pylist()))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, e in zip(cuts, cuts[1:]):
                if keys[a : a + 1] != [open_]:
                    close()
                    open_, n = keys[a], n + 1
                    files.create_dir(f"{root}/{_folder(open_[0])}", recursive=True)
                    out = files.open_output_stream(f"{root}/{_folder(open_[0])}/.part-{open_[1]}.csv-{own}")
                    out.write(head)
                out.write(("\n".join(lines.slice(a, e - a).to_pylist()) + "\n").encode())
        close()
        yield pa.record_batch([pa.array([n], pa.int64())], names=["files"])

    line = F.to_csv(F.struct(*df.columns), options).alias("line")
    rows = flat.sortWithinPartitions("video", stretch, "frame_idx").select("video_part", stretch.cast("long").alias("stretch"), line)
    rows.mapInArrow(write, "files long").agg(F.sum("files")).first()


def read_perf(spark: SparkSession, path: str | Sequence[str], schema: T.StructType = PERF) -> DataFrame:
    return _reader(spark, recursiveFileLookup="true", pathGlobFilter="*.csv").schema(schema).csv(path)


def write_perf(df: DataFrame, path: str, config: Column | None = None, mode: Column | None = None) -> None:
    """Write perf rows; ``experiment`` becomes ``<config>_<mode>`` when both are given."""
    if config is not None and mode is not None:
        df = df.withColumn("experiment", F.concat_ws("_", config, mode))
    df.write.options(sep=";", header="true", encoding="UTF-8").csv(path)


def read_video_meta(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Video inventory; the dataset comes from ``<dataset>_meta.csv``."""
    meta = _reader(spark, recursiveFileLookup="true", pathGlobFilter="*.csv").schema(VIDEO_META).csv(path)
    return meta.withColumn("dataset", F.regexp_extract(file_path(), r"([^/]+)_meta\.csv", 1))


def read_machine_names(spark: SparkSession, path: str) -> DataFrame:
    """Host names and their short forms; a schema by position is immune to the file's byte-order mark."""
    return _reader(spark, enforceSchema="true").schema(MACHINES).csv(path)


def read_raw_errors(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Per-video outcomes of a run, with the run's name taken apart."""
    raw = _reader(spark, recursiveFileLookup="true", pathGlobFilter="*.csv").schema(RAW_ERRORS).csv(path)
    run = parse_run_name(F.regexp_extract(file_path(), r"(?:^|/)(?:run=)?([^/=]+__ds_[^/]+)", 1))
    video = F.regexp_replace(video_of_file("csv_outfile"), "_results$", "")
    return raw.select(
        run.alias("run"),
        video.alias("video"),
        F.col("preds").alias("pred"),
        F.col("target").alias("truth"),
        F.col("corrected?").alias("correct"),
    ).select("run.*", "video", "pred", "truth", "correct")


def _speed_name(header: str) -> str:
    """``FPS``, or the variants with and without the time to read the frame (one header misspells it)."""
    low = header.lower()
    if "exclude" in low or "exlcude" in low:
        return "fps_excluded"
    return "fps_included" if "include" in low else "fps"


def read_speed_logs(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Speed logs with one or two FPS columns under one schema, one row per measurement."""
    tables = []
    for path in paths:
        raw = spark.read.options(sep=";", header="true", encoding="UTF-8").csv(path)
        speeds = [c for c in raw.columns if c.lower().startswith("fps")]
        video = next(c for c in raw.columns if c.lower().startswith("video file"))
        renamed = {c: _speed_name(c) for c in speeds}
        tables.append(
            raw.select(
                F.col("Algorithm").alias("algorithm"),
                *[F.col(f"`{c}`").cast("double").alias(n) for c, n in renamed.items()],
                F.col(f"`{video}`").alias("video_file"),
                file_name().alias("source"),
            )
        )
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def append_speed_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").options(sep=";", header="true", encoding="UTF-8").csv(path)


def write_predictions(df: DataFrame, path: str, formats: Sequence[str] = ("csv",)) -> list[str]:
    """Predictions as csv, json (one record per line) and/or parquet, in one folder per format."""
    unknown = [f for f in formats if f not in ("csv", "json", "parquet")]
    if unknown:
        raise ValueError(f"unknown prediction formats: {unknown}")
    lists = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType))]
    written = []
    for fmt in formats:
        target = f"{path}/{fmt}"
        if fmt == "csv":
            df.withColumns({c: F.to_json(c) for c in lists}).write.options(header="true", quote='"', escape='"').csv(target)
        elif fmt == "json":
            df.write.json(target)
        else:
            df.write.parquet(target)
        written.append(target)
    return written


def stream_frame_log(
    spark: SparkSession, path: str, schema: T.StructType | str, glob: str | None = None, files_per_trigger: int | None = None
) -> DataFrame:
    """The same records as a stream of parquet files."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)
