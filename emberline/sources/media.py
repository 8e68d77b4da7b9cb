"""Video file listings and image folders."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.labels import video_of_file
from emberline.operators.ordered import join_carry, number_by_range
from emberline.sources.logs import VIDEO_TYPES
from emberline.storage import materialize

PIXELS = 1 << 16  # pixels that go on from a task at a time
TASK_FILES, TASK_BYTES = 1024, 32 << 20  # of image files that a task reads


def list_videos(
    spark: SparkSession, path: str, exts: Sequence[str] = VIDEO_TYPES, recursive: bool = False
) -> DataFrame:
    """Files by extension. Only path and length are read, never the content."""
    kinds = ",".join(sorted({e for x in exts for e in (x.lstrip(".").lower(), x.lstrip(".").upper())}))
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*.{{{kinds}}}")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(path)
    )
    return files.select(F.col("path").alias("video_path"), video_of_file("path").alias("video"), "length")


def read_image_frames(spark: SparkSession, path: str) -> DataFrame:
    """A folder per video, an image per frame; frames follow the order of the file names.

    Returns ``video, frame_idx, height, width, channels, data`` with rows of blue-green-red bytes.
    Numbering touches the file names only, which are written once, so each image is opened and decoded once, where the
    result is read. An unreadable image keeps its number, with height -1 and no data.
    """
    images = (
        spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "false").load(path)
    )
    origin = F.col("_metadata.file_path").alias("__origin")
    # Without a column of the image, the source opens no file. It makes a task of few files, however small, so tasks are put together.
    least = 4 * spark.sparkContext.defaultParallelism
    names = materialize(images.select(origin, F.col("_metadata.file_size").alias("__size")).coalesce(least), "image-names")
    n, size = names.agg(F.count(F.lit(1)), F.coalesce(F.sum("__size"), F.lit(0))).first()
    tasks = max(least, -(-n // TASK_FILES), -(-size // TASK_BYTES))
    video = F.regexp_extract("__origin", r"([^/\\]+)[/\\][^/\\]+$", 1)
    names = names.drop("__size").withColumns({"video": video, "__name": video_of_file("__origin")})
    places = number_by_range(names, ["video"], ["__name"], "frame_idx")
    # The images are never the side that Spark broadcasts: it knows the size of their files only.
    out = join_carry(images.select("image.*", origin).coalesce(tasks), places.select("__origin", "video", "frame_idx"), ["__origin"])
    return out.select(
        "video", F.col("frame_idx").cast("int"), "height", "width", F.col("nChannels").alias("channels"), "data"
    )


def _bitmap(height: int, width: int, channels: int, data: bytes) -> bytes:
    """An uncompressed 24-bit bitmap file: rows from the bottom up, padded to four bytes."""
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)[:, :, :3]
    rows = np.zeros((height, -(-width * 3 // 4) * 4), dtype=np.uint8)
    rows[:, : width * 3] = np.broadcast_to(pixels, (height, width, 3)).reshape(height, -1)[::-1]
    head = struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def write_image_frames(frames: DataFrame, path: str) -> int:
    """Write image rows (see :func:`read_image_frames`) as a folder of bitmap files per video; how many.

    A file's name follows from its frame, so a task that runs again writes the same files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = fs.FileSystem.from_uri(path)
        made, n = set(), 0
        for batch in batches:
            for r in batch.to_pylist():
                if r["video"] not in made:
                    files.create_dir(f"{folder}/{r['video']}", recursive=True)
                    made.add(r["video"])
                with files.open_output_stream(f"{folder}/{r['video']}/{r['frame_idx']:012d}.bmp") as out:
                    out.write(_bitmap(r["height"], r["width"], r["channels"], r["data"]))
                n += 1
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    rows = frames.where("height > 0").select("video", "frame_idx", "height", "width", "channels", "data")
    return rows.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def image_blocks(frames: DataFrame, blk: int) -> DataFrame:
    """``(video, frame_idx, blk_idx, by, bx, values)``: blocks of each image as a model reads them, red, green and blue planes from 0 to 1.

    An image is filled up with zeros to whole blocks on the right and at the bottom. One image at a time is unpacked; its blocks go on in one
    Arrow batch, with those of the images before it as long as these are small. An unreadable image (height -1) has none.
    """

    def together(found: list[tuple[str, int, int, np.ndarray]]) -> pa.RecordBatch:
        counts = [len(values) for _, _, _, values in found]
        of = np.repeat(np.arange(len(found)), counts)
        at = np.concatenate([np.arange(n, dtype=np.int32) for n in counts])
        cols = np.array([c for _, _, c, _ in found], dtype=np.int32)[of]
        values = np.concatenate([values for _, _, _, values in found])
        offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1])
        video = pa.array([v for v, _, _, _ in found], pa.string()).take(pa.array(of))
        frame = pa.array([f for _, f, _, _ in found], pa.int32()).take(pa.array(of))
        return pa.record_batch(
            [video, frame, pa.array(at), pa.array(at // cols), pa.array(at % cols), pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))],
            names=["video", "frame_idx", "blk_idx", "by", "bx", "values"],
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                image = np.frombuffer(r["data"], dtype=np.uint8).reshape(r["height"], r["width"], r["channels"])
                image = np.broadcast_to(image[:, :, :3], (r["height"], r["width"], 3))[:, :, ::-1]
                rows, cols = -(-r["height"] // blk), -(-r["width"] // blk)
                whole = np.zeros((rows * blk, cols * blk, 3))
                whole[: r["height"], : r["width"]] = image / 255.0
                values = whole.reshape(rows, blk, cols, blk, 3).transpose(0, 2, 4, 1, 3).reshape(rows * cols, -1)
                held.append((r["video"], r["frame_idx"], cols, values))
                size += whole.shape[0] * whole.shape[1]
                if size >= PIXELS:
                    yield together(held)
                    held, size = [], 0
        if held:
            yield together(held)

    rows = frames.where("height > 0").select("video", F.col("frame_idx").cast("int").alias("frame_idx"), "height", "width", "channels", "data")
    return rows.mapInArrow(cut, "video string, frame_idx int, blk_idx int, by int, bx int, values array<double>")


def image_cells(frames: DataFrame) -> DataFrame:
    """One row per pixel. Frames' bytes are unpacked with numpy, a slice of rows of a large frame or many small frames at a time."""

    def together(held: list[tuple[str, int, int, np.ndarray]]) -> pd.DataFrame:
        counts = [part.shape[0] * part.shape[1] for _, _, _, part in held]
        of = np.repeat(np.arange(len(held)), counts)
        b, g, r = np.concatenate([part[:, :, :3].reshape(-1, 3) for _, _, _, part in held]).T.astype("int16")
        return pd.DataFrame(
            {
                "video": np.array([v for v, _, _, _ in held], dtype=object)[of],
                "frame_idx": np.array([f for _, f, _, _ in held], dtype="int32")[of],
                "y": np.concatenate([np.repeat(np.arange(top, top + len(p), dtype="int32"), p.shape[1]) for _, _, top, p in held]),
                "x": np.concatenate([np.tile(np.arange(p.shape[1], dtype="int32"), len(p)) for _, _, _, p in held]),
                "b": b,
                "g": g,
                "r": r,
            }
        )

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                pixels = np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width, r.channels)
                if r.channels == 1:
                    pixels = np.repeat(pixels, 3, axis=2)
                step = max(1, PIXELS // r.width)
                for top in range(0, r.height, step):
                    part = pixels[top : top + step]
                    held.append((r.video, r.frame_idx, top, part))
                    size += part.shape[0] * part.shape[1]
                    if size >= PIXELS:
                        yield together(held)
                        held, size = [], 0
        if held:
            yield together(held)

    return frames.where("height > 0").mapInPandas(
        unpack, "video string, frame_idx int, y int, x int, b smallint, g smallint, r smallint"
    )
