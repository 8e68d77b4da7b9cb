"""Motion on packed tiles: the same results as ``motion`` without one row per pixel.

A tile row is ``video, frame_idx, ty, tx, h, w, channels, data``; ``data`` holds ``h * w * channels``
bytes, row by row (one byte of gray or blue-green-red). A shuffle then moves one byte per pixel
instead of a whole row, and a task compares whole tiles with numpy. The results are block tables
that ``motion.active_blocks``, ``skip_decision`` and ``roi_from_blocks`` take.

``tile`` must be a multiple of the block size, so that no block lies in two tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.functions.geometry import LUMA
from emberline.operators.clipmaps import FAN, chunk_starts, packed_map
from emberline.operators.grouped import append_to_sorted_groups, map_sorted_groups
from emberline.operators.motion import FRAME, _DOWN, _TOP, _UP, grid_size
from emberline.operators.ordered import CELL_CHUNK, chunk_of, with_halo, with_previous
from emberline.storage import materialize

TILE_KEY = ["video", "ty", "tx"]
TILE_SCHEMA = "video string, frame_idx long, ty int, tx int, h int, w int, channels int, data binary"


def _shrink(image: np.ndarray, k: int) -> np.ndarray:
    """1/k of an image by area means, rounded half to even."""
    if k == 1:
        return image
    h, w, channels = image.shape
    if h % k or w % k:
        raise ValueError(f"a {w}x{h} frame cannot be shrunk by {k}")
    areas = np.zeros((h // k, w // k, channels), dtype=np.uint32)
    for y in range(k):
        for x in range(k):
            areas += image[y::k, x::k]
    return np.rint(areas / (k * k)).astype(np.uint8)


def image_tiles(frames: DataFrame, tile: int = 64, k: int = 1) -> DataFrame:
    """Cut image rows (``video, frame_idx, height, width, channels, data``) into tiles, without a shuffle.

    With ``k`` the image is first shrunk to 1/k by area means; its sides must be multiples of k.
    An unreadable image (height -1) has no tiles.
    """
    frames = frames.where("height > 0")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                image = np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width, r.channels)
                image = _shrink(image, k)
                out = []
                for y in range(0, image.shape[0], tile):
                    for x in range(0, image.shape[1], tile):
                        part = image[y : y + tile, x : x + tile]
                        out.append((r.video, r.frame_idx, y // tile, x // tile, *part.shape, part.tobytes()))
                yield pd.DataFrame(out, columns=["video", "frame_idx", "ty", "tx", "h", "w", "channels", "data"])

    return frames.select("video", "frame_idx", "height", "width", "channels", "data").mapInPandas(cut, TILE_SCHEMA)


def bytes_of(values: Column) -> Column:
    """An array of numbers 0..255 as bytes."""
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), ""))


def _stack(column: pa.ChunkedArray, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, *shape)


_RED, _GREEN, _BLUE = (np.arange(256) * LUMA[c] for c in "rgb")


def _changed(now: np.ndarray, before: np.ndarray, thr: float) -> np.ndarray:
    """Pixels whose difference is above ``thr``; colour takes the gray of the difference."""
    level = int(np.floor(thr))
    if level >= 255:
        return np.zeros(now.shape[:-1], dtype=bool)
    diff = np.maximum(now, before) - np.minimum(now, before)
    if diff.shape[-1] == 1:
        return diff[..., 0] > level
    b, g, r = diff[..., 0], diff[..., 1], diff[..., 2]
    # Gray never exceeds the largest channel, so most still pixels end here.
    mask = np.maximum(np.maximum(b, g), r) > level
    gray = np.floor(_RED[r[mask]] + _GREEN[g[mask]] + _BLUE[b[mask]] + 0.5)
    mask[mask] = gray > level
    return mask


def _block_sums(mask: np.ndarray, blk: int) -> np.ndarray:
    n, h, w = mask.shape
    rows, cols = -(-h // blk), -(-w // blk)
    padded = np.zeros((n, rows * blk, cols * blk), dtype=bool)
    padded[:, :h, :w] = mask
    return padded.reshape(n, rows, blk, cols, blk).sum(axis=(2, 4))


_COUNTS = "video string, frame_idx long, by int, bx int, fg_count long"


def _count_blocks(tiles: DataFrame, columns: list[str], mask_of, tile: int, blk: int, width: int | Column) -> DataFrame:
    """Blocks of every tile with the number of pixels ``mask_of`` selects."""
    if tile % blk:
        raise ValueError("the tile size must be a multiple of the block size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            shapes = np.stack([table[c].to_numpy() for c in ("h", "w", "channels")], axis=1)
            for shape in np.unique(shapes, axis=0):
                part = table.filter(pa.array((shapes == shape).all(axis=1)))
                sums = _block_sums(mask_of(part, tuple(int(s) for s in shape)), blk)
                n, rows, cols = sums.shape
                each = np.repeat(np.arange(n), rows * cols)
                by = np.tile(np.repeat(np.arange(rows), cols), n)
                bx = np.tile(np.arange(cols), n * rows)
                per = tile // blk
                yield from pa.table(
                    {
                        "video": part["video"].take(pa.array(each)),
                        "frame_idx": pa.array(part["frame_idx"].to_numpy()[each], pa.int64()),
                        "by": pa.array(part["ty"].to_numpy()[each] * per + by, pa.int32()),
                        "bx": pa.array(part["tx"].to_numpy()[each] * per + bx, pa.int32()),
                        "fg_count": pa.array(sums.ravel(), pa.int64()),
                    }
                ).to_batches()

    narrow = tiles.select(
        "video", F.col("frame_idx").cast("long").alias("frame_idx"), "ty", "tx", "h", "w", "channels", *columns
    )
    return _with_fractions(narrow.mapInArrow(run, _COUNTS), blk, width)


def _with_fractions(counts: DataFrame, blk: int, width: int | Column) -> DataFrame:
    return counts.select(
        *FRAME,
        "by",
        "bx",
        (F.col("by") * grid_size(width, blk) + F.col("bx")).cast("int").alias("blk_idx"),
        "fg_count",
        (F.col("fg_count") / F.lit(blk * blk)).alias("frac"),
    )


def with_previous_tile(tiles: DataFrame, size: int = CELL_CHUNK, segment: str | None = None) -> DataFrame:
    """The bytes of the previous frame's tile as ``prev``; NULL on the first frame, with ``segment`` on the first of every segment."""
    return with_previous(tiles, [*TILE_KEY, segment] if segment else TILE_KEY, "frame_idx", {"prev": F.col("data")}, size)


def block_motion(
    tiles: DataFrame, thr: float, blk: int, width: int | Column, tile: int, size: int = CELL_CHUNK, segment: str | None = None
) -> DataFrame:
    """Changed pixels per block against the previous frame; zero on the first frame (of a segment).

    Block numbers count ``width`` pixels to a row; frames of several sizes are told apart by ``by`` and ``bx``.
    """

    def changed(part: pa.Table, shape: tuple[int, ...]) -> np.ndarray:
        now = _stack(part["data"], shape)
        # A first frame is compared with itself.
        filled = [d if p is None else p for d, p in zip(part["data"].to_pylist(), part["prev"].to_pylist())]
        prev = np.frombuffer(b"".join(filled), dtype=np.uint8).reshape(now.shape)
        return _changed(now, prev, thr)

    return _count_blocks(with_previous_tile(tiles, size, segment), ["data", "prev"], changed, tile, blk, width)


def frame_block_motion(
    frames: DataFrame, thr: float, blk: int, width: int | Column, k: int = 1, size: int = 256
) -> DataFrame:
    """``block_motion`` straight from whole images (``video, frame_idx, height, width, channels, data``).

    Images move once, by (video, stretch of frames); each stretch starts with a copy of the frame
    before it. A task walks through its images in order, holds one previous image, and sends back
    block counts only. ``k`` shrinks the images first.
    """
    columns = ["video", "frame_idx", "height", "width", "channels", "data"]
    rows = with_halo(frames.select(*columns), "frame_idx", 1, size)
    rows = rows.withColumn("frame_idx", F.col("frame_idx").cast("long"))
    rows = rows.repartition("video", "__chunk").sortWithinPartitions("video", "__chunk", "frame_idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, None
        for batch in batches:
            out = {n: [] for n in ("video", "frame_idx", "by", "bx", "fg_count")}
            for r in batch.to_pylist():
                image = np.frombuffer(r["data"], dtype=np.uint8).reshape(r["height"], r["width"], r["channels"])
                image = _shrink(image, k)
                key = (r["video"], r["__chunk"], image.shape)
                if not r["__halo"]:
                    still = before is None or last != key
                    mask = np.zeros(image.shape[:2], dtype=bool) if still else _changed(image, before, thr)
                    sums = _block_sums(mask[None], blk)[0]
                    by, bx = np.indices(sums.shape)
                    out["video"] += [r["video"]] * sums.size
                    out["frame_idx"].append(np.full(sums.size, r["frame_idx"]))
                    for n, v in (("by", by), ("bx", bx), ("fg_count", sums)):
                        out[n].append(v.ravel())
                last, before = key, image
            if out["video"]:
                yield pa.RecordBatch.from_pydict(
                    {
                        "video": pa.array(out["video"], pa.string()),
                        "frame_idx": pa.array(np.concatenate(out["frame_idx"]), pa.int64()),
                        "by": pa.array(np.concatenate(out["by"]), pa.int32()),
                        "bx": pa.array(np.concatenate(out["bx"]), pa.int32()),
                        "fg_count": pa.array(np.concatenate(out["fg_count"]), pa.int64()),
                    }
                )

    return _with_fractions(rows.mapInArrow(run, _COUNTS), blk, width)


def motion_memory(tiles: DataFrame, thr: float, size: int = 256, segment: str | None = None, fan: int = FAN) -> DataFrame:
    """Change counters of every tile and frame as bytes in ``memory`` (one per pixel).

    Chunks are reduced to their map x -> clip(x + shift, low, high), the maps of a tile are chained in a
    tree, and each chunk is replayed from its start, which travels as a row before its frames. With
    ``segment`` the counters start again in every segment.
    """
    rows = with_previous_tile(tiles, segment=segment).withColumns(
        {"__chunk": chunk_of("frame_idx", size), "__place": F.col("frame_idx").cast("long")}
    )
    tile_key = [*TILE_KEY, segment] if segment else TILE_KEY
    key = [*tile_key, "__chunk"]
    key_fields = [rows.schema[k] for k in key]

    def steps_of(g: dict) -> np.ndarray:
        shape = (int(g["h"][0]), int(g["w"][0]), int(g["channels"][0]))
        now = np.frombuffer(b"".join(g["data"]), dtype=np.uint8).reshape(-1, *shape)
        known = np.array([p is not None for p in g["prev"]])
        prev = np.frombuffer(
            b"".join(d if p is None else p for d, p in zip(g["data"], g["prev"])), dtype=np.uint8
        ).reshape(now.shape)
        steps = np.where(_changed(now, prev, thr), _UP, _DOWN).astype(np.int32)
        steps[~known] = 0
        return steps.reshape(len(now), -1)

    def reduce_chunk(g: dict) -> dict:
        steps = steps_of(g)
        low = np.zeros(steps.shape[1], dtype=np.int32)
        high = np.full(steps.shape[1], _TOP, dtype=np.int32)
        for step in steps:
            low = np.clip(low + step, 0, _TOP)
            high = np.clip(high + step, 0, _TOP)
        blob = np.empty(1, dtype=object)
        blob[0] = packed_map(steps.sum(axis=0), low, high)
        return {**{k: g[k][:1] for k in key}, "map": blob}

    maps = map_sorted_groups(
        rows.select(*key, "__place", "h", "w", "channels", "data", "prev"),
        key,
        ["__place"],
        reduce_chunk,
        T.StructType([*key_fields, T.StructField("map", T.BinaryType())]),
    )
    starts = chunk_starts(materialize(maps, "chunk-maps"), tile_key, fan)
    lead = starts.withColumn("__place", F.lit(-1).cast("long"))
    marked = rows.withColumn("start", F.lit(None).cast("binary")).unionByName(lead, allowMissingColumns=True)

    def replay(g: dict) -> dict:
        at, state = 0, None
        if g["__place"][0] < 0:
            at, state = 1, np.frombuffer(g["start"][0], dtype=np.uint8).astype(np.int32)
        steps = steps_of({c: v[at:] for c, v in g.items()})
        state = np.zeros(steps.shape[1], dtype=np.int32) if state is None else state
        out = np.empty(len(g["__place"]), dtype=object)
        for i, step in enumerate(steps):
            state = np.clip(state + step, 0, _TOP)
            out[at + i] = state.astype(np.uint8).tobytes()
        return {"memory": out}

    fields = [T.StructField("memory", T.BinaryType())]
    inputs = ["__place", "h", "w", "channels", "data", "prev", "start"]
    out = append_to_sorted_groups(marked, key, ["__place"], inputs, replay, fields)
    return out.filter(F.col("__place") >= 0).drop("__chunk", "__place", "start", "prev")


def memory_blocks(memory: DataFrame, blk: int, width: int | Column, tile: int, active_at: int = 10) -> DataFrame:
    """Active pixels per block from the counters."""

    def active(part: pa.Table, shape: tuple[int, ...]) -> np.ndarray:
        return _stack(part["memory"], shape[:2]) >= active_at

    return _count_blocks(memory, ["memory"], active, tile, blk, width)
