"""Row-level operators on the frame log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.functions import geometry as G
from emberline.functions import labels as L


def limit_frames(df: DataFrame, n: int, index: str = "frame_idx") -> DataFrame:
    """First n frames of every video; n <= 0 keeps all. A plain filter, so it reaches the scan."""
    return df.filter(F.col(index) <= n) if n > 0 else df


def caption(df: DataFrame) -> DataFrame:
    """Text fields shown beside a frame."""
    return df.withColumns(
        {
            "caption_frame": L.frame_caption("frame_idx", "num_frames"),
            "caption_label": L.label_caption("pred_label", F.try_element_at("probs", F.col("pred_label_idx") + 1)),
            "caption_fps": L.fps_text(L.frame_fps("elapsed_time")),
        }
    )


def flatten_struct(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested fields as columns named by their path."""

    def leaves(schema: T.StructType, path: Sequence[str]):
        for field in schema.fields:
            here = [*path, field.name]
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType, here)
            else:
                yield here

    return df.select(
        *[F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path)) for path in leaves(df.schema, [])]
    )


def parse_list_columns(
    df: DataFrame, numbers: Sequence[str] = ("logits", "probs"), texts: Sequence[str] = ("class_names",)
) -> DataFrame:
    """List text as written by Python back to arrays."""
    out = {c: F.from_json(c, "array<double>") for c in numbers if c in df.columns}
    quoted = {"allowSingleQuotes": "true"}
    out.update({c: F.from_json(c, "array<string>", quoted) for c in texts if c in df.columns})
    return df.withColumns(out)


def normalize_pixels(cells: DataFrame) -> DataFrame:
    """Blue-green-red bytes to normalised red, green and blue planes."""
    return cells.withColumns({f"{c}_norm": G.normalize_channel(c, c) for c in ("r", "g", "b")})
