"""Rectangles, pixels and blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Channel statistics of the classifier's training images, the fill value of a
# masked pixel, and the luma weights of red, green and blue.
CHANNEL_MEAN = {"r": 0.485, "g": 0.456, "b": 0.406}
CHANNEL_STD = {"r": 0.229, "g": 0.224, "b": 0.225}
MASKED_PIXEL = 114
LUMA = {"r": 0.299, "g": 0.587, "b": 0.114}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rect(x1, y1, x2, y2) -> Column:
    return F.struct(*[_col(v).cast("int").alias(n) for v, n in zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"))])


def rect_overlap(roi: Column | str, excluded: Column | str) -> Column:
    """Intersection in the ROI's own coordinates; NULL when it is empty."""
    a, b = _col(roi), _col(excluded)
    x1, y1 = F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"])
    x2, y2 = F.least(a["x2"], b["x2"]), F.least(a["y2"], b["y2"])
    moved = rect(x1 - a["x1"], y1 - a["y1"], x2 - a["x1"], y2 - a["y1"])
    return F.when((x2 > x1) & (y2 > y1), moved)


def inside(y: Column | str, x: Column | str, area: Column | str) -> Column:
    """Half-open containment; false when there is no rectangle."""
    y, x, r = _col(y), _col(x), _col(area)
    hit = (x >= r["x1"]) & (x < r["x2"]) & (y >= r["y1"]) & (y < r["y2"])
    return F.coalesce(hit, F.lit(False))


def mask_excluded(value: Column | str, y: Column | str, x: Column | str, area: Column | str) -> Column:
    return F.when(inside(y, x, area), F.lit(MASKED_PIXEL)).otherwise(_col(value))


def gray_of(b: Column | str, g: Column | str, r: Column | str) -> Column:
    """8-bit gray, rounded half up."""
    mixed = _col(r) * LUMA["r"] + _col(g) * LUMA["g"] + _col(b) * LUMA["b"]
    return F.floor(mixed + 0.5).cast("int")


def normalize_channel(value: Column | str, channel: str) -> Column:
    return (_col(value) / F.lit(255.0) - F.lit(CHANNEL_MEAN[channel])) / F.lit(CHANNEL_STD[channel])


def heat_value(counter: Column | str, top: int = 25) -> Column:
    return F.floor(_col(counter) * F.lit(255) / F.lit(top)).cast("int")
