"""Label, name and text functions (all JVM-side column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POSITIVE = "positive"
NEGATIVE = "negative"

# Run names and the rules that read the truth from a video name.
RUN_NAME = r"^(.+?)__ds_(.+?)__mt_(.+?)__(\d{8}\.\d{6})"
TRUTH_RULES = {
    "test": [("nofire", NEGATIVE), ("", POSITIVE)],
    "DFire": [("VP", POSITIVE), ("FP", NEGATIVE)],
    "DFireStatic": [("VP", POSITIVE), ("FP", NEGATIVE)],
    "FireNet": [("NoFireVid", NEGATIVE), ("", POSITIVE)],
    "pexels": [("", POSITIVE)],
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def known_label(label: Column | str) -> Column:
    """The label with NULL read as the class named ``None``."""
    return F.coalesce(_col(label), F.lit("None"))


def is_fire_or_smoke(label: Column | str) -> Column:
    return F.lower(known_label(label)).rlike("fire|smoke")


def is_detection(label: Column | str) -> Column:
    """Anything but the class ``None``, whatever its case."""
    return F.lower(known_label(label)) != "none"


def to_binary_label(label: Column | str) -> Column:
    return F.when(is_fire_or_smoke(label), POSITIVE).otherwise(NEGATIVE)


def ground_truth(video: Column | str, dataset: Column | str, rules: dict | None = None) -> Column:
    """Truth of a video from its name; case-sensitive, first matching rule wins.

    A dataset without rules, or a name that no rule of its dataset matches, is an error.
    """
    video, dataset = _col(video), _col(dataset)
    out = None
    for name, steps in (rules or TRUTH_RULES).items():
        for text, truth in steps:
            hit = (dataset == name) & (video.contains(text) if text else F.lit(True))
            out = F.when(hit, truth) if out is None else out.when(hit, truth)
    message = F.concat(F.lit("no truth rule for dataset "), F.coalesce(dataset, F.lit("NULL")),
                       F.lit(", video "), F.coalesce(video, F.lit("NULL")))
    return out.otherwise(F.raise_error(message).cast("string"))


def fire_smoke_flags(label: Column | str) -> Column:
    """Fire counts as fire and smoke, smoke as smoke only."""
    low = F.lower(known_label(label))
    fire = low == "fire"
    smoke = fire | low.contains("smoke")
    return F.struct(fire.cast("int").alias("fire"), smoke.cast("int").alias("smoke"))


def alarm(fire_prob: Column | str, smoke_prob: Column | str, fire_at: float = 0.2, smoke_at: float = 0.5) -> Column:
    """True when a share reaches its threshold; ``>=`` is our choice, only the thresholds are given."""
    return (_col(fire_prob) >= fire_at) | (_col(smoke_prob) >= smoke_at)


def confusion_cell(pred: Column | str, truth: Column | str) -> Column:
    return (_col(pred) == _col(truth)).cast("int")


def frame_fps(elapsed: Column | str) -> Column:
    e = _col(elapsed)
    return F.when(e > 0, F.lit(1.0) / e).otherwise(F.lit(0.0))


def mean_rate(frames: Column, seconds: Column) -> Column:
    """Frames per second of a total time; frames that took no time at all have an infinite rate, an unknown time none."""
    none = F.when(frames > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return F.when(seconds != 0, frames / seconds).when(seconds == 0, none)


def fps_text(fps: Column | str) -> Column:
    return F.format_string("%.2f", _col(fps))


def frame_caption(frame_idx: Column | str, num_frames: Column | str) -> Column:
    """``k+1/N``: the caption is one ahead because ``frame_idx`` already starts at 1."""
    return F.format_string("%d/%d", _col(frame_idx).cast("long") + 1, _col(num_frames).cast("long"))


def label_caption(label: Column | str, prob: Column | str) -> Column:
    return F.format_string("%s (%.1f%%)", known_label(label), _col(prob) * 100)


def active_caption(active_share: Column | str) -> Column:
    return F.format_string("%.2f%%", _col(active_share) * 100)


def make_run_name(machine: Column | str, dataset: Column | str, method: Column | str, stamp: Column | str) -> Column:
    return F.concat_ws(
        "__",
        _col(machine),
        F.concat(F.lit("ds_"), _col(dataset)),
        F.concat(F.lit("mt_"), _col(method)),
        _col(stamp),
    )


def parse_run_name(name: Column | str) -> Column:
    """Struct of machine, dataset, method and stamp; all NULL when the name has another form."""
    name = _col(name)
    fields = ["machine", "dataset", "method", "stamp"]
    return F.struct(
        *[F.nullif(F.regexp_extract(name, RUN_NAME, i + 1), F.lit("")).alias(f) for i, f in enumerate(fields)]
    )


def video_of_file(file_name: Column | str) -> Column:
    """Base name of a path without its folders and last extension; ``/`` and ``\\`` both separate."""
    base = F.regexp_extract(_col(file_name), r"([^/\\]+)$", 1)
    return F.regexp_replace(base, r"\.[^.]*$", "")
