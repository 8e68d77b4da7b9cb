"""Recorded timings and device samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.ordered import join_carry, running
from emberline.storage import materialize


def profile_report(spans: DataFrame, min_mean: float = 1e-5) -> DataFrame:
    """Mean time of every step and its share in the context's summed means.

    Unfinished calls (no end) are ignored and means below ``min_mean`` dropped before the shares.
    The window runs over one row per step.
    """
    took = F.col("t_end") - F.col("t_start")
    steps = (
        spans.filter(took.isNotNull())
        .groupBy("ctx", "step")
        .agg(F.count(F.lit(1)).alias("calls"), F.avg(took).alias("avg_time"))
        .filter(F.col("avg_time") >= min_mean)
    )
    total = F.sum("avg_time").over(Window.partitionBy("ctx"))
    return steps.withColumn("total_avg_time", total).withColumn(
        "percent_time", F.col("avg_time") / F.col("total_avg_time") * 100.0
    )


def context_durations(spans: DataFrame) -> DataFrame:
    return spans.groupBy("ctx").agg((F.max("t_end") - F.min("t_start")).alias("duration"))


def samples_in_frame(
    intervals: DataFrame, samples: DataFrame, keys: Sequence[str], width: float, how: str = "inner"
) -> DataFrame:
    """Samples with ``t_start <= t <= t_end``.

    Both sides are cut into time slots of ``width``: an interval is repeated for each slot it
    touches, a sample has one slot, and the join is an equi-join on (keys, slot). Each pair
    meets in exactly one slot. Choose ``width`` near the usual interval length.
    """
    first = F.floor(F.col("t_start") / F.lit(width)).cast("long")
    last = F.floor(F.col("t_end") / F.lit(width)).cast("long")
    touched = intervals.filter(F.col("t_end") >= F.col("t_start")).withColumn(
        "__slot", F.explode(F.sequence(first, last))
    )
    placed = samples.withColumn("__slot", F.floor(F.col("t") / F.lit(width)).cast("long"))
    placed = placed.withColumnsRenamed({k: f"__s_{k}" for k in [*keys, "__slot"]})
    on = [F.col(k) == F.col(f"__s_{k}") for k in [*keys, "__slot"]]
    on += [F.col("t") >= F.col("t_start"), F.col("t") <= F.col("t_end")]
    return touched.join(placed, on, how).drop("__slot", *[f"__s_{k}" for k in [*keys, "__slot"]])


_FAN = 16  # children per node


def gpu_stats(
    intervals: DataFrame,
    samples: DataFrame,
    keys: Sequence[str],
    interval_id: str,
    width: float,
    levels: int = 6,
) -> DataFrame:
    """Mean power and peak memory of the samples inside each interval, 0 when there are none.

    No (interval, sample) pair is formed, however much the intervals overlap. Samples are numbered
    in time order per key; an interval becomes a range of numbers, and a range is the union of at
    most 30 nodes per level of a tree whose nodes cover 1, 16, 256, ... samples. Nodes are plain
    partial aggregates. The last level takes what is left, so ``levels`` changes the cost of very
    long intervals, not the result. ``width`` is the time slot by which a key's timeline is split
    between tasks.
    """
    keys = list(keys)
    none = F.lit(None)
    marks = intervals.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col("t_start").alias("t"), F.lit(0).alias("kind")),
                F.struct(F.col("t_end").alias("t"), F.lit(2).alias("kind")),
            )
        ).alias("m"),
        F.col(interval_id).alias("id"),
    ).select(*keys, "m.*", "id", none.cast("double").alias("power"), none.cast("double").alias("memory"))
    # At equal times a start comes before the samples and an end after them.
    line = samples.select(
        *keys,
        "t",
        F.lit(1).alias("kind"),
        none.cast(intervals.schema[interval_id].dataType).alias("id"),
        F.col("power").cast("double").alias("power"),
        F.col("memory").cast("double").alias("memory"),
    ).unionByName(marks)
    slot = F.floor(F.col("t") / F.lit(width))
    is_sample = F.when(F.col("kind") == 1, 1)
    # Samples equal in all columns are interchangeable, so the order need not tell them apart.
    line = running(line, keys, ["t", "kind", "power", "memory"], {"n": ("count", is_sample)}, slot)
    line = materialize(line, "line")

    level = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("level"), F.lit(_FAN**i).cast("long").alias("size"), F.lit(i + 1 == levels).alias("top"))
                for i in range(levels)
            ]
        )
    )
    n, size = F.col("n"), F.col("l.size")
    # A sample is a node of the lowest level; those of the next hold 16 of it, and all others are made of these.
    leaves = line.filter(F.col("kind") == 1).select(
        *keys, F.lit(0).alias("level"), (n - 1).alias("node"), "power", F.col("power").isNotNull().cast("long").alias("powers"), "memory"
    )
    sums = [F.sum("power").alias("power"), F.sum("powers").alias("powers"), F.max("memory").alias("memory")]
    nodes = leaves
    if levels > 1:
        joint = leaves.groupBy(*keys, F.lit(1).alias("level"), F.floor(F.col("node") / _FAN).cast("long").alias("node")).agg(*sums)
        above = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.lit(_FAN ** (i - 1)).cast("long").alias("size")) for i in range(2, levels)]))
        nodes = nodes.unionByName(joint)
        if levels > 2:
            upper = joint.drop("level").withColumn("l", above)
            nodes = nodes.unionByName(upper.groupBy(*keys, F.col("l.level").alias("level"), F.floor(F.col("node") / size).cast("long").alias("node")).agg(*sums))

    ranges = line.filter(F.col("kind") != 1).groupBy(*keys, "id").agg(
        F.max(F.when(F.col("kind") == 0, n)).alias("low"), F.max(F.when(F.col("kind") == 2, n)).alias("high")
    )
    low, high = F.ceil(F.col("low") / size).cast("long"), F.floor(F.col("high") / size).cast("long")
    up_low = F.ceil(F.col("low") / (size * _FAN)).cast("long") * _FAN
    up_high = F.floor(F.col("high") / (size * _FAN)).cast("long") * _FAN
    # What whole parents cover is left to them: only the ends on both sides stay on this level.
    parents = ~F.col("l.top") & (up_high > up_low)
    ends = F.array(
        F.struct(low.alias("a"), F.when(parents, up_low).otherwise(high).alias("b")),
        F.struct(F.when(parents, up_high).otherwise(high).alias("a"), high.alias("b")),
    )
    wanted = (
        ranges.select(*keys, "id", "low", "high", level.alias("l"))
        .select(*keys, "id", F.col("l.level").alias("level"), F.explode(ends).alias("e"))
        .filter(F.col("e.b") > F.col("e.a"))
        .select(*keys, "id", "level", F.explode(F.sequence(F.col("e.a"), F.col("e.b") - 1)).alias("node"))
    )
    found = join_carry(wanted, nodes, [*keys, "level", "node"], "inner").select("id", "power", "powers", "memory")
    # Intervals without samples still give a row.
    every = intervals.select(F.col(interval_id).alias("id"))
    return (
        found.unionByName(every, allowMissingColumns=True)
        .groupBy(F.col("id").alias(interval_id))
        .agg(
            F.coalesce(F.sum("power") / F.nullif(F.sum("powers"), F.lit(0)), F.lit(0.0)).alias("gpu_avg_power"),
            F.coalesce(F.max("memory"), F.lit(0.0)).alias("gpu_max_memory"),
        )
    )


def stage_means(times: DataFrame, stages: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean time per stage without each video's first frame."""
    return times.filter(F.col("frame_idx") > 1).groupBy(*by).agg(*[F.avg(s).alias(s) for s in stages])


def stage_ms(times: DataFrame, stages: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Milliseconds per image and stage."""
    return times.groupBy(*by).agg(*[(F.sum(s) / F.count(F.lit(1)) * 1e3).alias(f"{s}_ms") for s in stages])
