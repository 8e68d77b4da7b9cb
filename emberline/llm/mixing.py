"""Mixing sources to target weights along a curriculum.

Targets: the sources share ``demand`` times all words by weight; a target stops at ``most`` times
its source's size and what is left is shared again by weight until none is above. Taking: within
a source, documents stand in a fixed pseudo-random order; whole passes over the source come
first, then the words up to the target (the last document in part). No document is taken over
``most`` times.

Curriculum: a source's weight over the training time 0..1 is a piecewise linear schedule. Its
integral says which share of the source is due by a time; a taken document's place in the source's
order is turned into a training position by the inverse, and documents are sorted by position.

Running totals are cut into buckets of the pseudo-random order, so a source with most rows is
no single group: only totals per bucket are scanned per source, at most ``BUCKETS`` of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.frames import unused
from emberline.operators.ordered import join_carry
from emberline.storage import materialize

BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"
Schedule = Sequence[tuple[float, float]]  # (time, weight), from time 0 to time 1


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return docs.select(
        F.col(id_col).alias("id"),
        # sources by code point, NULL after all
        F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col))).alias("source_key"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        order.alias("order"),
        F.conv(F.substring(order, 1, 3), 16, 10).cast("int").alias("bucket"),
    )


def source_targets(rows: DataFrame, weights: Sequence[float], demand: float, most: float) -> DataFrame:
    """``(source_key, number, source_size, weight, target)``. A round of resharing asks Spark for three sums."""
    totals = rows.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    # Numbers in order without one task for all sources: a range sort, and the offset of each of its parts.
    spread = totals.repartitionByRange("source_key").sortWithinPartitions("source_key").withColumn("place", F.monotonically_increasing_id())
    spread = materialize(spread.withColumns({"part": F.shiftright("place", 33), "row": F.col("place").bitwiseAND((1 << 33) - 1)}).drop("place"), "sources")
    parts = spread.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = spread.join(before, F.col("part") == F.col("p")).withColumn("number", F.col("before") + F.col("row"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    table = materialize(numbered.select("source_key", "number", "source_size", weight.alias("weight")), "sources")
    cap = F.col("source_size") * F.lit(float(most))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        # what is capped at this level takes its cap; the rest share what remains
        full = cap < F.col("weight") * F.lit(level)
        taken, free = table.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if not free:
            break
        now = (total * demand - taken) / free
        if now <= level:
            break
        level = now
    return table.withColumn("target", F.least(F.col("weight") * F.lit(level), cap).cast("double"))


def _due(knots: Schedule) -> list[tuple[float, float, float, float, float]]:
    """Pieces ``(time, weight, slope, due before, due after)`` of a schedule, the whole integral made 1."""
    pieces, sum_ = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        area = (w0 + w1) / 2 * (t1 - t0)
        pieces.append((t0, w0, (w1 - w0) / (t1 - t0), sum_, sum_ + area))
        sum_ += area
    if knots[0][0] != 0 or knots[-1][0] != 1 or sum_ <= 0 or min(w for _, w in knots) < 0:
        raise ValueError("a schedule runs from time 0 to 1, with weights of zero or more that are not all zero")
    return [(t, w / sum_, s / sum_, a / sum_, b / sum_) for t, w, s, a, b in pieces]


def position(share: Column, number: Column, schedules: Sequence[Schedule]) -> Column:
    """The time by which ``share`` (0 to 1) of the source with this ``number`` is due; schedules repeat over the numbers."""
    out = None
    for i, knots in enumerate(schedules):
        time = None
        for t, w, slope, a, b in reversed([p for p in _due(knots) if p[4] > p[3]]):
            more = F.greatest(share - a, F.lit(0.0))
            # w x + slope x^2 / 2 = more, in the form that also holds for slope 0
            x = F.try_divide(2 * more, w + F.sqrt(F.greatest(F.lit(w * w) + 2 * slope * more, F.lit(0.0))))
            here = F.lit(t) + F.coalesce(x, F.lit(0.0))
            time = here if time is None else F.when(share <= b, here).otherwise(time)
        out = time if out is None else F.when(number % len(schedules) == i, time).otherwise(out)
    return F.least(out, F.lit(1.0))


RAMPS: tuple[Schedule, ...] = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))


def plan_mix(
    docs: DataFrame,
    weights: Sequence[float] = (3.0, 1.0, 2.0),
    demand: float = 1.5,
    most: float = 2.0,
    schedules: Sequence[Schedule] = RAMPS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``(id, size, source_size, target, taken, copies)`` for every row of ``docs``.

    ``copies`` is an array of ``(copy, words, position)``, one for each time that the document is
    read; ``words`` is below ``size`` only for a source's last one. NULL and empty texts have size 0 and
    are never taken. NULL is a source of its own, after the others. Equal rows stand next to each other;
    which of them is cut is then arbitrary, the counts are not.
    """
    rows = sized(docs, id_col, text_col, source_col)
    rows = materialize(rows, "sizes")
    targets = source_targets(rows, weights, demand, most)
    totals = rows.groupBy("source_key", "bucket").agg(F.sum("size").alias("n"))
    past = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("source_key", "bucket", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("before"))
    starts = join_carry(starts, targets, ["source_key"])
    local = Window.partitionBy("source_key", "bucket").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = join_carry(rows.withColumn("inside", F.coalesce(F.sum("size").over(local), F.lit(0))), starts, ["source_key", "bucket"])
    at = F.col("before") + F.col("inside")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    placed = placed.withColumn("at", at).withColumn("whole", whole).withColumn("rest", rest)
    extra = F.least(F.greatest(F.col("rest") - F.col("at"), F.lit(0)), F.col("size"))
    placed = placed.withColumn("extra", extra).withColumn("taken", F.col("whole") * F.col("size") + F.col("extra"))
    all_taken = F.col("whole") * F.col("source_size") + F.col("rest")

    def copy(number: Column, words: Column) -> Column:
        middle = (number * F.col("source_size") + F.col("at") + words / 2) / all_taken
        return F.struct(number.cast("int").alias("copy"), words.cast("long").alias("words"), position(middle, F.col("number"), schedules).alias("position"))

    copies = F.when(F.col("size") > 0, F.transform(F.sequence(F.lit(0), F.col("whole")), lambda c: copy(c, F.when(c < F.col("whole"), F.col("size")).otherwise(F.col("extra")))))
    copies = F.filter(F.coalesce(copies, F.array().cast("array<struct<copy:int,words:bigint,position:double>>")), lambda c: c["words"] > 0)
    return placed.select("id", "size", "source_size", "target", "taken", copies.alias("copies"))


def training_order(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Every taken copy of every document in training order: ``docs`` with ``copy``, ``words`` and ``position``.

    The rows are range-sorted by position. ``id_col`` should be unique; a row without an id is not
    placed, as the plan can't name it. Columns of ``docs`` with one of the three names are replaced.
    """
    key, copy = unused(docs, "key"), unused(docs, "copied")
    places = plan.where("id IS NOT NULL").select(F.col("id").alias(key), F.explode("copies").alias(copy))
    rows = docs.join(places, F.col(id_col) == F.col(key))
    out = rows.withColumns({k: F.col(f"{copy}.{k}") for k in ("copy", "words", "position")}).drop(key, copy)
    return out.repartitionByRange("position", id_col).sortWithinPartitions("position", id_col, "copy")
