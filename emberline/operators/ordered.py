"""Order-dependent building blocks for sequences of any length.

A plain window partitioned by the video puts all frames of a video into one task. One
camera can hold a large part of all rows, so every function here cuts a sequence into
chunks of bounded length, works per ``(key, chunk)``, and passes what a chunk needs from
its past in one of two exact ways:

* ``number_rows`` and ``running`` aggregate each chunk (combined on the map side), scan the
  one-row-per-chunk totals, and join the carried value back on ``(key, chunk)``. The window
  over the rows and that join use the same partitioning, so the rows are shuffled once.
* ``with_halo`` copies the last few rows of a chunk into the next one, enough for a bounded
  look-back.

Sequence keys must not be NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.storage import materialize

CHUNK = 1 << 16  # frames of one video handled by one task at a time
CELL_CHUNK = 1 << 10  # frames of one pixel handled by one window partition
SALTS = 16

_CHUNK = "__chunk"
_NO_BUCKET = -(1 << 62)


def chunk_of(index: Column | str, size: int = CHUNK) -> Column:
    """Chunk number of a 1-based position."""
    index = F.col(index) if isinstance(index, str) else index
    return F.floor((index - 1) / F.lit(size)).cast("long")


def join_carry(rows: DataFrame, carry: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join that keeps only the left copy of the keys."""
    renamed = carry.withColumnsRenamed({k: f"__c_{k}" for k in keys})
    on = [F.col(k) == F.col(f"__c_{k}") for k in keys]
    return rows.join(renamed, on, how).drop(*[f"__c_{k}" for k in keys])


def spread_join(
    rows: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    by: Column,
    how: str = "left",
    salts: int = SALTS,
    may_grow: bool = False,
) -> DataFrame:
    """Join many rows to one-row-per-key facts without one task per hot key.

    The rows of a key are spread over ``salts`` sub-keys by a hash of ``by``; each fact is
    repeated once per salt. Spark still turns this into a broadcast join by itself when the
    facts turn out small. It estimates that before they are repeated, though, and from the size of
    packed files: facts read from a table that ``may_grow`` are never broadcast, so that they can't fill the driver.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    repeated = facts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    if may_grow:
        repeated = repeated.hint("merge")
    return join_carry(salted, repeated, [*keys, "__salt"], how).drop("__salt")


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    bucket: Column,
    name: str = "row_id",
    method: str = "row_number",
) -> DataFrame:
    """Position of each row in its key's order, without sorting a whole key in one task.

    ``bucket`` must not decrease along ``order`` and must be a function of the leading order
    column, so that equal values share a bucket. ``method`` is ``row_number`` or ``rank``.
    """
    function = {"row_number": F.row_number, "rank": F.rank}[method]
    rows = df.withColumn(_CHUNK, F.coalesce(bucket.cast("long"), F.lit(_NO_BUCKET)))
    totals = rows.groupBy(*keys, _CHUNK).agg(F.count(F.lit(1)).alias("__n"))
    past = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, _CHUNK, F.coalesce(F.sum("__n").over(past), F.lit(0)).alias("__before"))
    local = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    rows = rows.withColumn("__pos", function().over(local))
    out = join_carry(rows, offsets, [*keys, _CHUNK])
    position = (F.col("__pos") + F.coalesce(F.col("__before"), F.lit(0))).cast("long")
    return out.withColumn(name, position).drop("__pos", "__before", _CHUNK)


def number_by_range(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    name: str = "row_id",
    method: str = "row_number",
) -> DataFrame:
    """As :func:`number_rows`, for any order: ranges of the rows take the place of a bucket.

    Spark cuts the rows into ranges of about equal size along ``(keys, order)``, with NULL and NaN
    where ``order`` puts them; equal rows share a range. Ranges are numbered one by one, and a
    key's count in its earlier ranges is added. The ranged rows are written once.
    """
    function = {"row_number": F.row_number, "rank": F.rank}[method]
    by = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    rows = materialize(df.repartitionByRange(*by).withColumn(_CHUNK, F.spark_partition_id()), "ranges")
    totals = rows.groupBy(*keys, _CHUNK).agg(F.count(F.lit(1)).alias("__n"))
    past = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, _CHUNK, F.coalesce(F.sum("__n").over(past), F.lit(0)).alias("__before"))
    rows = rows.withColumn("__pos", function().over(Window.partitionBy(*keys, _CHUNK).orderBy(*order)))
    out = join_carry(rows, offsets, [*keys, _CHUNK])
    return out.withColumn(name, (F.col("__pos") + F.col("__before")).cast("long")).drop("__pos", "__before", _CHUNK)


_TOTAL = {
    "sum": lambda c, _: F.sum(c),
    "count": lambda c, _: F.count(c),
    "max": lambda c, _: F.max(c),
    "min": lambda c, _: F.min(c),
    "last": lambda c, o: F.max_by(c, F.when(c.isNotNull(), o)),
}
_SCAN = {
    "sum": F.sum,
    "count": F.sum,
    "max": F.max,
    "min": F.min,
    "last": lambda c: F.last(c, ignorenulls=True),
}
_LOCAL = {**_SCAN, "count": F.count}


def _merge(kind: str, before: Column, here: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(before + here, before, here)
    if kind == "max":
        return F.greatest(before, here)
    if kind == "min":
        return F.least(before, here)
    return F.coalesce(here, before)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    measures: Mapping[str, tuple[str, Column]],
    chunk: Column | None = None,
    exclusive: bool = False,
) -> DataFrame:
    """Running aggregates over each key's whole past.

    ``measures`` maps an output name to ``(kind, value)``; kind is sum, count, max, min or last
    (last value that is not NULL). ``order`` is one or more columns, unique within the key; ``chunk``
    must not decrease along it and is derived from it when it is a single 1-based position. With
    ``exclusive`` the current row is left out.
    """
    order = [order] if isinstance(order, str) else list(order)
    place = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    rows = df.withColumn(_CHUNK, chunk_of(order[0]) if chunk is None else chunk.cast("long"))
    values = {f"__v_{name}": value for name, (_, value) in measures.items()}
    rows = rows.withColumns(values)
    totals = rows.groupBy(*keys, _CHUNK).agg(
        *[
            _TOTAL[kind](F.col(f"__v_{name}"), place).alias(f"__t_{name}")
            for name, (kind, _) in measures.items()
        ]
    )
    past = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys,
        _CHUNK,
        *[
            _SCAN[kind](F.col(f"__t_{name}")).over(past).alias(f"__b_{name}")
            for name, (kind, _) in measures.items()
        ],
    )
    local = (
        Window.partitionBy(*keys, _CHUNK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    )
    rows = rows.withColumns(
        {f"__l_{name}": _LOCAL[kind](F.col(f"__v_{name}")).over(local) for name, (kind, _) in measures.items()}
    )
    out = join_carry(rows, carry, [*keys, _CHUNK])
    out = out.withColumns(
        {
            name: _merge(kind, F.col(f"__b_{name}"), F.col(f"__l_{name}"))
            for name, (kind, _) in measures.items()
        }
    )
    helpers = [f"__{p}_{name}" for name in measures for p in ("v", "l", "b")]
    return out.drop(_CHUNK, *helpers)


def number_runs(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    breaks: Callable[[Column, Column], Column],
    name: str,
    chunk: Column | None = None,
) -> DataFrame:
    """Number the runs of a sequence from 0; ``breaks(previous, current)`` ends a run.

    One pass: runs are counted inside each chunk, and one row per chunk (its first and last
    value and its count) decides whether a run goes on across the border and how many came before.
    """
    rows = df.withColumns(
        {_CHUNK: chunk_of(order) if chunk is None else chunk.cast("long"), "__v": F.struct(value.alias("v"))}
    )
    local = Window.partitionBy(*keys, _CHUNK).orderBy(order)
    rows = rows.withColumn("__p", F.lag("__v").over(local))
    cut = F.col("__p").isNotNull() & breaks(F.col("__p.v"), F.col("__v.v"))
    rows = rows.withColumn("__n", F.sum(cut.cast("long")).over(local))
    chunks = rows.groupBy(*keys, _CHUNK).agg(
        F.min_by("__v", order).alias("__first"), F.max_by("__v", order).alias("__last"), F.max("__n").alias("__cuts")
    )
    across = Window.partitionBy(*keys).orderBy(_CHUNK)
    chunks = chunks.withColumn("__p", F.lag("__last").over(across))
    joint = F.col("__p").isNotNull() & breaks(F.col("__p.v"), F.col("__first.v"))
    chunks = chunks.withColumn("__joint", F.coalesce(joint, F.lit(False)).cast("long"))
    before = F.sum(F.col("__cuts") + F.col("__joint")).over(across) - F.col("__cuts")
    carry = chunks.select(*keys, _CHUNK, before.alias("__before"))
    out = join_carry(rows, carry, [*keys, _CHUNK])
    return out.withColumn(name, F.col("__n") + F.col("__before")).drop(_CHUNK, "__v", "__p", "__n", "__before")


def with_halo(df: DataFrame, index: str, before: int, size: int = CHUNK) -> DataFrame:
    """Tag rows with ``__chunk`` and copy the last ``before`` rows of a chunk into the next.

    ``index`` is the 1-based gap-free position in the sequence. Copies carry ``__halo`` = true
    and are dropped again by the caller after its window.
    """
    size = max(size, before)
    own = chunk_of(index, size)
    place = F.pmod(F.col(index) - 1, F.lit(size))
    chunks = F.when(place >= size - before, F.array(own, own + 1)).otherwise(F.array(own))
    return (
        df.withColumn("__own", own)
        .withColumn(_CHUNK, F.explode(chunks))
        .withColumn("__halo", F.col(_CHUNK) != F.col("__own"))
        .drop("__own")
    )


def over_recent(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    width: int,
    columns: Mapping[str, Column],
    size: int = CHUNK,
) -> DataFrame:
    """Add window expressions that look back at most ``width - 1`` rows.

    ``columns`` maps names to aggregate or ``lag`` expressions without ``over``.
    """
    rows = with_halo(df, index, width - 1, size)
    base = Window.partitionBy(*keys, _CHUNK).orderBy(index)
    frame = base.rowsBetween(-(width - 1), 0)
    rows = rows.withColumns({name: expr.over(frame) for name, expr in columns.items()})
    return rows.filter(~F.col("__halo")).drop("__halo", _CHUNK)


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    columns: Mapping[str, Column],
    size: int = CELL_CHUNK,
) -> DataFrame:
    """Add the values of the row before by ``index`` (NULL where the sequence begins or has a hole)."""
    rows = with_halo(df, index, 1, size)
    base = Window.partitionBy(*keys, _CHUNK).orderBy(index)
    next_to = F.col(index) - F.lag(index).over(base) == 1
    rows = rows.withColumns({name: F.when(next_to, F.lag(expr).over(base)) for name, expr in columns.items()})
    return rows.filter(~F.col("__halo")).drop("__halo", _CHUNK)


def renumber_frames(df: DataFrame, keys: Sequence[str] = ("video",), index: str = "frame_idx", size: int = CHUNK) -> DataFrame:
    """Give a filtered or gapped log a gap-free 1-based ``frame_idx`` again."""
    out = number_rows(df, list(keys), [index], chunk_of(index, size), "__dense")
    return out.withColumn(index, F.col("__dense")).drop("__dense")
