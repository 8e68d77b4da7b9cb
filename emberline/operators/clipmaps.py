"""Maps x -> clip(x + shift, low, high) of chunks of a sequence, chained in a tree.

Two such maps in a row are one such map. So the maps of up to ``FAN`` neighbouring chunks become one, level by level,
until one group holds all that is left; then the state before each group goes down again and gives the state before each
of its members. No group holds more than ``FAN`` maps, however long the sequence. A task chains many groups at once: the
second maps of all, then the third ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.operators.grouped import binaries, map_sorted_batches, matrix_of
from emberline.storage import materialize

FAN = 256


def packed_map(shift: np.ndarray, low: np.ndarray, high: np.ndarray) -> bytes:
    return np.concatenate([shift, low, high]).astype("<i4").tobytes()


def _counts(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def _of_one_size(table: pa.Table, starts: np.ndarray) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The groups parted by the size of their maps."""
    sizes = np.maximum.reduceat(pc.binary_length(table["map"]).to_numpy(), starts)
    counts = _counts(starts, table.num_rows)
    kinds = np.unique(sizes)
    for size in kinds:
        mine = sizes == size
        part = table if len(kinds) == 1 else table.filter(pa.array(np.repeat(mine, counts)))
        yield part, np.cumsum(counts[mine]) - counts[mine]


def chunk_starts(maps: DataFrame, keys: Sequence[str], fan: int = FAN) -> DataFrame:
    """``(keys, __chunk, start)``: the state before each chunk of ``maps(keys, __chunk, map)``, one byte for each place; all begin with zeros.

    ``maps`` is read twice: store it first.
    """
    keys = list(keys)
    key_fields = [maps.schema[k] for k in keys]

    def whole(table: pa.Table, starts: np.ndarray) -> Iterator[dict]:
        for part, first in _of_one_size(table, starts):
            maps = matrix_of(part["map"], "<i4").reshape(part.num_rows, 3, -1)
            counts = _counts(first, part.num_rows)
            out = maps[first]
            for i in range(1, counts.max()):
                more = np.flatnonzero(counts > i)
                shift, low, high = maps[first[more] + i].swapaxes(0, 1)
                out[more, 0] += shift
                out[more, 1:] = np.clip(out[more, 1:] + shift[:, None], low[:, None], high[:, None])
            yield {**{k: part[k].take(pa.array(first)) for k in [*keys, "__up"]}, "map": binaries(out)}

    def along(table: pa.Table, starts: np.ndarray) -> Iterator[dict]:
        for part, first in _of_one_size(table, starts):
            lead = part["__place"].to_numpy() < 0
            led = lead[first]
            counts = _counts(first, part.num_rows) - led
            part, before = part.filter(pa.array(~lead)), part.filter(pa.array(lead))["map"]
            first = np.cumsum(counts) - counts
            maps = matrix_of(part["map"], "<i4").reshape(part.num_rows, 3, -1)
            state = np.zeros((len(first), maps.shape[2]), dtype=np.int32)
            if len(before):
                state[led] = matrix_of(before, "u1")
            found = np.empty((part.num_rows, maps.shape[2]), dtype=np.uint8)
            for i in range(counts.max()):
                more = np.flatnonzero(counts > i)
                at = first[more] + i
                found[at] = state[more]
                shift, low, high = maps[at].swapaxes(0, 1)
                state[more] = np.clip(state[more] + shift, low, high)
            yield {**{k: part[k] for k in [*keys, "__chunk"]}, "start": binaries(found)}

    levels = [maps.select(*keys, "__chunk", "map")]
    top = levels[0].agg(F.max("__chunk")).first()[0] or 0
    up = F.floor(F.col("__chunk") / F.lit(fan)).cast("long").alias("__up")
    merged = T.StructType([*key_fields, T.StructField("__up", T.LongType()), T.StructField("map", T.BinaryType())])
    while top >= fan:
        out = map_sorted_batches(levels[-1].select("*", up), [*keys, "__up"], ["__chunk"], whole, merged)
        levels.append(materialize(out.withColumnRenamed("__up", "__chunk"), "chunk-maps"))
        top //= fan
    found = T.StructType([*key_fields, T.StructField("__chunk", T.LongType()), T.StructField("start", T.BinaryType())])
    starts = None
    for level in reversed(levels):
        rows = level.select(*keys, F.col("__chunk").cast("long").alias("__chunk"), "map", up, F.col("__chunk").cast("long").alias("__place"))
        if starts is not None:  # the state before a group comes before its maps
            lead = starts.select(*keys, F.lit(0).cast("long"), "start", "__chunk", F.lit(-1).cast("long"))
            rows = rows.union(lead)
        starts = map_sorted_batches(rows, [*keys, "__up"], ["__place"], along, found)
    return starts
