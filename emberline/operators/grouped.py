"""Arrow batches cut into small ordered groups.

``groupBy().applyInPandas`` pays a fixed price per group, which dominates when there are many
short videos. Here each task streams its sorted rows and hands numpy slices of one group after
another to a function. The caller bounds the group size by its keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

Arrays = dict[str, np.ndarray]


def map_sorted_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fn: Callable[[Arrays], Arrays | None],
    schema: T.StructType | str,
) -> DataFrame:
    """Apply ``fn`` to every group; it gets and returns one array per column."""
    keys = list(keys)
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def groups(batch: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> Iterator[pd.DataFrame]:
        columns = {c: batch[c].to_numpy() for c in batch.columns}
        out = []
        for low, high in zip(starts, ends):
            result = fn({c: v[low:high] for c, v in columns.items()})
            if result is not None:
                out.append(result)
        if out:
            yield pd.DataFrame({c: np.concatenate([o[c] for o in out]) for c in out[0]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            if held is not None:
                batch = pd.concat([held, batch], ignore_index=True)
            if batch.empty:
                continue
            new = np.zeros(len(batch), dtype=bool)
            new[0] = True
            for k in keys:
                v = batch[k].to_numpy()
                new[1:] |= v[1:] != v[:-1]
            starts = np.flatnonzero(new)
            # The last group may go on in the next batch.
            yield from groups(batch, starts[:-1], starts[1:])
            held = batch.iloc[starts[-1] :]
        if held is not None and len(held):
            yield from groups(held, np.array([0]), np.array([len(held)]))

    return rows.mapInPandas(run, schema)


def binaries(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    rows = np.ascontiguousarray(rows)
    width = rows.nbytes // len(rows) if len(rows) else 0
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def slices(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The bytes from each start to the next one, or to the end, as one binary value."""
    offsets = np.append(starts, len(values)).astype(np.int32) * np.int32(values.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def matrix_of(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    """Binary values of one length as the rows of a matrix."""
    values = column.to_numpy()
    return np.frombuffer(b"".join(values), dtype=dtype).reshape(len(values), -1)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches cut so that no group is in two of them, each with the places where its groups begin."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        new = np.zeros(table.num_rows, dtype=bool)
        new[0] = True
        for k in keys:
            v = table[k]
            if pa.types.is_string(v.type) and not v.null_count:  # compared without an object for each
                new[1:] |= pc.not_equal(v.slice(1), v.slice(0, len(v) - 1)).to_numpy()
                continue
            v = v.to_numpy()
            new[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(new)
        # The last group may go on in the next batch.
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts[:-1]
        held = table.slice(starts[-1])
    if held is not None and held.num_rows:
        yield held, np.array([0])


def map_sorted_batches(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fn: Callable[[pa.Table, np.ndarray], Iterator[dict]],
    schema: T.StructType,
) -> DataFrame:
    """As :func:`map_sorted_groups` where groups are small and many: ``fn`` gets many whole groups at once.

    It is called with a table and the places where its groups begin, and yields one array per column.
    """
    keys = list(keys)
    # The last key comes first: a chunk's number tells more rows apart than a video's name, and compares faster.
    rows = df.repartition(*keys).sortWithinPartitions(*keys[::-1], *order)
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_groups(batches, keys):
            for out in fn(table, starts):
                yield from pa.table([out[n] for n in arrow.names], names=arrow.names).cast(arrow).to_batches()

    return rows.mapInArrow(run, schema)


def append_to_sorted_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    inputs: Sequence[str],
    fn: Callable[[Arrays], Arrays],
    fields: Sequence[T.StructField],
) -> DataFrame:
    """Add columns that need the whole ordered group.

    ``fn`` sees only ``inputs`` and returns one array per new field. All other columns pass
    through as Arrow buffers, untouched.
    """
    keys, inputs = list(keys), list(inputs)
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    names = [f.name for f in fields]
    arrow_types = {f.name: to_arrow_type(f.dataType) for f in fields}

    def with_new(table: pa.Table, starts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        columns = {c: table[c].to_numpy() for c in inputs}
        parts = [fn({c: v[low:high] for c, v in columns.items()}) for low, high in zip(starts, ends)]
        for n in names:
            # Typed, so that a slice of only empty values keeps its column's type.
            table = table.append_column(n, pa.array(np.concatenate([p[n] for p in parts]), arrow_types[n]))
        yield from table.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_groups(batches, keys):
            yield from with_new(table, starts, np.append(starts[1:], table.num_rows))

    return rows.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))
