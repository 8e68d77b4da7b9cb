"""Small DataFrame helpers of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.storage import materialize


def equal_runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int = 1 << 16) -> Iterator[pa.Table]:
    """Sorted batches regrouped so that no run of equal ``keys`` is cut; a table holds about ``most`` rows, or one run."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def edge(batch: pa.RecordBatch) -> int:
        """Where the last run of the batch begins."""
        n = batch.num_rows
        if n < 2:
            return 0
        differs = np.zeros(n - 1, dtype=bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            differs |= v[1:] != v[:-1]
        at = np.flatnonzero(differs)
        return int(at[-1]) + 1 if len(at) else 0

    def same(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
        return all(a.column(k)[-1] == b.column(k)[0] for k in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and rows >= most and not same(held[-1], batch):
            yield pa.Table.from_batches(held)
            held, rows = [], 0
        cut = edge(batch)
        if rows + cut >= most and cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, rows = [batch.slice(cut)], batch.num_rows - cut
        else:
            held.append(batch)
            rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """First rows of the runs of equal values."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64)
    differs = np.zeros(n, dtype=bool)
    differs[0] = True
    for c in columns:
        differs[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(differs)


_ZSTD = pa.ipc.IpcWriteOptions(compression="zstd")


def packed(batch: pa.RecordBatch) -> bytes:
    """Rows as one compressed binary value: several times smaller in a shuffle than row by row."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_ZSTD) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(column: pa.ChunkedArray | pa.Array) -> Iterator[pa.RecordBatch]:
    for value in column:
        if value.is_valid:
            yield from pa.ipc.open_stream(value.as_buffer())


def packed_by(key: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
    """The rows of a batch packed for each key."""
    by = np.argsort(key, kind="stable")
    first = run_starts(key[by])
    ends = np.append(first[1:], len(by))
    return key[by][first], pa.array([packed(batch.take(pa.array(by[a:e]))) for a, e in zip(first, ends)], pa.binary())


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with as many lines after it as no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def block_of(column: str, n_blocks: int) -> Column:
    """The block of a row by a hash of its number; blocks come out about equal."""
    return F.pmod(F.xxhash64(column), F.lit(n_blocks)).cast("int")


def components(edges: DataFrame) -> DataFrame:
    """Connected components: ``edges(u, v)`` of longs to ``(node, root)``, ``root`` the smallest node reachable.

    Every round points the neighbours of a node to the smallest of them, once among larger and
    once among smaller neighbours, until all nodes hang on their root. A round moves each edge a
    few times and holds minima only; no component is gathered in a task. Each round is written
    to the shared folder. Nodes without edges are not in the result.
    """

    def hang(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        return pairs.join(least.withColumnRenamed("u", "__u"), F.col("u") == F.col("__u")).drop("__u")

    def fingerprint(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())

    state = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = fingerprint(state)
    while seen[0]:
        both = state.unionAll(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = hang(both).select("u", "v", F.least("u", "m").alias("m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = hang(large)
        small = small.select("u", F.col("m").alias("v")).unionAll(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        state = materialize(small.where("u <> v").distinct(), "edges")
        now = fingerprint(state)
        if now == seen:
            break
        seen = now
    roots = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
