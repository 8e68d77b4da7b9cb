"""Running a stream to its end and fanning a batch out to several sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.storage import fresh_path, materialize

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PARTITIONS = "spark.sql.shuffle.partitions"
PARTITION_ROWS = 100_000  # of one epoch, for each partition of keyed state


def _with_state_store(spark: SparkSession, start: Callable, partitions: int | None = None):
    """Start a query with the state store that keyed processors need and so many partitions of state; the settings are put back."""
    settings = {_PROVIDER: _ROCKSDB} | ({_PARTITIONS: str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        query = start()
        query.awaitTermination()
        return query
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def state_partitions(spark: SparkSession, epoch_rows: int) -> int:
    """Partitions of keyed state for epochs of so many rows: one for each core at least, never more than the session's.

    Every partition of every stateful step opens and commits a store in each micro-batch, whether it has rows or not.
    """
    wanted = max(spark.sparkContext.defaultParallelism, -(-epoch_rows // PARTITION_ROWS))
    return min(wanted, int(spark.conf.get(_PARTITIONS)))


def run_to_table(
    stream: DataFrame, name: str, mode: str = "append", place: tuple[str, str] | None = None, partitions: int | None = None
) -> DataFrame:
    """Process all available input and return the written result.

    Files and offsets go to the shared folder, so a restart after a lost executor goes on from
    the last committed batch. Give the same ``place`` (result, progress) to go on with new input; it keeps the
    ``partitions`` of state of its first start.
    """
    spark = stream.sparkSession
    out, progress = place or (fresh_path(spark, name), fresh_path(spark, f"{name}-progress"))
    done: list[str] = []
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", out)
    else:
        # Complete mode: every batch has all results so far, in a folder of its own, so that a whole one is always there.
        def write(df: DataFrame, batch_id: int) -> None:
            df.write.mode("overwrite").parquet(f"{out}/{batch_id}")
            done.append(f"{out}/{batch_id}")

        writer = stream.writeStream.foreachBatch(write)
    writer = writer.outputMode(mode).option("checkpointLocation", progress).trigger(availableNow=True)
    _with_state_store(spark, writer.start, partitions)
    if mode != "append" and not done:
        raise ValueError("no new input to go on with")
    return spark.read.schema(stream.schema).parquet(out if mode == "append" else done[-1])


EPOCH_ROWS = 10_000_000
LEAST_EPOCHS = 5


def land_in_epochs(
    df: DataFrame, order: Column, name: str, epoch_rows: int = EPOCH_ROWS, epoch: Column | None = None
) -> DataFrame:
    """A stored table as a stream whose micro-batches are epochs in the order of ``order``, a numeric position in time.

    Keyed state needs its rows in order, and a file source orders files by landing time only. So
    the table is cut into ranges of at most about ``epoch_rows`` rows (equal times stay together), or by ``epoch``, an
    ascending number, and each lands as one file, one after the other, to be read one by one. A row without a time has no place in the
    order, so it is an error, never a late row.
    """
    return _land(df, order, name, epoch_rows, epoch)[0]


def _land(df: DataFrame, order: Column, name: str, epoch_rows: int, epoch: Column | None) -> tuple[DataFrame, int]:
    """The stream of :func:`land_in_epochs`, and the rows of its largest epoch."""
    spark = df.sparkSession
    rows = materialize(df.withColumns({"__at": order, "__epoch": F.lit(0).cast("long") if epoch is None else epoch.cast("long")}), f"{name}-all")
    n, known = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("__at").isNotNull() & F.col("__epoch").isNotNull(), 1))).first()
    if known < n:
        raise ValueError("a row without a time can't be put in order")
    cut, source = fresh_path(spark, f"{name}-epochs"), fresh_path(spark, f"{name}-in")
    if epoch is None:
        rows = rows.repartitionByRange(max(LEAST_EPOCHS, -(-n // epoch_rows)), "__at").withColumn("__epoch", F.spark_partition_id().cast("long"))
    else:
        rows = rows.repartition("__epoch")
    rows.drop("__at").write.partitionBy("__epoch").parquet(cut)
    counts = dict(spark.read.schema("__epoch long").parquet(cut).groupBy("__epoch").count().collect()) if n else {None: 0}
    for e in sorted(counts) if n else counts:
        part = df.limit(0) if e is None else spark.read.schema(df.schema).parquet(f"{cut}/__epoch={e}")
        part.coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source), max(counts.values())


def run_in_epochs(
    df: DataFrame,
    order: Column,
    transform: Callable[[DataFrame], DataFrame],
    name: str,
    mode: str = "append",
    epoch_rows: int = EPOCH_ROWS,
    epoch: Column | None = None,
) -> DataFrame:
    """Feed a stored table to one stream, epoch by epoch, see :func:`land_in_epochs`: a task never holds more than one epoch of a channel."""
    stream, largest = _land(df, order, name, epoch_rows, epoch)
    return run_to_table(transform(stream), name, mode, partitions=state_partitions(df.sparkSession, largest))


class ResultHandler:
    """Hooks of one sink; override what is needed."""

    def open(self) -> None: ...

    def handle(self, batch: DataFrame, batch_id: int) -> None: ...

    def close(self) -> None: ...


class ParquetHandler(ResultHandler):
    """Writes each batch to its own folder, so a repeated batch replaces itself."""

    def __init__(self, path: str, transform: Callable[[DataFrame], DataFrame] | None = None):
        self.path, self.transform = path, transform

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        out = self.transform(batch) if self.transform else batch
        out.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")


def stream_results(
    stream: DataFrame, handlers: Sequence[ResultHandler], mode: str = "append", progress: str | None = None
) -> int:
    """Give every micro-batch to all handlers; the batch is computed once. Returns the batch count.

    A batch that fails in one handler was perhaps taken by others: started again with the same
    ``progress`` folder, the stream repeats it under the same number, by which handlers replace what they have.
    """
    spark = stream.sparkSession
    progress = progress or fresh_path(spark, "results-progress")
    seen = []

    def fan_out(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for handler in handlers:
                handler.handle(batch, batch_id)
        finally:
            batch.unpersist()
        seen.append(batch_id)

    for handler in handlers:
        handler.open()
    try:
        writer = stream.writeStream.foreachBatch(fan_out).outputMode(mode)
        writer = writer.option("checkpointLocation", progress).trigger(availableNow=True)
        _with_state_store(spark, writer.start)
    finally:
        for handler in handlers:
            handler.close()
    return len(seen)
