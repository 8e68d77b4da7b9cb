"""Joins between file lists, runs, results and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.ordered import number_by_range, spread_join
from emberline.storage import materialize


def missing_outputs(videos: DataFrame, results: DataFrame, key: str = "video") -> DataFrame:
    """Videos without a result and results without a video."""
    v, r = videos.select(key), results.select(key)
    return (
        v.join(r, key, "left_anti")
        .select(key, F.lit("no result").alias("problem"))
        .unionByName(r.join(v, key, "left_anti").select(key, F.lit("no video").alias("problem")))
    )


def pending_videos(videos: DataFrame, results: DataFrame, key: str = "video") -> DataFrame:
    return videos.join(results.select(key), key, "left_anti")


def attach_machine(runs: DataFrame, names: DataFrame, host: str = "pc_name") -> DataFrame:
    """Short machine name of each run; an unknown host is an error."""
    lookup = names.select(F.col("pc_name").alias(host), F.col("abbr").alias("__abbr"))
    out = spread_join(runs, lookup, [host], F.xxhash64(*runs.columns))
    unknown = F.raise_error(F.concat(F.lit("unknown machine "), F.coalesce(F.col(host), F.lit("NULL"))))
    return out.withColumn("machine", F.coalesce(F.col("__abbr"), unknown.cast("string"))).drop("__abbr")


def latest_runs(runs: DataFrame, keys: Sequence[str] = ("machine", "dataset"), stamp: str = "stamp") -> DataFrame:
    """The newest run of each group. An aggregate, not a window: it is combined on the map side."""
    rest = [c for c in runs.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(F.col(stamp), *[F.col(c) for c in rest if c != stamp]))
    return runs.groupBy(*keys).agg(newest.alias("__r")).select(*keys, "__r.*")


def reuse_runs(runs: DataFrame, source_method: str = "no_temp", keys: Sequence[str] = ("machine", "dataset")) -> DataFrame:
    """For each run, the newest log of ``source_method`` on the same machine and dataset."""
    source = latest_runs(runs.filter(F.col("method") == source_method), keys)
    source = source.select(*keys, F.col("run").alias("source_run"))
    return spread_join(runs, source, list(keys), F.col("run"), "inner")


def experiment_matrix(
    datasets: DataFrame, methods: Sequence[str], timestamps: Sequence[str] | None = None, n_datasets: int | None = None
) -> DataFrame:
    """All (method, dataset) pairs in method-major order, with timestamps by position.

    The methods are a literal list, so every dataset row is expanded in place; nothing is
    joined. Timestamps need the number of datasets for the length check.
    """
    methods = list(methods)
    if not methods:
        raise ValueError("no methods provided")
    placed = number_by_range(datasets.select("dataset").distinct(), [], ["dataset"], "__place")
    options = F.array(*[F.struct(F.lit(i).alias("m"), F.lit(m).alias("method")) for i, m in enumerate(methods)])
    out = placed.withColumn("__o", F.explode(options))
    if timestamps is None:
        return out.select("__o.method", "dataset")
    if n_datasets is None or len(timestamps) != n_datasets * len(methods):
        raise ValueError("one timestamp per method and dataset is needed")
    position = F.col("__o.m") * n_datasets + F.col("__place")
    stamps = F.array(*[F.lit(t) for t in timestamps])
    return out.select("__o.method", "dataset", F.element_at(stamps, position.cast("int")).alias("stamp"))


def select_manifest(files: DataFrame, manifest: DataFrame, key: str = "video", strict: bool = True) -> DataFrame:
    """Files named in the manifest; with ``strict`` a name without a file is an error."""
    names = manifest.select(F.col(key).alias("__name")).distinct()
    if not strict:
        return files.join(names, F.col(key) == F.col("__name"), "left_semi")
    joined = names.join(files, F.col(key) == F.col("__name"), "left")
    absent = F.raise_error(F.concat(F.lit("manifest names a missing file: "), F.col("__name")))
    return joined.withColumn(key, F.coalesce(F.col(key), absent.cast(files.schema[key].dataType))).drop("__name")


def union_perf(*tables: DataFrame) -> DataFrame:
    """Perf tables with different columns; what a table lacks is NULL."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def compare_speed(included: DataFrame, excluded: DataFrame, key: str = "algorithm") -> DataFrame:
    """The same algorithm with and without capture time."""
    a = included.select(key, F.col("fps").alias("fps_included"))
    b = excluded.select(key, F.col("fps").alias("fps_excluded"))
    ratio = F.when(F.col("fps_included") > 0, F.col("fps_excluded") / F.col("fps_included"))
    return a.join(b, key).withColumn("speedup", ratio)


def stratified_split(
    df: DataFrame,
    fractions: Sequence[tuple[str, float]],
    key: str,
    order: Column,
    order_range: int,
    tie: str,
    fan: int = 1 << 10,
) -> DataFrame:
    """Exact shares per class. ``order`` is a hash in 0 .. order_range-1, ties broken by ``tie``; a NULL class is one of its own.

    No class is sorted or numbered. The cut of a share is the hash of its last row: a histogram of ``fan`` ranges, combined
    on the map side, tells in which range that is, and the next one divides that range only. So ``log(order_range)`` to the base ``fan`` passes
    count, one row for each class and range is shuffled, and only the rows that share a cut's hash are ranked by ``tie``.
    """
    bounds = [round(sum(share for _, share in fractions[: i + 1]), 12) for i in range(len(fractions) - 1)]
    names = [n for n, _ in fractions]
    if not bounds:
        return df.withColumn("split", F.lit(names[0]))
    rows = df.withColumns({"__order": order.cast("long"), "__key": F.struct(key)})
    facts = rows.groupBy("__key").agg(F.count(F.lit(1)).alias("__n"))
    # of each class and bound: the rank that is sought, counted from the range in which it lies
    cuts = facts.select(
        F.col("__key").alias("k"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col("__n") * F.lit(b)).cast("long").alias("rank"), F.lit(0).cast("long").alias("low")) for i, b in enumerate(bounds)])).alias("c"),
    ).select("k", "c.*")
    cuts = materialize(cuts.where("rank > 0"), "cuts")
    width = 1
    while width < order_range:
        width *= fan
    while width > 1:
        width //= fan
        wide = width * fan
        asked = cuts.select("k", "low").distinct()
        inside = spread_join(rows.select(F.col("__key").alias("k"), "__order", F.floor(F.col("__order") / wide).cast("long").alias("low")), asked.select("k", F.floor(F.col("low") / wide).cast("long").alias("low"), F.lit(True).alias("asked")), ["k", "low"], F.col("__order"), "inner")
        counts = inside.groupBy("k", "low", F.floor(F.col("__order") / width).cast("long").alias("r")).agg(F.count(F.lit(1)).alias("n"))
        up_to = F.sum("n").over(Window.partitionBy("k", "low").orderBy("r"))  # at most ``fan`` rows
        counts = counts.select(F.col("k").alias("hk"), F.col("low").alias("hlow"), "r", (up_to - F.col("n")).alias("before"), up_to.alias("until"))
        hit = (F.col("k") == F.col("hk")) & (F.floor(F.col("low") / wide) == F.col("hlow")) & (F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("until"))
        cuts = materialize(cuts.join(counts, hit).select("k", "i", (F.col("rank") - F.col("before")).alias("rank"), (F.col("r") * width).alias("low")), "cuts")
    # of the rows that share a cut's hash, the first few by ``tie``
    at_cut = spread_join(rows.select(F.col("__key").alias("k"), F.col("__order").alias("low"), F.col(tie).alias("t")), cuts.select("k", "low").distinct().withColumn("asked", F.lit(True)), ["k", "low"], F.xxhash64("t"), "inner")
    placed = number_by_range(at_cut.drop("asked"), ["k", "low"], ["t"], "place")
    last = placed.join(cuts.withColumnsRenamed({"k": "ck", "low": "clow"}), (F.col("k") == F.col("ck")) & (F.col("low") == F.col("clow")) & (F.col("place") == F.col("rank")))
    ends = last.groupBy(F.col("k").alias("__key")).agg(*[F.max(F.when(F.col("i") == i, F.struct(F.col("low").alias("o"), F.col("t")))).alias(f"__e{i}") for i in range(len(bounds))])
    rows = spread_join(rows, ends, ["__key"], F.col(tie))
    here = F.struct(F.col("__order").alias("o"), F.col(tie).alias("t"))
    part = F.lit(names[-1])
    for i in reversed(range(len(bounds))):
        part = F.when(here <= F.col(f"__e{i}"), names[i]).otherwise(part)
    return rows.withColumn("split", part).drop("__order", "__key", *[f"__e{i}" for i in range(len(bounds))])


def class_index(labels: DataFrame, name: str) -> DataFrame:
    """Distinct class names numbered from 0 in name order, with the number of classes."""
    names = labels.filter(F.col(name).isNotNull()).select(F.col(name).alias("class_name")).distinct()
    placed = number_by_range(names, [], ["class_name"], "__place")
    return placed.select("class_name", (F.col("__place") - 1).alias("class_id"))


def with_class_index(df: DataFrame, name: str) -> DataFrame:
    """Add ``class_id`` to every row. Spark broadcasts the names when they turn out small."""
    index = class_index(df, name).withColumnRenamed("class_name", name)
    return spread_join(df, index, [name], F.xxhash64(*df.columns))


def rank_rows(df: DataFrame, order: Column, name: str = "place") -> DataFrame:
    """Rank over a whole table (equal values share a rank) without one global sort task; NULL and NaN as in ``order``."""
    return number_by_range(df, [], [order], name, method="rank")

