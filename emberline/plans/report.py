"""Reports over many experiments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.operators.inventory import rank_rows
from emberline.operators.ordered import join_carry


def to_long(perf: DataFrame, ids: Sequence[str] = ("experiment", "dataset"), prefix: str = "metric_") -> DataFrame:
    """Wide perf rows as ``(ids..., metric, value)``; empty values are dropped."""
    metrics = [c for c in perf.columns if c.startswith(prefix)]
    values = F.array(
        *[F.struct(F.lit(c[len(prefix):]).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in metrics]
    )
    return perf.select(*ids, F.explode(values).alias("__m")).select(*ids, "__m.*").filter(F.col("value").isNotNull())


def wide_report(perf_long: DataFrame, columns: Sequence[tuple[str, str]], method: str = "method") -> DataFrame:
    """Methods in rows and one column ``dataset|metric`` per listed pair.

    The pairs are given, so Spark neither collects them first nor builds an open-ended pivot.
    """
    pair = F.concat_ws("|", "dataset", "metric")
    names = [f"{d}|{m}" for d, m in columns]
    return perf_long.withColumn("__pair", pair).groupBy(method).pivot("__pair", names).agg(F.first("value", ignorenulls=True))


def long_report(wide: DataFrame, headers: Sequence[tuple[str, str, str]], method: str = "method") -> DataFrame:
    """A two-header table back to rows: ``headers`` lists (column, dataset, metric)."""
    cells = F.array(
        *[
            F.struct(
                F.lit(d).alias("dataset"), F.lit(m).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")
            )
            for c, d, m in headers
        ]
    )
    out = wide.select(F.col(method), F.explode(cells).alias("__c")).select(method, "__c.*")
    return out.filter(F.col("value").isNotNull())


def order_methods(df: DataFrame, order: Sequence[str], method: str = "method") -> DataFrame:
    """Rows in a fixed method order; a method that is not listed is an error."""
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col(method))
    unknown = F.raise_error(F.concat(F.lit("method without a place: "), F.coalesce(F.col(method), F.lit("NULL"))))
    checked = F.when(place > 0, place).otherwise(unknown.cast("long"))
    return df.withColumn("method_order", checked.cast("int")).orderBy("method_order")


def baseline_delta(perf_long: DataFrame, base: str = "no_temp", method: str = "method") -> DataFrame:
    """Change of every value against the baseline method on the same dataset and metric."""
    ref = perf_long.filter(F.col(method) == base).select("dataset", "metric", F.col("value").alias("base_value"))
    out = join_carry(perf_long, ref, ["dataset", "metric"])
    return out.withColumn("delta", F.col("value") - F.col("base_value"))


def speed_ranking(log: DataFrame) -> DataFrame:
    """Algorithms by FPS, fastest first; equal speeds share a rank. NaN comes first and NULL last, as Spark sorts."""
    return rank_rows(log, F.col("fps").desc(), "place")


def first_errors(table: DataFrame, n: int = 10) -> DataFrame:
    """The first n wrong videos of a run: a top-n, not a full sort."""
    return table.filter(F.col("correct") == 0).orderBy("video").limit(n)


def best_trial(trials: DataFrame, value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """Parameters of the highest value; the smaller trial id wins a tie."""
    rest = [c for c in trials.columns if c not in by]
    best = F.max_by(F.struct(*rest), F.struct(F.col(value), (-F.col("trial_id")).alias("t")))
    return trials.filter(F.col(value).isNotNull()).groupBy(*by).agg(best.alias("__b")).select(*by, "__b.*")
