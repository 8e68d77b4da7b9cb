"""Functions over the per-class score arrays of a frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKIPPED = "skipped"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def softmax(logits: Column | str) -> Column:
    """Probabilities of one score row; the maximum is subtracted first so ``exp`` stays finite."""
    x = _col(logits)
    shifted = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(shifted, lambda v: v / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def log_sum_exp(logits: Column | str) -> Column:
    x = _col(logits)
    peak = F.array_max(x)
    return peak + F.log(F.aggregate(F.transform(x, lambda v: F.exp(v - peak)), F.lit(0.0), lambda a, b: a + b))


def argmax_index(probs: Column | str) -> Column:
    """0-based index of the largest score, the first one on ties."""
    p = _col(probs)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def argmax_label(probs: Column | str, names: Column | str) -> Column:
    """Class name of the largest score; an index outside the names is an error."""
    index = argmax_index(probs)
    names = _col(names)
    return F.when(index < F.size(names), F.try_element_at(names, index + 1)).otherwise(
        F.when(index.isNotNull(), F.raise_error(F.lit("class index out of range")).cast("string"))
    )


def topk(probs: Column | str, names: Column | str | None, k: int) -> Column:
    """The k best classes as an array of (index, label, prob); lower index first on ties."""
    p = _col(probs)
    rows = F.transform(
        p,
        lambda v, i: F.struct(
            (-v).alias("order"),
            i.cast("int").alias("index"),
            (F.try_element_at(_col(names), i + 1) if names is not None else F.lit(None).cast("string")).alias("label"),
            v.alias("prob"),
        ),
    )
    best = F.slice(F.array_sort(rows), 1, k)
    return F.transform(best, lambda r: F.struct(r["index"].alias("index"), r["label"].alias("label"), r["prob"].alias("prob")))


def with_topk(
    df: DataFrame, k: int, n_classes: int, probs: str = "probs", names: str | None = "class_names", separate: bool = True
) -> DataFrame:
    """Add the top-k classes, as ``index_0, label_0, prob_0, ...`` or as three arrays."""
    k = min(k, n_classes)
    out = df.withColumn("__top", topk(probs, names, k))
    parts = ["index", "prob"] if names is None else ["index", "label", "prob"]
    if separate:
        out = out.withColumns({f"{p}_{i}": F.get(F.col(f"__top.{p}"), F.lit(i)) for i in range(k) for p in parts})
    else:
        out = out.withColumns({p: F.col(f"__top.{p}") for p in parts})
    return out.drop("__top")


def fill_skipped(df: DataFrame, skip: Column | str, n_classes: int) -> DataFrame:
    """Give skipped frames zero scores, index -1 and the label ``skipped``."""
    skip = F.coalesce(_col(skip), F.lit(False))
    zeros = F.array_repeat(F.lit(0.0), n_classes)
    return df.withColumns(
        {
            "logits": F.when(skip, zeros).otherwise(F.col("logits")),
            "probs": F.when(skip, zeros).otherwise(F.col("probs")),
            "pred_label_idx": F.when(skip, F.lit(-1)).otherwise(F.col("pred_label_idx")),
            "pred_label": F.when(skip, F.lit(SKIPPED)).otherwise(F.col("pred_label")),
        }
    )


def split_valid(df: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with every required result, and the rest."""
    missing = F.lit(False)
    for name in required:
        missing = missing | F.col(name).isNull()
    return df.filter(~missing), df.filter(missing)


def validate_frames(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Fail when a row lacks a required result; a missing column fails at once."""
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"missing result columns: {absent}")
    checked = {
        name: F.coalesce(
            F.col(name),
            F.raise_error(F.lit(f"missing result: {name}")).cast(df.schema[name].dataType),
        )
        for name in required
    }
    return df.withColumns(checked)


def cross_entropy(logits: Column | str, target: Column | str) -> Column:
    """Per-row loss: log-sum-exp of the scores minus the target's score (0-based target)."""
    return log_sum_exp(logits) - F.element_at(_col(logits), (_col(target) + 1).cast("int"))


def target_rank(scores: Column | str, target: Column | str) -> Column:
    """1-based place of the target's score; equal scores rank by class index."""
    s, t = _col(scores), _col(target).cast("int")
    mine = F.element_at(s, t + 1)
    places = F.transform(s, lambda v, i: F.when((v > mine) | ((v == mine) & (i < t)), 1).otherwise(0))
    return F.aggregate(places, F.lit(1), lambda a, b: a + b)
