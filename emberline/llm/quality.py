"""Quality classifier: a cumulative-link (proportional odds) regression on graded ratings.

A document has one score ``s = w . x`` over hashed features of its words; ordered thresholds
``b_1 < b_2 < ...`` turn it into ``P(grade >= g) = sigmoid(s - b_g)``. All grades share ``w``. The
expected grade is the sum of these tails. Features are the distinct lower-cased words, the first
four and five bytes and the last three bytes of words, and a few shares (repeats, capitals, marks).

The model is fitted with numpy on a bounded sample of the rated documents (``FIT_ROWS``, chosen
by a hash of the id; features are computed by Spark tasks, the driver gets their numbers only).
Scoring reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.tokens import LOWER, prefix_sums, slices, span_hashes, words

BITS = 18
FIT_ROWS = 8_000
_DENSE = 6
_SPREAD = 0xD6E8FEB86659FD93
_MARK = np.ones(256, dtype=bool)
_MARK[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100), 0x20, *range(0x09, 0x0E), ord("."), ord(",")]] = False


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    dense: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """``P(grade >= g)`` for g = 1, 2, ...: a row for each score."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def featurize(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse feature numbers, where each text's begin (one more than texts), and the dense shares."""
    w = words(texts)
    n, size = len(w.first) - 1, np.int64(1 << BITS)
    low, raw = prefix_sums(LOWER[w.buf]), prefix_sums(w.buf)
    length = w.ends - w.starts
    kinds = (
        span_hashes(low, w.starts, w.ends),
        span_hashes(low, w.starts, w.starts + np.minimum(length, 4)),
        span_hashes(low, w.starts, w.starts + np.minimum(length, 5)),
        span_hashes(raw, w.ends - np.minimum(length, 3), w.ends),
    )
    text_of = w.text_of.astype(np.int64)
    keys = np.concatenate([text_of * size + ((h ^ np.uint64(i << 62)) * np.uint64(_SPREAD) >> np.uint64(64 - BITS)).astype(np.int64) for i, h in enumerate(kinds)])
    keys.sort()
    if len(keys):
        keys = keys[np.append(True, keys[1:] != keys[:-1])]
    first = np.searchsorted(keys, np.arange(n + 1) * size)

    def count(flags: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(flags, dtype=np.int64))
        return np.diff(sums[w.offsets]).astype(float)

    n_bytes = np.maximum(np.diff(w.offsets), 1)
    n_words = np.maximum(w.counts, 1)
    capitals = (w.buf >= ord("A")) & (w.buf <= ord("Z"))
    dense = np.stack(
        [
            np.ones(n),
            np.log1p(w.counts) / 5,
            np.minimum(np.diff(first) / n_words, 4) / 2,
            count(capitals) / n_bytes * 5,
            count(_MARK[w.buf]) / n_bytes * 5,
            np.minimum(n_bytes / n_words, 40) / 10,
        ],
        axis=1,
    )
    return keys % size, first, dense


def score(model: Model, numbers: np.ndarray, first: np.ndarray, dense: np.ndarray) -> np.ndarray:
    sums = np.append(0.0, np.cumsum(model.weights[numbers], dtype=np.float64))
    return sums[first[1:]] - sums[first[:-1]] + dense @ model.dense


def telling(numbers: np.ndarray, first: np.ndarray, grades: np.ndarray, n_grades: int, z: float, least: float) -> np.ndarray:
    """How much a feature tells: its largest log odds ratio between two sides of a grade, or zero.

    It counts where the shares of documents differ by ``z`` standard errors at least and the ratio is
    ``least`` or more; words that merely come with longer documents stay below.
    """
    size = 1 << BITS
    grade_of = np.repeat(grades.astype(np.int8), np.diff(first))
    have = np.stack([np.bincount(numbers[grade_of == g], minlength=size) for g in range(n_grades)]).astype(float)
    n = np.bincount(grades, minlength=n_grades).astype(float)
    out = np.zeros(size)
    for g in range(1, n_grades):
        for below in ([*range(g)], [g - 1]):
            low, high = max(n[below].sum(), 1), max(n[g:].sum(), 1)
            a, b = have[below].sum(axis=0), have[g:].sum(axis=0)
            p = (a + b + 1) / (low + high + 2)
            sure = np.abs(a / low - b / high) >= z * np.sqrt(p * (1 - p) * (1 / low + 1 / high))
            ratio = np.abs(np.log((a + 0.5) / (low - a + 0.5)) - np.log((b + 0.5) / (high - b + 0.5)))
            out = np.maximum(out, np.where(sure & (ratio >= least), ratio, 0.0))
    return out


def fit(numbers: np.ndarray, first: np.ndarray, dense: np.ndarray, grades: np.ndarray, n_grades: int, rounds: int = 150, rate: float = 0.03, decay: float = 1e-3, z: float = 4.0, least: float = 2.0) -> Model:
    """Penalized maximum likelihood by full-batch Adam over the telling features; the others weigh nothing.

    A grade weighs as the square root of its count. A feature enters with what it tells as its value, so that
    the penalty hardly holds back words that one grade alone has.
    """
    value = telling(numbers, first, grades, n_grades, z, least)
    kept = np.flatnonzero(value)
    used = value[numbers] > 0
    first = np.append(0, np.cumsum(used))[first]
    numbers = np.searchsorted(kept, numbers[used])
    value, size = value[kept], len(kept)
    levels = np.arange(1, n_grades)
    share = np.bincount(grades, minlength=n_grades) / max(len(grades), 1)
    weight = np.where(share > 0, np.maximum(share, 1e-9) ** -0.5, 0.0)[grades]
    weight /= weight.mean()
    above = (grades[:, None] >= levels[None, :]).astype(float)
    text_of = np.repeat(np.arange(len(grades)), np.diff(first))
    x = np.zeros(size + _DENSE + n_grades - 1)  # weights, dense weights, first threshold and the logs of the steps
    m, v = np.zeros_like(x), np.zeros_like(x)
    for i in range(1, rounds + 1):
        steps = np.append(x[size + _DENSE], np.exp(np.clip(x[size + _DENSE + 1 :], -5, 5)))
        model = Model(x[:size] * value, x[size : size + _DENSE], np.cumsum(steps))
        s = score(model, numbers, first, dense)
        # P(grade = g) is a difference of neighbouring tails; its logarithm's slope in s and in each threshold:
        tail = np.concatenate([np.ones((len(s), 1)), model.tails(s), np.zeros((len(s), 1))], axis=1)
        rows = np.arange(len(s))
        high, low = tail[rows, grades], tail[rows, grades + 1]
        p = np.maximum(high - low, 1e-9)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
        slope = (d_low - d_high) * weight / len(s)
        at_b = np.zeros((len(s), n_grades + 1))
        at_b[rows, grades] += d_high * weight / len(s)
        at_b[rows, grades + 1] -= d_low * weight / len(s)
        by_threshold = at_b.sum(axis=0)[1:n_grades]
        by_step = np.cumsum(by_threshold[::-1])[::-1] * np.append(1.0, steps[1:])
        g = np.concatenate([np.bincount(numbers, weights=slope[text_of], minlength=size) * value, dense.T @ slope, by_step])
        g[: size + _DENSE] += decay * x[: size + _DENSE]
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        x = x - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    steps = np.append(x[size + _DENSE], np.exp(np.clip(x[size + _DENSE + 1 :], -5, 5)))
    weights = np.zeros(1 << BITS, dtype=np.float32)
    weights[kept] = x[:size] * value
    return Model(weights, x[size : size + _DENSE], np.cumsum(steps))


def train(docs: DataFrame, grades: DataFrame, n_grades: int, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on at most about ``fit_rows`` rated documents. ``grades(id, grade)`` has integers 0 to ``n_grades - 1``.

    Rows with a NULL id, text or grade are not learned from; repeated ids count as often as they
    pair. With no rated row, or one grade alone, the model knows nothing: all weights are zero and
    the thresholds are those of an untrained model, below zero, so that nothing is rejected.
    """
    rated = grades.select(F.col("id").cast("long").alias("__id"), F.col("grade").cast("int").alias("grade")).where("__id IS NOT NULL AND grade IS NOT NULL").distinct()
    n = max(rated.count(), 1)
    chosen = rated.where((F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < F.lit(int(min(1.0, fit_rows / n) * (1 << 30)))))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    rows = rows.join(chosen, F.col("id") == F.col("__id")).select("id", "text", "grade")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            numbers, first, dense = featurize(b.column("text"))
            parts = [numbers[a:e].astype(np.int32).tobytes() for a, e in zip(first[:-1], first[1:])]
            yield pa.record_batch([b.column("id"), b.column("grade"), pa.array(parts, pa.binary()), pa.array([d.tobytes() for d in dense], pa.binary())], names=["id", "grade", "numbers", "dense"])

    got = rows.mapInArrow(run, "id long, grade int, numbers binary, dense binary").collect()
    got.sort(key=lambda r: (r.id, r.grade, bytes(r.numbers)))
    grade = np.array([r.grade for r in got], dtype=np.int64)
    if len(set(grade.tolist())) < 2:
        return Model(np.zeros(1 << BITS, np.float32), np.zeros(_DENSE), -4.0 + 0.1 * np.arange(n_grades - 1))
    first = np.append(0, np.cumsum([len(r.numbers) // 4 for r in got]))
    numbers = np.frombuffer(b"".join(r.numbers for r in got), np.int32)
    dense = np.stack([np.frombuffer(r.dense, np.float64) for r in got])
    del got
    return fit(numbers, first, dense, grade, n_grades)


def rate(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_from: int | None = None, least: float = 0.5) -> DataFrame:
    """``(id, expected_grade, tail, keep)`` for every row; ``tail`` is ``P(grade >= keep_from)``, the top grade by default.

    A document is kept when its tail is at least ``least``. NULL counts as the empty text, which is
    not kept: there is nothing to learn from. Repeated rows get equal results.
    """
    spark = docs.sparkSession
    top = len(model.thresholds) if keep_from is None else keep_from
    shared = spark.sparkContext.broadcast(model)  # a fixed number of weights, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches, "text"):
            numbers, first, dense = featurize(b.column("text"))
            tails = m.tails(score(m, numbers, first, dense))
            tail = tails[:, top - 1]
            keep = (tail >= least) & (np.diff(first) > 0)
            yield pa.record_batch([b.column("id"), pa.array(tails.sum(axis=1)), pa.array(tail), pa.array(keep)], names=["id", "expected_grade", "tail", "keep"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "id long, expected_grade double, tail double, keep boolean")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", keep_from: int | None = None, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`rate` keeps; nothing is joined, so rows may repeat or lack an id."""
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)
    top = len(model.thresholds) if keep_from is None else keep_from

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches, text_col):
            numbers, first, dense = featurize(b.column(text_col))
            tail = m.tails(score(m, numbers, first, dense))[:, top - 1]
            yield b.filter(pa.array((tail >= least) & (np.diff(first) > 0)))

    return docs.select(*names).mapInArrow(run, docs.schema)


def grades_of_labels(labels: DataFrame) -> DataFrame:
    """``(id, grade)`` of the labels table: a point for quality and one for not being toxic, 0 to 2 in all."""
    return labels.select(F.col("doc_id").cast("long").alias("id"), (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade"))
