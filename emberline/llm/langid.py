"""Language identification by a byte convolutional network, in numpy.

A window of ``WINDOW`` bytes is a sequence of byte classes (lower-cased letters, the low five bits of
bytes above 0x7F, space, the rest of ASCII). Filters of widths 2, 3 and 4 slide over it; a filter's
output is a sum of one weight for each of its positions and the class found there. The largest output of a filter
in the window goes through a rectifier into a softmax over the languages. A text is cut
into windows that cover all of it, in equal steps; their log probabilities are averaged.

Training takes stochastic gradient steps (Adam) on windows drawn from a bounded sample of the
labelled rows (``FIT_TEXTS``, ``FIT_WINDOWS`` each). Filters pass their gradient to the place of the maximum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.tokens import LOWER, slices, text_buffer

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 16  # of each width
FIT_TEXTS = 6_000
FIT_WINDOWS = 4
_PAD = max(WIDTHS) - 1

_CLASS = np.zeros(256, dtype=np.uint8)  # 0: marks, digits and what else is in ASCII
_CLASS[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CLASS[LOWER != np.arange(256)] = np.arange(1, 27)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 27
_CLASS[0x80:] = 28 + np.arange(128) % 32
CLASSES = 60


@dataclass
class Net:
    langs: list[str]
    filters: dict[int, np.ndarray]  # by width: (width, CLASSES, FILTERS)
    shift: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    pairs: list[np.ndarray] = field(default_factory=list)

    def tables(self) -> list[np.ndarray]:
        """Weights of neighbouring positions added up for each pair of classes: half the look-ups.

        One table for the width of two; for the others one of the first two positions and one of the rest.
        """
        if not self.pairs:

            def both(f: np.ndarray, i: int) -> np.ndarray:
                second = f[i + 1][None, :, :] if i + 1 < len(f) else 0
                return (f[i][:, None, :] + second + np.zeros((CLASSES, CLASSES, 1))).reshape(CLASSES * CLASSES, -1)

            wide = [self.filters[w] for w in WIDTHS[1:]]
            joined = [both(self.filters[WIDTHS[0]], 0), *(np.concatenate([both(f, i) for f in wide], axis=1) for i in (0, 2))]
            self.pairs = [t.astype(np.float32) for t in joined]
        return self.pairs

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Largest output of each filter for windows of classes ``x`` (n, WINDOW + _PAD); positions lead, so that rows stay long."""
        two, head, tail = self.tables()
        across = np.ascontiguousarray(x.T).astype(np.intp)
        pair = across[:-1] * CLASSES + across[1:]
        narrow = np.take(two, pair[:WINDOW], axis=0)
        wide = np.take(head, pair[:WINDOW], axis=0)
        wide += np.take(tail, pair[2 : WINDOW + 2], axis=0)
        return np.concatenate([narrow.max(axis=0), wide.max(axis=0)], axis=1)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(self.pooled(x) + self.shift, 0) @ self.out + self.bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def windows(lengths: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where windows begin, and each one's text: the fewest that cover a text, in equal steps; one for a short text."""
    n = np.maximum(-(-lengths // WINDOW), 1)
    owner = np.repeat(np.arange(len(lengths)), n)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    room = np.maximum(lengths - WINDOW, 0)[owner]
    return offsets[:-1][owner] + within * room // np.maximum(n[owner] - 1, 1), owner


def classes_at(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Byte classes of windows; what lies beyond the text's end counts as a space."""
    at = starts[:, None] + np.arange(WINDOW + _PAD)[None, :]
    x = _CLASS[buf[np.minimum(at, max(len(buf) - 1, 0))]] if len(buf) else np.full(at.shape, 27, np.uint8)
    x[at >= ends[:, None]] = 27
    return x


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], steps: int = 1200, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Net:
    """Adam on the cross entropy. Languages are drawn evenly, whatever their counts."""
    rng = np.random.default_rng(seed)
    k = len(langs)
    total = FILTERS * len(WIDTHS)
    net = Net(
        langs,
        {w: rng.normal(0, 0.5 / w, (w, CLASSES, FILTERS)) for w in WIDTHS},
        np.zeros(total),
        rng.normal(0, 0.3, (total, k)),
        np.zeros(k),
    )
    params = [*net.filters.values(), net.shift, net.out, net.bias]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    of_lang = [np.flatnonzero(y == i) for i in range(k)]
    lane = np.arange(FILTERS)
    for step in range(1, steps + 1):
        lang = rng.integers(0, k, batch)
        pick = np.array([of_lang[i][rng.integers(0, len(of_lang[i]))] for i in lang])
        xb = x[pick].astype(np.int64)
        peaks, best = [], []
        for w, f in net.filters.items():
            a = sum(f[i].astype(np.float32)[xb[:, i : WINDOW + i]] for i in range(w))
            place = a.argmax(axis=1)
            best.append(place)
            peaks.append(np.take_along_axis(a, place[:, None, :], axis=1)[:, 0, :])
        h = np.concatenate(peaks, axis=1) + net.shift
        r = np.maximum(h, 0)
        z = r @ net.out + net.bias
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        dz = p
        dz[np.arange(batch), lang] -= 1
        dz /= batch
        dh = (dz @ net.out.T) * (h > 0)
        grads = []
        for j, (w, f) in enumerate(net.filters.items()):
            g = np.zeros_like(f)
            d = dh[:, j * FILTERS : (j + 1) * FILTERS]
            for i in range(w):
                np.add.at(g[i], (xb[np.arange(batch)[:, None], best[j] + i], lane[None, :]), d)
            grads.append(g)
        grads += [dh.sum(axis=0), r.T @ dz + 1e-4 * net.out, dz.sum(axis=0)]
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for q, g, m, v in zip(params, grads, first, second):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            q -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    net.shift, net.out, net.bias = (a.astype(np.float32) for a in (net.shift, net.out, net.bias))
    return net


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_texts: int = FIT_TEXTS, fit_windows: int = FIT_WINDOWS) -> Net | None:
    """Fit on about ``fit_texts`` rows at most, chosen by a hash of the id, ``fit_windows`` windows of each.

    Rows with a NULL text or language or without a letter are not learned from. None when nothing is left.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = rows.count()
    if not n:
        return None
    rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int(min(1.0, fit_texts / n) * (1 << 30)))).where(F.col("text").rlike(r"\p{L}"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            buf, offsets = text_buffer(b.column("text"))
            starts, owner = windows(np.diff(offsets), offsets)
            first = np.searchsorted(owner, np.arange(b.num_rows + 1))
            chosen = np.concatenate([np.unique(np.linspace(a, e - 1, fit_windows).astype(np.int64)) for a, e in zip(first[:-1], first[1:])])
            x = classes_at(buf, starts[chosen], offsets[1:][owner[chosen]])
            yield pa.record_batch([b.column("id").take(pa.array(owner[chosen])), b.column("lang").take(pa.array(owner[chosen])), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "lang", "x"])

    got = rows.mapInArrow(draw, "id string, lang string, x binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r.id or "", r.lang, bytes(r.x)))
    langs = sorted({r.lang for r in got})
    x = np.stack([np.frombuffer(r.x, np.uint8) for r in got])
    return fit(x, np.array([langs.index(r.lang) for r in got]), langs)


def predict(docs: DataFrame, net: Net | None, id_col: str = "doc_id", text_col: str = "text", unknown: str = "und", step: int = 32) -> DataFrame:
    """``(id, lang_pred, score)`` for every row: the likeliest language and its probability.

    A text that is NULL or has no letter gets ``unknown`` and score 0, and so does every text without a net.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a fixed number of weights for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in slices(batches, "text"):
            buf, offsets = text_buffer(b.column("text"))
            letters = np.array(b.column("letters").to_numpy(zero_copy_only=False), dtype=bool)
            names = np.full(b.num_rows, unknown, dtype=object)
            score = np.zeros(b.num_rows)
            if model is not None and letters.any():
                starts, owner = windows(np.diff(offsets), offsets)
                sums = np.zeros((b.num_rows, len(model.langs)))
                for at in range(0, len(starts), step):
                    s = slice(at, at + step)
                    np.add.at(sums, owner[s], model.log_probabilities(classes_at(buf, starts[s], offsets[1:][owner[s]])))
                mean = sums / np.bincount(owner, minlength=b.num_rows)[:, None]
                p = np.exp(mean - mean.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                names[letters] = np.array(model.langs, dtype=object)[best[letters]]
                score[letters] = np.clip(p[np.arange(len(p)), best][letters], 0, 1)
            yield pa.record_batch([b.column("id"), pa.array(names, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, lang_pred string, score double")
