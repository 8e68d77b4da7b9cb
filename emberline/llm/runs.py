"""Periodic runs of words, by the branching-tandem test on an enhanced suffix array.

A run is a maximal stretch of words that repeats with a smallest period ``q``. Its last square (two
equal halves of ``q`` words) is the one that no shift to the right keeps: the two halves start with the same ``q`` words and
differ in the next, so that their suffixes lie in different children of the LCP interval of depth ``q``. So every run is found by
listing, for each interval, the suffixes ``i`` of all its children but the largest, and by looking up whether ``i + q`` or
``i - q`` lies in the interval, too (its rank between the interval's bounds, outside the child's). A square found so
is rotated to the left as long as the words agree, which gives the run; equal stretches are merged to the smallest period.

There is no tree: intervals are nearest smaller values of the LCP array, found for all positions at
once by climbing its table of minima. Suffixes are ranked by prefix doubling, all texts of a batch together;
the ranks of each doubling also give common prefixes and, backwards, the rotation.

Texts are rows of their own: nothing is shuffled, and no row depends on another one. A step holds about 2 MB of text, or one
longer text, at some 4 bytes for each word and doubling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.frames import run_starts
from emberline.llm.tokens import mix, slices, words

LEAST_WORDS = 6
LEAST_EXPONENT = 4

_SALT = np.uint64(0x9E3779B97F4A7C15)


def ranked_suffixes(keys: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and their ranks by the first 1, 2, 4, ... keys; those of the last table are all different.

    A suffix goes from its place to ``end`` of it. Only suffixes that share their rank are ranked again.
    """
    n = len(keys)
    suffixes = np.argsort(keys, kind="stable")
    first = run_starts(keys[suffixes])
    size = np.diff(np.append(first, n))
    rank = np.empty(n, np.int64)
    rank[suffixes] = np.repeat(first, size)
    tables = [rank]
    slots = np.flatnonzero(np.repeat(size > 1, size))
    step = 1
    while len(slots):
        at = suffixes[slots]
        after = at + step
        inside = after < end[at]
        second = np.where(inside, rank[np.where(inside, after, 0)] + 1, 0)
        key = rank[at] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        suffixes[slots] = at
        first = run_starts(key)
        size = np.diff(np.append(first, len(key)))
        rank = rank.copy()
        rank[at] = np.repeat(slots[first], size)
        tables.append(rank)
        slots = slots[np.repeat(size > 1, size)]
        step *= 2
    return suffixes, tables


def common_prefix(tables: list[np.ndarray], a: np.ndarray, b: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many keys agree from ``a`` and from ``b`` (other places of the same text) on."""
    a, b = a.copy(), b.copy()
    begin = a.copy()
    last = len(tables[0]) - 1
    for j in range(len(tables) - 1, -1, -1):
        inside = np.maximum(a, b) < end
        same = inside & (tables[j][np.minimum(a, last)] == tables[j][np.minimum(b, last)])
        a += same << j
        b += same << j
    return a - begin


def common_suffix(tables: list[np.ndarray], a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """How many keys agree before ``a`` and before ``b`` (a later place of the same text), at most back to ``start``."""
    a, b = a.copy(), b.copy()
    begin = a.copy()
    for j in range(len(tables) - 1, -1, -1):
        inside = a - (1 << j) >= start
        same = inside & (tables[j][np.maximum(a - (1 << j), 0)] == tables[j][np.maximum(b - (1 << j), 0)])
        a -= same << j
        b -= same << j
    return begin - a


def minima(values: np.ndarray) -> list[np.ndarray]:
    """Minima of 1, 2, 4, ... neighbours."""
    out = [values]
    while len(out[-1]) > 1:
        v = out[-1]
        if len(v) % 2:
            v = np.append(v, np.iinfo(v.dtype).max)
        out.append(np.minimum(v[::2], v[1::2]))
    return out


def nearest_below(table: list[np.ndarray], at: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """The last place before each ``at`` with a value under ``bound``; there must be one."""
    n = len(at)
    level, node = np.zeros(n, np.int64), at.copy()
    todo = np.arange(n)
    for j in range(len(table)):
        if not len(todo):
            break
        here = node[todo]
        found = (here & 1).astype(bool)
        found[found] = table[j][here[found] - 1] < bound[todo[found]]
        level[todo[found]] = j
        node[todo[found]] -= 1
        todo = todo[~found]
        node[todo] >>= 1
    for j in range(int(level.max(initial=0)), 0, -1):
        down = np.flatnonzero(level >= j)
        right = 2 * node[down] + 1
        low = right < len(table[j - 1])
        low[low] = table[j - 1][right[low]] < bound[down[low]]
        node[down] = right - ~low
    return node


def small_children(lcp: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Children, all but a largest one, of the LCP intervals of at least ``least`` suffixes.

    ``lcp[k]`` belongs to the suffixes ``k - 1`` and ``k``; it begins and ends with a zero. Returned
    are depth, interval and child, both with the place after their last.
    """
    at = np.flatnonzero(lcp > 0)
    if not len(at):
        return (at,) * 5
    # zeros but one between two stretches say nothing
    keep = np.zeros(len(lcp), bool)
    keep[at] = keep[at - 1] = keep[at + 1] = True
    places = np.flatnonzero(keep)
    values = lcp[places]
    own = np.flatnonzero(values > 0)
    depth = values[own]
    forth, back, n = minima(values), minima(values[::-1].copy()), len(values)
    low = places[nearest_below(forth, own, depth)]
    high = places[n - 1 - nearest_below(back, n - 1 - own, depth)]
    big = high - low >= least
    own, depth, low, high = own[big], depth[big], low[big], high[big]
    left = places[nearest_below(forth, own, depth + 1)]
    right = places[n - 1 - nearest_below(back, n - 1 - own, depth + 1)]
    at = places[own]
    leftmost = left == low
    depth, low, high = (np.append(x, x[leftmost]) for x in (depth, low, high))
    begin, stop = np.append(at, low[: len(at)][leftmost]), np.append(right, at[leftmost])
    by = np.lexsort((begin - stop, depth, low))  # the largest child of an interval comes first
    depth, low, high, begin, stop = (x[by] for x in (depth, low, high, begin, stop))
    rest = np.ones(len(by), bool)
    rest[run_starts(low, depth)] = False
    return tuple(x[rest] for x in (depth, low, high, begin, stop))


def runs_of(keys: np.ndarray, first: np.ndarray, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> tuple[np.ndarray, ...]:
    """Runs of all texts, text ``t`` having the keys ``first[t]`` to ``first[t + 1]``: start, end (after the last key), period; by start and period."""
    none = np.zeros(0, np.int64)
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    if not len(keys):
        return none, none, none
    start, end = np.repeat(first[:-1], counts), np.repeat(first[1:], counts)
    # keys of different texts differ, so that intervals stay within a text
    suffixes, tables = ranked_suffixes(mix(keys + (text.astype(np.uint64) + np.uint64(1)) * _SALT), end)
    if len(tables) < 2:
        return none, none, none
    lcp = np.zeros(len(keys) + 1, np.int64)
    near = np.flatnonzero(tables[0][suffixes[1:]] == tables[0][suffixes[:-1]]) + 1
    lcp[near] = common_prefix(tables, suffixes[near - 1], suffixes[near], end[suffixes[near]])
    # the halves of a run of exponent e begin at e - 1 places of its period, and one more where it is not an integer
    depth, low, high, begin, stop = small_children(lcp, max(2, least_exponent))
    size = stop - begin
    fits = depth * least_exponent <= counts[text[suffixes[begin]]] if len(begin) else none.astype(bool)
    depth, low, high, begin, stop, size = (x[fits] for x in (depth, low, high, begin, stop, size))
    child = np.repeat(np.arange(len(size)), size)
    slot = np.arange(len(child)) - np.repeat(np.cumsum(size) - size, size) + begin[child]
    at, rank = suffixes[slot], tables[-1]
    d = depth[child]
    squares = []
    for other in (at + d, at - d):
        ok = (other >= start[at]) & (other < end[at])
        r = rank[np.where(ok, other, 0)]
        c = child
        ok &= (r >= low[c]) & (r < high[c]) & ((r < begin[c]) | (r >= stop[c]))
        squares.append((np.minimum(at, other)[ok], d[ok]))
    at, d = (np.concatenate(x) for x in zip(*squares))
    ok = at - (least_exponent - 2) * d >= start[at]
    at, d = at[ok], d[ok]
    rotated = common_suffix(tables, at, at + d, start[at])
    begin, stop = at - rotated, at + 2 * d
    ok = stop - begin >= np.maximum(least_words, least_exponent * d)
    begin, stop, d = begin[ok], stop[ok], d[ok]
    by = np.lexsort((d, stop, begin))
    begin, stop, d = begin[by], stop[by], d[by]
    least = run_starts(begin, stop)
    begin, stop, d = begin[least], stop[least], d[least]
    by = np.lexsort((d, begin))
    return begin[by], stop[by], d[by]


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """``(id, n_words, runs, collapsed)`` for each row: its runs by start, then period, and its words without their repetitions.

    A run has at least ``least_words`` words and ``least_exponent`` times its period, which is 2 at least; places count words from 0. ``collapsed``
    joins by one space the words that no run contains after its first period. NULL, empty and blank texts have no words, no runs
    and an empty ``collapsed``. Rows do not depend on each other: repeated ids are rows of their own, a NULL id stays NULL, and other columns do not matter.
    """
    if least_exponent < 2:
        raise ValueError("a run has two periods at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = words(b.column("text"))
            begin, stop, period = runs_of(w.hashes(lower=False), w.first, least_words, least_exponent)
            gone = np.zeros(len(w.starts) + 1, np.int64)
            np.add.at(gone, begin + period, 1)
            np.add.at(gone, stop, -1)
            kept = np.cumsum(gone[:-1]) == 0
            of = np.searchsorted(begin, w.first)
            texts = []
            for t, value in enumerate(b.column("text")):
                own = value.as_buffer().to_pybytes().split() if value.is_valid else []
                if of[t + 1] > of[t]:
                    own = [own[i] for i in np.flatnonzero(kept[w.first[t] : w.first[t + 1]]).tolist()]
                texts.append(b" ".join(own))
            shift = np.repeat(w.first[:-1], np.diff(of))
            items = pa.StructArray.from_arrays([pa.array(begin - shift), pa.array(stop - begin), pa.array(period)], fields=list(_RUN))
            yield pa.record_batch(
                [b.column("id"), pa.array(w.counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), items), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["id", "n_words", "runs", "collapsed"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id long, n_words long, runs {RUNS}, collapsed string")
