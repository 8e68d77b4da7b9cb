"""Suffix-array dedup: bytes covered by strings of ``span`` bytes that an earlier document has, too.

Suffixes are sorted only where it matters and where equal ones meet. Every window of ``span`` bytes is
filed under its minimizer, the smallest hash among its strings of ``SEED`` bytes; neighbouring windows
mostly share it and travel as one string. Equal windows have equal minimizers, so

1. minimizers are counted: those of one document only can't be part of a repeat and go;
2. the strings of the others are gathered by minimizer (equal strings of a block of documents
   once, with the smallest document), and their suffixes are put in order; the previous and the next
   smaller document in suffix order, with the shortest common prefix on the way, give the longest
   previous factor of every suffix; one of ``span`` bytes or more marks a repeat;
3. the marked bytes are cut out of each document.

A minimizer with very many strings (``HOT``) has each window filed under the window's own hash instead, so
that a common passage with varying surroundings is no single group. Documents are shuffled once,
into blocks of about ``BLOCK_BYTES``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.frames import block_of, equal_runs, packed_by, run_starts, unpacked
from emberline.llm.tokens import mix, prefix_sums, slices, span_hashes, text_buffer

SPAN = 50
SEED = 20
BLOCK_BYTES = 8 << 20
HOT = 4096
STEP_ROWS = 1 << 15
STEP_BYTES = 1 << 20
_LOW = np.uint64((1 << 31) - 1)
_OTHER = np.uint64(0x5851F42D4C957F2D)


def super_strings(buf: np.ndarray, offsets: np.ndarray, span: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimizer: its hash, the first and last window start, and the text."""
    none = np.zeros(0, np.int64)
    n = len(buf) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), none, none, none
    sums = prefix_sums(buf)
    at = np.arange(len(buf) - seed + 1)
    h = span_hashes(sums, at, at + seed)
    order = (h & ~_LOW) | at.astype(np.uint64)  # a tie goes to the left
    width, have = span - seed + 1, 1
    low = order
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    place = (low & _LOW).astype(np.int64)
    bad = np.zeros(len(buf) + 1, np.int32)
    ends = offsets[1:]
    np.add.at(bad, np.maximum(ends - span + 1, offsets[:-1]), 1)
    np.add.at(bad, ends, -1)
    valid = np.cumsum(bad[:n]) == 0
    change = np.ones(n, dtype=bool)
    change[1:] = (place[1:] != place[:-1]) | ~valid[:-1]
    first = np.flatnonzero(change & valid)
    if not len(first):
        return np.zeros(0, np.uint64), none, none, none
    stop = np.flatnonzero(valid & np.append(change[1:] | ~valid[1:], True))
    return h[place[first]], first, stop, np.searchsorted(offsets, first, side="right") - 1


def longest_previous(order: np.ndarray, lcp: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Longest prefix that each suffix shares with one of a smaller document.

    ``order`` lists the suffixes in order, ``lcp[i]`` is the common prefix of its i-th and the one before.
    The previous and the next smaller document are found by jumping over all that are not smaller; the
    shortest common prefix on the way is what is shared with it.
    """
    n = len(order)
    value = doc[order]
    best = np.zeros(n, np.int64)
    for forward in (False, True):
        v = value[::-1] if forward else value
        # shared[i]: common prefix of i and i - 1 in this direction
        shared = np.append(0, lcp[1:][::-1]) if forward else np.append(0, lcp[1:])
        to, way = np.arange(n) - 1, shared.astype(np.int64)
        active = np.flatnonzero(to >= 0)
        while len(active):
            active = active[(way[active] > 0) & (v[to[active]] >= v[active])]
            j = to[active]
            # where j itself has nothing left to jump to, neither has i
            next_to, next_way = to[j], np.minimum(way[active], way[j])
            next_way[next_to < 0] = 0
            to[active], way[active] = next_to, next_way
            active = active[next_to >= 0]
        found = np.where((to >= 0) & (v[np.maximum(to, 0)] < v), way, 0)
        best = np.maximum(best, found[::-1] if forward else found)
    out = np.empty(n, np.int64)
    out[order] = best
    return out


def suffix_order(buf: np.ndarray, starts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` by their first ``span`` bytes, and common prefixes of neighbours in
    steps of 8, exact at ``span``. Ties are refined word by word, among themselves only."""
    padded = np.append(buf, np.zeros(8, np.uint8)).astype(np.uint64)
    word = padded[:-1] << np.uint64(8) | padded[1:]
    word = word[:-2] << np.uint64(16) | word[2:]
    word = word[:-4] << np.uint64(32) | word[4:]
    n = len(starts)
    order = np.argsort(word[starts], kind="stable")
    lcp = np.zeros(n, np.int64)
    key = word[starts[order]]
    tied = np.append(False, key[1:] == key[:-1])  # with the one before
    lcp[tied] = 8
    for depth in [*range(8, span - 8, 8), span - 8]:
        rows = np.flatnonzero(tied | np.append(tied[1:], False))
        if not len(rows):
            break
        group = np.cumsum(~tied[rows])
        key = word[starts[order[rows]] + depth]
        inner = np.lexsort((key, group))
        order[rows] = order[rows][inner]
        same = np.append(False, (key[inner][1:] == key[inner][:-1]) & (group[1:] == group[:-1]))
        tied[:] = False
        tied[rows] = same
        lcp[rows[same]] = depth + 8
    return order, lcp


def _identity(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
    """128 bits that stand for byte strings: the second word has each string's length and another mixing."""
    out = np.empty((len(starts), 2), np.uint64)
    out[:, 0] = span_hashes(sums, starts, ends)
    middle = starts + (ends - starts) // 2
    out[:, 1] = mix(span_hashes(sums, starts, middle) * _OTHER ^ (ends - starts).astype(np.uint64)) ^ span_hashes(sums, middle, ends) ^ h
    return out


def _rest(strings: list[bytes]) -> pa.Array:
    return pa.array(strings, pa.binary())


def merged(doc: np.ndarray, at: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one document that follow each other made one."""
    if not len(doc):
        return doc, at, windows
    by = np.lexsort((at, doc))
    doc, at, windows = doc[by], at[by], windows[by]
    new = np.append(True, (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + windows[:-1]))[: len(doc)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], at[first], at[last] + windows[last] - at[first]


_FILED = "part int, filed binary"
_ROWS = ["key", "doc", "at", "windows", "string"]


def _filed(key, doc, at, windows, string) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.asarray(x).astype(np.int64)) for x in (key, doc, at, windows)] + [string], names=_ROWS)


def repeats(docs: DataFrame, n_blocks: int, span: int = SPAN, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """``(block, doc, at, windows)``: windows at ``at`` to ``at + windows - 1`` of ``doc`` also start in an earlier document.

    ``docs(block, docs)`` has packed ``(doc, text)`` rows, each in the block that a hash of ``doc`` gives it among ``n_blocks``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a document lies in one slice, so two rows with a seed are of two documents; one with a negative block is, too
        for batch in batches:
            for block, value in zip(batch.column("block").to_pylist(), batch.column("docs")):
                for b in slices(unpacked([value]), "text", STEP_BYTES):
                    h, _, _, text = super_strings(*text_buffer(b.column("text")), span, seed)
                    by = np.argsort(h, kind="stable")
                    h, text = h[by], text[by]
                    first = run_starts(h)
                    last = np.append(first[1:], len(h)) - 1
                    where = np.where(text[first] != text[last[: len(first)]], -1 - block, block) if len(h) else first
                    yield pa.record_batch([pa.array(h[first].view(np.int64)), pa.array(where.astype(np.int32))], names=["seed", "block"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in equal_runs(batches, ["seed"], 1 << 18):
            h, block = t.column("seed").to_numpy(), t.column("block").to_numpy()
            first = run_starts(h)
            size = np.diff(np.append(first, len(h)))
            several = (size > 1) | (np.minimum.reduceat(block, first) < 0)
            rows = np.repeat(several, size)
            yield pa.record_batch([pa.array(h[rows]), pa.array(np.where(block < 0, -1 - block, block)[rows]), pa.array(np.repeat(size > hot, size)[rows])], names=["seed", "block", "hot"])

    counted = docs.mapInArrow(count, "seed long, block int")
    wanted = counted.repartition("seed").sortWithinPartitions("seed").mapInArrow(shared, "seed long, block int, hot boolean")

    def file(left: pa.Table, right: pa.Table) -> pa.Table:
        seeds = right.column("seed").to_numpy().view(np.uint64)
        by = np.argsort(seeds)
        seeds, is_hot = seeds[by], np.array(right.column("hot").to_numpy(), dtype=bool)[by]
        nothing = pa.table([pa.array([], pa.int32()), pa.array([], pa.binary())], names=["part", "filed"])
        held: list[tuple] = []
        for b in slices(unpacked(left.column("docs")), "text", STEP_BYTES) if len(seeds) else ():
            buf, offsets = text_buffer(b.column("text"))
            h, first, stop, text = super_strings(buf, offsets, span, seed)
            if not len(h):
                continue
            at = np.minimum(np.searchsorted(seeds, h), len(seeds) - 1)
            use = seeds[at] == h
            h, first, stop, text, heat = h[use], first[use], stop[use], text[use], is_hot[at[use]]
            many = np.repeat(np.arange(len(h)), np.where(heat, stop - first + 1, 1))
            step = np.arange(len(many)) - np.repeat(np.cumsum(np.where(heat, stop - first + 1, 1)) - np.where(heat, stop - first + 1, 1), np.where(heat, stop - first + 1, 1))
            h, heat, text = h[many], heat[many], text[many]
            start = np.where(heat, first[many] + step, first[many])
            end = np.where(heat, start, stop[many]) + span
            sums = prefix_sums(buf)
            name = _identity(sums, start, end, h)
            key = np.where(heat, name[:, 0], h)
            held.append((key, name[:, 0], name[:, 1], b.column("doc").to_numpy()[text], start - offsets[text], end - start - span + 1, start, end, np.full(len(h), len(held)), buf))
        if not held:
            return nothing
        key, n0, n1, doc, at, windows, start, end, piece = (np.concatenate([x[i] for x in held]) for i in range(9))
        by = np.lexsort((at, doc, n1, n0))
        first = run_starts(n0[by], n1[by])
        least = np.repeat(doc[by][first], np.diff(np.append(first, len(by))))
        later = doc[by] != least
        gone, send = by[later], by[~later]
        # of equal strings of one block those of the first document wait for an answer, the others have theirs
        found = merged(doc[gone], at[gone], windows[gone])
        rows = [_filed(np.zeros(len(found[0])), *found, pa.nulls(len(found[0]), pa.binary()))]
        strings = [held[p][9][a:e].tobytes() for p, a, e in zip(piece[send], start[send], end[send])]
        rows.append(_filed(key[send].view(np.int64), doc[send], at[send], windows[send], _rest(strings)))
        part = np.concatenate([found[0].view(np.uint64) % np.uint64(n_blocks), mix(key[send].copy()) % np.uint64(n_blocks)]).astype(np.int32)
        parts, values = packed_by(part, pa.Table.from_batches(rows).combine_chunks().to_batches()[0])
        return pa.table([pa.array(parts), values], names=["part", "filed"])

    filed = docs.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(file, _FILED)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values in equal_runs(batches, ["part"], 1):
            t = pa.Table.from_batches(list(unpacked(values.column("filed")))).combine_chunks()
            if not t.num_rows:
                continue
            t = t.take(pa.array(np.argsort(t.column("key").to_numpy(), kind="stable")))
            # in runs of keys, so that the suffixes of one step are few
            key = t.column("key").to_numpy()
            cuts = run_starts(key)
            cuts = [*cuts[np.append(True, np.diff(cuts // STEP_ROWS) > 0)], len(key)]
            for a, e in zip(cuts[:-1], cuts[1:]):
                yield from settle(t.slice(a, e - a).combine_chunks())

    def settle(t: pa.Table) -> Iterator[pa.RecordBatch]:
        string = t.column("string").combine_chunks()
        known = np.array(string.is_null().to_numpy(zero_copy_only=False), dtype=bool)
        doc, at, windows = (t.column(c).to_numpy() for c in ("doc", "at", "windows"))
        yield _found(doc[known], at[known], windows[known])
        rows = np.flatnonzero(~known)
        if not len(rows):
            return
        buf, offsets = text_buffer(string.take(pa.array(rows)))
        doc, at, windows = doc[rows], at[rows], windows[rows]
        name = _identity(prefix_sums(buf), offsets[:-1], offsets[1:], np.zeros(len(rows), np.uint64))
        by = np.lexsort((doc, name[:, 1], name[:, 0]))
        first = run_starts(name[by, 0], name[by, 1])
        size = np.diff(np.append(first, len(by)))
        later = doc[by] != np.repeat(doc[by][first], size)
        whole = by[later]
        yield _found(doc[whole], at[whole], windows[whole])
        one = by[first]  # distinct strings with their smallest documents
        n = windows[one]
        owner = np.repeat(np.arange(len(one)), n)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        starts = offsets[:-1][one][owner] + step
        order, lcp = suffix_order(buf, starts, span)
        repeat = longest_previous(order, lcp, doc[one][owner]) >= span
        # the answer of a string holds for its equals in the same document
        same = np.repeat(np.arange(len(one)), size)[~later]
        mine = by[~later]
        n = windows[mine]
        who = np.repeat(np.arange(len(mine)), n)
        nth = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
        base = np.append(0, np.cumsum(windows[one]))[:-1]
        marked = repeat[base[same][who] + nth]
        edge = marked & ~np.append(False, marked[:-1] & (who[1:] == who[:-1]))
        close = marked & ~np.append(marked[1:] & (who[1:] == who[:-1]), False)
        a, e = np.flatnonzero(edge), np.flatnonzero(close)
        yield _found(doc[mine][who[a]], at[mine][who[a]] + nth[a], e - a + 1)

    found = filed.repartition("part").sortWithinPartitions("part").mapInArrow(decide, "doc long, at long, windows int")
    return found.withColumn("block", block_of("doc", n_blocks))


def _found(doc: np.ndarray, at: np.ndarray, windows: np.ndarray) -> pa.RecordBatch:
    doc, at, windows = merged(doc, at, windows)
    return pa.record_batch([pa.array(doc), pa.array(at), pa.array(windows.astype(np.int32))], names=["doc", "at", "windows"])


def without_repeats(docs: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256, kept)``: every text as UTF-8 bytes without what an earlier document has.

    A byte goes if a string of ``span`` bytes around it also starts in a document with a smaller id;
    strings are judged on the input. ``kept`` has the remaining bytes (cut points may split a character).
    NULL counts as the empty text; rows with one id are the same document and are taken to have one text; a
    NULL id comes before all others.
    """
    lowest = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("doc"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            blocks, values = packed_by(b.column("block").to_numpy(), b.select(["doc", "text"]))
            yield pa.record_batch([pa.array(blocks), values], names=["block", "docs"])

    rows = rows.select(block_of("doc", n).alias("block"), "doc", "text").mapInArrow(pack, "block int, docs binary").repartition("block")
    found = repeats(rows, n, span, seed, hot)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        doc = right.column("doc").to_numpy()
        by = np.lexsort((right.column("at").to_numpy(), doc))
        doc, at, windows = doc[by], right.column("at").to_numpy()[by], right.column("windows").to_numpy()[by]
        out: dict[str, list] = {k: [] for k in ("doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        whole = pa.Table.from_batches(list(unpacked(left.column("docs"))))
        ids = whole.column("doc").to_numpy()
        lo, hi = np.searchsorted(doc, ids), np.searchsorted(doc, ids, side="right")
        for i, text in enumerate(whole.column("text")):
            data = text.as_buffer().to_pybytes() if text.as_buffer() is not None else b""
            begin, end = at[lo[i] : hi[i]], at[lo[i] : hi[i]] + windows[lo[i] : hi[i]] + span - 1
            kept, spans, removed = data, 0, 0
            if len(begin):
                end = np.minimum(np.maximum.accumulate(end), len(data))
                new = np.append(True, begin[1:] > end[:-1])
                a, e = begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
                kept = b"".join(data[x:y] for x, y in zip([0, *e.tolist()], [*a.tolist(), len(data)]))
                spans, removed = len(a), int((e - a).sum())
            for k, v in zip(out, (int(ids[i]), len(data), removed, spans, hashlib.sha256(kept).hexdigest(), kept)):
                out[k].append(v)
        return pa.table([pa.array(out["doc"], pa.int64()), *(pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept"], pa.binary())], names=list(out))

    done = rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(cut, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done.select(F.when(F.col("doc") != lowest, F.col("doc")).alias("id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
