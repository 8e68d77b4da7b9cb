"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is contained in a document when at least ``share`` of its distinct word shingles occur in
it. Items are partitioned by their number of shingles (powers of two), since a short item inside a
long document has a low Jaccard similarity but may be contained whole: how many MinHash values an
item needs depends on its size alone, not on the document's. An item of ``n`` shingles is sketched by
its ``n - ceil(share n) + 1`` smallest hashes; a document that contains the item has one of them at
least, so no contained item is missed. Documents with a sketch hash are candidates, and each is
verified on the shingle strings themselves.

Items are searched in blocks of at most ``BLOCK_VALUES`` shingles, whose sketches are broadcast; more
items mean more blocks, each against all documents. An item of fewer words than a shingle
is its whole word sequence, found only where a document is that very sequence.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.tokens import LOWER, inside_text, mix, rolling, slices, words

BLOCK_VALUES = 1_000_000
_LOWER = bytes(LOWER)
_SHORT = np.uint64(0xA5A5A5A5DEADBEEF)


def shingle_hashes(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle and the text it belongs to, in order. A shorter text is one shingle; an empty one has none."""
    w = words(texts)
    h = w.hashes()
    at = inside_text(w, size)
    text_of = w.text_of
    full, owner = rolling(h, size)[at] if len(at) else np.zeros(0, np.uint64), text_of[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    if len(short):
        whole = np.array([_sequence(h[w.first[t] : w.first[t + 1]]) for t in short], dtype=np.uint64)
        full, owner = np.concatenate([full, whole]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        full, owner = full[order], owner[order]
    return full, owner


def _sequence(h: np.ndarray) -> np.uint64:
    return mix(rolling(h, len(h)) ^ _SHORT)[0]


def shingles(text: bytes, size: int) -> set[bytes]:
    """The distinct shingles themselves, lower-cased and joined by one space."""
    found = text.translate(_LOWER).split()
    if len(found) < size:
        return {b"\n" + b" ".join(found)} if found else set()
    return set(map(b" ".join, zip(*(found[i:] for i in range(size)))))


class Sketches:
    """Items of one block: sorted sketch hashes with their items, by size class, and the items' shingles."""

    def __init__(self, items: list[tuple[int, bytes]], size: int, share: float):
        self.size, self.share = size, share
        self.shingles = [shingles(text, size) for _, text in items]
        self.ids = [i for i, _ in items]
        by_class: dict[int, list[tuple[int, int]]] = defaultdict(list)
        hashes, owner = shingle_hashes(pa.array([t for _, t in items], pa.large_binary()), size)
        starts = np.searchsorted(owner, np.arange(len(items) + 1))
        for i in range(len(items)):
            own = np.unique(hashes[starts[i] : starts[i + 1]])
            if len(own):
                needed = len(own) - self.least(len(own)) + 1
                by_class[len(own).bit_length()] += [(int(h), i) for h in own[:needed]]
        self.classes = []
        for _, pairs in sorted(by_class.items()):
            pairs.sort()
            self.classes.append((np.array([h for h, _ in pairs], dtype=np.uint64), np.array([i for _, i in pairs])))

    def least(self, n: int) -> int:
        """Shingles of ``n`` that must occur."""
        return max(1, math.ceil(self.share * n - 1e-9))

    def candidates(self, hashes: np.ndarray, owner: np.ndarray) -> set[tuple[int, int]]:
        """``(text, item)`` pairs with a sketch hash in common."""
        out: set[tuple[int, int]] = set()
        for values, item in self.classes:
            lo = np.searchsorted(values, hashes)
            hit = np.flatnonzero(values[np.minimum(lo, len(values) - 1)] == hashes)
            for j in hit:
                at = int(lo[j])
                while at < len(values) and values[at] == hashes[j]:
                    out.add((int(owner[j]), int(item[at])))
                    at += 1
        return out


def _blocks(items: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of about ``limit`` words, one block at a time on the driver."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).where("text IS NOT NULL")
    block, held = [], 0
    for r in rows.distinct().sort("id", "text").toLocalIterator():
        text = bytes(r.text)
        n = len(text.split())
        if block and held + n > limit:
            yield block
            block, held = [], 0
        block.append((r.id, text))
        held += n
    if block:
        yield block


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    size: int = 5,
    share: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """``(id, item_id, containment)`` for every document and item it contains.

    NULL and empty texts and items contain nothing and are contained nowhere. Repeated documents and
    ids give repeated rows, once for each document row. With no items or documents the result is empty.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, item_id long, containment double"
    out = spark.createDataFrame([], schema)

    def search(sketches):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = sketches.value
            for b in slices(batches, "text"):
                found: list[tuple] = []
                texts = b.column("text")
                last, own = -1, set()
                for t, i in sorted(s.candidates(*shingle_hashes(texts, s.size))):
                    if t != last:
                        last, own = t, shingles(texts[t].as_buffer().to_pybytes(), s.size)
                    n = len(s.shingles[i])
                    common = len(s.shingles[i] & own)
                    if common >= s.least(n):
                        found.append((b.column("id")[t].as_py(), s.ids[i], common / n))
                ids, item, value = zip(*found) if found else ((), (), ())
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(item, pa.int64()), pa.array(value, pa.float64())], names=["id", "item_id", "containment"])

        return run

    for block in _blocks(items, item_id, item_text, block_values):
        sketches = spark.sparkContext.broadcast(Sketches(block, size, share))
        out = out.unionAll(source.mapInArrow(search(sketches), schema))
    return out


def without_contaminated(docs: DataFrame, items: DataFrame, size: int = 5, share: float = 0.8, text_col: str = "text", block_values: int = BLOCK_VALUES, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item. Nothing is joined: rows may repeat or lack an id."""
    spark = docs.sparkSession

    def clean(sketches):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = sketches.value
            for b in slices(batches, text_col):
                keep = np.ones(b.num_rows, dtype=bool)
                texts = b.column(text_col)
                for t, i in sorted(s.candidates(*shingle_hashes(texts, s.size))):
                    if keep[t]:
                        own = shingles(texts[t].as_buffer().to_pybytes(), s.size)
                        keep[t] = len(s.shingles[i] & own) < s.least(len(s.shingles[i]))
                yield b.filter(pa.array(keep))

        return run

    for block in _blocks(items, item_id, item_text, block_values):
        docs = docs.mapInArrow(clean(spark.sparkContext.broadcast(Sketches(block, size, share))), docs.schema)
    return docs
