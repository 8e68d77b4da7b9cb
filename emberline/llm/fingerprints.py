"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs.

A text is cut into pieces: at line ends, and after words whose hash says so (one in ``PIECE_WORDS``), so
that an edit changes the pieces it touches and no others. Every piece becomes a 64-bit digest; a
repeated one is told apart by its occurrence number. A sketch is a table of cells, each with a count,
the XOR of its digests and the XOR of their checks; a digest goes to one cell of each third of the table.

Two versions are compared by subtracting their tables: what they share cancels out, and peeling cells
that hold one digest recovers the digests that differ, with their side. When peeling gets stuck, the
comparison is done again with four times the cells, until all differing digests are known. All
comparisons of a batch are peeled in step, in numpy.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.tokens import SLICE_BYTES, mix, prefix_sums, span_hashes, words
from emberline.storage import materialize

CELLS = 21  # of a fingerprint; three thirds
PIECE_WORDS = 8
_THIRDS = 3
_SALTS = np.array([0x9AE16A3B2F90404F, 0xC949D7C7509E6557, 0xB492B66FBE98F273], dtype=np.uint64)
_CHECK = np.uint64(0x2545F4914F6CDD1D)
_AGAIN = np.uint64(0xD6E8FEB86659FD93)


def _check(keys: np.ndarray) -> np.ndarray:
    return mix(keys ^ _CHECK) & np.uint64(0xFFFFFFFF)


def digests(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct piece digests of every text, text after text, and where each text's begin (one more than texts)."""
    w = words(texts)
    n = len(w.first) - 1
    if not len(w.starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    lines = np.append(0, np.cumsum(w.buf == 10))
    sums = prefix_sums(w.buf)
    close = span_hashes(sums, w.starts, w.ends) % np.uint64(PIECE_WORDS) == 0
    close[:-1] |= lines[w.starts[1:]] > lines[w.ends[:-1]]
    close[w.first[1:][w.counts > 0] - 1] = True
    last = np.flatnonzero(close)
    begin = np.append(0, last[:-1] + 1)
    owner = w.text_of[begin]
    keys = span_hashes(sums, w.starts[begin], w.ends[last])
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))
    at = np.arange(len(keys))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    return mix(keys + nth.astype(np.uint64) * _AGAIN), np.searchsorted(owner, np.arange(n + 1))


@dataclass
class Cells:
    """Tables of ``size`` cells each, one after the other."""

    size: int
    count: np.ndarray
    key: np.ndarray
    check: np.ndarray

    @classmethod
    def empty(cls, tables: int, size: int) -> Cells:
        return cls(size, np.zeros(tables * size, np.int64), np.zeros(tables * size, np.uint64), np.zeros(tables * size, np.uint64))

    def add(self, table: np.ndarray, keys: np.ndarray, sign: np.ndarray) -> None:
        third = self.size // _THIRDS
        checks = _check(keys)
        for i in range(_THIRDS):
            at = table * self.size + i * third + (mix(keys ^ _SALTS[i]) % np.uint64(third)).astype(np.int64)
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, keys)
            np.bitwise_xor.at(self.check, at, checks)

    def strings(self, pieces: np.ndarray) -> list[str]:
        """Each table with its number of pieces, in base 64."""
        rows = len(pieces)
        parts = np.concatenate(
            [
                pieces.astype("<u4").reshape(rows, 1).view(np.uint8),
                self.count.astype("<i2").reshape(rows, self.size).view(np.uint8),
                self.key.astype("<u8").reshape(rows, self.size).view(np.uint8),
                self.check.astype("<u4").reshape(rows, self.size).view(np.uint8),
            ],
            axis=1,
        )
        return [base64.b64encode(r.tobytes()).decode() for r in parts]

    def minus(self, mine: np.ndarray, other: Cells, theirs: np.ndarray) -> Cells:
        """Differences of the tables ``mine`` and the tables ``theirs`` of another set."""

        def take(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
            return values.reshape(-1, self.size)[rows].reshape(-1)

        return Cells(self.size, take(self.count, mine) - take(other.count, theirs), take(self.key, mine) ^ take(other.key, theirs), take(self.check, mine) ^ take(other.check, theirs))

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Empties the tables as far as it goes: ``(table, digest, side)`` of what was found, and which tables are done."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(4 * self.size):
            at = np.flatnonzero(np.abs(self.count) == 1)
            at = at[_check(self.key[at]) == self.check[at]]
            third = self.size // _THIRDS
            home = (mix(self.key[at] ^ _SALTS[at % self.size // third]) % np.uint64(third)).astype(np.int64)
            at = at[home == at % third]
            if not len(at):
                break
            table, keys, sign = at // self.size, self.key[at], self.count[at]
            order = np.lexsort((keys, table))
            new = np.append(True, (np.diff(table[order]) != 0) | (keys[order][1:] != keys[order][:-1]))
            one = order[new]
            found.append((table[one], keys[one], sign[one]))
            self.add(table[one], keys[one], -sign[one])
        rest = ((self.count != 0) | (self.key != 0)).reshape(-1, self.size).any(axis=1)
        parts = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        return *parts, ~rest


def _gather(keys: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The digests of some texts, with the number of each text in ``rows``."""
    n = (first[1:] - first[:-1])[rows]
    at = np.repeat(first[:-1][rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return keys[at], np.repeat(np.arange(len(rows)), n)


@dataclass
class Sketched:
    """Texts of a batch with their digests and fingerprint tables."""

    keys: np.ndarray
    first: np.ndarray
    cells: Cells

    @classmethod
    def of(cls, texts: pa.Array, size: int = CELLS) -> Sketched:
        keys, first = digests(texts)
        cells = Cells.empty(len(first) - 1, size)
        cells.add(np.repeat(np.arange(len(first) - 1), np.diff(first)), keys, np.ones(len(keys), np.int64))
        return cls(keys, first, cells)

    def strings(self) -> list[str]:
        return self.cells.strings(np.diff(self.first))


def differing(a: Sketched, rows_a: np.ndarray, b: Sketched, rows_b: np.ndarray) -> np.ndarray:
    """How many piece digests the texts of each pair do not share."""
    out = np.zeros(len(rows_a), np.int64)
    left = np.arange(len(rows_a))
    cells, size = a.cells.minus(rows_a, b.cells, rows_b), a.cells.size
    while len(left):
        table, _, _, done = cells.peel()
        n = np.bincount(table, minlength=len(left))
        out[left[done]] = n[done]
        left = left[~done]
        size *= 4
        cells = Cells.empty(len(left), size)
        for s, rows, sign in ((a, rows_a, 1), (b, rows_b, -1)):
            keys, owner = _gather(s.keys, s.first, rows[left])
            cells.add(owner, keys, np.full(len(keys), sign))
    return out


def likeness(a: Sketched, rows_a: np.ndarray, b: Sketched, rows_b: np.ndarray) -> np.ndarray:
    """Shared pieces as a part of all, 0 to 1; two texts without pieces are alike."""
    both = np.diff(a.first)[rows_a] + np.diff(b.first)[rows_b]
    return 1.0 - differing(a, rows_a, b, rows_b) / np.maximum(both, 1)


RESULT = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
RESULT_SCHEMA = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many, or all, of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def versions(texts: list[str], following: np.ndarray) -> list[pa.Array]:
    """Result columns of the first texts, as many as ``following`` has places of the text that comes after."""
    n = len(following)
    edited = [edit(texts[i], texts[j]) for i, j in enumerate(following)]
    own, new = (Sketched.of(pa.array([t.encode("utf-8", "surrogatepass") for t in x], pa.large_binary())) for x in (texts, edited))
    rows = np.arange(n)
    return [
        pa.array([len(t) for t in texts[:n]], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
        pa.array(own.strings()[:n], pa.string()),
        pa.array(new.strings(), pa.string()),
        pa.array(likeness(own, rows, new, rows), pa.float64()),
        pa.array(likeness(own, rows, own, following), pa.float64()),
    ]


def edited_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document, its fingerprint, and how alike its text is to an edit of it and to the next document.

    Documents stand by descending id (NULL last); the last is followed by the
    first, a single one by itself (equal ids stand by a hash of their texts). The edit takes its second half from the next document. NULL counts as
    the empty text. Texts move once, into ranges of ids; only the rows at the ranges' ends meet again.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=6)
        for b in batches:
            raw = [t.as_buffer() or pa.py_buffer(b"") for t in b.column("text").cast(pa.large_binary())]
            sizes = pa.array([r.size for r in raw], pa.int64())
            yield pa.record_batch([b.column("id"), b.column("tie"), sizes, pa.array([codec.compress(r, asbytes=True) for r in raw], pa.binary())], names=["id", "tie", "size", "zipped"])

    # texts cross the shuffle compressed one by one
    zipped = rows.withColumn("tie", F.xxhash64("text")).select("id", "tie", "text").mapInArrow(small, "id long, tie long, size long, zipped binary")
    order = [F.col("id").desc_nulls_last(), F.col("tie")]
    ranged = zipped.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=6)
        part = TaskContext.get().partitionId()
        ids: list = []
        texts: list[str] = []
        held, begun = 0, False

        def done() -> pa.RecordBatch:
            n = len(ids) - 1
            columns = versions(texts, np.arange(1, n + 1))
            return pa.record_batch([pa.array(["done"] * n), pa.array([part] * n, pa.int32()), pa.array(ids[:n], pa.int64()), pa.nulls(n, pa.string()), *columns], names=["kind", "part", "id", "text", *RESULT])

        def end(kind: str, i: int, t: str) -> pa.RecordBatch:
            return pa.record_batch([pa.array([kind]), pa.array([part], pa.int32()), pa.array([i], pa.int64()), pa.array([t]), *(pa.nulls(1, k) for k in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=["kind", "part", "id", "text", *RESULT])

        for b in batches:
            for i, size, z in zip(b.column("id").to_pylist(), b.column("size").to_pylist(), b.column("zipped")):
                t = codec.decompress(z.as_buffer(), size, asbytes=True).decode("utf-8", "surrogatepass")
                if not begun:
                    begun = True
                    yield end("head", i, t)
                ids.append(i)
                texts.append(t)
                held += len(t)
                if held > SLICE_BYTES // 2 and len(ids) > 1:
                    yield done()
                    ids, texts, held = ids[-1:], texts[-1:], len(texts[-1])
        if len(ids) > 1:
            yield done()
        if ids:
            yield end("tail", ids[-1], texts[-1])

    passed = materialize(ranged.mapInArrow(run, f"kind string, part int, id long, text string, {RESULT_SCHEMA}"), "versions")
    heads = passed.where("kind = 'head'").select("part", F.col("text").alias("following"))
    # one row for each range: which range comes after
    parts = heads.select("part")
    after = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy(F.lit(1)))).alias("next"))
    ends = passed.where("kind = 'tail'").select("part", "id", "text").join(after, "part").join(heads.withColumnRenamed("part", "next"), "next").select("id", "text", "following")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                both = b.column("text").to_pylist() + b.column("following").to_pylist()
                yield pa.record_batch([b.column("id"), *versions(both, np.arange(b.num_rows, 2 * b.num_rows))], names=["id", *RESULT])

    return passed.where("kind = 'done'").select("id", *RESULT).unionAll(ends.mapInArrow(meet, f"id long, {RESULT_SCHEMA}"))
