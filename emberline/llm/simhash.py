"""SimHash near-duplicates, compared on bit planes.

A document's fingerprint has a bit set where over half of its shingle hashes have it. Two
fingerprints link when they differ in at most ``radius`` bits. Eight bytes differ in at most
``radius`` places, so linked fingerprints agree on all bytes but ``radius`` of them: they meet
under one of the keys made by blanking that many bytes (28 keys for radius 2). A key's group has
at most 2**16 members for radius 2, whatever the number of documents, since all else is equal.

Inside a group, bit planes are stored vertically (word ``w`` of plane ``b`` holds bit ``b`` of 64
members), distances of a member to all others are counted by carry-save adders on whole words, and
a block of words is abandoned once every lane is past the radius. Only a spanning forest leaves a
group, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.decontam import shingle_hashes
from emberline.llm.frames import block_of, components, equal_runs, packed_by, run_starts, unpacked, unused
from emberline.llm.tokens import LOWER, mix, signed, slices
from emberline.storage import materialize

SEED = 42
_LOWER = bytes(LOWER)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, size: int = 3) -> int:
    """SimHash of the word shingles, repeats included; fewer words make one shingle, none give zero."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, SEED) for s in shingles], dtype=np.uint64)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``(id, fp)``: the 64 bits as a long. NULL and empty texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", size) for t in b.column("text")]
            yield pa.record_batch([b.column("id"), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["id", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "id long, fp long")


def planes(f: np.ndarray) -> np.ndarray:
    """Bit planes of the members: ``planes[b, w]`` has bit ``b`` of members 64 w to 64 w + 63."""
    lanes = -(-len(f) // 64) * 64
    bits = np.zeros((64, lanes), dtype=np.uint8)
    bits[:, : len(f)] = (f[None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def within(p: np.ndarray, query: int, radius: int, block: int = 512) -> np.ndarray:
    """Lanes (a bit each) at distance ``radius`` or less from ``query``; the last word may have spare lanes."""
    counters = max(1, (radius + 1).bit_length())
    out = np.zeros(p.shape[1], dtype=np.uint64)
    for at in range(0, p.shape[1], block):
        part = p[:, at : at + block]
        count = [np.zeros(part.shape[1], dtype=np.uint64) for _ in range(counters)]
        past = np.zeros(part.shape[1], dtype=np.uint64)
        for b in range(64):
            carry = part[b] ^ (_ALL if query >> b & 1 else np.uint64(0))
            for c in range(counters):
                count[c], carry = count[c] ^ carry, count[c] & carry
            past |= carry
            if b % 8 == 7:
                # above the radius: a first high bit that the radius does not have
                equal = np.full(part.shape[1], _ALL)
                for c in reversed(range(counters)):
                    if radius >> c & 1:
                        equal &= count[c]
                    else:
                        past |= equal & count[c]
                        equal &= ~count[c]
                if (past == _ALL).all():
                    break
        out[at : at + block] = ~past
    return out


def forest(f: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """``(member, smaller member of its local component)``, one edge for each member but the first of a component."""
    n, edges = len(f), []
    left = np.zeros(-(-n // 64) * 64, dtype=np.uint8)
    left[:n] = 1
    left = np.packbits(left, bitorder="little").view(np.uint64)
    p = planes(f)
    for i in range(n):
        if not int(left[i // 64]) >> (i % 64) & 1:
            continue
        left[i // 64] &= ~np.uint64(1 << (i % 64))
        reach = [i]
        while reach:
            hit = within(p, int(f[reach.pop()]), radius) & left
            if hit.any():
                left &= ~hit
                found = np.flatnonzero(np.unpackbits(hit.view(np.uint8), bitorder="little"))
                edges += [(int(j), i) for j in found]
                reach += found.tolist()
    return edges


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """``(u, v)`` edges that connect distinct fingerprints ``fp`` at ``radius`` bits or less."""
    if not 0 <= radius <= 2:
        raise ValueError("the groups are bounded for a radius of at most 2")
    masks = []
    for blank in combinations(range(8), radius):
        mask = (1 << 64) - 1
        for b in blank:
            mask &= ~(0xFF << (8 * b))
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))
    keyed = keyed.repartition("t", "key").sortWithinPartitions("t", "key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in equal_runs(batches, ["t", "key"]):
            f = table.column("fp").to_numpy().view(np.uint64)
            at = run_starts(table.column("t").to_numpy(), table.column("key").to_numpy())
            ends = np.append(at[1:], len(f))
            size = ends - at
            two = at[size == 2]
            differ = np.bitwise_count(f[two] ^ f[two + 1])
            two = two[differ <= radius]
            u, v = [f[two + 1]], [f[two]]
            for a, e in zip(at[size > 2], ends[size > 2]):
                pairs = np.array(forest(f[a:e], radius), dtype=np.int64).reshape(-1, 2)
                u.append(f[a:e][pairs[:, 0]])
                v.append(f[a:e][pairs[:, 1]])
            yield pa.record_batch([pa.array(np.concatenate(x).view(np.int64)) for x in (u, v)], names=["u", "v"])

    return keyed.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2) -> DataFrame:
    """``(id, fp, component_id)`` for every row: the smallest id among all that are linked, over any number of links.

    NULL and empty texts have fingerprint zero and link like any other. Equal texts always share a
    component. A repeated id gives a repeated row; a NULL id gets a component but never names one,
    unless all ids of it are NULL.
    """
    prints = materialize(with_fingerprint(docs, id_col, text_col, size), "fingerprints")
    least = prints.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(least.select("fp"), radius))
    named = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.join(smallest, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("id", "fp", "component_id")


# Documents that are similar, not only alike: a wide radius for candidates, and the shingles themselves for the answer.

BANDS, BAND_ROWS = 12, 3
TIGHT, WIDE = 7, 18


def _signatures(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``(id, ident, n, fp, keys)``: what copies have in common, the number of distinct shingles, their bits, and MinHash band keys."""
    rng = np.random.default_rng(11)
    odd = rng.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            h, owner = shingle_hashes(b.column("text"), size)
            by = np.lexsort((h, owner))
            h, owner = h[by], owner[by]
            once = run_starts(h, owner)
            h, owner = h[once], owner[once]
            first = np.searchsorted(owner, np.arange(b.num_rows + 1))
            n = np.diff(first)
            some = np.flatnonzero(n)
            ident, fp = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64)
            keys = np.zeros((b.num_rows, BANDS), np.uint64)
            if len(some):
                at = first[:-1][some]
                ident[some] = np.add.reduceat(mix(h.copy()), at)
                bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
                fp[some] = np.packbits(ones * 2 > n[some][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
                for band in range(BANDS):
                    key = np.full(len(some), band, np.uint64)
                    for row in range(BAND_ROWS):
                        key = mix(key ^ np.minimum.reduceat(h * odd[band * BAND_ROWS + row], at))
                    keys[some, band] = key
            flat = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * BANDS), signed(keys.reshape(-1)))
            yield pa.record_batch([b.column("id"), signed(ident), pa.array(n.astype(np.int64)), signed(fp), flat], names=["id", "ident", "n", "fp", "keys"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "id long, ident long, n long, fp long, keys array<long>")


def leaders(f: np.ndarray, n: np.ndarray, share: float, tight: int = TIGHT, wide: int = WIDE) -> list[tuple[int, int]]:
    """``(member, earlier member)`` candidates: each with the first within ``tight`` bits, and those firsts among themselves within ``wide``.

    Sizes that rule out the similarity ``share`` rule a candidate out.
    """
    edges: list[tuple[int, int]] = []
    rows = np.arange(len(f))
    for radius in (tight, wide):
        p, m = planes(f[rows]), n[rows]
        left = np.ones(len(rows), dtype=bool)
        heads = []
        for i in range(len(rows)):
            if not left[i]:
                continue
            heads.append(i)
            hit = np.unpackbits(within(p, int(f[rows[i]]), radius).view(np.uint8), bitorder="little")[: len(rows)].astype(bool)
            hit &= left & (m >= share * m[i]) & (m * share <= m[i])
            hit[: i + 1] = False
            found = np.flatnonzero(hit)
            edges += [(int(rows[j]), int(rows[i])) for j in found]
            left[i] = False
            left[found] = False
        rows = rows[heads]
    return edges


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, share: float = 0.8, block_bytes: int = 8 << 20) -> DataFrame:
    """``(id, earlier)``: documents whose set of word shingles has a Jaccard similarity of ``share`` or more to an earlier one's.

    A document that repeats an earlier one's shingles exactly is paired with the first such. Others are
    candidates when they share a MinHash band and their bits are near, and every candidate is verified on the
    shingle sets; a document gets a pair with the leaders of its bands, not with all its likes. Documents
    without words are copies of each other. Ids should be unique; rows without an id are left out.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    marks = materialize(_signatures(docs, "id", "text", size), "signatures")
    same = marks.groupBy("ident", "n", "fp").agg(F.min("id").alias("first"), F.min_by("keys", "id").alias("keys"))
    renamed = same.select(F.col("ident").alias("i"), F.col("n").alias("m"), F.col("fp").alias("f"), "first")
    copies = marks.join(renamed, (F.col("ident") == F.col("i")) & (F.col("n") == F.col("m")) & (F.col("fp") == F.col("f"))).where("id <> first").select("id", F.col("first").alias("earlier"))
    keyed = same.where("n > 0").select(F.col("first").alias("id"), "n", "fp", F.explode("keys").alias("key"))
    keyed = keyed.repartition("key").sortWithinPartitions("key", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in equal_runs(batches, ["key"]):
            ids, n, f = (t.column(c).to_numpy() for c in ("id", "n", "fp"))
            f = f.view(np.uint64)
            at = run_starts(t.column("key").to_numpy())
            ends = np.append(at[1:], len(f))
            two = at[ends - at == 2]
            near = (np.bitwise_count(f[two] ^ f[two + 1]) <= WIDE) & (np.minimum(n[two], n[two + 1]) >= share * np.maximum(n[two], n[two + 1]))
            later, earlier = [two[near] + 1], [two[near]]
            for a, e in zip(at[ends - at > 2].tolist(), ends[ends - at > 2].tolist()):
                pairs = np.array(leaders(f[a:e], n[a:e], share), dtype=np.int64).reshape(-1, 2) + a
                later.append(pairs[:, 0])
                earlier.append(pairs[:, 1])
            yield pa.record_batch([pa.array(ids[np.concatenate(x)]) for x in (later, earlier)], names=["id", "earlier"])

    maybe = materialize(keyed.mapInArrow(run, "id long, earlier long").distinct(), "candidates")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-int(total) // block_bytes))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            blocks, values = packed_by(b.column("block").to_numpy(), b.select(["id", "text"]))
            yield pa.record_batch([pa.array(blocks), values], names=["block", "docs"])

    # whole documents cross one shuffle, compressed; which of them are candidates is looked up in their block
    rows = docs.withColumn("block", block_of("id", n_blocks)).mapInArrow(pack, "block int, docs binary").repartition("block")

    def sets(column, wanted: set[int]) -> dict[int, np.ndarray]:
        out, known = {}, pa.array(sorted(wanted), pa.int64())
        for b in slices((b.filter(pc.is_in(b.column("id"), known)) for b in unpacked(column)), "text"):
            ids = b.column("id").to_pylist()
            h, owner = shingle_hashes(b.column("text"), size)
            first = np.searchsorted(owner, np.arange(len(ids) + 1))
            for i, d in enumerate(ids):
                out[d] = np.unique(h[first[i] : first[i + 1]])
        return out

    def alike(x: np.ndarray, y: np.ndarray) -> bool:
        common = len(np.intersect1d(x, y, assume_unique=True))
        return common >= share * (len(x) + len(y) - common) - 1e-9

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        pairs = list(zip(right.column("id").to_pylist(), right.column("earlier").to_pylist()))
        own = sets(left.column("docs"), {x for p in pairs for x in p})
        out = []
        for d, e in pairs:
            if e not in own:
                out.append((d, e, own[d].tobytes()))
            elif alike(own[d], own[e]):
                out.append((d, e, None))
        cols = list(zip(*out)) if out else [()] * 3
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()))], names=["id", "earlier", "shingles"])

    asked = rows.groupBy("block").cogroup(maybe.withColumn("block", block_of("id", n_blocks)).groupBy("block")).applyInArrow(ask, "id long, earlier long, shingles binary")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        known = right.filter(right.column("shingles").is_null()).select(["id", "earlier"])
        open_ = right.filter(right.column("shingles").is_valid())
        own = sets(left.column("docs"), set(open_.column("earlier").to_pylist())) if open_.num_rows else {}
        ok = [alike(np.frombuffer(s.as_buffer(), np.uint64), own[e]) for e, s in zip(open_.column("earlier").to_pylist(), open_.column("shingles"))]
        return pa.concat_tables([known, open_.filter(pa.array(ok, pa.bool_())).select(["id", "earlier"])])

    verified = rows.groupBy("block").cogroup(asked.withColumn("block", block_of("earlier", n_blocks)).groupBy("block")).applyInArrow(answer, "id long, earlier long")
    return copies.unionAll(verified)


def first_of_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, share: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without the documents that :func:`similar_pairs` pairs with an earlier one.

    So a document that is similar to an earlier one that stands for its group goes, and each group's smallest id stays. Similarity is no equivalence: two documents that are
    both similar to a third, later one, but not to each other, are two groups, and both stay. Rows without an id stay; an empty table gives no rows.
    """
    name = unused(docs, "gone")
    gone = similar_pairs(docs, id_col, text_col, size, share).select(F.col("id").alias(name)).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")
