"""Embedding near-dedup on hierarchical navigable small-world graphs, one for each shard of the vectors.

Equal vectors are folded first and counted as copies of one. The rest is cut into shards by a hash of the
vector, so a group of near copies spreads over all of them; each shard becomes one graph, written to the
shared folder. Every two shards meet once: the vectors of one search the graph of the other, all
vectors of a block in step, on whole arrays. A search whose beam is full of links goes on with a beam
twice as wide, and beyond ``WIDEST`` compares its vector with the whole shard, so that no number of partners is a limit.
Before a shard is searched, a sample of the searches (every ``AUDIT``-th vector) is held against
brute force over the graph's shard; the beam widens until ``RECALL`` of the sample's links are found.

Links are verified by cosine in double precision. Only sums leave a meeting of two shards: each vector's number of links, weighted by
copies, and one edge for each vector that has any, to the smallest of its group in that meeting. So a group of near copies sends
as many rows as it has members in a meeting, never its pairs. Edges are joined to components on Spark.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.frames import components
from emberline.storage import materialize

THRESHOLD = 0.9
M = 12  # links of a node in the upper layers; twice as many at the bottom
BUILD_BEAM = 48
BEAM = 32
WIDEST = 256
RECALL = 0.99
AUDIT = 50
SHARD_BYTES = 64 << 20  # of 4-byte components
FEW_SHARDS, SHARD_ROWS = 8, 1000  # small tables: up to so many shards, of at least about so many vectors
STEP = 512  # searches in step
_SLACK = 1e-5  # of a cosine in single precision


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; rows are finite and not zero."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Graph:
    """Nodes in order of falling layer: layer ``l`` holds the first ``len(layers[l])`` nodes and their neighbours (-1: none)."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray]):
        self.x, self.layers = x, layers

    @classmethod
    def build(cls, x: np.ndarray, m: int = M, beam: int = BUILD_BEAM) -> Graph:
        """``x``: rows of length one in any order without sense; a node's layer follows from its place."""
        graph = cls(x, [])
        size, sizes = len(x), []
        while size > 4 * m or not sizes:
            sizes.append(size)
            size //= m
        graph.layers = [np.full((n, 2 * m if not i else m), -1, np.int32) for i, n in enumerate(sizes)]
        for layer in range(len(sizes) - 1, -1, -1):
            done = 0
            while done < sizes[layer]:
                more = min(max(done, 128), STEP, sizes[layer] - done)
                graph._insert(layer, done, done + more, m, beam)
                done += more
        return graph

    def _insert(self, layer: int, begin: int, end: int, m: int, beam: int) -> None:
        new = np.arange(begin, end)
        q = self.x[begin:end]
        own = q @ q.T
        np.fill_diagonal(own, -3)
        k = min(beam, len(new) - 1)
        near = np.argpartition(-own, max(k - 1, 0), axis=1)[:, :k]
        ids, sims = new[near], np.take_along_axis(own, near, 1)
        if begin:
            start = self.descend(q, layer)
            start[start >= begin] = -1
            start[(start < 0).all(axis=1), 0] = 0
            a, b = self.beam(layer, q, start, beam)
            ids, sims = np.concatenate([a, ids], 1), np.concatenate([b, sims], 1)
        links = self.layers[layer]
        chosen = self.choose(ids, sims, m)
        links[begin:end, : chosen.shape[1]] = chosen
        # and back: at most m at a time for each node, so that no node's list grows long
        r, c = np.nonzero(chosen >= 0)
        to, back = chosen[r, c], new[r]
        mutual = (links[to] == back[:, None]).any(axis=1)
        to, back = to[~mutual], back[~mutual]
        while len(to):
            by = np.argsort(to, kind="stable")
            to, back = to[by], back[by]
            node, first, count = np.unique(to, return_index=True, return_counts=True)
            nth = np.arange(len(to)) - np.repeat(first, count)
            now = nth < m
            add = np.full((len(node), m), -1, np.int64)
            add[np.repeat(np.arange(len(node)), count)[now], nth[now]] = back[now]
            for i in range(0, len(node), STEP):
                own_nodes = node[i : i + STEP]
                ids = np.concatenate([links[own_nodes], add[i : i + STEP]], 1)
                links[own_nodes] = self.choose(ids, self.likeness(self.x[own_nodes], ids), links.shape[1])
            to, back = to[~now], back[~now]

    def likeness(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        sims = np.einsum("bkd,bd->bk", self.x[np.maximum(ids, 0)], q)
        sims[ids < 0] = -3
        return sims

    def choose(self, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
        """Up to ``m`` neighbours of each row: the nearest that are nearer to the row than to one chosen before, then, up to half of ``m``, others."""
        by = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1)
        v = self.x[np.maximum(ids, 0)]
        pair = v @ v.transpose(0, 2, 1)
        kept = np.zeros(ids.shape, bool)
        n = np.zeros(len(ids), np.int64)
        for j in range(ids.shape[1]):
            nearest = np.where(kept, pair[:, j], -2).max(axis=1)
            kept[:, j] = (ids[:, j] >= 0) & (n < m) & (nearest < sims[:, j])
            n += kept[:, j]
        rest = (ids >= 0) & ~kept
        kept |= rest & (np.cumsum(rest, axis=1) + n[:, None] <= m // 2)
        front = np.argsort(~kept, axis=1, kind="stable")[:, :m]
        return np.where(np.take_along_axis(kept, front, 1), np.take_along_axis(ids, front, 1), -1)

    def beam(self, layer: int, q: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest nodes that each row meets from its starts on (-1: none), and their cosines; in no order."""
        links, x = self.layers[layer], self.x
        n = len(q)
        rows = np.arange(n)
        seen = np.zeros((n, len(links)), bool)
        ids = np.full((n, width), -1, np.int64)
        sims = np.full((n, width), -2, np.float32)
        k = min(start.shape[1], width)
        ids[:, :k] = start[:, :k]
        sims[:, :k] = np.where(start[:, :k] >= 0, self.likeness(q, start[:, :k]), -2)
        r, c = np.nonzero(ids >= 0)
        seen[r, ids[r, c]] = True
        open_ = ids >= 0
        while len(rows):
            score = np.where(open_[rows], sims[rows], -3)
            best = score.argmax(axis=1)
            rows = rows[np.take_along_axis(score, best[:, None], 1)[:, 0] > -3]
            if not len(rows):
                break
            best = best[np.take_along_axis(score, best[:, None], 1)[:, 0] > -3]
            open_[rows, best] = False
            near = links[ids[rows, best]]
            fresh = near >= 0
            fresh &= ~seen[rows[:, None], np.maximum(near, 0)]
            r, c = np.nonzero(fresh)
            if not len(r):
                continue
            node, row = near[r, c], rows[r]
            seen[row, node] = True
            found = np.full(near.shape, -2, np.float32)
            found[r, c] = np.einsum("ij,ij->i", x[node], q[row])
            some = np.unique(r)
            own = rows[some]
            every = np.concatenate([sims[own], found[some]], 1)
            top = np.argpartition(-every, width - 1, axis=1)[:, :width]
            sims[own] = np.take_along_axis(every, top, 1)
            ids[own] = np.take_along_axis(np.concatenate([ids[own], np.where(fresh, near, -1)[some]], 1), top, 1)
            open_[own] = np.take_along_axis(np.concatenate([open_[own], fresh[some]], 1), top, 1)
        return ids, sims

    def descend(self, q: np.ndarray, layer: int) -> np.ndarray:
        """Starts for a search in a layer: the nearest few met in each layer above."""
        start = np.zeros((len(q), 1), np.int64)
        for above in range(len(self.layers) - 1, layer, -1):
            start = self.beam(above, q, start, 4)[0]
        return start

    def within(self, q: np.ndarray, least: float, width: int, widest: int = WIDEST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of ``q`` and nodes of a cosine of ``least`` or more (in single precision), block by block."""
        n = len(self.x)
        step = max(16, min(STEP, (1 << 26) // n))
        for i in range(0, len(q), step):
            rows = np.arange(i, min(i + step, len(q)))
            start = self.descend(q[rows], 0)
            wide = min(width, n)
            while len(rows) and wide < min(widest, n):
                ids, sims = self.beam(0, q[rows], start, wide)
                hit = (sims >= least) & (ids >= 0)
                full = hit.sum(axis=1) > wide // 2
                r, c = np.nonzero(hit & ~full[:, None])
                yield rows[r], ids[r, c]
                rows, start = rows[full], ids[full]
                wide *= 2
            for j in range(0, len(rows), 64):  # as many links as a beam may hold: the whole shard
                r, c = np.nonzero(q[rows[j : j + 64]] @ self.x.T >= least)
                yield rows[j : j + 64][r], c

    def audited(self, q: np.ndarray, least: float, recall: float = RECALL, every: int = AUDIT, width: int = BEAM) -> tuple[int, int, int]:
        """A beam that finds ``recall`` of the links of every ``every``-th row, how many it finds, and how many there are."""
        q = q[::every]
        there = sum(int((q[i : i + STEP] @ self.x.T >= least).sum()) for i in range(0, len(q), STEP))
        while True:
            found = sum(len(r) for r, _ in self.within(q, least, width))
            if found >= recall * there:
                return width, found, there
            width *= 2


class Groups:
    """Sets of numbers that are joined in batches."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, at: np.ndarray) -> np.ndarray:
        up = self.parent[at]
        while True:
            above = self.parent[up]
            if (above == up).all():
                return up
            up = above

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            p, q = self.root(a), self.root(b)
            differs = p != q
            a, b, p, q = a[differs], b[differs], p[differs], q[differs]
            self.parent[np.maximum(p, q)] = np.minimum(p, q)


def _dump(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _load(value: pa.Scalar) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(value.as_buffer().to_pybytes())) as z:
        return dict(z)


def folded(vectors: DataFrame) -> DataFrame:
    """``(cid, dim, embedding, least_id, copies)``, written: one row for each different vector that can link."""
    x = F.col("embedding")
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(x, lambda v: v != 0)
    each = vectors.where(x.isNotNull() & ok).groupBy("embedding").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    return materialize(each.select(F.monotonically_increasing_id().alias("cid"), F.size("embedding").alias("dim"), "embedding", "least_id", "copies"), "vectors")


def shard_graphs(classes: DataFrame, n_shards: int, m: int = M, beam: int = BUILD_BEAM) -> DataFrame:
    """``(dim, shard, points, links)``, written: the vectors of each shard, and their graph."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("cid")
        dim = table.column("dim")[0].as_py()
        x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column("embedding").chunks]).reshape(-1, dim)
        graph = Graph.build(unit(x).astype(np.float32), m, beam)
        points = _dump(x=x, cid=table.column("cid").to_numpy(), copies=table.column("copies").to_numpy())
        links = _dump(**{f"l{i}": layer for i, layer in enumerate(graph.layers)})
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": table.column("shard")[:1], "points": pa.array([points], pa.binary()), "links": pa.array([links], pa.binary())})

    rows = classes.withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(n_shards)).cast("int"))
    rows = rows.repartition(n_shards, "dim", "shard")
    return materialize(rows.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, points binary, links binary"), "graphs")


def meetings(shards: DataFrame, n_shards: int) -> DataFrame:
    """``(points, links, others)``: every two shards once, and each with itself; the one that is searched alternates."""

    def searches(q, i):
        odd = (q + i) % 2 == 1
        return (q == i) | (odd & (q < i)) | (~odd & (q > i))

    every = F.sequence(F.lit(0), F.lit(n_shards - 1))
    searched = shards.select("dim", "points", "links", F.col("shard").alias("to"), F.explode(F.filter(every, lambda q: searches(q, F.col("shard")))).alias("by"))
    by = shards.select(F.col("dim").alias("d"), F.col("points").alias("others"), F.col("shard").alias("b"), F.explode(F.filter(every, lambda i: searches(F.col("shard"), i))).alias("t"))
    n = n_shards * (n_shards + 1) // 2
    both = searched.repartition(n, "dim", "to", "by").join(by.repartition(n, "d", "t", "b"), (F.col("dim") == F.col("d")) & (F.col("to") == F.col("t")) & (F.col("by") == F.col("b")))
    return both.select("points", "links", "others", (F.col("to") == F.col("by")).alias("same"))


LINKS, EDGE, AUDITED = 0, 1, 2


def _meet(points: dict, layers: list[np.ndarray], others: dict, same: bool, threshold: float, recall: float, every: int, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    x, y = unit(points["x"]), unit(others["x"])
    graph = Graph(x.astype(np.float32), layers)
    q = y.astype(np.float32)
    least = np.float32(threshold - _SLACK)
    width, found, there = graph.audited(q, least, recall, every, width)
    yield AUDITED, np.array([found]), np.array([there])
    n = len(x)
    counts = np.zeros(n + (0 if same else len(y)), np.int64)
    groups = Groups(len(counts))
    for r, c in graph.within(q, least, width):
        if same:  # a pair is found from its first vector
            r, c = r[c > r], c[c > r]
        for i in range(0, len(r), 1 << 16):
            a, b = r[i : i + (1 << 16)], c[i : i + (1 << 16)]
            linked = np.einsum("ij,ij->i", y[a], x[b]) >= threshold
            a, b = a[linked], b[linked]
            k = a if same else a + n
            np.add.at(counts, k, points["copies"][b])
            np.add.at(counts, b, others["copies"][a])
            groups.join(k, b)
    cid = points["cid"] if same else np.append(points["cid"], others["cid"])
    some = np.flatnonzero(counts)
    yield LINKS, cid[some], counts[some]
    root = groups.root(some)
    yield EDGE, cid[some], cid[root]


def linked(classes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, every: int = AUDIT, width: int = BEAM, m: int = M, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``(kind, a, b)``, written: of vector ``a`` so many links ``b``; an edge from ``a`` to ``b``; of an audit the links found and those there are."""
    total = classes.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("dim").cast("long")).alias("values")).first()
    n_shards = max(1, -(-4 * (total["values"] or 0) // shard_bytes), min(FEW_SHARDS, total["n"] // SHARD_ROWS))
    pairs = meetings(shard_graphs(classes, n_shards, m), n_shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for points, links, others, same in zip(*(batch.column(c) for c in ("points", "links", "others", "same"))):
                layers = _load(links)
                layers = [layers[f"l{i}"] for i in range(len(layers))]
                for kind, a, b in _meet(_load(points), layers, _load(others), same.as_py(), threshold, recall, every, width):
                    yield pa.record_batch([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], names=["kind", "a", "b"])

    return materialize(pairs.mapInArrow(run, "kind int, a long, b long"), "links")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, **options) -> DataFrame:
    """``(id, n_links, component_id)`` for each row: how many other rows link with it, and the smallest id reachable by links.

    Rows link by a cosine of ``threshold`` (over zero) or more. Vectors that are NULL, empty or zero, or hold a NULL, NaN or infinite component, link with
    nothing; vectors of different lengths do not link. Equal vectors link; repeated rows and rows that share an id are rows of their own.
    A NULL id takes part, and is no component's smallest id unless all are NULL. An empty table gives no rows, and other columns do not matter.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    kind = dict(vectors.dtypes)[vector_col]
    cast = "array<float>" if kind == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(cast).alias("embedding"))
    classes = folded(rows)
    found = linked(classes, threshold, **options)
    counts = found.where(F.col("kind") == LINKS).groupBy("a").agg(F.sum("b").alias("more"))
    roots = components(found.where(F.col("kind") == EDGE).select(F.col("a").alias("u"), F.col("b").alias("v")))
    each = classes.join(counts, F.col("cid") == F.col("a"), "left").join(roots, F.col("cid") == F.col("node"), "left")
    each = each.select("cid", "embedding", "copies", "least_id", F.coalesce("more", F.lit(0)).alias("more"), F.coalesce("root", "cid").alias("root"))
    each = materialize(each, "classes")
    least = each.groupBy(F.col("root").alias("r")).agg(F.min("least_id").alias("component_id"))
    facts = each.join(least, F.col("root") == F.col("r")).select(F.col("embedding").alias("x"), (F.col("copies") - 1 + F.col("more")).alias("n_links"), "component_id", F.lit(True).alias("known"))
    # zeros of either sign are equal in a grouping and in a join
    out = rows.join(facts, F.col("embedding") == F.col("x"), "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("known"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
