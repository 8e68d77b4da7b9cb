"""Embedding near-dedup against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import neighbors

NAN, INF = float("nan"), float("inf")


def clusters(seed, sizes, dim=24, noise=0.02, alone=300):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(size=(alone, dim))]
    parts += [rng.normal(size=dim) + noise * rng.normal(size=(n, dim)) * math.sqrt(dim) for n in sizes]
    x = np.concatenate(parts)
    return x[rng.permutation(len(x))].astype(np.float32)


def brute(rows, threshold=0.9):
    """Links and components of ``(id, vector)`` rows; the order of rows is kept."""
    sound = [i for i, (_, v) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for dim in {len(rows[i][1]) for i in sound}:
        at = [i for i in sound if len(rows[i][1]) == dim]
        x = np.array([np.array(rows[i][1], np.float64) / max(abs(c) for c in rows[i][1]) for i in at])
        x /= np.linalg.norm(x, axis=1)[:, None]
        for a, b in zip(*np.nonzero(x @ x.T >= threshold)):
            if a != b:
                links[at[a]].add(at[b])
    label = list(range(len(rows)))
    for i in range(len(rows)):
        todo = [i] if label[i] == i else []
        while todo:
            for j in links[todo.pop()]:
                if label[j] > i:
                    label[j] = i
                    todo.append(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[label[i]] = min(k, least.get(label[i], k))
    return sorted((str(k), len(links[i]), str(least.get(label[i]))) for i, (k, _) in enumerate(rows))


def answers(df):
    return sorted((str(r.id), r.n_links, str(r.component_id)) for r in df.collect())


def test_graph_finds_links():
    x = neighbors.unit(clusters(1, [2] * 60 + [30, 400], alone=2500))
    a, b = x[: len(x) // 2], x[len(x) // 2 :]
    graph = neighbors.Graph.build(a.astype(np.float32))
    assert len(graph.layers) > 1
    truth = b @ a.T >= 0.9
    found = np.zeros_like(truth)
    for r, c in graph.within(b.astype(np.float32), np.float32(0.9), 32):
        assert not found[r, c].any()
        found[r, c] = True
    assert not (found & ~(b @ a.T >= 0.9 - 1e-5)).any()
    assert found.sum() >= 0.99 * truth.sum()


def test_audit_widens():
    x = neighbors.unit(clusters(3, [3] * 100, alone=3000)).astype(np.float32)
    graph = neighbors.Graph.build(x, m=4, beam=8)
    width, found, there = graph.audited(x, 0.9, 0.99, every=5, width=1)
    assert width > 1 and found >= 0.99 * there > 0


def test_groups():
    rng = np.random.default_rng(5)
    for _ in range(50):
        n = int(rng.integers(2, 60))
        u, v = rng.integers(0, n, (2, int(rng.integers(0, n))))
        g = neighbors.Groups(n)
        for part in np.array_split(np.arange(len(u)), 3):
            g.join(u[part], v[part])
        label = np.arange(n)
        for _ in range(n):
            for a, b in zip(u, v):
                label[a] = label[b] = min(label[a], label[b])
        assert (g.root(np.arange(n)) == label).all()


@pytest.mark.parametrize("kind", ["float", "double"])
def test_against_brute_force(spark, kind):
    x = clusters(7, [2] * 40 + [3, 5, 25, 700], dim=16, alone=1500)
    rows = [(int(i) * 3 + 1, [float(c) for c in v]) for i, v in enumerate(x)]
    copy = rows[10][1]
    rows += [(100_000 + i, copy) for i in range(150)]  # exact copies
    rows += [(1, copy), (1, copy), (None, copy), (None, rows[11][1]), (None, None), (7, None), (8, []), (9, [0.0] * 16), (10, [-0.0] * 16)]
    rows += [(11, copy[:15] + [None]), (12, copy[:15] + [NAN]), (13, copy[:15] + [INF]), (14, copy[:8]), (15, [2 * c for c in copy[:8]]), (16, [-c for c in copy])]
    rows += [(17, [3.0]), (18, [0.5]), (19, [-3.0])]
    if kind == "double":
        rows += [(30, [1e-200, 2e-200]), (31, [1e200, 2e200])]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], f"vec_id long, embedding array<{kind}>, id string, cid int").repartition(5)
    got = answers(neighbors.near_vectors(df))
    want = brute(rows)
    assert [g[::2] for g in got] == [w[::2] for w in want]
    assert got == want


def test_recall_of_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    assert answers(neighbors.near_vectors(df, threshold=0.55)) == brute(rows, 0.55)


def test_audit_rows_and_empty_table(spark):
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(clusters(9, [40], alone=100))], "id long, embedding array<float>")
    found = neighbors.linked(neighbors.folded(df), every=1)
    found_, there = found.where(F.col("kind") == neighbors.AUDITED).agg(F.sum("a"), F.sum("b")).first()
    assert there >= 40 * 40 and found_ >= 0.99 * there
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, id int")
    assert neighbors.near_vectors(empty).collect() == []
