"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from emberline.llm import queries, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w, least_words=6, least_exponent=4):
    found = {}
    for q in range(1, len(w) // least_exponent + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least_words, least_exponent * q):
                found.setdefault((s, i + q), q)
            i += 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def word_lists(seed, count):
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        n = rng.randint(0, 70)
        if rng.random() < 0.5:
            w = [rng.randint(1, rng.choice([1, 2, 3, 6])) for _ in range(n)]
        else:
            p = [rng.randint(1, 4) for _ in range(rng.randint(1, 8))]
            w = [p[i % len(p)] for i in range(n)]
            for _ in range(rng.randint(0, 3) if w else 0):
                w[rng.randrange(n)] = rng.randint(1, 4)
        out.append(w)
    return out


@pytest.mark.parametrize("least_exponent", [2, 3, 4])
def test_runs_of_random_words(least_exponent):
    for seed in range(60):
        lists = word_lists(seed, 6)
        first = np.cumsum([0] + [len(w) for w in lists])
        keys = np.array([x for w in lists for x in w], dtype=np.uint64)
        begin, stop, period = runs.runs_of(keys, first, 6, least_exponent)
        want = [(s + first[t], s + n + first[t], q) for t, w in enumerate(lists) for s, n, q in brute_runs(w, 6, least_exponent)]
        assert list(zip(begin.tolist(), stop.tolist(), period.tolist())) == want


def test_nearest_below():
    rng = np.random.default_rng(2)
    for n in (3, 17, 64, 200):
        v = np.concatenate([[0], rng.integers(1, 9, n), [0]])
        at = np.arange(1, n + 1)
        got = runs.nearest_below(runs.minima(v), at, v[at])
        assert got.tolist() == [max(j for j in range(k) if v[j] < v[k]) for k in at]


def test_long_runs_in_one_text():
    for keys, period in ((np.ones(200_000, np.uint64), 1), (np.arange(200_000).astype(np.uint64) % np.uint64(977), 977)):
        assert [x.tolist() for x in runs.runs_of(keys, np.array([0, len(keys)]))] == [[0], [len(keys)], [period]]


def brute_row(i, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
    found = brute_runs(w)
    gone = {j for s, size, q in found for j in range(s + q, s + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        i, len(found), *best, 1000 * best[1] // best[2] if found else None,
        digest("".join(f"{s},{size},{q}\n" for s, size, q in found)), digest(" ".join(x for j, x in enumerate(w) if j not in gone)),
    )


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(7)
    texts = [" ".join(f"w{x}" for x in w) for w in word_lists(5, 250)]
    texts += [None, "", " \n\t ", "Ä ä Ä ä Ä ä Ä ä ß", "one two " * 9, " x\ty\nx  y\x0bx y x\x0cy z ", "a b c d e f g", "same " * 5000]
    texts += [" ".join(rng.choices(["ab", "cd", "ef", "gh", "ij"], k=400)) for _ in range(20)]
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts)] + [(9, texts[9]), (9, texts[10]), (12, texts[12])]
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "id": ["x"] * len(rows), "runs": [1] * len(rows), "g": [2] * len(rows)})
    pq.write_table(table, tmp_path / "documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    key = lambda r: str(r)
    assert sorted((tuple(r) for r in got), key=key) == sorted((brute_row(*r) for r in rows), key=key)


def test_collapsed_text_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "so on and on and on and on and on we go", 5)], "doc_id long, text string, collapsed int")
    row = runs.periodic_runs(docs).first()
    assert (row.n_words, [tuple(r) for r in row.runs], row.collapsed) == (12, [(1, 9, 2)], "so on and we go")
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_text_longer_than_a_step(spark):
    text = " ".join(f"word{i}" for i in range(200_000)) + " go on" * 5000 + " " + " ".join(f"w{i}" for i in range(150_000))
    docs = spark.createDataFrame([(1, text), (2, "a b c")], "doc_id long, text string")
    row = runs.periodic_runs(docs).where("id = 1").first()
    assert len(text) > 3_000_000 and [tuple(r) for r in row.runs] == [(200_000, 10_000, 2)]
    assert hashlib.sha256(row.collapsed.encode()).hexdigest() == hashlib.sha256(text.replace(" go on" * 5000, " go on").encode()).hexdigest()
