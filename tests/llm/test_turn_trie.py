"""The trie of conversations against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from emberline.llm import queries, turn_trie


def in_order(rows):
    """Turns ``(role, text)`` of each conversation."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn, role or "", text or ""))
    framed = lambda t: hashlib.sha256(f"{len(t[1].encode())}:{t[1]}{t[2]}".encode()).hexdigest()
    return {c: [t[1:] for t in sorted(ts, key=lambda t: (t[0] is not None, t[0] or 0, framed(t)))] for c, ts in convs.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c / 5) * 5
        out[c] = convs.get(c - base, [])[:h] + turns[h:]
    return out


def brute_trie(convs):
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[x] for x in children[p])
        ends = ",".join(str(c) for c in members[p] if len(convs[c]) == len(p))
        up = min(members[p[:-1]]) if p else None
        out.append((min(members[p]), len(p), up, len(members[p]), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n, longest=30):
    rng = random.Random(seed)
    rows, stock = [], []
    for c in rng.sample(range(-20, 6 * n), n):
        if stock and rng.random() < 0.6:
            turns = list(rng.choice(stock))[: rng.randint(0, longest)]
        else:
            turns = []
        turns += [(rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None, "long text " * 3])) for _ in range(rng.randint(0, 6))]
        stock.append(turns)
        rows += [(c, i if i or rng.random() < 0.5 else None, *t) for i, t in enumerate(turns)]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=str)


@pytest.mark.parametrize("seed,block", [(1, 1), (2, 3), (3, 8)])
def test_trie(spark, seed, block):
    rows = conversations(seed, 90)
    rows += [(None, 1, "user", "x"), *[(700, 5, "user", "tie")] * 3, (700, 5, "user", "other"), *[(c, 0, "user", "same") for c in range(1000, 1700)]]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", conv int, depth string").repartition(3)
    assert found(turn_trie.conversation_trie(df, block=block)) == brute_trie(in_order(rows))


def test_long_paths_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(turn_trie, "CHUNK", 2)
    monkeypatch.setattr(turn_trie, "ID_CHUNK", 4)
    steps = [("user", f"t{i % 7}") for i in range(60)]
    rows = [(c, i, *t) for c in range(40) for i, t in enumerate([*steps[: 60 - c], ("x", str(c % 3))])]  # each hangs off the one before
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(turn_trie.conversation_trie(df, block=4)) == brute_trie(in_order(rows))


def test_query(spark, tmp_path):
    rows = conversations(11, 120) + [(5 * c + i, t, "user", f"family {c} {t}") for c in range(400, 420) for i in range(5) for t in range(random.Random(c + i).randint(1, 14))]
    columns = list(zip(*rows))
    pq.write_table(pa.table({n: pa.array(c, k) for n, c, k in zip(SCHEMA.replace(" long", "").replace(" string", "").split(", "), columns, [pa.int64(), pa.int64(), pa.string(), pa.string()])}), tmp_path / "conversations.parquet")
    want = brute_trie(rebuilt(in_order(rows)))
    assert any(r[1] == 0 and r[3] > 1 for r in want)
    assert found(queries.op11_conversation_trie(spark, str(tmp_path))) == want


def test_empty_table_and_long_text(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert turn_trie.conversation_trie(empty).collect() == []
    assert turn_trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).collect() == []
    rows = [(1, 0, "user", "ä" * 1_500_000), (2, 0, "user", "ä" * 1_500_000), (3, 0, "user", "ä" * 1_500_000 + "!")]
    assert found(turn_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == brute_trie(in_order(rows))
