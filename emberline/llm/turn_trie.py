"""Prefix trie of conversations, by digests of fixed-length blocks of turns.

A conversation is cut into blocks of ``BLOCK`` turns. The digest of a prefix is the exclusive or of the hashes of its
(depth, turn) pairs, two words of 64 bits, so a block's digest is summed where its turns are, and the prefix
before a block follows from a running exclusive or, chunk by chunk.

Conversations are grouped by prefix and block first: those that share a block and all before it are one
row from there on, with their number and the smallest of them. Only that one's turns are looked up again. Where a
prefix goes on with one block only, the turns inside are nodes as they stand; where sibling blocks diverge, turn boundaries
inside them are grouped by prefix once more, one row for each block and depth instead of each conversation.

A node is known by its smallest member and its depth: a conversation owns the nodes from the first depth at which no smaller one
shares its prefix. So the trie is a tree of paths, one for each such conversation, hung onto a node of another. Sums over subtrees
are sums over that tree, by doubling (the logarithm of its height in rounds, each written), and running sums from a path's end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.frames import run_starts
from emberline.operators.ordered import join_carry, number_by_range, running
from emberline.storage import materialize

BLOCK = 8
CHUNK = 1 << 12  # blocks of a conversation handled by one task at a time
ID_CHUNK = 1 << 8  # ids of one string
_EMPTY = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, depth, h1, h2, n_bytes)``, written: each turn's place in its conversation from 1, its digest, and its text's UTF-8 bytes.

    Turns are ordered by ``turn_col``, NULL first; ties by the SHA-256 of role and text, so that equal rows are turns one after the other.
    A NULL role or text is empty. Rows with a NULL conversation belong to none and are left out. Texts do not leave the scan.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.sha2(framed, 256).alias("sha"), F.octet_length(text).cast("long").alias("n_bytes")
    )
    rows = number_by_range(rows, ["conv"], [F.col("turn").asc_nulls_first(), F.col("sha")], "depth")
    return materialize(rows.select("conv", "depth", F.xxhash64("sha").alias("h1"), F.xxhash64(F.lit(1), "sha").alias("h2"), "n_bytes"), "turns")


def _placed(word: str) -> Column:
    return F.xxhash64("depth", word)


def _blocks(turns: DataFrame, block: int) -> DataFrame:
    """``(conv, k, b1, b2, e1, e2)``: the prefix before each block, and with it."""
    rows = turns.groupBy("conv", F.floor((F.col("depth") - 1) / block).alias("k"))
    rows = rows.agg(F.bit_xor(_placed("h1")).alias("x1"), F.bit_xor(_placed("h2")).alias("x2"))
    rows = rows.withColumn("c", F.floor(F.col("k") / CHUNK))
    totals = rows.groupBy("conv", "c").agg(F.bit_xor("x1").alias("t1"), F.bit_xor("x2").alias("t2"))
    past = Window.partitionBy("conv").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    totals = totals.select("conv", "c", *(F.coalesce(F.bit_xor(f"t{i}").over(past), zero).alias(f"p{i}") for i in (1, 2)))
    local = Window.partitionBy("conv", "c").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"l{i}": F.bit_xor(f"x{i}").over(local) for i in (1, 2)})
    rows = join_carry(rows, totals, ["conv", "c"])
    ends = [F.col(f"l{i}").bitwiseXOR(F.col(f"p{i}")) for i in (1, 2)]
    return rows.select("conv", "k", *(e.bitwiseXOR(F.col(f"x{i}")).alias(f"b{i}") for i, e in zip((1, 2), ends)), *(e.alias(f"e{i}") for i, e in zip((1, 2), ends)))


def _nodes(turns: DataFrame, blocks: DataFrame, convs: DataFrame, block: int) -> DataFrame:
    """``(depth, p1, p2, q1, q2, conv, n_convs, n_bytes)``: all nodes, ``q`` being the parent's prefix."""
    shared = materialize(blocks.groupBy("k", "b1", "b2", "e1", "e2").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n")), "blocks")
    forks = shared.groupBy("k", "b1", "b2").agg((F.count(F.lit(1)) > 1).alias("diverges"))
    shared = join_carry(shared, forks, ["k", "b1", "b2"])
    inside = turns.withColumn("k", F.floor((F.col("depth") - 1) / block))
    rows = join_carry(inside, shared, ["conv", "k"], "inner")
    along = Window.partitionBy("conv", "k", "diverges").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"p{i}": F.col(f"b{i}").bitwiseXOR(F.bit_xor(_placed(f"h{i}")).over(along)) for i in (1, 2)})
    rows = rows.withColumns({f"q{i}": F.col(f"p{i}").bitwiseXOR(_placed(f"h{i}")) for i in (1, 2)})
    names = ["depth", "p1", "p2", "q1", "q2", "conv", "n_convs", "n_bytes"]
    rows = rows.withColumnRenamed("n", "n_convs")
    alone = rows.where(~F.col("diverges")).select(*names)
    refined = rows.where("diverges").groupBy("depth", "p1", "p2")
    refined = refined.agg(*(F.min(c).alias(c) for c in ("q1", "q2", "conv")), F.sum("n_convs").alias("n_convs"), F.min("n_bytes").alias("n_bytes"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(*(zero.alias(c) for c in ("depth", "p1", "p2")), *(F.lit(None).cast("long").alias(c) for c in ("q1", "q2")), "conv", "n_convs", zero.alias("n_bytes"))
    return alone.unionByName(refined.select(*names)).unionByName(root)


def _digests(ends: DataFrame) -> DataFrame:
    """``(depth, p1, p2, ends_sha256)`` of ``(conv, depth, p1, p2)``: ids ascending and comma-joined, in short strings hashed one after the other."""
    key = ["depth", "p1", "p2"]
    parts = ends.groupBy(*key, F.floor(F.col("conv") / ID_CHUNK).alias("part")).agg(F.concat_ws(",", F.array_sort(F.collect_list("conv")).cast("array<string>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest = None, None

        def done(rows: list) -> pa.RecordBatch:
            return pa.record_batch([*(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[3] for r in rows], pa.string())], names=[*key, "ends_sha256"])

        for b in batches:
            if not b.num_rows:
                continue
            keys, ids, out = [b.column(c).to_numpy() for c in key], b.column("ids"), []
            first = run_starts(*keys)
            for s, e in zip(first.tolist(), np.append(first[1:], b.num_rows).tolist()):
                here = tuple(int(c[s]) for c in keys)
                text = ",".join(ids[s:e].to_pylist()).encode()
                if here == held:
                    digest.update(b"," + text)
                else:
                    if held:
                        out.append((*held, digest.hexdigest()))
                    held, digest = here, hashlib.sha256(text)
            yield done(out)
        if held:
            yield done([(*held, digest.hexdigest())])

    parts = parts.repartition(*key).sortWithinPartitions(*key, "part")
    return parts.mapInArrow(run, "depth long, p1 long, p2 long, ends_sha256 string")


def _path_sums(paths: DataFrame, measures: list[str]) -> DataFrame:
    """``(conv, up, at, measures)`` with each path's measures summed over all paths hung below it, and itself."""
    state = materialize(paths.select("conv", "up", "at", F.col("up").alias("anc"), *measures), "paths")
    while state.where("anc IS NOT NULL").limit(1).count():
        below = state.where("anc IS NOT NULL").groupBy(F.col("anc").alias("a")).agg(*(F.sum(m).alias(f"s_{m}") for m in measures))
        far = state.select(F.col("conv").alias("c"), F.col("anc").alias("next"))
        rows = state.join(below, F.col("conv") == F.col("a"), "left").join(far, F.col("anc") == F.col("c"), "left")
        state = materialize(rows.select("conv", "up", "at", F.col("next").alias("anc"), *((F.col(m) + F.coalesce(f"s_{m}", F.lit(0))).alias(m) for m in measures)), "paths")
    return state.select("conv", "up", "at", *measures)


def prefix_trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Nodes of the trie of ``turns(conv, depth, h1, h2, n_bytes)``; ``convs(conv)`` are all conversations, also those without turns.

    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, n_ends, ends_sha256)``: a node's smallest member and depth, its parent's
    smallest member (NULL for the root), its members, children, childless nodes of its subtree, the bytes that its
    subtree's turns would take again in all members but one, and how many members end at it, with the SHA-256 of their ids.
    Both tables are read several times and should be written ones. Without conversations there is no node.
    """
    blocks = materialize(_blocks(turns, block), "prefixes")
    nodes = materialize(_nodes(turns, blocks, convs, block), "nodes")

    # where conversations end
    last = blocks.groupBy("conv").agg(F.max_by(F.struct("e1", "e2"), "k").alias("e"))
    length = turns.groupBy("conv").agg(F.max("depth").alias("n"))
    ends = join_carry(join_carry(convs.select("conv"), last, ["conv"]), length, ["conv"])
    zero = F.lit(0).cast("long")
    ends = ends.select("conv", *(F.coalesce(c, zero).alias(n) for c, n in ((F.col("n"), "depth"), (F.col("e.e1"), "p1"), (F.col("e.e2"), "p2"))))
    key = ["depth", "p1", "p2"]
    ends = materialize(ends, "ends")
    digests = join_carry(ends.groupBy(*key).agg(F.count(F.lit(1)).alias("n_ends")), _digests(ends), key)

    # a node is (conv, depth) from here on
    parents = nodes.select(F.col("conv").alias("up"), (F.col("depth") + 1).alias("d"), F.col("p1").alias("o1"), F.col("p2").alias("o2"))
    rows = nodes.join(parents, (F.col("depth") == F.col("d")) & (F.col("q1") == F.col("o1")) & (F.col("q2") == F.col("o2")), "left").drop("d", "o1", "o2")
    rows = materialize(join_carry(rows, digests, key).drop("p1", "p2", "q1", "q2"), "tree")
    children = rows.where("up IS NOT NULL").groupBy(F.col("up").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    rows = join_carry(rows, children, ["conv", "depth"]).fillna(0, ["n_children", "n_ends"])
    rows = rows.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("n_bytes")})
    rows = materialize(rows, "tree")
    top = F.col("up").isNull() | (F.col("up") != F.col("conv"))
    paths = rows.groupBy("conv").agg(F.min(F.when(top, F.struct("depth", "up"))).alias("top"), F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    paths = _path_sums(paths.select("conv", F.col("top.up").alias("up"), (F.col("top.depth") - 1).alias("at"), "leaf", "saved"), ["leaf", "saved"])
    hung = paths.where("up IS NOT NULL").groupBy(F.col("up").alias("conv"), F.col("at").alias("depth")).agg(F.sum("leaf").alias("more_leaf"), F.sum("saved").alias("more_saved"))
    rows = join_carry(rows, hung, ["conv", "depth"]).withColumn("back", -F.col("depth"))
    sums = {m: ("sum", F.col(c) + F.coalesce(f"more_{c}", F.lit(0))) for m, c in (("n_leaves", "leaf"), ("saved_tokens", "saved"))}
    rows = running(rows, ["conv"], "back", sums)
    return rows.select(
        F.col("conv").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends",
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """:func:`prefix_trie` of a table of turns, see :func:`numbered_turns`."""
    turns = numbered_turns(conversations, conv_col, turn_col, role_col, text_col)
    return prefix_trie(turns, turns.where("depth = 1").select("conv"), block)
