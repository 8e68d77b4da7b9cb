"""URL filters: a trie over reversed host labels and path segments, the longest rule wins.

A rule is ``(verdict, host, path)`` with verdict ``allow`` or ``block``. It fits its host and all
subdomains, if the path of the url starts with the rule's. The rule with more host labels wins, then
the one with the longer path; of two equal rules the blocking one holds. Rules are broadcast in
tries of at most ``TRIE_RULES`` rules each; a longer list makes several tries, one after the other,
and the longest match over all of them counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.frames import unused

TRIE_RULES = 50_000  # 100 bytes or so each: a broadcast of a few MB
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

Rule = tuple[str, str, str]


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    if url is None:
        return "", ""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for i in (tail.find(c) for c in "?#") if i >= 0), default=len(tail))
    return rest[:end].translate(_LOWER), tail[:stop]


class Trie:
    """Host nodes by label from the right; each may have a tree of path segments.

    The last segment of a rule's path may end inside a segment of the url, so it is kept apart: by
    length and text, below the node of the segments before it.
    """

    def __init__(self, rules: Iterable[tuple[int, Rule]]):
        self.root: dict = {}
        for number, (verdict, host, path) in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(("host", label), {})
            *whole, last = path.split("/")
            node = node.setdefault("paths", {})
            for segment in whole:
                node = node.setdefault(("segment", segment), {})
            ends = node.setdefault("ends", {}).setdefault(len(last), {})
            held = ends.get(last)
            if held is None or (verdict == "block", number) > (held[1] == "block", held[0]):
                ends[last] = (number, verdict)

    def longest(self, host: str, path: str) -> tuple[int, int, int]:
        """Host labels and path length of the longest fitting rule, and its number; -1 without one."""
        best = (-1, -1, -1)
        node, labels = self.root, 0
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(("host", label))
            if node is None:
                break
            labels += 1
            below, length = node.get("paths"), 0
            for segment in segments if below is not None else ():
                for size, ends in below.get("ends", {}).items():
                    hit = ends.get(segment[:size]) if size <= len(segment) else None
                    if hit is not None:
                        best = max(best, (labels, length + size, hit[0]))
                length += len(segment) + 1
                below = below.get(("segment", segment))
                if below is None:
                    break
        return best


def _matcher(spark: SparkSession, rules: Sequence[Rule]):
    """A column function: the longest match among ``rules``, best first when compared as a struct."""
    shared = spark.sparkContext.broadcast((Trie(enumerate(rules)), [(h + p, v) for v, h, p in rules]))

    @F.pandas_udf("labels int, length int, blocks boolean, rule string, verdict string, host string, path string")
    def look(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie, names = shared.value
        for urls in parts:
            rows = []
            for u in urls:
                host, path = split_url(u)
                labels, length, number = trie.longest(host, path)
                rule, verdict = names[number] if number >= 0 else (None, None)
                rows.append((labels, length, verdict == "block", rule, verdict, host, path))
            yield pd.DataFrame(rows, columns=["labels", "length", "blocks", "rule", "verdict", "host", "path"])

    return look


def url_verdicts(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url", default: str = "allow", per_trie: int = TRIE_RULES) -> DataFrame:
    """``pages`` with the columns ``host``, ``path``, ``rule`` (as ``host`` + ``path``) and ``verdict``.

    A url that is NULL, empty or without ``://`` has an empty host and path and no rule. Without a
    rule the verdict is ``default`` and ``rule`` is NULL. Rows repeat as they come. Columns of
    ``pages`` with one of the four names are replaced.
    """
    spark = pages.sparkSession
    rules = list(rules)
    found: Column | None = None
    for at in range(0, max(len(rules), 1), per_trie):
        here = _matcher(spark, rules[at : at + per_trie])(F.col(url_col))
        found = here if found is None else F.greatest(found, here)
    match = unused(pages, "match")
    out = pages.withColumn(match, found)
    return out.withColumns(
        {
            "host": F.col(f"`{match}`.host"),
            "path": F.col(f"`{match}`.path"),
            "rule": F.col(f"`{match}`.rule"),
            "verdict": F.coalesce(F.col(f"`{match}`.verdict"), F.lit(default)),
        }
    ).drop(match)
