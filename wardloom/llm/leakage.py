"""Evaluation passages inside corpus documents, found by Wu-Manber multi-pattern search (problem 8).

Words are runs of letters or digits, compared case-folded; everything between them is one blank. An item of n words
leaks if a run of at least half of them stands unbroken in a document. Any such run holds, whole, at least one of the
item's consecutive word blocks of ``(ceil(n/2) + 1) // 2`` words, so those blocks are the search patterns: the shift table
skips positions where none can end, the suffix bucket selects the blocks that may end there, and direct comparison
confirms them and grows the run word by word in both directions.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.session import spread

WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.casefold()) if text else []


class WuManber:
    """Exact search for many patterns at once; ``block`` characters decide each shift."""

    def __init__(self, patterns: list[str], block: int = 6):
        self.patterns = patterns
        self.m = min(map(len, patterns))
        self.block = b = min(block, self.m)
        self.far = self.m - b + 1
        self.shift: dict[str, int] = {}
        self.bucket: dict[str, list[int]] = defaultdict(list)
        for k, p in enumerate(patterns):
            for j in range(b, self.m + 1):
                key = p[j - b : j]
                self.shift[key] = min(self.shift.get(key, self.far), self.m - j)
            self.bucket[p[self.m - b : self.m]].append(k)

    def find(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, pattern index) of each occurrence."""
        shift, far, b, m, n = self.shift.get, self.far, self.block, self.m, len(text)
        end = m
        while end <= n:
            key = text[end - b : end]
            step = shift(key, far)
            if step:
                end += step
                continue
            start = end - m
            for k in self.bucket[key]:
                if text.startswith(self.patterns[k], start):
                    yield start, k
            end += 1


class ItemSearch:
    """The blocks of a set of items, in one search table for each class of block length, so that a short item doesn't shorten all shifts."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items: list[tuple[int, list[str], int]] = []
        by_class: dict[int, dict[str, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            w = words(text)
            if not w:
                continue
            need = math.ceil(len(w) / 2)
            size = max(1, (need + 1) // 2)
            at = len(self.items)
            self.items.append((item_id, w, need))
            for first in range(0, len(w) - size + 1, size):
                pattern = f" {' '.join(w[first : first + size])} "
                by_class[min(len(pattern) // 16, 3)][pattern].append((at, first))
        self.engines = [(WuManber(list(p)), list(p.values())) for p in by_class.values()]

    def search(self, text: str | None) -> set[int]:
        w = words(text)
        found: set[int] = set()
        if not w:
            return found
        joined = f" {' '.join(w)} "
        for engine, owners in self.engines:
            here = at_sign = 0
            for start, k in engine.find(joined):  # from left to right, so blanks are counted once
                here += joined.count(" ", at_sign, start)
                at_sign = start
                for at, first in owners[k]:
                    item_id, iw, need = self.items[at]
                    if item_id not in found and self._run(w, here, iw, first) >= need:
                        found.add(item_id)
        return found

    @staticmethod
    def _run(w: list[str], i: int, iw: list[str], j: int) -> int:
        """Length of the common run of both word lists through position ``i`` of one and ``j`` of the other."""
        left = 0
        while i - left > 0 and j - left > 0 and w[i - left - 1] == iw[j - left - 1]:
            left += 1
        right = 0
        while i + right < len(w) and j + right < len(iw) and w[i + right] == iw[j + right]:
            right += 1
        return left + right


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_items: int = 20_000) -> DataFrame:
    """(doc_id, item_id) of each document that holds at least half of an item's words as one run.

    The items are the stated query set: they go to the executors in blocks of ``block_items``, one scan of the documents a
    block; a block's tables are bounded by it. Null or wordless texts and items match nothing; repeated rows count once.
    """
    q = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").distinct()
    blocks = max(1, math.ceil(q.count() / block_items))
    corpus = spread(docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("d is not null and t is not null"))
    out = None
    for b in range(blocks):
        part = q if blocks == 1 else q.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        rows = [(r.i, r.t) for r in part.collect()]  # at most about block_items

        def run(batches: Iterator[pd.DataFrame], rows=rows) -> Iterator[pd.DataFrame]:
            search = ItemSearch(rows)
            for x in batches:
                hits = [(d, i) for d, t in zip(x["d"], x["t"]) for i in search.search(t)]
                yield pd.DataFrame(hits, columns=["doc_id", "item_id"])

        kinds = dict(q.dtypes)["i"]
        hit = corpus.mapInPandas(run, f"doc_id {dict(corpus.dtypes)['d']}, item_id {kinds}")
        out = hit if out is None else out.unionByName(hit)
    return out.dropDuplicates(["doc_id", "item_id"])
