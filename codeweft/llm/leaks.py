"""Held-out test items that occur in a corpus: pigeonhole edit matching.

A passage is a window of ``window`` consecutive words of an item (the whole
item if it is shorter), found with at most ``errors`` word edits.  A grid of
pieces of ``(window + 1) // (errors + 2)`` words lies over each item, so that
any window holds errors + 1 whole pieces: of a passage with at most ``errors``
edits at least one piece occurs unchanged.  Exact piece hits are looked up by
rolling keys over whole texts; each hit's diagonal is then verified, exact runs
by extension, passages with edits by Myers' bit-parallel distance over words.

The corpus is read once per block of items and never shuffled; only the found
(document, item) pairs are.  A block of items is broadcast; its size is bounded
by ``BLOCK_CHARS`` (the number of blocks follows from the measured size).

Words are maximal runs of Unicode letters and digits in lower case.  Null texts
and items without a word are no cases; repeated rows of a key count once.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS = 8_000_000
_word = re.compile(r"[^\W_]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    return _word.findall(text.lower())


def distance(pattern: list[int], text: list[int], most: int) -> int:
    """Least edit distance of ``pattern`` to any stretch of ``text``, or most + 1.

    Myers' bit-vector algorithm, one bit for each word of the pattern.
    """
    m = len(pattern)
    peq: dict[int, int] = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for w in text:
        eq = peq.get(w, 0) if w else 0
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = ph << 1, mh << 1
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv & full
        best = min(best, score)
    return min(best, most + 1)


def _rolling(ids: np.ndarray, m: int) -> np.ndarray:
    keys = np.zeros(len(ids) - m + 1, dtype=np.uint64)
    for k in range(m):
        keys = keys * _MULTIPLIER + ids[k : len(ids) - m + 1 + k]
    return keys


class Index:
    """Pieces of a block of items."""

    def __init__(self, items, window: int, errors: int):
        self.window, self.errors = window, errors
        self.vocabulary: dict[str, int] = {}
        self.items, by_length = [], {}
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if not ids:
                continue
            w = min(window, len(ids))
            m = max(1, (w + 1) // (errors + 2))
            k = len(self.items)
            self.items.append((item_id, ids, w))
            by_length.setdefault(m, []).extend((k, o, ids[o : o + m]) for o in range(0, len(ids) - m + 1, m))
        self.pieces = {}
        for m, pieces in by_length.items():
            keys = np.array([_rolling(np.array(p, dtype=np.uint64), m)[0] for _, _, p in pieces], dtype=np.uint64)
            order = np.argsort(keys, kind="stable")
            self.pieces[m] = (keys[order], [pieces[i][:2] for i in order])

    def search(self, texts: list[str]):
        """(text number, item id, longest exact run, least distance) of each leak."""
        get, ids, starts = self.vocabulary.get, [], []
        for text in texts:
            starts.append(len(ids))
            ids += [get(w, 0) for w in words(text)]
            ids += [0]
        ends = [*starts[1:], len(ids)]
        flat = np.array(ids, dtype=np.uint64)
        found: dict[tuple[int, int], tuple[int, int]] = {}
        done, whole = set(), set()
        for m, (keys, places) in self.pieces.items():
            if len(flat) < m:
                continue
            rolled = _rolling(flat, m)
            at = np.searchsorted(keys, rolled)
            at[at == len(keys)] = 0
            hits = np.nonzero(keys[at] == rolled)[0]
            owner = np.searchsorted(np.array(starts), hits, side="right") - 1
            for p, j, d in zip(hits.tolist(), at[hits].tolist(), owner.tolist()):
                while j < len(keys) and keys[j] == rolled[p]:
                    k, o = places[j]
                    j += 1
                    if (k, p - o) in done or (d, k) in whole:
                        continue
                    item_id, item, w = self.items[k]
                    a, b = p, p + m
                    if ids[a:b] != item[o : o + m]:
                        continue
                    i = o
                    while a > starts[d] and i > 0 and ids[a - 1] == item[i - 1]:
                        a, i = a - 1, i - 1
                    i = o + m
                    while b < ends[d] and i < len(item) and ids[b] == item[i]:
                        b, i = b + 1, i + 1
                    if b - a >= w:
                        done.add((k, p - o))
                    if b - a == len(item):
                        whole.add((d, k))  # no longer run is possible
                    run, least = b - a, 0
                    if run < w:
                        least = self.errors + 1
                        for s in range(max(0, o + m - w), min(o, len(item) - w) + 1):
                            lo, hi = max(starts[d], p - (o - s) - self.errors), min(ends[d], p + (w - (o - s)) + self.errors)
                            least = min(least, distance(item[s : s + w], ids[lo:hi], self.errors))
                            if least <= 1:
                                break
                    if least <= self.errors:
                        old = found.get((d, k), (0, least))
                        found[d, k] = (max(old[0], run), min(old[1], least))
        return [(d, self.items[k][0], run, least, self.items[k][2]) for (d, k), (run, least) in found.items()]


def leaks(documents: DataFrame, items: DataFrame, window: int = 12, errors: int = 1) -> DataFrame:
    """(doc_id, item_id, run, needed, edits): every document an item leaked into.

    ``run`` is the longest run of words shared exactly, ``needed`` the length
    of a passage of the item, ``edits`` the least number of word edits with
    which a passage occurs.
    """
    spark = documents.sparkSession
    items = items.select("item_id", "text").where("text is not null")
    documents = documents.select("doc_id", "text").where("text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_CHARS) or 1
    schema = "doc_id bigint, item_id bigint, run int, needed int, edits int"
    out = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).dropDuplicates(["item_id"]).collect()
        index = spark.sparkContext.broadcast(Index([(r.item_id, r.text) for r in rows], window, errors))

        def search(batches, index=index):
            for batch in batches:
                docs, texts = batch["doc_id"].tolist(), batch["text"].tolist()
                found = index.value.search(texts)
                yield pd.DataFrame(
                    [(docs[d], item, run, need, least) for d, item, run, least, need in found],
                    columns=["doc_id", "item_id", "run", "needed", "edits"],
                )

        part = documents.mapInPandas(search, schema)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.max("run").alias("run"), F.max("needed").alias("needed"), F.min("edits").alias("edits"))
