"""Character trigram models over hashed counts of fixed size."""

from __future__ import annotations

from collections import Counter

import numpy as np

BUCKETS = 1 << 18
#: one more place than buckets: the number of characters
TOTAL = BUCKETS
EDGE = "\x02\x02"


def mix(*codes: np.ndarray, salt: int = 0) -> np.ndarray:
    x = np.full(codes[0].shape, len(codes) + 8 * salt, dtype=np.uint64)
    for c in codes:
        x = (x ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return (x & np.uint64(BUCKETS - 1)).astype(np.int64)


def grams(texts: list[str]):
    """Of many texts at once: (text number, character codes, places of characters and ends)."""
    codes = np.frombuffer("".join(EDGE + s + "\x03" for s in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(s) + 3 for s in texts])
    owner = np.repeat(np.arange(len(texts)), lengths)
    inner = np.ones(len(codes), dtype=bool)
    starts = np.cumsum(lengths) - lengths
    inner[starts] = inner[starts + 1] = False
    at = np.flatnonzero(inner)
    return owner[at], codes, at


def add(sums: np.ndarray, texts: Counter, salt: int = 0) -> None:
    """Add the 1-, 2- and 3-grams of texts (with their numbers, negative to take away)."""
    names = list(texts)
    if names:
        owner, codes, at = grams(names)
        n = np.array([texts[t] for t in names], dtype=float)
        weight, x, y, z = n[owner], codes[at - 2], codes[at - 1], codes[at]
        for slots in (mix(z, salt=salt), mix(y, z, salt=salt), mix(x, y, z, salt=salt)):
            sums[:BUCKETS] += np.bincount(slots, weight, BUCKETS)
        edge = np.array([2])
        sums[mix(edge, salt=salt)] += n.sum()
        sums[mix(edge, edge, salt=salt)] += n.sum()
        sums[TOTAL] += weight.sum()


def logs(counts: np.ndarray, texts: list[str], salt: int = 0) -> np.ndarray:
    """Natural log probability of each text, by interpolated trigrams."""
    if not texts:
        return np.zeros(0)
    owner, codes, at = grams(texts)
    x, y, z = codes[at - 2], codes[at - 1], codes[at]
    p = (counts[mix(z, salt=salt)] + 0.01) / (max(1.0, counts[TOTAL]) + 0.01 * 1e5)
    p = (counts[mix(y, z, salt=salt)] + 2 * p) / (counts[mix(y, salt=salt)] + 2)
    p = (counts[mix(x, y, z, salt=salt)] + p) / (counts[mix(x, y, salt=salt)] + 1)
    return np.bincount(owner, np.log(np.clip(p, 1e-12, 1)), len(texts))
