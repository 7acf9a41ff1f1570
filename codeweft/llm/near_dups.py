"""Near-duplicate records with small edits, by bit-sliced comparison.

Each record becomes the set of its runs of three tokens, and of that set a
min-hash signature.  Records of one kind that agree in a band of ``ROWS``
signature values meet in a bucket; in a bucket they are compared by sketches of
``BITS`` bits (one bit of each of BITS min-hashes), stored vertically: bit plane
b holds bit b of 64 records in a word.  For each record the planes are XORed
with its own bits and added up by carry-save counters, so one word operation
advances 64 distances; a block of records is abandoned as soon as all of its
distances exceed the radius.  Survivors are verified by the sets themselves.

With BANDS bands of ROWS values a pair of similarity s meets with probability
1 - (1 - s^ROWS)^BANDS (s = 0.7: 0.99993); the radius lies five standard
deviations above the mean distance at the threshold.

Equal sets are compared once: records are grouped to classes by their set, and
only one representative of each class takes part.  A bucket may be large (many
records that differ slightly), so it is cut into slices of ``SLICE`` records
and pairs of slices are the unit of work: no task holds more than two slices,
whatever the bucket's size.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm.units import edges, whole_units
from codeweft.storage import materialize

ROWS, BANDS, BITS = 4, 36, 128
SLICE = 2048
_token = re.compile(r"[A-Za-z0-9_]+")
_PRIME = np.uint64((1 << 61) - 1)


def _coefficients():
    rng = np.random.default_rng(20240229)
    n = ROWS * BANDS
    return rng.integers(1, 1 << 32, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 62, n, dtype=np.uint64)


_A, _B = _coefficients()


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of three consecutive tokens."""
    tokens = _token.findall(text)
    if len(tokens) < 3:
        return np.empty(0, dtype=np.int64)
    ids: dict[str, int] = {}
    h = np.array([ids[t] if t in ids else ids.setdefault(t, hash_token(t)) for t in tokens], dtype=np.uint64)
    m = np.uint64(0x9E3779B97F4A7C15)
    x = (h[:-2] * m + h[1:-1]) * m + h[2:]
    x ^= x >> np.uint64(29)
    return np.unique(x.view(np.int64))


def hash_token(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")


def signature(sets: np.ndarray) -> np.ndarray:
    """ROWS * BANDS min-hashes (32 bits each) of one set."""
    x = sets.view(np.uint64)
    x = x ^ (x >> np.uint64(31))
    mixed = x[None, :] * _A[:, None] + _B[:, None]
    mixed ^= mixed >> np.uint64(32)
    return (mixed * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)).min(axis=1).astype(np.uint32)


def radius(threshold: float) -> int:
    p = (1 - threshold) / 2
    return math.floor(BITS * p + 5 * math.sqrt(BITS * p * (1 - p)))


def _planes(sketches: np.ndarray) -> np.ndarray:
    """Bit planes (BITS x words) of n sketches given as n x BITS bits."""
    n = len(sketches)
    padded = np.zeros((-(-n // 64) * 64, sketches.shape[1]), dtype=np.uint8)
    padded[:n] = sketches
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(padded.T), axis=1, bitorder="little")).view(np.uint64)


def within_radius(left: np.ndarray, right: np.ndarray, most: int):
    """(i, j) of bit vectors left[i], right[j] at a Hamming distance <= most.

    ``right`` lies vertically; every left record runs over its planes at once.
    After each 32 planes the counters are compared with the radius bit by bit,
    and left records all of whose words have run out are left behind.
    """
    planes, width = _planes(right), int(left.shape[1]).bit_length()
    n = len(right)
    valid = np.packbits(np.arange(planes.shape[1] * 64) < n, bitorder="little").view(np.uint64)
    out_i, out_j = [], []
    for start in range(0, len(left), 256):
        at = np.arange(start, min(start + 256, len(left)))
        own = np.where(left[at].astype(bool), ~np.uint64(0), np.uint64(0))
        counters = [np.zeros((len(at), planes.shape[1]), dtype=np.uint64) for _ in range(width)]
        alive = np.broadcast_to(valid, (len(at), planes.shape[1]))
        for b in range(0, left.shape[1], 2):
            # carry-save: two planes and the lowest counter give a sum and one carry
            x, y, z = planes[b] ^ own[:, b, None], planes[b + 1] ^ own[:, b + 1, None], counters[0]
            xy = x ^ y
            counters[0], carry = xy ^ z, (x & y) | (xy & z)
            for c in range(1, width):
                counters[c], carry = counters[c] ^ carry, counters[c] & carry
                if c > 3 and not carry.any():
                    break
            if b % 32 == 30:
                # distance > most, compared from the highest counter down
                above, equal = np.zeros_like(alive), np.full_like(alive, ~np.uint64(0))
                for c in reversed(range(width)):
                    if most >> c & 1:
                        equal = equal & counters[c]
                    else:
                        above, equal = above | (equal & counters[c]), equal & ~counters[c]
                alive = valid & ~above
                keep = alive.any(axis=1)
                if not keep.any():
                    break
                if not keep.all():
                    at, own, alive = at[keep], own[keep], alive[keep]
                    counters = [c[keep] for c in counters]
        else:
            i, bit = np.nonzero(np.unpackbits(np.ascontiguousarray(alive).view(np.uint8), axis=1, bitorder="little"))
            out_i.append(at[i])
            out_j.append(bit)
    if not out_i:
        return np.empty(0, dtype=int), np.empty(0, dtype=int)
    return np.concatenate(out_i), np.concatenate(out_j)


def class_table(records: DataFrame, least: int) -> DataFrame:
    """(id, kind, class_id, shingles) of the records with at least ``least`` runs.

    ``class_id`` is a 128-bit digest of kind and set: records of one class have
    similarity 1.  ``records`` has id, kind (null is a kind of its own) and text.
    """

    def build(batches):
        for batch in batches:
            out = []
            for i, kind, text in zip(batch["id"], batch["kind"], batch["text"]):
                s = shingles(text)
                if len(s) >= least:
                    digest = hashlib.blake2b((kind or "\0").encode() + b"\0" + s.tobytes(), digest_size=16).hexdigest()
                    out.append((i, kind, digest, s))
            yield pd.DataFrame(out, columns=["id", "kind", "class_id", "shingles"])

    return records.select("id", "kind", "text").mapInPandas(build, "id bigint, kind string, class_id string, shingles array<bigint>")


def similar_classes(classes: DataFrame, threshold: float) -> DataFrame:
    """(class_a, class_b, similarity) of different classes of one kind, class_a < class_b.

    ``classes`` has one row for each class: class_id and shingles.
    """
    spark = classes.sparkSession

    def bands(batches):
        for batch in batches:
            keys, ids, bits = [], [], []
            for class_id, kind, s in zip(batch["class_id"], batch["kind"], batch["shingles"]):
                sig = signature(np.asarray(s))
                sketch = np.packbits((sig[:BITS] & np.uint32(1)).astype(np.uint8)).tobytes()
                salt = hash_token(kind or "\0")
                for b in range(BANDS):
                    band = hashlib.blake2b(sig[b * ROWS : (b + 1) * ROWS].tobytes() + salt.to_bytes(8, "little") + bytes([b]), digest_size=8)
                    keys.append(int.from_bytes(band.digest(), "little", signed=True))
                    ids.append(class_id)
                    bits.append(sketch)
            yield pd.DataFrame({"band": keys, "class_id": ids, "sketch": bits})

    banded = materialize(
        classes.select("class_id", "kind", "shingles").mapInPandas(bands, "band bigint, class_id string, sketch binary")
    )
    sizes = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    # slice s of a bucket meets each slice t >= s; a bucket of one slice is one unit
    slices = F.ceil(F.col("n") / SLICE).cast("int")
    members = banded.join(sizes, "band").withColumns({"slices": slices, "slice": F.pmod(F.xxhash64("class_id"), F.ceil(F.col("n") / SLICE)).cast("int")})
    members = members.withColumn(
        "unit",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.col("slices") - 1),
                lambda t: F.struct(F.least("slice", t).alias("s"), F.greatest("slice", t).alias("t")),
            )
        ),
    ).select("band", "unit.s", "unit.t", "slice", "class_id", "sketch")
    most = radius(threshold)

    def compare(batches):
        for rows in whole_units(batches, ["band", "s", "t"]):
            yield _units(rows, most)

    near = (
        members.repartition("band", "s", "t").sortWithinPartitions("band", "s", "t").mapInPandas(compare, "class_a string, class_b string").distinct()
    )
    sets = classes.select("class_id", "shingles")
    a = sets.withColumnsRenamed({"class_id": "class_a", "shingles": "set_a"})
    b = sets.withColumnsRenamed({"class_id": "class_b", "shingles": "set_b"})
    common = F.size(F.array_intersect("set_a", "set_b"))
    return (
        near.join(a, "class_a").join(b, "class_b")
        .withColumn("common", common)
        .withColumn("similarity", F.col("common") / (F.size("set_a") + F.size("set_b") - F.col("common")))
        .where(F.col("similarity") >= threshold)
        .select("class_a", "class_b", "similarity")
    )


def _units(rows: pd.DataFrame, most: int) -> pd.DataFrame:
    """Pairs within the radius of whole units (band, s, t)."""
    a, b = [], []
    band, s, t = (rows[c].to_numpy() for c in ("band", "s", "t"))
    ends = edges([band, s, t])
    ids, slices = rows["class_id"].to_numpy(), rows["slice"].to_numpy()
    bits = np.unpackbits(np.frombuffer(b"".join(rows["sketch"]), dtype=np.uint8).reshape(len(rows), -1), axis=1)
    for lo, hi in zip(ends[:-1], ends[1:]):
        if hi - lo < 2:
            continue
        if hi - lo == 2 and s[lo] == t[lo]:
            if int((bits[lo] != bits[lo + 1]).sum()) <= most:
                a.append(ids[lo])
                b.append(ids[lo + 1])
            continue
        left = np.arange(lo, hi)[slices[lo:hi] == s[lo]]
        right = np.arange(lo, hi)[slices[lo:hi] == t[lo]]
        i, j = within_radius(bits[left], bits[right], most)
        keep = left[i] != right[j]
        a.extend(ids[left[i[keep]]])
        b.extend(ids[right[j[keep]]])
    out = pd.DataFrame({"class_a": a, "class_b": b}, dtype=object)
    swap = out["class_a"] > out["class_b"]
    out.loc[swap, ["class_a", "class_b"]] = out.loc[swap, ["class_b", "class_a"]].to_numpy()
    return out.drop_duplicates()


def node_records(nodes: DataFrame) -> DataFrame:
    """(id, kind, text) of code nodes: signature (null = empty), line feed, body."""
    return (
        nodes.dropDuplicates(["node_id"])
        .where("node_id is not null")
        .select(
            F.col("node_id").alias("id"), "kind",
            F.concat(F.coalesce("signature", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit(""))).alias("text"),
        )
    )


def near_duplicates(records: DataFrame, threshold: float = 0.8, least: int = 1):
    """(members, links): members has id and class_id of every record with enough
    runs, links has class_a, class_b and similarity of classes that differ.
    """
    table = materialize(class_table(records, least))
    classes = table.groupBy("class_id").agg(F.first("kind").alias("kind"), F.first("shingles").alias("shingles"))
    return table.select("id", "class_id"), similar_classes(materialize(classes), threshold)


def copy_pairs(members: DataFrame, rows: int = 4096) -> DataFrame:
    """(a, b), a < b, of the records of one class.

    A large class is cut: the left side by a salt, the right side repeated for
    each salt, so that no task pairs more than ``rows`` records with the class.
    """
    sizes = members.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1")
    several = members.join(sizes, "class_id").withColumn("cuts", F.ceil(F.col("n") / rows).cast("int"))
    a = several.select("class_id", F.col("id").alias("a"), F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int").alias("salt"))
    b = several.select("class_id", F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("salt"))
    return a.join(b, ["class_id", "salt"]).where("a < b").select("a", "b")
