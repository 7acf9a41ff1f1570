"""The k most similar vectors of every vector: inverted lists with an adaptive
dimension scan.

Vectors are normalised and turned by one fixed random rotation, so that their
first columns are a fair sample of all.  A k-means codebook, fitted on a bounded
sample, gives the lists; every vector is a member of its nearest list and looks
for neighbours in the ``PROBES`` nearest ones.  In a list the columns are read
in blocks; after each block a hypothesis test on the partial distance abandons
the candidates that can hardly come within the current k-th distance.

Bounds.  The first ``COARSE`` centres are fitted on at most ``SAMPLE`` vectors.
Where the rows need more lists, each coarse cell is divided by centres fitted in
it, on at most ``CELL_SAMPLE`` rows a centre, as a Spark job; lists then hold
``FINE_ROWS`` rows on average, so that work and shuffle follow the rows.  What is
broadcast are the centres, ``MOST_LISTS`` at most (64 MB for 64 numbers), which
is a billion rows; beyond that lists grow.  Every row is indexed.  A list may
hold any share of the rows: it is cut into member blocks and query blocks, and a
pair of blocks is the unit of work.
Exact copies are searched once, by a representative; a class of copies keeps
its k + 1 least keys, which is all a result can need.

Only vectors of exactly ``dim`` finite numbers that are not all zero take part;
repeated rows of a key count once; null keys are left out.  Equal distances are
ordered by key.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.llm.units import edges, whole_units
from codeweft.storage import materialize

SAMPLE = 65_536
LIST_ROWS, FINE_ROWS = 500, 4000
COARSE, MOST_LISTS, CELL_SAMPLE = 1024, 1 << 18, 64
PROBES, CELLS_PROBED = 4, 8
MEMBERS, QUERIES = 4096, 16_384
COLUMNS = (0, 16, 32, 64)
EPSILON = 2.1
#: numbers are kept as 16-bit fixed point: an error of 1.5e-5 at half the bytes
SCALE = 32767


def _floats(packed, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype=np.int16).reshape(-1, dim).astype(np.float32) / SCALE


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def valid_vectors(df: DataFrame, key, vector, dim: int) -> DataFrame:
    """(key, vector) of the vectors that take part."""
    big = F.lit(float("inf"))
    v = F.col("vector")
    return (
        df.select(key.alias("key"), vector.alias("vector"))
        .where(F.col("key").isNotNull() & (F.size("vector") == dim))
        .where(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == big)) & F.exists(v, lambda x: x != 0))
    )


def _classes(vectors: DataFrame, dim: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(key, id) of all records, and (id, vec, firsts) of the distinct vectors."""
    turn = rotation(dim)

    def unit(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = np.array(batch["vector"].tolist(), dtype=np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            x = x @ turn
            packed = [row.tobytes() for row in np.rint(x * SCALE).astype(np.int16)]
            ids = [int.from_bytes(hashlib.blake2b(p, digest_size=8).digest(), "little", signed=True) for p in packed]
            yield pd.DataFrame({"key": batch["key"], "id": ids, "vec": packed})

    table = materialize(vectors.mapInPandas(unit, "key string, id bigint, vec binary"))

    def firsts(batches):
        # combine within a batch, so that a hot class sends a few keys a batch
        for batch in batches:
            first = batch.sort_values("key").groupby("id", sort=False)
            yield pd.DataFrame(
                [(i, g["vec"].iloc[0], g["key"].drop_duplicates().tolist()[: k + 1]) for i, g in first], columns=["id", "vec", "firsts"]
            ) if len(batch) else batch.assign(firsts=None)[["id", "vec", "firsts"]]

    # most classes have one record: only ids that repeat go through Python
    counts = table.groupBy("id").agg(F.count("*").alias("n"), F.min("key").alias("key"), F.first("vec").alias("vec"))
    single = counts.where("n = 1").select("id", "vec", F.array("key").alias("firsts"))
    repeated = table.join(counts.where("n > 1").select("id"), "id", "left_semi")
    several = repeated.mapInPandas(firsts, "id bigint, vec binary, firsts array<string>").groupBy("id").agg(
        F.first("vec").alias("vec"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("firsts")))), 1, k + 1).alias("firsts")
    )
    return table.select("key", "id").distinct(), materialize(single.unionByName(several))


def codebook(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means centres of a bounded sample."""
    rng = np.random.default_rng(11)
    centres = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([np.argmax(sample[i : i + 8192] @ centres.T, axis=1) for i in range(0, len(sample), 8192)])
        order = np.argsort(own, kind="stable")
        starts = np.searchsorted(own[order], np.arange(lists))
        sums = np.add.reduceat(sample[order], np.minimum(starts, len(sample) - 1), axis=0)
        sums[np.bincount(own, minlength=lists) == 0] = sample[rng.integers(len(sample))]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centres.astype(np.float32)


def _survivors(q, m, part, bound, cuts, factor, k):
    """(query, member, squared distance) of the candidates within ``bound``.

    While many candidates are left a block of columns is one product of matrices
    over the queries and members that still have any; the rest are read singly.
    """
    rows, columns, hi = np.arange(len(q)), np.arange(len(m)), cuts[1]
    for lo, up in zip(cuts[1:-1], cuts[2:]):
        alive = part <= (bound[rows] * factor[hi])[:, None]
        if np.count_nonzero(alive) < 0.02 * alive.size:
            break
        keep, hold = alive.any(axis=1), alive.any(axis=0)
        if keep.mean() < 0.8 or hold.mean() < 0.8:
            rows, columns, part, alive = rows[keep], columns[hold], part[np.ix_(keep, hold)], alive[np.ix_(keep, hold)]
        a, b = q[rows, lo:up], m[columns, lo:up]
        part = part + (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * (a @ b.T)
        hi = up
    if hi == cuts[-1] and part.shape[1] > k:
        # all columns are read: k of each query are enough
        j = np.argpartition(part, k - 1, axis=1)[:, :k]
        d = np.take_along_axis(part, j, axis=1)
        i, at = np.nonzero(d <= bound[rows][:, None])
        j, d = j[i, at], d[i, at]
    else:
        i, j = np.nonzero(part <= (bound[rows] * factor[hi])[:, None])
        d = part[i, j]
    i, j = rows[i], columns[j]
    finite = np.isfinite(d)
    i, j, d = i[finite], j[finite], d[finite]
    for lo, up in zip(cuts[1:-1], cuts[2:]):
        if lo >= hi:
            d = d + ((q[i, lo:up] - m[j, lo:up]) ** 2).sum(1)
            keep = d <= bound[i] * factor[up]
            i, j, d = i[keep], j[keep], d[keep]
    return i, j, d


def scan(queries: np.ndarray, members: np.ndarray, own: np.ndarray, k: int, columns=COLUMNS, epsilon: float = EPSILON):
    """(distances, members) of the k nearest of each query, inf and -1 where there are fewer.

    ``own`` is the query's own place among the members, or -1.  Squared
    distances grow block of columns by block; a candidate is abandoned when its
    partial distance, scaled to all columns, exceeds the k-th best so far by
    the factor (1 + epsilon / sqrt(columns read)).
    """
    n, dim = queries.shape
    best_d, best_i = np.full((n, k), np.inf, dtype=np.float32), np.full((n, k), -1)
    cuts = [c for c in columns if c < dim] + [dim]
    hi = cuts[1]
    factor = {c: (c / dim) * (1 + epsilon / np.sqrt(c)) ** 2 if c < dim else 1.0 for c in cuts[1:]}
    for q0 in range(0, n, 1024):
        q, mine = queries[q0 : q0 + 1024], own[q0 : q0 + 1024]
        top_d, top_i = best_d[q0 : q0 + 1024], best_i[q0 : q0 + 1024]
        norms = (q[:, :hi] ** 2).sum(1)[:, None]
        for m0 in range(0, len(members), 1024):
            m = members[m0 : m0 + 1024]
            part = norms + (m[:, :hi] ** 2).sum(1)[None, :] - 2 * (q[:, :hi] @ m[:, :hi].T)
            inside = np.flatnonzero((mine >= m0) & (mine < m0 + len(m)))
            part[inside, mine[inside] - m0] = np.inf
            # the nearest by the first block give a bound for all others
            seeds = np.argpartition(part, k - 1, axis=1)[:, :k] if len(m) > k else np.broadcast_to(np.arange(len(m)), (len(q), len(m)))
            full = np.take_along_axis(part, seeds, axis=1) + ((q[:, None, hi:] - m[seeds][:, :, hi:]) ** 2).sum(2)
            bound = np.sort(np.concatenate([top_d, full], axis=1), axis=1)[:, k - 1] * (1 + 1e-5) + 1e-6
            i, j, d = _survivors(q, m, part, bound, cuts, factor, k)
            old = np.flatnonzero(top_i >= 0)
            rows = np.concatenate([i, old // k])
            dist = np.concatenate([np.maximum(d, 0), top_d.ravel()[old]])
            place = np.concatenate([j + m0, top_i.ravel()[old]])
            order = np.lexsort((place, dist, rows))
            rows, dist, place = rows[order], dist[order], place[order]
            rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
            keep = rank < k
            top_d[rows[keep], rank[keep]], top_i[rows[keep], rank[keep]] = dist[keep], place[keep]
    return best_d, best_i


class Codebook:
    """Coarse centres, each with the fine centres of its cell; a list is a fine centre."""

    def __init__(self, coarse: np.ndarray, fine: dict[int, np.ndarray]):
        self.coarse = coarse
        cells = [fine.get(c, coarse[c : c + 1]) for c in range(len(coarse))]
        self.starts = np.cumsum([0, *map(len, cells)])
        self.centres = np.concatenate(cells)

    def __len__(self) -> int:
        return len(self.centres)

    def probed(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The nearest lists of each vector, the nearest first, -1 where there are fewer."""
        p = min(probes, len(self))
        if len(self) == len(self.coarse):
            score = x @ self.centres.T
            near = np.argpartition(-score, p - 1, axis=1)[:, :p]
            return np.take_along_axis(near, np.argsort(-np.take_along_axis(score, near, axis=1), axis=1, kind="stable"), axis=1)
        score = x @ self.coarse.T
        c = min(CELLS_PROBED, len(self.coarse))
        cells = np.argpartition(-score, c - 1, axis=1)[:, :c]
        order = np.argsort(cells, axis=None, kind="stable")
        cell, row = cells.ravel()[order], order // c
        rows, lists, scores = [], [], []
        for lo, hi in zip((cut := edges([cell]))[:-1], cut[1:]):
            a, b = self.starts[cell[lo]], self.starts[cell[lo] + 1]
            own = x[row[lo:hi]] @ self.centres[a:b].T
            k = min(p, b - a)
            best = np.argpartition(-own, k - 1, axis=1)[:, :k]
            rows.append(np.repeat(row[lo:hi], k))
            lists.append(a + best.ravel())
            scores.append(np.take_along_axis(own, best, axis=1).ravel())
        rows, lists, scores = map(np.concatenate, (rows, lists, scores))
        order = np.lexsort((lists, -scores, rows))
        rows, lists = rows[order], lists[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        out = np.full((len(x), p), -1)
        out[rows[rank < p], rank[rank < p]] = lists[rank < p]
        return out


def fine_centres(classes: DataFrame, coarse: np.ndarray, lists: int, n: int, dim: int) -> dict[int, np.ndarray]:
    """Centres of each coarse cell, in proportion to its rows; fitted by Spark, cell by cell."""
    shared = classes.sparkSession.sparkContext.broadcast(coarse)
    step = max(1, n // (lists * CELL_SAMPLE))

    def assign(batches):
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"cell": np.argmax(_floats(batch["vec"], dim) @ shared.value.T, axis=1).astype(np.int32), "id": batch["id"], "vec": batch["vec"]})

    picked = classes.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(step)) == 0).mapInPandas(assign, "cell int, id bigint, vec binary")
    most = 16 * CELL_SAMPLE * -(-lists // len(coarse))  # no cell's sample outgrows a task
    rank = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("id"), "id"))
    whole = picked.groupBy("cell").agg(F.count("*").alias("rows"))
    bounded = picked.withColumn("rank", rank).where(F.col("rank") <= most).join(F.broadcast(whole), "cell")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        k = max(1, min(len(group) // 8, round(group["rows"].iloc[0] / CELL_SAMPLE)))
        centres = codebook(_floats(group["vec"], dim), k)
        return pd.DataFrame({"cell": group["cell"].iloc[0], "centre": [c.tobytes() for c in centres]})

    found = bounded.groupBy("cell").applyInPandas(fit, "cell int, centre binary").toPandas()
    return {int(c): np.stack([np.frombuffer(x, dtype=np.float32) for x in g["centre"]]) for c, g in found.groupby("cell")}


def nearest(classes: DataFrame, dim: int, k: int, probes: int = PROBES, list_rows: int = LIST_ROWS, coarse: int = COARSE, fine_rows: int = FINE_ROWS) -> DataFrame:
    """(id, found): the k nearest other distinct vectors as array<struct<d, id>>."""
    spark = classes.sparkSession
    n = classes.count()
    step = max(1, -(-n // SAMPLE))
    picked = classes.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).select("vec").limit(2 * SAMPLE).toPandas()["vec"]
    sample = _floats(picked, dim)
    first = int(min(max(1, n // list_rows), max(1, len(sample) // 64), coarse)) if len(sample) else 1
    book = Codebook(codebook(sample, first) if len(sample) else np.zeros((1, dim), dtype=np.float32), {})
    lists = min(MOST_LISTS, n // fine_rows)
    if lists > first:
        book = Codebook(book.coarse, fine_centres(classes, book.coarse, lists, n, dim))
    centres = spark.sparkContext.broadcast(book)

    def probed(packed) -> np.ndarray:
        return centres.value.probed(_floats(packed, dim), probes)

    def tally(batches):
        m, q = np.zeros(len(centres.value), dtype=np.int64), np.zeros(len(centres.value), dtype=np.int64)
        for batch in batches:
            if len(batch):
                near = probed(batch["vec"])
                m += np.bincount(near[:, 0], minlength=len(m))
                q += np.bincount(near[near >= 0], minlength=len(q))
        at = np.flatnonzero(q)
        yield pd.DataFrame({"list": at.astype(np.int32), "m": m[at], "q": q[at]})

    # at most MOST_LISTS rows; the assignment itself is cheaper to repeat than to store
    sizes = classes.select("vec").mapInPandas(tally, "list int, m bigint, q bigint").groupBy("list").agg(F.sum("m"), F.sum("q")).collect()
    blocks = np.ones((len(book), 2), dtype=np.int64)
    for number, m, q in sizes:
        blocks[number] = max(1, -(-m // MEMBERS)), max(1, -(-q // QUERIES))
    blocks = spark.sparkContext.broadcast(blocks)

    def send(batches):
        # a member goes to its block for each query block, a query to each member
        # block; in a list of one block a member row serves as a query too
        for batch in batches:
            if not len(batch):
                continue
            near, ids, vec = probed(batch["vec"]), batch["id"].to_numpy(), batch["vec"].to_numpy()
            for r in range(near.shape[1]):
                mb, qb = blocks.value[near[:, r]].T
                one = (mb == 1) & (qb == 1)
                block_m, block_q = ids % mb, ids // 7 % qb
                for role in ("member", "query"):
                    if role == "member" and r:
                        continue
                    times = np.where(near[:, r] < 0, 0, qb if role == "member" else np.where(one & (r == 0), 0, mb))
                    at = np.repeat(np.arange(len(ids)), times)
                    turn = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                    yield pd.DataFrame(
                        {
                            "list": near[at, r].astype(np.int32),
                            "m": (block_m[at] if role == "member" else turn).astype(np.int32),
                            "q": (turn if role == "member" else block_q[at]).astype(np.int32),
                            "role": np.where(one[at] & (role == "member"), 2, int(role == "query")).astype(np.int8),
                            "id": ids[at], "vec": vec[at],
                        }
                    )

    def search(batches):
        for rows in whole_units(batches, ["list", "m", "q"]):
            ends = edges([rows[c].to_numpy() for c in ("list", "m", "q")])
            role, ids, x = rows["role"].to_numpy(), rows["id"].to_numpy(), _floats(rows["vec"], dim)
            for lo, hi in zip(ends[:-1], ends[1:]):
                at = np.arange(lo, hi)
                m, q = at[role[lo:hi] != 1], at[role[lo:hi] != 0]
                if not len(m) or not len(q):
                    continue
                order = np.argsort(ids[m])
                place = np.minimum(np.searchsorted(ids[m], ids[q], sorter=order), len(m) - 1)
                own = np.where(ids[m][order[place]] == ids[q], order[place], -1)
                d, i = scan(x[q], x[m], own, k)
                count = (i >= 0).sum(1)
                near = ids[m][np.maximum(i, 0)]
                yield pd.DataFrame({"id": ids[q], "d": [a[:c] for a, c in zip(d, count)], "near": [a[:c] for a, c in zip(near, count)]})

    sent = classes.select("id", "vec").mapInPandas(send, "list int, m int, q int, role byte, id bigint, vec binary")
    found = sent.repartition("list", "m", "q").sortWithinPartitions("list", "m", "q").mapInPandas(
        search, "id bigint, d array<float>, near array<bigint>"
    )
    # a vector has a row for each probed list and block of it
    return (
        found.select("id", F.arrays_zip("d", F.col("near").alias("id")).alias("found"))
        .groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found"))
    )


def neighbours(vectors: DataFrame, dim: int = 64, k: int = 5, **lists) -> DataFrame:
    """(key, neighbour, similarity): the k most similar records of every record.

    ``vectors`` is the result of :func:`valid_vectors`, ``lists`` are options of :func:`nearest`.
    """
    records, classes = _classes(vectors, dim, k)
    found = nearest(classes, dim, k, **lists)
    firsts = classes.select(F.col("id").alias("near_id"), F.col("firsts").alias("near"))
    others = (
        found.select("id", F.explode("found").alias("f")).select("id", F.col("f.d").alias("d"), F.col("f.id").alias("near_id"))
        .join(firsts, "near_id")
        .groupBy("id").agg(F.flatten(F.collect_list(F.transform("near", lambda x: F.struct(F.col("d"), x.alias("key"))))).alias("near"))
    )
    # all that any record of a class can need: its own copies, then the others by distance
    lists = classes.select("id", "firsts").join(others, "id", "left").select(
        "id",
        F.concat(
            F.transform("firsts", lambda x: F.struct(F.lit(0.0).cast("float").alias("d"), x.alias("key"))),
            F.coalesce(F.slice(F.array_sort("near"), 1, k), F.array()),
        ).alias("near"),
    )
    top = F.slice(F.filter("near", lambda x: x["key"] != F.col("key")), 1, k)
    return records.join(lists, "id").select("key", F.explode(top).alias("n")).select(
        "key", F.col("n.key").alias("neighbour"), (1 - F.col("n.d") / 2).cast("double").alias("similarity")
    )


def pairs(found: DataFrame) -> DataFrame:
    """Distinct (key_a, key_b), key_a < key_b, of the rows of :func:`neighbours`."""
    return found.select(F.least("key", "neighbour").alias("key_a"), F.greatest("key", "neighbour").alias("key_b")).distinct()
