import numpy as np
from pyspark.sql import functions as F

from codeweft.llm import neighbours as N


def clustered(n, rng, spread=0.25):
    centres = rng.standard_normal((n // 20 + 1, 64))
    return (centres[rng.integers(len(centres), size=n)] + spread * rng.standard_normal((n, 64))) * rng.uniform(0.5, 9, (n, 1))


def exact(keys, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i, key in enumerate(keys):
        s = x @ x[i]
        s[i] = -9
        out[key] = {keys[j] for j in np.argsort(-s)[:k]}
    return out


def test_scan_equals_brute_force_without_abandoning():
    rng = np.random.default_rng(0)
    x = clustered(1500, rng).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d, i = N.scan(x, x, np.arange(len(x)), 5, epsilon=1e9)
    full = ((x[:, None, :64] - x[None]) ** 2).sum(2)
    np.fill_diagonal(full, np.inf)
    want = np.sort(full, axis=1)[:, :5]
    assert np.allclose(d, want, atol=1e-4) and (i >= 0).all()
    d, i = N.scan(x[:3], x[:2], np.array([0, 1, -1]), 5)
    assert (np.isfinite(d).sum(1) == [1, 1, 2]).all() and (i[0] == [1, -1, -1, -1, -1]).all()


def test_recall_copies_and_hot_lists(spark, monkeypatch):
    monkeypatch.setattr(N, "MEMBERS", 200)
    monkeypatch.setattr(N, "QUERIES", 300)
    rng = np.random.default_rng(3)
    x = clustered(3000, rng).astype(np.float32)
    keys = [str(i) for i in range(len(x))]
    rows = list(zip(keys, x.tolist()))
    rows += rows[:50]  # repeated rows
    rows += [(f"c{i}", x[0].tolist()) for i in range(40)]  # copies of one vector
    rows += [("bad1", [0.0] * 64), ("bad2", [1.0] * 63), ("bad3", None), ("bad4", [float("nan")] * 64), ("bad5", [float("inf")] + [0.0] * 63), (None, [1.0] * 64)]
    df = spark.createDataFrame(rows, "k string, v array<float>")
    vectors = N.valid_vectors(df, F.col("k"), F.col("v"), 64)
    got = {}
    for r in N.neighbours(vectors, list_rows=600).collect():
        got.setdefault(r.key, set()).add(r.neighbour)
    assert set(got) == set(keys) | {f"c{i}" for i in range(40)}
    assert all(len(v) == 5 and k not in v for k, v in got.items())
    copies = {f"c{i}" for i in range(40)} | {"0"}
    assert all(got[k] <= copies for k in copies)
    want = exact(keys, x, 5)
    hits = [len(got[k] & want[k]) for k in keys if not want[k] & copies and k not in copies]
    assert sum(hits) >= 0.95 * 5 * len(hits)


def test_few_and_none(spark):
    df = spark.createDataFrame([("a", [1.0] * 64), ("b", [1.0] * 32 + [2.0] * 32)], "k string, v array<float>")
    v = N.valid_vectors(df, F.col("k"), F.col("v"), 64)
    assert [tuple(r) for r in N.pairs(N.neighbours(v)).collect()] == [("a", "b")]
    assert N.neighbours(v.where("false")).count() == 0


def test_lists_follow_the_rows_beyond_the_coarse_centres(spark):
    """With the coarse centres capped at 16, twice the rows give twice the lists, not longer ones; recall stays."""
    rng = np.random.default_rng(5)
    sizes = []
    for n in (2000, 4000):
        x = clustered(n, rng).astype(np.float32)
        keys = [str(i) for i in range(n)]
        v = N.valid_vectors(spark.createDataFrame(list(zip(keys, x.tolist())), "k string, v array<float>"), F.col("k"), F.col("v"), 64)
        _, classes = N._classes(v, 64, 5)
        coarse = N.codebook(N._floats(classes.select("vec").toPandas()["vec"], 64), 16)
        book = N.Codebook(coarse, N.fine_centres(classes, coarse, n // 50, n, 64))
        near = book.probed(N._floats(classes.select("vec").toPandas()["vec"], 64), 4)
        assert near.shape[1] == 4 and (near >= 0).all() and all(len(set(r)) == 4 for r in near.tolist())
        sizes.append((len(book), np.bincount(near[:, 0], minlength=len(book)).max()))
        got = {}
        for r in N.neighbours(v, coarse=16, fine_rows=50).collect():
            got.setdefault(r.key, set()).add(r.neighbour)
        want = exact(keys, x, 5)
        assert sum(len(got[k] & want[k]) for k in keys) >= 0.93 * 5 * n
    assert 1.6 * sizes[0][0] <= sizes[1][0] <= 2.4 * sizes[0][0] and sizes[1][1] <= 2 * sizes[0][1]
