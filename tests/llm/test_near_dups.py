import random

import numpy as np

from codeweft.llm import near_dups as N


def test_within_radius_equals_brute_force():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2, (40, N.BITS), dtype=np.uint8)
    right = np.concatenate([base, base ^ (rng.random(base.shape) < 0.1), rng.integers(0, 2, (77, N.BITS), dtype=np.uint8)]).astype(np.uint8)
    left = base[:33]
    d = (left[:, None, :] != right[None, :, :]).sum(2)
    for most in (0, 13, 40, 61, 127):
        i, j = N.within_radius(left, right, most)
        assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(d <= most))))


def brute(records, threshold, least):
    sets = {}
    for i, kind, text in records:
        t = N._token.findall(text)
        s = {tuple(t[k : k + 3]) for k in range(len(t) - 2)}
        if len(s) >= least:
            sets[i] = (kind, s)
    return {
        (a, b) for a in sets for b in sets
        if a < b and sets[a][0] == sets[b][0] and len(sets[a][1] & sets[b][1]) >= threshold * len(sets[a][1] | sets[b][1])
    }


def pairs(members, links):
    cls = {}
    for r in members.collect():
        cls.setdefault(r.class_id, []).append(r.id)
    out = {(min(a, b), max(a, b)) for ids in cls.values() for a in ids for b in ids if a != b}
    for r in links.collect():
        out |= {(min(a, b), max(a, b)) for a in cls[r.class_a] for b in cls[r.class_b]}
    return out


def test_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "SLICE", 16)
    rng = random.Random(3)
    records = []
    for g in range(12):
        base = [f"t{rng.randrange(500)}" for _ in range(80)]
        for _ in range(12 if g else 90):
            t = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                k = rng.randrange(len(t))
                t[k : k + 1] = rng.choice([[], ["new"], [f"n{rng.randrange(99)}", "x"]])
            records.append((len(records), rng.choice(["function", "class"]), " ".join(t)))
    records += [(9000, "function", ""), (9001, None, "a b c"), (9002, "function", "... !")]
    df = spark.createDataFrame(records, "id long, kind string, text string")
    want, got = brute(records, 0.7, 30), pairs(*N.near_duplicates(df, 0.7, 30))
    assert got <= want and len(got) >= 0.999 * len(want) and len(want) > 200


def test_nodes_nulls_repeats_and_empty(spark):
    body = " ".join(f"v{i}" for i in range(60))
    rows = [(1, "function", None, body, "c"), (1, "function", None, body, "c"), (2, "function", "", body, "d"), (3, None, body, None, "e"), (None, "function", "", body, "x")]
    nodes = spark.createDataFrame(rows, "node_id long, kind string, signature string, body string, class_id string")
    records = N.node_records(nodes)
    assert records.count() == 3
    assert pairs(*N.near_duplicates(records, 0.7, 30)) == {(1, 2)}
    members, links = N.near_duplicates(records.where("false"), 0.7, 30)
    assert members.count() == 0 and links.count() == 0


def test_copy_pairs_of_a_large_class(spark):
    members = spark.createDataFrame([(i, "x") for i in range(60)] + [(100, "y"), (101, "y"), (102, "z")], "id long, class_id string")
    got = [tuple(r) for r in N.copy_pairs(members, rows=7).collect()]
    assert len(got) == len(set(got)) == 60 * 59 // 2 + 1 and all(a < b for a, b in got)


def test_classes_count_links_of_the_threshold_of_the_pairs(spark, tmp_path):
    from codeweft.llm import queries

    words = [f"w{i}" for i in range(40)]
    other = [w + "x" if i in (10, 25) else w for i, w in enumerate(words)]  # 32 of 44 runs in common
    rows = [(i, "function", None, " ".join(w)) for i, w in enumerate((words, words, other))]
    spark.createDataFrame(rows, "node_id long, kind string, signature string, body string").write.parquet(str(tmp_path / "nodes.parquet"))
    got = {r.node_id: r.links for r in queries.p6_classes(spark, str(tmp_path)).collect()}
    assert got == {0: 1, 1: 1, 2: 1}
    assert {tuple(r) for r in queries.p6_found(spark, str(tmp_path)).collect()} == {(0, 1), (0, 2), (1, 2)}
