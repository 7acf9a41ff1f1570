import random

from codeweft.operators import hierarchy as H

SCHEMA = "project string, child string, parent string"


def rels(spark, rows):
    return spark.createDataFrame(rows, "project string, source_name string, target_name string, relationship_kind string, node string, extra int")


def closure(links):
    up = {}
    for p, c, a in links:
        up.setdefault((p, c), set()).add(a)
    out = set()
    for p, c in up:
        todo, seen = list(up[p, c]), set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += up.get((p, x), ())
        out |= {(p, x, c) for x in seen}
    return out


def test_links_are_cleaned(spark):
    rows = [
        ("a", " x ", "y\t", " extends", "n", 1), ("a", "x", "y", "EXTENDS", "n", 2), ("a", None, "y", "EXTENDS", "n", 1),
        ("a", "x", "  ", "IMPLEMENTS", "n", 1), ("a", "x", "z", "CALLS", "n", 1), (None, "x", "y", "Implements ", "n", None), ("a", "x", "y", None, None, None),
    ]
    got = {tuple(r) for r in H.parent_links(rels(spark, rows)).collect()}
    assert got == {("a", "x", "y"), ("", "x", "y")}


def test_reachable_equals_brute_force(spark):
    rng = random.Random(3)
    links = {("p", f"n{i}", f"n{i + 1}") for i in range(70)} | {("q", f"c{i}", f"c{(i + 1) % 5}") for i in range(5)} | {("q", "tail", "c0"), ("q", "self", "self")}
    links |= {("r", f"m{rng.randrange(25)}", f"m{rng.randrange(25)}") for _ in range(30)} | {("p", f"leaf{i}", "n69") for i in range(50)}
    got = [tuple(r) for r in H.reachable(spark.createDataFrame(sorted(links), SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == closure(links)


def test_paths_depths_and_cycles(spark):
    links = [("p", "b", "a"), ("p", "c", "b"), ("p", "c", "z"), ("p", "d", "c"), ("p", "k", "l"), ("p", "l", "k"), ("p", "m", "k"), ("p", "s", "s")]
    got = {r["name"]: r for r in H.hierarchy(spark.createDataFrame(links, SCHEMA)).collect()}
    assert (got["d"].path, got["d"].depth, got["d"].root) == ("a > b > c > d", 3, "a")
    assert (got["a"].depth, got["a"].descendants, got["z"].descendants) == (0, 3, 2)
    assert all(got[x].cyclic and got[x].path is None for x in "klms")
    assert got["k"].on_cycle and got["s"].on_cycle and not got["m"].on_cycle and not got["a"].on_cycle


def test_empty(spark):
    links = H.parent_links(rels(spark, []))
    assert H.reachable(links).count() == 0 and H.hierarchy(links).count() == 0
