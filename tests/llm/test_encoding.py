import random

import pytest

from codeweft.llm import encoding as E

WORDS = "über größer prüfung schlüssel einträge café déjà modèle élément straße können fällt".split()


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, spans string, chain int")


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    clean = [(i, " ".join(rng.choice(WORDS) for _ in range(12)), rng.choice(["a", "b", None]), None, None) for i in range(400)]
    bad = []
    for i, (read, written) in enumerate([("cp1252", "utf-8"), ("cp437", "utf-8"), ("mac_roman", "latin-1")] * 3):
        good = " ".join(rng.choice(WORDS[:9]) for _ in range(10))
        bad.append((1000 + i, good, good.encode(written).decode(read)))
    twice = "für über prüfung größer"
    bad.append((1050, twice, twice.encode().decode("cp1252").encode().decode("cp1252")))
    rows = clean + [(i, t, "a", None, None) for i, _, t in bad] + [(1000, bad[0][2], "a", None, None)]
    rows += [(2000, None, "a", None, None), (2001, "", None, None, None), (2002, "plain ascii", "b", None, None), (2003, "a\xa0b \xa0c", "b", None, None), (2004, "gr��er als f�r", "b", None, None)]
    return documents(spark, rows), bad


def test_finds_and_restores(corpus):
    df, bad = corpus
    got = {r.doc_id: r for r in E.repaired(df).collect()}
    assert set(got) == {i for i, _, _ in bad} | {2004}
    assert got[2004].repaired is None and got[2004].chain == "lost bytes"
    restored = sum(got[i].repaired == good for i, good, _ in bad)
    assert restored >= 0.9 * len(bad)


def test_one_row_for_repeated_keys_and_empty_table(spark, corpus):
    df, bad = corpus
    assert E.garbled(df).where("doc_id = 1000").count() == 1
    assert E.garbled(documents(spark, [])).count() == 0


def test_undo_inverts_every_single_byte_chain():
    text = "größer"
    for k, chain in enumerate(E.CHAINS):
        if len(chain) == 1:
            read, written = chain[0]
            try:
                seen = text.encode(written).decode(read)
            except UnicodeError:
                continue
            assert E.undo(seen, k) == text


def test_every_stretch_is_restored(spark, corpus):
    df, _ = corpus
    garble = lambda t, read: t.encode().decode(read)
    clean = " ".join(WORDS[i % 9] for i in range(40))
    first, second = "über größer prüfung schlüssel", "einträge café déjà modèle"
    rows = [
        (3000, f"{garble(first, 'cp1252')} {clean} {garble(second, 'cp1252')}", "a", None, None),
        (3001, f"{garble(first, 'cp1252')} {clean} {garble(second, 'cp437')}", "a", None, None),
        (3002, f"gr\ufffd\ufffder {clean} {garble(second, 'cp1252')} f\ufffdr", "a", None, None),
    ]
    got = {r.doc_id: r for r in E.repaired(df.unionByName(documents(spark, rows))).where("doc_id >= 3000").collect()}
    assert got[3000].repaired == got[3001].repaired == f"{first} {clean} {second}"
    assert got[3000].chain == "utf-8 read as cp1252" and got[3001].chain == "utf-8 read as cp1252; utf-8 read as cp437"
    assert got[3002].repaired == f"gr\ufffd\ufffder {clean} {second} f\ufffdr" and "lost bytes" in got[3002].chain


def test_runs_are_maximal_and_disjoint():
    assert E._runs({0: 6.0, 1: 6.0, 30: 7.0, 31: 1.5}) == [(12.0, 0, 2), (8.5, 30, 32)]
    assert E._runs({0: 6.0, 2: 6.0}) == [(10.0, 0, 3)]
    rng = random.Random(4)
    for _ in range(300):
        hits = {i: rng.uniform(1, 9) for i in rng.sample(range(60), 12)}
        runs = E._runs(hits)
        assert abs(max(runs)[0] - E._best_run([hits.get(i, -2.0) for i in range(60)])[0]) < 1e-9
        assert all(a[2] <= b[1] for a, b in zip(runs, runs[1:])) and set(hits) == {i for _, a, b in runs for i in range(a, b)} & set(hits)
