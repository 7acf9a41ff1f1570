import random

from codeweft.llm import leaks as L


def edit(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return min(row)


def test_myers_equals_dynamic_programming():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.randint(1, 4) for _ in range(rng.randint(1, 12))]
        b = [rng.randint(1, 4) for _ in range(rng.randint(0, 20))]
        assert L.distance(a, b, 99) == edit(a, b)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünïcode", "日本"]
    sentence = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, sentence(rng.choice([5, 11, 12, 13, 40]))) for i in range(30)]
    docs = []
    for i in range(200):
        body = sentence(30)
        if i % 2:
            _, item = rng.choice(items)
            n = rng.choice([4, 11, 12, 20])
            s = rng.randrange(max(1, len(item) - n))
            part = list(item[s : s + n])
            if i % 3 == 0 and len(part) > 6:
                part[5] = "changed"
            body[10:10] = part
        docs.append((i, ("_ , ".join(body)).upper(), None))
    docs += [(1, docs[1][1], None), (900, None, None), (901, "", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    idf = spark.createDataFrame([(i, " ".join(t), None) for i, t in items] + [(77, None, None), (78, " ", None)], "item_id long, text string, answer string")
    got = L.leaks(df, idf).collect()
    assert len({(r.doc_id, r.item_id) for r in got}) == len(got)
    want, near = set(), set()
    for d, text, _ in docs:
        t = L.words(text or "")
        for i, item in items:
            w = min(12, len(item))
            for s in range(len(item) - w + 1):
                if any(t[p : p + w] == [x.lower() for x in item[s : s + w]] for p in range(len(t) - w + 1)):
                    want.add((d, i))
                if edit([x.lower() for x in item[s : s + w]], t) <= 1:
                    near.add((d, i))
    assert {(r.doc_id, r.item_id) for r in got if r.run >= r.needed} == want
    assert {(r.doc_id, r.item_id) for r in got} == near


def test_blocks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_CHARS", 30)
    items = spark.createDataFrame([(i, f"alpha beta gamma delta item number{i}") for i in range(9)], "item_id long, text string")
    docs = spark.createDataFrame([(5, "x alpha beta gamma delta item number4 y")], "doc_id long, text string")
    assert [tuple(r)[:2] for r in L.leaks(docs, items).where("edits = 0").collect()] == [(5, 4)]
    assert L.leaks(docs.where("false"), items).count() == 0 and L.leaks(docs, items.where("false")).count() == 0
