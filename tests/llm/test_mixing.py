import random

from pyspark.sql import functions as F

from codeweft.llm import mixing as M


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, tokens string, share int")


def mix(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_token_counts_equal_the_tokenizer(spark):
    texts = ["hello world", " ", "", None, "naïve 日本 x=1;\n\n", "hello world"]
    df = docs(spark, [(i, t, "a", None, 1) for i, t in enumerate(texts)] + [(0, texts[0], "a", None, 1), (9, "x", None, None, 1)])
    e = M.encoding(M.TOKENIZER)
    got = {r.doc_id: r.tokens for r in M.token_counts(df).collect()}
    assert got == {i: len(e.encode_ordinary(texts[i])) for i in (0, 4, 5)}
    assert all(e.decode(e.encode_ordinary(t)) == t for t in texts if t)


def test_pieces_cover_every_token_once(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_ROWS", 20)
    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), rng.randrange(1, 70)) for i in range(200)]
    pieces = M.pieces_of(spark.createDataFrame(rows, "doc_id long, source string, tokens long"), 32, 0).collect()
    size, seen = {}, {}
    for p in pieces:
        size[p.source, p.block] = size.get((p.source, p.block), 0) + p.end_token - p.first_token
        seen.setdefault(p.doc_id, []).append((p.first_token, p.end_token))
    for i, _, n in rows:
        spans = sorted(seen[i])
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    for s in "ab":
        last = max(b for x, b in size if x == s)
        assert all(size[s, b] == 32 for b in range(last)) and 0 < size[s, last] <= 32


def test_slots_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 37)
    sources = [("a", 0.5, 2, 32 * 40), ("b", 0.3, 3, 32 * 21), ("c", 0.2, 1, 32 * 50)]
    got = {r.slot: (r.source, r.repeat, r.block) for r in M.slots_of(spark, sources, None, 32).collect()}
    ranks, slot, blocks, caps = {}, 0, {"a": 40, "b": 21, "c": 50}, {"a": 2, "b": 3, "c": 1}
    while True:
        u = (slot * M.GOLDEN) % 1.0
        s = "a" if u < 0.5 else "b" if u < 0.8 else "c"
        r = ranks.get(s, 0)
        if r // blocks[s] >= caps[s]:
            break
        assert got[slot] == (s, r // blocks[s], r % blocks[s])
        ranks[s] = r + 1
        slot += 1
    assert len(got) == slot and slot > 140


def test_shares_caps_and_missing_sources(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(60))
    rows = [(i, text(), "big" if i % 3 else "mid", None, 1) for i in range(900)] + [(2000 + i, text(), "small", None, 1) for i in range(40)] + [(5000, text(), "other", None, 1)]
    targets = mix(spark, [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 4), ("none", 0.05, 3), (None, 0.3, 1), ("zero", 0.0, 1)])
    schedule, report = M.mixture(docs(spark, rows), targets, block=64)
    got = {r.source: r for r in report.collect()}
    assert set(got) == {"big", "mid", "small", "none"} and got["none"].tokens == 0
    for name, share, cap in (("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 4)):
        assert abs(got[name].actual_share - share / 0.95) < 0.02 and got[name].most_repeats <= cap
    assert schedule.agg(F.countDistinct("slot")).first()[0] > 100
    assert schedule.groupBy("doc_id").agg(F.countDistinct("repeat").alias("n")).agg(F.max("n")).first()[0] <= 4


def test_empty(spark):
    schedule, report = M.mixture(docs(spark, []), mix(spark, [("a", 1.0, 1)]))
    assert schedule.count() == 0 and [r.tokens for r in report.collect()] == [0]
    assert M.mixture(docs(spark, [(1, "x", "a", None, 1)]), mix(spark, []))[1].count() == 0
