import random

import pytest

from codeweft.operators import chunks as C

LINE = "const variable{} = 'This is a line of code that takes up some space';"


@pytest.mark.parametrize(
    "text,tokens,count,first,last",
    [
        ("\n".join(LINE.format(i) for i in range(1000)), 1200, 18, [(1, 68), (59, 126), (117, 183)], (972, 1000)),
        ("\n".join(["const x = 1;"] * 100), 50, 18, [(1, 15), (6, 20), (11, 25)], (86, 100)),
        ("\n".join(["const x = 1;"] * 100), 5000, 1, [(1, 100)], (1, 100)),
        ("\n".join(["const x = 1;"] * 500), 200, 10, [(1, 61), (52, 112), (103, 163)], (460, 500)),
        ("\n".join(f"function func{i}() {{ return {i}; }}" for i in range(500)), 500, 11, [(1, 60), (51, 109), (100, 155)], (468, 500)),
        ("", 1200, 1, [(1, 1)], (1, 1)), ("   \n\n   \n", 1200, 1, [(1, 4)], (1, 4)),
        ("\n".join(["x" * 1000] * 14), 1200, 11, [(1, 4), (1, 5), (1, 6)], (4, 14)),
    ],
)
def test_goldens(text, tokens, count, first, last):
    got = [(a + 1, b) for a, b in C.spans(text, tokens)]
    assert len(got) == count and got[: len(first)] == first and got[-1] == last


def test_chunks_cover_every_line():
    rng = random.Random(1)
    for _ in range(100):
        text = "\n".join(rng.choice(["", "def", "class A {", "x" * rng.randrange(200)]) for _ in range(rng.randrange(1, 120)))
        for strict in (False, True):
            got = C.spans(text, 60, strict)
            n = len(text.split("\n"))
            assert got[0][0] == 0 and got[-1][1] == n and all(a[1] >= b[0] and a[1] <= b[1] for a, b in zip(got, got[1:]))


def test_table(spark):
    df = spark.createDataFrame([("p", "a.ts", "x\ny", "h", 1), ("p", "a.ts", "x\ny", "h", 1), ("p", "b.ts", None, None, 2), ("p", "c.ts", "", "e", 3)], "project string, file_path string, content string, hash string, chunk_index int")
    got = {r.file_path: (r.total_chunks, r.start_line, r.end_line, r.content) for r in C.chunk_files(df).collect()}
    assert got == {"a.ts": (1, 1, 2, "x\ny"), "c.ts": (1, 1, 1, "")}
