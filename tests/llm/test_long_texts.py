"""Every operator on texts of several hundred thousand characters."""

import time

import pytest

from codeweft.llm import encoding, leaks, mixing, near_dups, parsing, provenance, secrets

LONG = {
    "words": "ledger router stale " * 30_000,
    "no spaces": "a" * 600_000,
    "one line of code": "f(a, b); " * 60_000,
    "quotes": "\"'`" * 150_000,
    "brackets": "([{" * 100_000,
    "assignments": "password = \"x\"; token: '" * 20_000,
    "accents": "größer über " * 40_000,
    "numbers": "0x1f, " * 90_000,
    "lines": "x\n" * 250_000,
}


@pytest.mark.parametrize("name", LONG)
def test_files(spark, name):
    df = spark.createDataFrame([("p", "a.ts", LONG[name]), ("p", "b.rs", LONG[name]), ("p", "c.c", LONG[name]), ("p", "d.sol", LONG[name])], "project string, file_path string, content string")
    began = time.time()
    assert parsing.syntax(df).count() == 4
    assert provenance.provenance(df).count() == 4
    assert time.time() - began < 120


@pytest.mark.parametrize("name", LONG)
def test_texts(spark, name):
    text = LONG[name]
    began = time.time()
    docs = spark.createDataFrame([(1, text, "s"), (2, "short", "s")], "doc_id long, text string, source string")
    items = spark.createDataFrame([(1, text[:400])], "item_id long, text string")
    assert encoding.garbled(docs).count() == 0
    assert leaks.leaks(docs, items).count() <= 1
    assert mixing.token_counts(docs).count() == 2
    records = spark.createDataFrame([("nodes", "p", "1", text)], "source_table string, project string, record_key string, text string")
    assert secrets.credentials(records).count() == 0
    pairs = spark.createDataFrame([(1, "k", text), (2, "k", text)], "id long, kind string, text string")
    members, links = near_dups.near_duplicates(pairs, 0.8, 1)
    assert links.count() == 0 and members.select("class_id").distinct().count() <= 1
    assert time.time() - began < 120
