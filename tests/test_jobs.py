import os
import subprocess

import pytest
from pyspark.sql import functions as F

from codeweft import embed, jobs
from codeweft.catalog import Catalog
from codeweft.operators import incremental
from codeweft.sources import files as file_source
from codeweft.sources import git as git_source
from codeweft.streaming.ingest import commits_per_window, index_stream

FILES = "project string, file_path string, content string, hash string"


@pytest.fixture
def catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "root"))
    c.setup()
    return c


def test_scan_keeps_sources_only(spark, tmp_path):
    for name in ["main.ts", "lib.tsx", "code.rs", "contract.sol", "src/nested.ts", "types.d.ts", "readme.md", "data.json", "node_modules/x.ts", "src/dist/y.ts", "a/.git/z.ts", "target/q.rs", "build/b.c", "out/o.c"]:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"const a = 1;\n" if name != "code.rs" else b"fn f() {} // \xff")
    got = {r.file_path: r for r in file_source.scan(spark, str(tmp_path), "My Proj").collect()}
    assert set(got) == {"main.ts", "lib.tsx", "code.rs", "contract.sol", "src/nested.ts"}
    assert got["main.ts"].project == "my-proj" and got["code.rs"].content == "fn f() {} // �" and len(got["main.ts"].hash) == 64


def test_index_is_incremental_and_idempotent(spark, catalog):
    files = spark.createDataFrame([("p", "a.ts", "function a() {}", None), ("p", "b.ts", "x\n" * 9000, None), ("q", "a.ts", "y", None), ("p", "n.ts", None, None)], FILES)
    provider = embed.HashingEmbedder(8)
    assert jobs.index_files(catalog, files, provider) == 3
    before = catalog.read("embeddings").count()
    assert jobs.index_files(catalog, files, provider) == 0 and catalog.read("embeddings").count() == before
    changed = spark.createDataFrame([("p", "b.ts", "short", None)], FILES)
    assert jobs.index_files(catalog, changed, provider) == 1
    assert catalog.read("chunks", "p").where("file_path = 'b.ts'").count() == 1
    assert catalog.read("embeddings", "q").count() == 1
    assert {tuple(r) for r in catalog.projects().collect()} == {("p", 2, False), ("q", 1, False)}
    with pytest.raises(ValueError):
        jobs.delete_project(catalog, "p")
    assert jobs.delete_project(catalog, "p", force=True)["embeddings"] == 2
    assert catalog.read("embeddings").count() == 1
    jobs.prune(catalog, force=True)
    assert catalog.read("embeddings").count() == 0


def test_graph_survives_reindexing_a_callee(spark, catalog):
    files = spark.createDataFrame([("p", "a.c", "int a(void) {\n  return b();\n}\n", None), ("p", "b.c", "int b(void) {\n  return 1;\n}\n", None)], FILES)
    g = jobs.build_graph(catalog, files)
    assert [(r.of, r.name) for r in g.callers().collect()] == [("b", "a")]
    again = spark.createDataFrame([("p", "b.c", "int b(void) {\n  return 2;\n}\n", None)], FILES)
    g = jobs.build_graph(catalog, again)
    assert [(r.of, r.name) for r in g.callers().collect()] == [("b", "a")]
    assert g.v.where("name = 'b'").first().body.find("2") > 0


@pytest.mark.parametrize("first", ["index", "graph"])
def test_index_and_graph_do_not_hide_changes_from_each_other(spark, catalog, first):
    provider = embed.HashingEmbedder(8)
    for text in ("int a(void) {\n  return b();\n}\n", "int a(void) {\n  return 2 + b();\n}\n"):
        files = spark.createDataFrame([("p", "a.c", text, None), ("p", "b.c", "int b(void) {\n  return 1;\n}\n", None)], FILES)
        if first == "index":
            assert jobs.index_files(catalog, files, provider) > 0
        g = jobs.build_graph(catalog, files)
        assert [(r.of, r.name) for r in g.callers().collect()] == [("b", "a")]
        assert g.v.where("name = 'a'").first().body.strip() == text.strip()
        if first == "graph":
            assert jobs.index_files(catalog, files, provider) > 0
        assert {r.content.strip() for r in catalog.read("chunks").where("file_path = 'a.c'").collect()} == {text.strip()}
        assert jobs.index_files(catalog, files, provider) == 0
    assert jobs.delete_project(catalog, "p", force=True)["graph_hashes"] == 2
    assert jobs.build_graph(catalog, files).v.count() == 2


def test_upserts(spark):
    schema = "project string, commit_hash string, author string, message string"
    old = spark.createDataFrame([("p", "1", "ann", "old"), ("p", "2", None, "two")], schema)
    new = spark.createDataFrame([("p", "1", "bob", "new"), (None, "3", "cat", "three"), ("p", "2", "dan", None)], schema)
    got = {r.commit_hash: (r.author, r.message) for r in incremental.upsert_commits(old, new).collect()}
    assert got == {"1": ("ann", "new"), "2": (None, None), "3": ("cat", "three")}
    rows = incremental.upsert(old, new, ["project", "commit_hash"]).collect()
    assert len(rows) == 3 and {r.message for r in rows} == {"new", None, "three"}
    assert incremental.delete(old, author=None).count() == 1


def test_states(spark):
    files = spark.createDataFrame([("p", "a", "x", 0), ("p", "a", "x", 0), ("p", "b", "y", 0), ("p", "c", None, 0)], "project string, file_path string, content string, state int")
    x = "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"
    hashes = spark.createDataFrame([("p", "a", x, "2024-01-02"), ("p", "a", "old", "2024-01-01"), ("p", "b", x, None), ("p", "gone", x, None)], "project string, file_path string, hash string, t string").select("*", F.to_timestamp("t").alias("last_indexed"))
    assert {(r.file_path, r.state) for r in incremental.file_states(files, hashes).collect()} == {("a", "unchanged"), ("b", "changed")}


def test_git(spark, catalog, tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    env = os.environ | {"GIT_AUTHOR_NAME": "Ann", "GIT_AUTHOR_EMAIL": "a@x.test", "GIT_COMMITTER_NAME": "Ann", "GIT_COMMITTER_EMAIL": "a@x.test"}
    run = lambda *a: subprocess.run(["git", "-C", str(repo), *a], check=True, capture_output=True, env=env)
    run("init", "-q")
    for i in range(3):
        (repo / f"f{i}.ts").write_text("x")
        run("add", ".")
        run("commit", "-qm", f"subject {i}\n\nbody {i}")
    commits = git_source.read_repository(spark, str(repo), "p").orderBy("seq").collect()
    assert [c.message for c in commits] == ["subject 2\n\nbody 2", "subject 1\n\nbody 1", "subject 0\n\nbody 0"]
    assert commits[0].files_changed == '["f2.ts"]' and commits[0].author == "Ann" and "f2.ts" in commits[0].diff_summary
    df = git_source.read_repository(spark, str(repo), "p")
    assert jobs.index_commits(catalog, df, embed.HashingEmbedder(8), most=2) == 2
    assert jobs.index_commits(catalog, df, embed.HashingEmbedder(8)) == 1
    assert jobs.index_commits(catalog, df, embed.HashingEmbedder(8)) == 0


def test_log_dump(spark, tmp_path):
    f, c = git_source.FIELD, git_source.COMMIT
    (tmp_path / "log").write_text(f"h1{f}Ann{f}2024-01-01T10:00:00+02:00{f}subject{f}body\n{c}\nh2{f}Bob{f}2024-01-02T00:00:00Z{f}only{f}{c}\nbad{f}x{c}")
    got = git_source.read_log(spark, str(tmp_path / "log"), "p").orderBy("commit_hash").collect()
    assert [(r.commit_hash, r.message) for r in got] == [("h1", "subject\n\nbody"), ("h2", "only")]
    assert got[0].date.hour == 8


def test_stream(spark, catalog, tmp_path):
    drop = str(tmp_path / "drop")
    spark.createDataFrame([("p", "a.ts", "function a() {}", None)], FILES).write.parquet(drop)
    for _ in range(2):
        index_stream(catalog, drop, embed.HashingEmbedder(8), str(tmp_path / "cp")).awaitTermination()
    assert catalog.read("embeddings").count() == 1
    spark.createDataFrame([("p", "a.ts", "function b() {}", None), ("p", "c.ts", "x", None)], FILES).write.mode("append").parquet(drop)
    index_stream(catalog, drop, embed.HashingEmbedder(8), str(tmp_path / "cp")).awaitTermination()
    assert catalog.read("embeddings").count() == 2
    batch = spark.createDataFrame([("p", "2024-01-04 00:00:00"), ("p", "2024-01-05 00:00:00"), ("p", None)], "project string, d string").select("project", F.to_timestamp("d").alias("date"))
    assert sum(r.commits for r in commits_per_window(batch).collect()) == 2


def test_guards_name_what_there_is_and_states_of_graphs(spark, catalog):
    with pytest.raises(ValueError, match="there are: none"):
        jobs.project_graph(catalog, "p")
    files = spark.createDataFrame([("p", "a.c", "int a(void) {\n  return 1;\n}\n", None), ("q", "b.c", "/* nothing */\n", None)], FILES)
    jobs.build_graph(catalog, files)
    jobs.index_files(catalog, spark.createDataFrame([("r", "c.c", "int c;", None)], FILES), embed.HashingEmbedder(8))
    assert {tuple(r) for r in catalog.graph_states().collect()} == {("p", "graph"), ("q", "empty graph"), ("r", "no graph")}
    assert {(r.project, r.path) for r in catalog.file_vertices().collect()} == {("p", "a.c"), ("q", "b.c")}
    assert all(len(r.hash) == 64 for r in catalog.file_vertices().collect())
    for call in (lambda: jobs.project_graph(catalog, "x"), lambda: jobs.delete_project(catalog, "x", force=True)):
        with pytest.raises(ValueError, match="no project 'x'; there are: p, q, r"):
            call()
