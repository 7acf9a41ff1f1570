import math

from pyspark.sql import functions as F

from codeweft.functions import text as T
from codeweft.functions.vectors import cosine
from codeweft.operators import search


def one(spark, col, **values):
    names = list(values)
    schema = ", ".join(f"{n} {'array<float>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for n, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(col.alias("v")).first().v if names else None


def test_names_and_texts(spark):
    assert one(spark, T.project_name(F.col("a")), a="My  Project_X!") == "my-project-x"
    assert one(spark, T.symbol_text(F.col("a"), F.col("b"), F.col("c")), a="n", b="s", c="x" * 2000) == "n\ns\n" + "x" * 1000 + "..."
    assert one(spark, T.without_binary(F.col("a")), a="a\nBinary files x and y differ\nb") == "a\nb"
    assert one(spark, T.score_text(F.lit(0.12345)), a="") in ("0.1234", "0.1235")


def test_commit_text(spark):
    c = T.commit_text(F.col("m"), F.col("f"), F.col("d"), 500)
    assert one(spark, c, m="msg", f='["a.ts", "b.ts"]', d="diff") == "msg\n\nFiles changed:\na.ts\nb.ts\n\nDiff:\ndiff"
    assert one(spark, c, m="msg", f="not json", d="") == "msg\n\nFiles changed:\nnot json\n\nDiff:\n"
    assert len(one(spark, c, m="msg", f="[]", d="d" * 9000)) == 503
    assert one(spark, c, m="m" * 600, f="[]", d="d") == "m" * 500 + "..."
    assert one(spark, c, m="m" * 475, f="[]", d="d") == "m" * 475 + "\n\nFiles changed:\n"


def test_boundaries(spark):
    for line, want in [("export async function f() {", True), ("  pub fn f()", True), ("contract A {", True), ("static int f(void)", True), ("x = 1;", False), ("", False), (None, False)]:
        assert one(spark, T.is_boundary(F.col("a")), a=line) is want


def test_cosine_and_top_k(spark):
    assert abs(one(spark, cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]) - math.sqrt(0.5)) < 1e-9
    assert one(spark, cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 1.0]) is None
    rows = [(i, "p" if i % 2 else "", [1.0, float(i)]) for i in range(6)] + [(3, "p", [1.0, 3.0]), (90, "p", [0.0, 0.0]), (91, "p", None), (92, "p", [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, project string, embedding array<float>")
    assert [r.vec_id for r in search.top_k(df, [1.0, 0.0], 3, dim=2).collect()] == [0, 1, 2]
    assert [r.vec_id for r in search.top_k(df, [1.0, 0.0], 2, project="", dim=2).collect()] == [0, 2]
    got = search.top_k_each(df, df.where("vec_id in (0, 5, 90)"), k=2, dim=2).collect()
    assert {(r["query"], r["key"]) for r in got} == {(0, 0), (0, 1), (5, 5), (5, 4)}
    assert search.top_k_each(df, df.where("false"), k=2, dim=2).count() == 0


def test_top_k_counts_repeated_rows_once_and_orders_ties_by_key(spark):
    from codeweft.operators import search

    rows = [(5, "a", [1.0, 0.0]), (5, "a", [1.0, 0.0]), (3, "b", [2.0, 0.0]), (4, "c", [0.0, 1.0]), (6, "d", None), (7, "e", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, name string, embedding array<float>")
    assert [r.vec_id for r in search.top_k(df, [1.0, 0.0], k=2, dim=2).collect()] == [3, 5]
    assert search.top_k(df, [1.0, 0.0], k=9, dim=2).count() == 3 and search.top_k(df.where("false"), [1.0, 0.0], dim=2).count() == 0
    many = spark.range(5000).selectExpr("id as vec_id", "array(cast(1 as float), cast(id % 7 as float)) as embedding").coalesce(1)
    got = search.top_k_each(many, many.where("vec_id = 0"), k=3, dim=2).orderBy("rank").collect()
    assert [r.key for r in got] == [0, 7, 14]
