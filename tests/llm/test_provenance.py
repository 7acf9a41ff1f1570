import random

import pytest

from codeweft.llm import provenance as P

WORDS = "cold ferry packet router settle queue ledger quota shard merge drain visit token wallet signer".split()


def written(rng, n=14):
    name = lambda: rng.choice(WORDS) + "".join(rng.choice(WORDS).title() for _ in range(2))
    lines = ["import { %s } from './x';" % name()]
    for _ in range(n):
        a, b, c = name(), name(), name()
        lines += rng.choice([
            [f"export function {a}({b}, {c}) {{", f"  const {name()} = {b}.{rng.choice(WORDS)}({c}, {rng.randrange(99)});", f"  return {b};", "}"],
            [f"if ({a} > {rng.randrange(99)}) {{", f"  {b}.push('{rng.choice(WORDS)}');", "}"],
            [f"class {a.title()} {{", f"  {b}({c}) {{ return {c}.{rng.choice(WORDS)}; }}", "}"],
            [f"for (const {a} of {b}.{c}()) {{ {name()}({a}); }}"], [f"// {rng.choice(WORDS)} before the {rng.choice(WORDS)}"],
        ])
    return "\n".join(lines)


@pytest.fixture(scope="module")
def files(spark):
    rng = random.Random(8)
    rows = [("p%d" % (i % 7), f"src/w{i}_a{i}.ts", written(rng)) for i in range(120)]
    small = "".join(f"if({a}==={b}){{{b}({i});}}var {a}={b}.{w}(function(e){{return e.{w}}});" for i, (a, b, w) in enumerate((rng.choice("xyzab"), rng.choice("klmn"), rng.choice(WORDS)) for _ in range(60)))
    bad = [
        ("p1", "www/a_1.js", small),
        ("p1", "src/g_1.ts", "\n".join(f"export interface M{i} {{\n  field{i}: number;\n  name{i}: string;\n}}" for i in range(20))),
        ("p1", "src/b_1.ts", "/* Code generated by pgen. DO NOT EDIT. */\n" + written(rng, 5)),
        ("p1", "src/d_1.c", "const unsigned char t[] = {\n" + "\n".join(" ".join("0x%02x," % rng.randrange(256) for _ in range(12)) for _ in range(30)) + "\n};\n"),
        ("p1", "vendor/libx/v_1.js", written(rng, 5)),
        ("p1", "src/util/c_1.js", "// Copied from libx 1.2.3 (MIT), upstream: https://libx.example/src\n" + written(rng, 5)),
    ]
    copy = written(rng, 12)
    bad += [("p1", "src/some_copy_1.js", copy), ("p2", "src/other/some_copy_2.js", copy + "\n// local change\n")]
    good = [
        ("p3", "src/codegen/m_1.ts", "// do not edit while the ledger lock is held\n" + written(rng, 6)), ("p3", "packages/deps_graph/m_2.ts", written(rng, 6)),
        ("p3", "src/m_3.ts", "// emits the '@generated' banner of the ledger\n" + written(rng, 6)), ("p3", "src/m_4.ts", written(rng, 8) + "\nconst table = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12];\n"),
        ("p3", "src/e.ts", ""), ("p3", "src/n.ts", None), ("p3", "src/x.c", "\x00\x01\x7fELF�" * 50), ("p3", "src/l.ts", "/*" + "a" * 300_000),
    ]
    df = spark.createDataFrame([(*r, "h", 1) for r in rows + bad + good + bad[:2]], "project string, file_path string, content string, hash string, kind int")
    return df, bad


def test_kinds(files):
    df, bad = files
    got = [(r.project, r.file_path) for r in P.provenance(df).where("kind is not null").collect()]
    assert sorted(got) == sorted((p, f) for p, f, _ in bad)


def test_every_file_once_and_empty_table(files):
    df, _ = files
    out = P.provenance(df)
    assert out.count() == df.where("content is not null").select("project", "file_path").distinct().count()
    assert P.provenance(df.where("false")).count() == 0


@pytest.mark.parametrize("banner, found", [("Code generated by pgen. DO NOT EDIT.", (True, False)), ("Copied from libx 1.2.3 (MIT)", (False, True))])
def test_banners_after_a_long_licence_and_at_the_end(banner, found):
    code = written(random.Random(3), 5)
    licence = "/*\n" + " * the terms of the licence\n" * 30 + " */\n"
    said = lambda text: P.announced("src/a_1.c", text, P.measure(text)["end"])
    for text in (
        f"{licence}// {banner}\n{code}", f"{licence[:-4]} * {banner}\n */\n{code}", f"{licence}#ifndef A_H\n#define A_H\n// {banner}\n{code}\n#endif\n",
        f"{code}\n// {banner}\n", f"{code}\n{licence}/* {banner} */", f"#ifndef A_H\n{code}\n// {banner}\n#endif // A_H\n",
    ):
        assert said(text) == found
    for text in (f"{licence}{code}\n// {banner}\n{code}\n", f"{licence}{code}\nconst note = `\n// {banner}\n`;\n", f"{code}\nsettle(); // {banner}\n", f"{licence}{code}\n// keeps the '@generated' mark of what was copied from libx\n"):
        assert said(text) == (False, False)


def kinds(df):
    return {(r.project, r.file_path): r.kind for r in P.provenance(df).collect()}


def test_cross_entropy_decides_what_is_minified(files, monkeypatch):
    df, _ = files
    assert kinds(df)["p1", "www/a_1.js"] == "minified"
    monkeypatch.setattr(P, "surprise", lambda counts, names, salt: (2.5, 25.0))
    assert "minified" not in kinds(df).values()


def test_scrambled_names_of_any_length_are_mangled(files, spark):
    df, _ = files
    rng = random.Random(4)
    scrambled = lambda: "_0x" + "".join(rng.choice("0123456789abcdef") for _ in range(6))
    text = "".join(f"var {scrambled()}={scrambled()}({scrambled()},{scrambled()});" for _ in range(60))
    # dense lines alone, or written names on dense lines, are no case
    dense = " ".join(written(rng, 20).replace("//", "").split("\n"))
    more = spark.createDataFrame([("p2", "www/s_1.ts", text, "h", 1), ("p2", "www/w_1.ts", dense, "h", 1)], df.schema)
    got = kinds(df.unionByName(more))
    assert got["p2", "www/s_1.ts"] == "minified" and got["p2", "www/w_1.ts"] is None


def test_foreign_style_lowers_the_share_that_makes_a_copy(files, spark):
    df, _ = files
    rng = random.Random(5)
    snake = lambda: "_".join(rng.choice(WORDS) for _ in range(3))
    lines = lambda: [f"const {snake()} = {snake()}({snake()}, {snake()});" for _ in range(10)]
    shared = lines()
    # four of ten statements are shared: a copy only where its names are foreign to the project
    rows = [(p, f"lib/borrowed_{i}.ts", "\n".join(shared[:4] + lines()[:6]), "h", 1) for i, p in enumerate(["p1", "own"])]
    rows += [("own", f"src/own_{i}.ts", "\n".join(lines()), "h", 1) for i in range(4)]
    got = kinds(df.unionByName(spark.createDataFrame(rows, df.schema)))
    assert got["p1", "lib/borrowed_0.ts"] == "vendored" and got["own", "lib/borrowed_1.ts"] is None


def test_null_project_and_repeated_rows(spark):
    text = written(random.Random(6), 5)
    df = spark.createDataFrame([(None, "vendor/x/a.ts", text)] * 2 + [("", None, text), ("p", "noext", text)], "project string, file_path string, content string")
    got = [(r.project, r.file_path, r.kind) for r in P.provenance(df).collect()]
    assert sorted(got, key=str) == sorted([(None, "vendor/x/a.ts", "vendored"), ("p", "noext", None)], key=str)
