import itertools

import pytest

from codeweft.llm import parsing as P

VALID = {
    "ts": [
        "", "// only\n/* comments */", "﻿import { a as b } from './x';\r\nexport const c: Map<string, number[]> = new Map<string, number[]>();\r\n",
        "export class A<T> extends B implements C {\n  private x?: string;\n  static y = 1;\n  async m({ a, b: c }: T, ...r: number[]): Promise<void> {\n    await this.x?.[0]!.f(a ?? 1);\n  }\n}",
        "type U = 'a' | 'b' | { [k: string]: () => void };\ninterface I { a: string; b?(x: number): void }\nenum E { A = 1, B }", "const f = async <T,>(x: T): Promise<T> => x\nconst g = (a) => ({ b: a })\n",
        "for (const x of y) { if (!x) continue; else break }\nswitch (a) { case 1: f(); break; default: g() }", "const t = `a ${b.map((c) => `${c}}`).join('')} {`;\nconst r = /[{(]\\s*x['\"]?/.test(t) ? 1 : a / b / c;",
        "do { x++ } while (x < 3)\nlabel: for (let i = 0, j = 1; i < j; i++) {}\ntry { a() } catch { b() } finally { c() }",
    ],
    "tsx": ["export function F({ a }: P) {\n  return (\n    <section title=\"}\" data-x={a}>\n      {a.map((k) => <B key={k.id} c={`${a}}`} />)}\n      <p>can't {a.b} of</p>\n    </section>\n  );\n}"],
    "js": ["!function(y){for(var m=0;m<y.length;m++)y[m]^=32}(x);var e=j.sort(function(p){return p.v&&!k[\"g\"]});(()=>{var e={1:(e,t,n)=>{a.b=c||(d.e={}),f=void 0;}}})()", "const { a, ...b } = c\nlet x = [1, , 2,], y = class { #p = 1; get q() { return this.#p } }"],
    "rs": [
        "use a::{b, c::*};\npub fn f<'a, T: Clone + 'a>(x: &'a mut T, y: [u32; 4]) -> Result<Vec<T>, E> where T: Send {\n  let c = '\"'; let s = r#\"{\"a{\"#; /* a /* nested } */ b */\n  while let Some(ref z) = x.pop() { g(z, 1)?; }\n  match x.y { A::B => 1, _ if y[0] > 2 => { 3 } _ => y.iter().filter(|e| e.z != 3).cloned().collect::<Vec<_>>().len(), }\n}",
        "#[derive(Debug)]\npub enum E { A, B(u8), C { x: i32 } }\nimpl<T> Tr for S<T> { fn f(&self) {} }\nextern \"C\" { pub fn g(a: *mut ::std::os::raw::c_void) -> i32; }\npub static T: [u32; 2] = [0x1, 0x2];",
    ],
    "sol": [
        "// SPDX-License-Identifier: MIT\npragma solidity ^0.8.4;\nimport './a.sol';\ncontract A is B, C(1) {\n  mapping(address => uint256) private m;\n  event E(address indexed a, uint256 b);\n  modifier only() { require(msg.sender == o, \"x {\"); _; }\n"
        "  function f(uint256 a, bytes memory b) public view returns (uint256) {\n    unchecked { a -= 1; }\n    assembly { let x := mload(add(b, 32)) mstore(1, x) }\n    try c.f(a) returns (uint256 z) { a = z; } catch { a = 1; }\n    m[msg.sender].x = block.timestamp + 30 days;\n    for (uint256 i = 0; i < 3; i++) { emit E(address(0), i); }\n    revert X(1);\n  }\n}",
    ],
    "c": [
        "#include \"a.h\"\n#ifdef X\n#define Y(a) \\\n  (a)\n#endif\ntypedef struct A { int x[3]; char *y; } A;\nenum E { P, Q = 2 };\nstatic const unsigned char t[] = { 0x1, 0x2, };\nint f(struct A * a, size_t n) {\n  size_t s = sizeof(struct A) * 2;\n  a->x[1] = a->x[0] & 0xff;\n"
        "  if (!a) goto out;\n#ifdef B\n  a->y++;\n#else\n  a->y--;\n#endif\n  do { g(a, &a->x); } while (a->x[0] < 3);\n  switch (*a->y) { case '\\'': h(\"%s {\"); break; default: return 1; }\nout:\n  return a ? 1 : 0;\n}",
    ],
}
INVALID = {
    "ts": ["function f() {", "f());", "const a = 'b;", "retrun x;", "a b c", "<<<<<<< HEAD\na;\n=======\nb;\n>>>>>>> x\n", "version https://a.b/c\noid 1", "def f(x):\n    return x", "class {{ a.b }} {}", "x = 1 +;", "/* open"],
    "tsx": ["const a = <p>x</q>;", "const a = <p>{b</p>;"],
    "js": ["const a: string = b;", "interface A { b: c }", "if (a { b }", "`a ${b"],
    "rs": ["fn f() { let a = 1 }}", "fn f( { }", "let x = 1;", "function f() {}", "fn f() { a b; }", "fn f() -> { 1 }", "/* a /* b */"],
    "sol": ["contract A { function f() public { x = 1 } }", "contract A {", "pragma ^1", "contract A { uint256 }"],
    "c": ["int f(void) { return 1 }", "int f(void) {", "class A {};", "int x = ;", "#includ <a.h>"],
}


@pytest.mark.parametrize("ext,text", [(e, t) for e, ts in VALID.items() for t in ts])
def test_valid(ext, text):
    assert P.check("a." + ext, text)[0] == 0


@pytest.mark.parametrize("ext,text", [(e, t) for e, ts in INVALID.items() for t in ts])
def test_invalid(ext, text):
    assert P.check("a." + ext, text)[0] > 0


def test_repair_is_of_least_cost():
    g = P.Grammar('program = item*\nitem = "a" "b" | "c" program "d"')
    words = {""}
    for n in range(1, 7):
        for w in itertools.product("abcd", repeat=n):
            if g.ids["program"] in g.recognise([frozenset(x) for x in w], [False] * n, [g.ids["program"]]):
                words.add("".join(w))
    assert {"ab", "cd", "cabd", "abab", "ccdd"} <= words and "ad" not in words

    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    for n in range(5):
        for w in itertools.product("abcd", repeat=n):
            want = min(edit(w, x) for x in words)
            got = g.repair([frozenset(x) for x in w], [False] * n, [g.ids["program"]], 4)[0]
            assert got == min(want, 5), w


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_whole_repair_against_brute_force():
    """Never below the least cost, and the least one (stray signs included) within a part, where no bracket is in doubt."""
    grammar = P.Grammar('program = stmt*\nstmt = "a" ";" | "a" @args ";" | @block\nblock_whole = stmt*\nargs_whole = "a"?')
    roles = {"(": {"args": "args_whole"}, "[": {}, "{": {"block": "block_whole"}}
    one = P.Language(grammar, roles, {"block": ("block_whole", ";")}, "a", r"(?P<space> )|(?P<line>\n)|(?P<comment>//)|(?P<sign>[;(){}\[\]])|(?P<name>a)")
    words = {"".join(w) for n in range(6) for w in itertools.product("a;(){}", repeat=n) if one.check("".join(w))[0] == 0}
    assert {"", "a;", "{a;}", "a();", "{{}}"} <= words and not {"a", "{a}", "}{", "a(a)"} & words
    for n in range(4):
        for w in itertools.product("a;(){}?", repeat=n):
            text = "".join(w)
            want, got = min(edit(text, x) for x in words), one.check(text)[0]
            assert got >= want and (got > 0) == (want > 0), text
            assert got == want or set(text) & set("(){}") or ";" in text[:-1], (text, want, got)


@pytest.mark.parametrize("ext, text", [("ts", "export class A {\n  f(b: number): void {\n    if (b) {\n      g(b);\n    }\n  }\n}\n"), ("rs", "fn f(a: u8) -> u8 {\n    if a > 1 {\n        return a;\n    }\n    a\n}\n"), ("c", "int f(int a) {\n    if (a) {\n        g(a);\n    }\n    return a;\n}\n")])
def test_one_edit_costs_little(ext, text):
    """Whichever bracket or semicolon is missing, doubled or replaced by a stray sign, the cost stays bounded."""
    assert P.check("a." + ext, text)[0] == 0
    for k in [k for k, c in enumerate(text) if c in "(){};"]:
        for broken in (text[:k] + text[k + 1 :], text[:k] + text[k] + text[k:], text[:k] + "\x07" + text[k + 1 :]):
            cost = P.check("a." + ext, broken)[0]
            assert 0 <= cost <= 20, (broken, cost)


def test_cost_of_a_file_cut_in_open_blocks():
    text = "class A {\n  f() {\n    if (a) {\n      for (;;) {\n        while (b) {\n          c();\n"
    assert P.check("a.ts", text)[:2] == (5, "truncated")


def test_each_failing_part_counts():
    for n in (1, 3, 9):
        assert P.check("a.ts", "x = 1;\n" + "b c;\nd = 2;\n" * n)[0] == n


def test_wrong_language_is_a_mismatch():
    assert P.check("a.rs", "def f(x):\n    return x\n\ndef g(y):\n    return y\n")[1] == "mismatch"
    assert P.check("a.ts", "<!DOCTYPE html>\n<html><head><title>404</title></head>\n<body>no such page here</body>\n")[1] == "mismatch"


def test_kinds():
    assert P.check("a.ts", "function f() {\n  a();\n")[1] == "truncated"
    assert P.check("a.ts", "<<<<<<< a\nx;\n=======\ny;\n>>>>>>> b\n")[1] == "conflict"
    assert P.check("a.ts", "// <<<<<<< HEAD is stripped\nx;")[0] == 0
    cost, kind, at = P.check("a.ts", "a = 1;\nb c;\nd = 2;")
    assert (cost, kind, at) == (1, "syntax", 7)


def test_place_in_a_long_piece():
    text = "a = " + " + ".join(["b"] * 80) + " c + " + " + ".join(["b"] * 80) + ";"
    assert P.check("a.ts", text) == (1, "syntax", text.index("c"))
    assert P.check("a.ts", text.replace(" c", "")[:-1] + " +")[0] >= 1


def test_table(spark):
    rows = [("p", "a.ts", "f(", 1), ("p", "a.ts", "f(", 1), ("p", "b.ts", "f();", 2), (None, "c.rs", "fn f(", 1), ("p", "d.ts", None, 1), ("p", "e.md", "f(", 1), ("p", None, "f(", 1), ("p", "f.js", "(" * 3000, 1), ("p", "g.c", "int x = 1;\n" * 5000, 1)]
    df = spark.createDataFrame(rows, "project string, file_path string, content string, cost int")
    got = {(r.project, r.file_path) for r in P.syntax(df).where("cost > 0").collect()}
    assert got == {("p", "a.ts"), (None, "c.rs"), ("p", "f.js")}
    rates = {(r.project, r.language): (r.files, r.invalid) for r in P.rates(df).collect()}
    assert rates[("p", "ts")] == (2, 1) and P.rates(df.where("false")).count() == 0


@pytest.mark.parametrize("n", [3, 30, 300])
def test_least_cost_whatever_the_length(n):
    """Two edits apart, a stray sign that stands for a token, and a single edit cost the same in short and in long parts."""
    sum_ = " + ".join(["b"] * n)
    text = f"a = {sum_} c + {sum_} c + {sum_};"
    assert P.check("a.ts", text)[0] == 2
    assert P.check("a.c", "int " + text)[0] == 2
    text = f"a = {sum_} \x07 c + {sum_};"
    assert P.check("a.ts", text) == (1, "syntax", text.index("\x07"))
    text = f"a = {sum_} c + {sum_};"
    assert P.check("a.ts", text) == (1, "syntax", text.index("c"))
    assert P.check("a.ts", f"a = b ? {sum_};")[0] == 1


def test_bounds_lose_no_repair():
    """Bounds are never above the cost that the chart finds without them."""
    from codeweft.llm.bounds import Bounds

    class Open(Bounds):
        def run(self, keys, *args):
            return [(-1,) * 4] * (len(keys) + 1)

    text = 'program = item*\nitem = "a" expr ";" | "b" ASI\nexpr = expr "+" expr | "?" expr ":" expr | "a"'
    g, free = P.Grammar(text), P.Grammar(text)
    start = g.ids["program"]
    free.bounds[(start,)] = Open(free, (start,))
    for n in range(4):
        for w in itertools.product("ab+?;", repeat=n):
            for breaks in ([False] * n, [k % 2 == 1 for k in range(n)]):
                for most, weights in ((1, None), (2, None), (1, [2 if x == "?" else 1 for x in w]), (1, [0 if x == "+" else 1 for x in w])):
                    args = [frozenset(x) for x in w], breaks, [start], most, weights
                    assert g.repair(*args) == free.repair(*args), (w, breaks, most, weights)
