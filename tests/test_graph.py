import pytest

from codeweft.operators import extract, graph
from codeweft.operators.graph import Graph

C = """#include "berth.h"
#include <time.h>

enum tide { EBB, SLACK, FLOOD };

static int draught(const struct hull *h)
{
    return h->keel * 3;
}

struct hull {
    int keel;
};

typedef struct {
    long due;
    char mark[8];
} Buoy;

long moor(Buoy *b, struct hull *h)
{
    b->due += draught(h); /* not a call: sink(h) */
    log_line("moored } at", b->due);
    return b->due;
}

typedef long fathoms;
"""
H = "typedef struct { long due; } Buoy;\nlong moor(Buoy *b, struct hull *h);\n"
TS = """type Grain = 'rye' | 'oat';

const mill = (grain: Grain): number => {
  return weigh(grain) * 2;
};

import { weigh } from './scales';

export class Oven extends Hearth {
  bake(loaves: Tray): number {
    const note = `{${loaves.size}} not(a) call`;
    Timer.start(note);
    return mill('rye');
  }

  constructor(readonly heat: number) {
    super();
  }
}

interface Tray {
  size: number;
}

async function dispatch(tray: Tray): Promise<void> {
  await Courier.send(tray);
}
"""
RS = """pub struct Kite { line: u32 }

fn reel(by: u32) -> u32 { by + 1 }

impl Kite {
    pub fn launch(line: u32) -> Kite {
        Kite { line }
    }
}

mod winds {}

use std::time::Duration;

pub trait Flies {
    fn climb(&mut self);
}

impl Flies for Kite {
    fn climb(&mut self) {
        self.line = reel(self.line);
    }
}
"""
SOL = """pragma solidity ^0.8.4;

contract Orchard is Fenced, IHarvest {
    modifier inSeason() { _; }
    event Picked(uint256 crates);
    enum Ripeness { Green, Ready }
    function pick(uint256 crates) public inSeason {
        store(crates);
        emit Picked(crates);
    }
    struct Row { uint256 trees; }
    function store(uint256 crates) private {}
}

import "./Fenced.sol";

interface IHarvest {
    function pick(uint256 crates) external;
}
"""


def names(path, text):
    nodes, rels = extract.extract(path, text)
    return {(k, n) for n, k, *_ in nodes}, {(s, t, k) for s, _, t, _, k in rels}, {n: (a, b) for n, _, _, a, b, _ in nodes}


def test_c():
    nodes, rels, lines = names("a.c", C)
    assert {("import", "berth.h"), ("import", "time.h"), ("enum", "tide"), ("function", "draught"), ("struct", "hull"), ("type", "Buoy"), ("function", "moor"), ("type", "fathoms")} == nodes
    assert {("moor", "draught", "CALLS"), ("moor", "log_line", "CALLS"), ("a.c", "time.h", "IMPORTS")} <= rels and not {x for x in rels if x[1] == "sink"}
    assert lines["Buoy"] == (15, 18) and lines["moor"] == (20, 25)


def test_typescript():
    nodes, rels, lines = names("a.ts", TS)
    assert {("type", "Grain"), ("function", "mill"), ("import", "./scales"), ("class", "Oven"), ("function", "Oven.bake"), ("function", "Oven.constructor"), ("interface", "Tray"), ("function", "dispatch")} == nodes
    assert {("a.ts", "weigh", "IMPORTS"), ("Oven", "Hearth", "EXTENDS"), ("Oven.bake", "Timer.start", "CALLS"), ("Oven.bake", "mill", "CALLS"), ("dispatch", "Courier.send", "CALLS"), ("dispatch", "Tray", "USES")} <= rels
    assert not {x for x in rels if x[1] == "not"} and lines["Oven"] == (9, 19) and lines["dispatch"] == (25, 27)


def test_rust_and_solidity():
    nodes, rels, _ = names("a.rs", RS)
    assert {("struct", "Kite"), ("function", "reel"), ("impl", "impl Kite"), ("function", "Kite.launch"), ("module", "winds"), ("trait", "Flies"), ("impl", "impl Flies for Kite"), ("function", "Kite.climb")} <= nodes
    assert {("Kite", "Flies", "IMPLEMENTS"), ("Kite.climb", "reel", "CALLS"), ("Kite.launch", "Kite", "USES")} <= rels
    nodes, rels, _ = names("a.sol", SOL)
    assert {("contract", "Orchard"), ("modifier", "Orchard.inSeason"), ("event", "Orchard.Picked"), ("enum", "Orchard.Ripeness"), ("function", "Orchard.pick"), ("struct", "Orchard.Row"), ("function", "Orchard.store"), ("interface", "IHarvest")} <= nodes
    assert {("Orchard", "Fenced", "EXTENDS"), ("Orchard", "IHarvest", "EXTENDS"), ("Orchard.pick", "store", "CALLS")} <= rels


@pytest.fixture(scope="module")
def built(spark):
    from pyspark.sql import functions as F

    rows = [("p", "quay.c", C, "h"), ("p", "quay.h", H, "h"), ("p", "kite.rs", RS, "h"), ("p", "oven.ts", TS, "h"), ("p", "orchard.sol", SOL, "h"), ("q", "quay.c", C, "h"), ("p", "n.ts", None, None), ("p", "e.ts", "", "h")]
    rows.append(("p", "slip.rs", "fn haul(b: Buoy) -> u32 {\n    1\n}\n", "h"))
    files = spark.createDataFrame(rows, "project string, file_path string, content string, hash string")
    nodes = extract.symbols(files).withColumn("node_id", F.xxhash64("project", "kind", "name", "file_path", "start_line"))
    v = graph.without_prototypes(graph.vertices(nodes)).cache()
    return Graph(v, graph.edges(v, graph.links(extract.relationships(files))).cache())


def test_prototypes_go_and_edges_resolve_by_name(built):
    assert built.v.where("file_path = 'quay.h' and label = 'Function'").count() == 0
    got = {(r.project, r.a_name, r.b_name, r.type, r.b_file_path) for r in built.hop().collect()}
    assert ("p", "moor", "draught", "CALLS", "quay.c") in got and ("q", "moor", "draught", "CALLS", "quay.c") in got
    assert ("p", "dispatch", "Tray", "USES", "oven.ts") in got
    assert {x for x in got if x[1] == "haul"} == {("p", "haul", "Buoy", "USES", "quay.c"), ("p", "haul", "Buoy", "USES", "quay.h")}


def test_tools(built):
    callers = {(r.of, r.name) for r in built.callers().where("project = 'p'").collect()}
    assert ("draught", "moor") in callers and ("reel", "Kite.climb") in callers
    context = {(r.role, r.name) for r in built.context().where("project = 'p' and of = 'mill'").collect()}
    assert context == {("function", "mill"), ("caller", "Oven.bake"), ("used_type", "Grain")}
    impact = {(r.name, r.relationship) for r in built.impact().where("project = 'p' and file_path = 'quay.c'").collect()}
    assert impact == {("haul", "USES")}
    used = {(r.of, r.name) for r in built.used_types().where("project = 'p'").collect()}
    assert {("haul", "Buoy"), ("dispatch", "Tray")} <= used


def test_call_paths_cut_cycles(spark):
    v = spark.createDataFrame([("p", i, "Function", n, "f", "function", "", "", 1, 2) for i, n in enumerate("abcd")], "project string, node_id long, label string, name string, file_path string, kind string, signature string, body string, start_line int, end_line int")
    e = spark.createDataFrame([("p", 0, 1, "CALLS"), ("p", 1, 2, "CALLS"), ("p", 2, 0, "CALLS"), ("p", 2, 3, "CALLS"), ("p", 3, 3, "CALLS")], "project string, src_id long, dst_id long, type string")
    g = Graph(v, e)
    roots = spark.createDataFrame([("p", "a")], "project string, name string")
    assert {r.path for r in g.call_paths(99, roots).collect()} == {"a > b", "a > b > c", "a > b > c > d"}
    assert {r.path for r in g.call_paths(0, roots).collect()} == {"a > b"}
    assert g.undirected().count() == 9


def test_nulls_and_empty(spark, built):
    nodes = spark.createDataFrame([("p", 1, None, None, None, None, None, None, None), (None, None, "f", "n", "function", "", "", 1, 2)], "project string, node_id long, file_path string, name string, kind string, signature string, body string, start_line int, end_line int")
    got = graph.vertices(nodes).collect()
    assert len(got) == 1 and (got[0].label, got[0].kind, got[0].name, got[0].start_line) == ("Function", "function", "", 0)
    assert graph.edges(graph.vertices(nodes.where("false")), graph.links(spark.createDataFrame([], "project string, source_file_path string, source_name string, source_kind string, target_name string, target_kind string, relationship_kind string"))).count() == 0
