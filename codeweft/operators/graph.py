"""The property graph of a project: vertices, edges and what is asked of them.

Edges are a join over all current nodes and relationships, resolved by name
within a project, so re-indexing a file never loses the edges of its callers.
A name may be defined many times; what is asked by name therefore works on
distinct (project, name) pairs before it meets the vertices again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions.text import strip
from codeweft.operators import incremental
from codeweft.storage import materialize

# The label of each kind of node.
LABELS = {
    "function": "Function", "class": "Class", "type": "Type", "interface": "Type", "import": "File", "struct": "Struct", "enum": "Enum",
    "trait": "Trait", "impl": "Impl", "module": "Module", "contract": "Contract", "event": "Event", "modifier": "Modifier",
}


def label_of(kind):
    """Label of a kind; unknown kinds are functions."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[kind], F.lit("Function"))


def vertices(nodes: DataFrame) -> DataFrame:
    """One row for each node_id, with its label; reads give '' or 0 for nulls."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return nodes.where("node_id is not null").dropDuplicates(["node_id"]).select(
        F.coalesce("project", F.lit("")).alias("project"), "node_id", label_of(F.col("kind")).alias("label"), text("name"), text("file_path"),
        F.coalesce("kind", F.lit("function")).alias("kind"), text("signature"), text("body"),
        F.coalesce("start_line", F.lit(0)).alias("start_line"), F.coalesce("end_line", F.lit(0)).alias("end_line"),
    )


def file_vertices(hashes: DataFrame) -> DataFrame:
    """(project, path, hash): the vertex of each file, from the hashes that the graph keeps of its files."""
    known = incremental.latest(hashes.where("file_path is not null"), ["project", "file_path"], "last_indexed")
    return known.select(F.coalesce("project", F.lit("")).alias("project"), F.col("file_path").alias("path"), "hash")


def links(relationships: DataFrame) -> DataFrame:
    """Distinct relationships with clean names and kinds in capitals."""
    name = lambda c: strip(F.col(c)).alias(c)
    return (
        relationships.select(
            F.coalesce("project", F.lit("")).alias("project"), "source_file_path", name("source_name"), name("source_kind"),
            name("target_name"), name("target_kind"), F.upper(strip(F.col("relationship_kind"))).alias("type"),
        )
        .where("source_name <> '' and target_name <> '' and type <> ''")
        .distinct()
    )


def edges(verts: DataFrame, rels: DataFrame) -> DataFrame:
    """(project, src_id, dst_id, type): every pair of vertices that a link names."""
    named = rels.select(
        "project", "source_name", "target_name", "type", label_of(F.col("source_kind")).alias("source_label"), label_of(F.col("target_kind")).alias("target_label")
    ).distinct()
    ends = verts.select("project", "label", "name", "node_id")
    a = ends.withColumnsRenamed({"label": "source_label", "name": "source_name", "node_id": "src_id"})
    b = ends.withColumnsRenamed({"label": "target_label", "name": "target_name", "node_id": "dst_id"})
    return named.join(a, ["project", "source_label", "source_name"]).join(b, ["project", "target_label", "target_name"]).select("project", "src_id", "dst_id", "type").distinct()


class Graph:
    """Vertices and edges, and the patterns that the tools match in them."""

    def __init__(self, verts: DataFrame, edgs: DataFrame):
        self.v, self.e = verts, edgs

    def nodes(self, prefix: str, label: str | None = None, columns=("name", "file_path", "kind")) -> DataFrame:
        """Vertices as columns prefix_id, prefix_name, ...; ``project`` keeps its name."""
        v = self.v if label is None else self.v.where(F.col("label") == label)
        return v.select("project", F.col("node_id").alias(f"{prefix}_id"), *[F.col(c).alias(f"{prefix}_{c}") for c in columns])

    def hop(self, a: str = "a", b: str = "b", types=None, a_label=None, b_label=None, columns=("name", "file_path", "kind")) -> DataFrame:
        """(a)-[type]->(b): one row for each edge, with both ends."""
        e = self.e if types is None else self.e.where(F.col("type").isin(*types))
        return (
            e.withColumnsRenamed({"src_id": f"{a}_id", "dst_id": f"{b}_id"})
            .join(self.nodes(a, a_label, columns), ["project", f"{a}_id"])
            .join(self.nodes(b, b_label, columns), ["project", f"{b}_id"])
        )

    def undirected(self) -> DataFrame:
        """Edges from either end; a loop counts once."""
        back = self.e.where("src_id <> dst_id").select("project", F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"), "type")
        return self.e.unionByName(back)

    def callers(self) -> DataFrame:
        """Distinct callers of each function name."""
        return self._ends("a", "b", "CALLS", "Function", "Function")

    def callees(self) -> DataFrame:
        """Distinct functions that each function name calls."""
        return self._ends("b", "a", "CALLS", "Function", "Function")

    def used_types(self) -> DataFrame:
        """Distinct types that each function name uses."""
        return self._ends("b", "a", "USES", "Function", "Type")

    def _ends(self, far, near, type_, a_label, b_label):
        rows = self.hop(types=[type_], a_label=a_label, b_label=b_label)
        return rows.select("project", F.col(f"{near}_name").alias("of"), F.col(f"{far}_name").alias("name"), F.col(f"{far}_file_path").alias("file_path"), F.col(f"{far}_kind").alias("kind")).distinct()

    def context(self) -> DataFrame:
        """Long form of a function's context: (project, of, role, name, file_path)."""
        part = lambda df, role: df.select("project", "of", F.lit(role).alias("role"), "name", "file_path")
        first = Window.partitionBy("project", "name").orderBy("file_path", "start_line", "kind", "node_id")
        own = self.v.withColumn("n", F.row_number().over(first)).where("n = 1").select("project", F.col("name").alias("of"), F.lit("function").alias("role"), "name", "file_path")
        return own.unionByName(part(self.callers(), "caller")).unionByName(part(self.callees(), "callee")).unionByName(part(self.used_types(), "used_type"))

    def impact(self) -> DataFrame:
        """Incoming edges of each file from other files: who is affected by a change in it."""
        rows = self.hop(columns=("name", "file_path", "kind")).where("a_file_path <> b_file_path")
        return rows.select("project", F.col("b_file_path").alias("file_path"), F.col("a_file_path").alias("affected_file"), F.col("a_name").alias("name"), F.col("a_kind").alias("kind"), F.col("type").alias("relationship"))

    def impact_by_file(self) -> DataFrame:
        """Affected files of each file with their affected names, in order."""
        return self.impact().groupBy("project", "file_path", "affected_file").agg(
            F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "name", "relationship"))), ", ").alias("affected"), F.count("*").alias("edges")
        )

    def call_paths(self, depth: int = 3, roots: DataFrame | None = None) -> DataFrame:
        """Every simple path of calls by name from each root: (project, depth, name, path).

        ``roots`` has project and name (all callers by default); depth is kept
        between 1 and 10.  Each level is one join with the distinct name pairs.
        """
        depth = min(max(depth, 1), 10)
        calls = self.hop(types=["CALLS"], a_label="Function", b_label="Function").select("project", "a_name", "b_name").where("a_name <> b_name").distinct()
        if depth > 1:  # every level reads them
            calls = materialize(calls)
        level = calls if roots is None else calls.join(roots.withColumnRenamed("name", "a_name"), ["project", "a_name"], "left_semi")
        level = level.select("project", F.array("a_name", "b_name").alias("path"))
        out = level
        step = calls.withColumnRenamed("a_name", "last")
        for _ in range(depth - 1):
            level = (
                level.withColumn("last", F.element_at("path", -1)).join(step, ["project", "last"])
                .where(~F.array_contains("path", F.col("b_name"))).select("project", F.concat("path", F.array("b_name")).alias("path"))
            )
            level = materialize(level)  # else each level would compute all before it again
            out = out.unionByName(level)
        return out.select("project", (F.size("path") - 1).alias("depth"), F.element_at("path", -1).alias("name"), F.array_join("path", " > ").alias("path"))


def without_prototypes(nodes: DataFrame) -> DataFrame:
    """Nodes without the one-line functions of a name that has a longer definition in its project."""
    longer = nodes.where("kind = 'function' and end_line > start_line").select("project", "name").distinct()
    one_line = (F.col("kind") == "function") & (F.col("start_line") == F.col("end_line"))
    marked = nodes.join(longer.withColumn("defined", F.lit(True)), ["project", "name"], "left")
    return marked.where(~(F.coalesce(one_line, F.lit(False)) & F.col("defined").isNotNull())).drop("defined").select(nodes.columns)
