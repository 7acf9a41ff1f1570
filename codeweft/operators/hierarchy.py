"""Parent-child links to full hierarchies by pointer doubling.

Every round joins the table of known ancestor pointers with the pointers that
jump exactly 2^k links and so doubles the reach; a hierarchy of depth d is
complete after ceil(log2 d) rounds.  Each round is one equi-join and one
aggregation; its table is written to the shared folder, so plans stay short.

A parent may have a third of all rows below it.  The join is therefore made on
(group, node, salt): the long side takes a salt from a hash of its own node,
the short side (one row per node and jump target) is replicated once per salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.storage import drop_table, materialize

SALTS = 8


def strip(col):
    """``col`` without surrounding (Unicode) white space."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def parent_links(relationships: DataFrame, kinds=("EXTENDS", "IMPLEMENTS")) -> DataFrame:
    """Distinct (project, child, parent) of relationship rows of ``kinds``.

    The kind is compared in upper case without surrounding white space; rows
    with a null or blank name are no links; a null project is a group of its
    own, written as the empty string.
    """
    return (
        relationships.where(F.upper(strip(F.col("relationship_kind"))).isin(*kinds))
        .select(
            F.coalesce(F.col("project"), F.lit("")).alias("project"),
            strip(F.col("source_name")).alias("child"),
            strip(F.col("target_name")).alias("parent"),
        )
        .where((F.col("child") != "") & (F.col("parent") != ""))
        .distinct()
    )


def _salted(left: DataFrame, right: DataFrame, salts: int) -> DataFrame:
    """Join left.ptr to right.node, both with ``project``; see the module text."""
    right = right.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    left = left.withColumn("salt", F.pmod(F.hash("node"), F.lit(salts)))
    return left.join(
        right.withColumnsRenamed({"project": "r_project", "node": "r_node", "salt": "r_salt"}),
        (F.col("project") == F.col("r_project")) & (F.col("ptr") == F.col("r_node")) & (F.col("salt") == F.col("r_salt")),
    )


def reachable(links: DataFrame, salts: int = SALTS) -> DataFrame:
    """(project, ancestor, descendant): every pair joined by one or more links.

    A name on a cycle reaches itself and is its own ancestor.  An empty table
    gives an empty result; repeated links count once; several parents per
    child are allowed.
    """
    known = materialize(
        links.select("project", F.col("child").alias("node"), F.col("parent").alias("ptr"), F.lit(True).alias("jump"))
    )
    pairs = known.count()
    while pairs:
        jumps = known.where("jump").select("project", "node", F.col("ptr").alias("far"))
        further = _salted(known, jumps, salts).select("project", "node", F.col("far").alias("ptr"), "jump")
        # "jump" marks targets exactly 2^(k+1) links away: a jump made from a jump.
        grown = materialize(
            known.withColumn("jump", F.lit(False))
            .unionByName(further)
            .groupBy("project", "node", "ptr")
            .agg(F.max("jump").alias("jump"))
        )
        drop_table(known)
        known = grown
        counts = known.agg(F.count("*").alias("n"), F.count_if("jump").alias("j")).first()
        # No jump left: every chain has ended. No new pair: all that is left are cycles.
        if not counts.j or counts.n == pairs:
            break
        pairs = counts.n
    return known.select("project", F.col("ptr").alias("ancestor"), F.col("node").alias("descendant"))


def paths_to_root(links: DataFrame, salts: int = SALTS) -> DataFrame:
    """(project, name, path, depth, root, cyclic) along the first parent.

    Of several parents the least name is the one a path follows.  ``path``
    leads from the root to the name, joined by ``" > "``; depth counts links.
    A name whose chain runs into a cycle has no root: path, depth and root
    are null and ``cyclic`` is true.  Path segments are concatenated as the
    pointers double; a segment that repeats a name has closed a cycle and is
    not followed further.
    """
    first = links.groupBy("project", F.col("child").alias("node")).agg(F.min("parent").alias("ptr"))
    parents = links.select("project", F.col("parent").alias("node")).distinct()
    roots = parents.join(first, ["project", "node"], "left_anti")
    state = materialize(
        first.join(roots.select("project", F.col("node").alias("ptr"), F.lit(True).alias("at_root")), ["project", "ptr"], "left")
        .select(
            "project", "node", "ptr", F.array("node").alias("path"),
            F.coalesce("at_root", F.lit(False)).alias("done"), (F.col("node") == F.col("ptr")).alias("cyclic"),
        )
    )
    todo = state.where("not done and not cyclic").count()
    while todo:
        far = state.select(
            "project", "node", F.col("ptr").alias("far"), F.col("path").alias("far_path"),
            F.col("done").alias("far_done"), F.col("cyclic").alias("far_cyclic"),
        )
        moved = _salted(state.where("not done and not cyclic"), far, salts).withColumn("longer", F.concat("path", "far_path"))
        moved = moved.withColumn(
            "loops", F.col("far_cyclic") | (F.size(F.array_distinct("longer")) < F.size("longer"))
        ).select(
            "project", "node", F.col("far").alias("ptr"), F.when(F.col("loops"), F.col("path")).otherwise(F.col("longer")).alias("path"),
            (F.col("far_done") & ~F.col("loops")).alias("done"), F.col("loops").alias("cyclic"),
        )
        grown = materialize(state.where("done or cyclic").unionByName(moved))
        drop_table(state)
        state = grown
        todo = state.where("not done and not cyclic").count()
    chain = F.concat(F.reverse("path"))
    resolved = state.select(
        "project", F.col("node").alias("name"),
        F.when(~F.col("cyclic"), F.concat_ws(" > ", F.concat(F.array("ptr"), chain))).alias("path"),
        F.when(~F.col("cyclic"), F.size("path")).alias("depth"),
        F.when(~F.col("cyclic"), F.col("ptr")).alias("root"),
        "cyclic",
    )
    return resolved.unionByName(
        roots.select(
            "project", F.col("node").alias("name"), F.col("node").alias("path"), F.lit(0).alias("depth"),
            F.col("node").alias("root"), F.lit(False).alias("cyclic"),
        )
    )


def hierarchy(links: DataFrame, salts: int = SALTS) -> DataFrame:
    """:func:`paths_to_root` with the number of descendants and ``on_cycle``.

    All descendants are the rows of :func:`reachable`; they are not gathered
    into arrays, since a root may have a third of all rows below it.
    """
    pairs = materialize(reachable(links, salts))
    below = pairs.groupBy("project", F.col("ancestor").alias("name")).agg(
        F.count("*").alias("descendants"), F.max(F.col("ancestor") == F.col("descendant")).alias("on_cycle")
    )
    return (
        paths_to_root(links, salts)
        .join(below, ["project", "name"], "left")
        .withColumns({"descendants": F.coalesce("descendants", F.lit(0).cast("bigint")), "on_cycle": F.coalesce("on_cycle", F.lit(False))})
    )
