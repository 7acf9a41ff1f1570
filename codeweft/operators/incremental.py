"""What changed since the last run, and writing it: hash diffs and upserts.

Tables are snapshots; an upsert is an anti-join of the old rows with the new
keys and a union.  A table of several rows for one key is first reduced to the
latest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the greatest ``order``, nulls last; ties by all other columns."""
    others = [F.col(c).desc_nulls_last() for c in df.columns if c not in (*keys, order)]
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), *others)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def file_states(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """(project, file_path, hash, state) of every current file: changed or unchanged.

    A file is unchanged if its content's hash equals the one last recorded.
    Files without content are left out; rows of files that are gone do nothing.
    """
    now = files.where("content is not null").select("project", "file_path", F.sha2("content", 256).alias("hash")).distinct()
    old = latest(hashes.select("project", "file_path", "hash", "last_indexed"), ["project", "file_path"], "last_indexed").select("project", "file_path", F.col("hash").alias("old"))
    return now.join(old, ["project", "file_path"], "left").select(
        "project", "file_path", "hash", F.when(F.col("hash").eqNullSafe(F.col("old")), F.lit("unchanged")).otherwise(F.lit("changed")).alias("state")
    )


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same keys."""
    same = [old[k].eqNullSafe(new[k]) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return old.join(new.select(*keys), condition, "left_anti").unionByName(new.select(*old.columns))


def upsert_commits(old: DataFrame, new: DataFrame) -> DataFrame:
    """Commits of both tables by (project, commit_hash); a known commit keeps its author and date."""
    keys = ["project", "commit_hash"]
    kept = {"author", "date"}
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full")
    in_new, in_old = F.col("n.commit_hash").isNotNull(), F.col("o.commit_hash").isNotNull()
    out = [F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys]
    for c in old.columns:
        if c in kept:
            out.append(F.when(in_old, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
        elif c not in keys:
            out.append(F.when(in_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return joined.select(*out)


def delete(df: DataFrame, **values) -> DataFrame:
    """``df`` without the rows that have all these values."""
    hit = F.lit(True)
    for column, value in values.items():
        hit = hit & F.col(column).eqNullSafe(F.lit(value))
    return df.where(~hit)


def new_rows(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not known yet."""
    return df.join(known.select(*keys).distinct(), keys, "left_anti")
